"""The registered queries of stores, feeds, streams, ledger, backtest and battery as DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

from wattline.operators.storage import BatterySpec

from .oracles import _CAP, _DAILY, _EV, _FEATURES, _GEN, _HM, _LOAD, _MARGIN, _NAIVE, _PANEL, _PRED, _PRICE, _STRATEGY_DAYS, _UTC, _hourly, _local, _lp, _scores


def _r(*columns: str) -> str:
    """Rounded columns; adding zero turns a negative zero into a plain one, as the other engine's rounding does."""
    return ", ".join(f"round({c}, 6) + 0::DOUBLE AS {c}" for c in columns)


_REVISED = "rev AS (SELECT ts_utc, res, price + 100 AS price FROM price WHERE hour(ts_utc) % 3 = 0), far AS (SELECT ts_utc + INTERVAL 40 DAY AS ts_utc, res, price FROM rev)"
_LATEST = f"""{_REVISED}, merged AS (SELECT ts_utc, res, CASE WHEN hour(ts_utc) % 3 = 0 THEN price + 100 ELSE price END AS price FROM price UNION ALL SELECT * FROM far)"""
#: Sums of each event type by hour; null without any.
_HOURS = """hs AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS mean_, sum(value) FILTER (event_type = 'view') AS solar, sum(value) FILTER (event_type = 'click') AS onshore,
  sum(value) FILTER (event_type = 'purchase') AS offshore, sum(value) FILTER (event_type = 'signup') AS gas, sum(value) FILTER (event_type = 'error') AS load_ FROM events GROUP BY 1)"""
_FUND = f"""{_HOURS}, fd AS (SELECT h AS ts_utc, gas AS load, onshore + offshore AS wind, solar FROM hs)"""


def _sums(row: str) -> str:
    """Running sums over the earlier rows of an hour, of two features and the target."""
    names = {"n": "1", "sx": "x", "sz": "z", "sy": "y", "sxx": "x * x", "szz": "z * z", "sxz": "x * z", "sxy": "x * y", "szy": "z * y"}
    return ", ".join(f"sum({expr}) OVER w AS {name}" for name, expr in names.items())


#: Two standardised features: the 2 x 2 system in closed form.
_RIDGE2 = f"""{_FEATURES}, rows_ AS (SELECT local_date, local_hour, price AS y, price_d1 - 100 AS x, price_d7 - 100 AS z FROM f WHERE price_d1 IS NOT NULL AND price_d7 IS NOT NULL),
m AS (SELECT *, {_sums("")} FROM rows_ WINDOW w AS (PARTITION BY local_hour ORDER BY local_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, sxx / n - (sx / n) ** 2 AS vx, szz / n - (sz / n) ** 2 AS vz, sxz / n - sx / n * sz / n AS vxz, sxy / n - sx / n * sy / n AS cx, szy / n - sz / n * sy / n AS cz FROM m WHERE n >= 30),
s AS (SELECT *, vxz / sqrt(vx * vz) AS rho, cx / sqrt(vx) AS px, cz / sqrt(vz) AS pz FROM c),
b AS (SELECT *, (1.1 * px - rho * pz) / (1.21 - rho * rho) / sqrt(vx) AS bx, (1.1 * pz - rho * px) / (1.21 - rho * rho) / sqrt(vz) AS bz FROM s)"""


def _ridge1(feature: str, frame: str, name: str = "rm") -> str:
    """Moments of one feature over a frame of earlier rows of the hour."""
    return f"""{name} AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS mx, avg(y) OVER w AS my, var_pop(x) OVER w AS vx, covar_pop(y, x) OVER w AS cx, row_number() OVER (PARTITION BY local_hour ORDER BY local_date) - 1 AS place
  FROM (SELECT local_date, local_hour, price AS y, {feature} AS x FROM f WHERE {feature} IS NOT NULL) WINDOW w AS (PARTITION BY local_hour ORDER BY local_date {frame}))"""


_EXPANDING = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _backtest(feature: str, suffix: str = "") -> str:
    """Usable rows, the split by usable days, the alpha with the smallest validation error, and all test forecasts."""
    s = suffix
    return f"""us{s} AS (SELECT * FROM f WHERE {feature} IS NOT NULL), dy{s} AS (SELECT local_date, row_number() OVER (ORDER BY local_date) AS k FROM (SELECT DISTINCT local_date FROM us{s})),
sp{s} AS (SELECT max(local_date) FILTER (k = 271) AS v0, max(local_date) FILTER (k = 360) AS v1, max(local_date) FILTER (k = 361) AS t0, max(local_date) AS t1 FROM dy{s}),
{_ridge1(feature, _EXPANDING, f"rm{s}")}, va{s} AS (SELECT alpha, avg(abs(y - (my + (x - mx) * cx / (vx * (1 + alpha))))) AS e FROM rm{s}, sp{s}, (VALUES (0.1), (1.0)) AS a(alpha) WHERE n >= 30 AND local_date BETWEEN v0 AND v1 GROUP BY alpha),
al{s} AS (SELECT arg_min(alpha, e) AS alpha FROM va{s}),
fo{s} AS (SELECT 'ridge' AS model, local_date, local_hour, my + (x - mx) * cx / (vx * (1 + alpha)) AS forecast, y AS actual FROM rm{s}, sp{s}, al{s} WHERE n >= 30 AND local_date BETWEEN t0 AND t1
  UNION ALL SELECT model, nf.local_date, nf.local_hour, forecast, actual FROM nf JOIN us{s} USING (local_date, local_hour), sp{s} WHERE nf.local_date BETWEEN t0 AND t1),
cs{s} AS (SELECT * FROM fo{s} WHERE (local_date, local_hour) IN (SELECT (local_date, local_hour) FROM fo{s} GROUP BY local_date, local_hour HAVING count(DISTINCT model) = 4)),
sm{s} AS (SELECT model, count(*) AS n, avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) ** 2)) AS rmse FROM cs{s} GROUP BY model)"""


#: One split on rounded yesterday's price at midnight hours, from the rows before 1998.
_STUMP = f"""{_FEATURES}, st AS (SELECT local_date, local_hour, price AS y, round(price_d1 / 10) * 10 AS x FROM f WHERE local_hour = 0 AND price_d1 IS NOT NULL),
tr AS (SELECT *, median(y) OVER () AS base FROM st WHERE local_date < DATE '1998-01-01'), g AS (SELECT x, sum(sign(y - base)) AS g, count(*) AS n FROM tr GROUP BY x),
cu AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(g) OVER (ORDER BY x) AS gl, sum(n) OVER (ORDER BY x) AS nl, sum(g) OVER () AS gt, sum(n) OVER () AS nt FROM g),
sp AS (SELECT (x + nx) / 2 AS edge FROM cu WHERE nx IS NOT NULL AND nl >= 40 AND nt - nl >= 40 ORDER BY round(gl ** 2 / (nl + 1) + (gt - gl) ** 2 / (nt - nl + 1) - gt ** 2 / (nt + 1), 9) DESC, edge LIMIT 1),
lf AS (SELECT x <= edge AS low, median(y - base) AS leaf, any_value(base) AS base, any_value(edge) AS edge FROM tr, sp GROUP BY 1),
ps AS (SELECT st.*, base, leaf FROM st JOIN lf ON (st.x <= lf.edge) = lf.low WHERE local_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31')"""

#: Strategies on the days that both models cover, intervals numbered by time.
_INPUTS = f"""{_STRATEGY_DAYS}, yd AS (SELECT t.*, y.price AS past FROM hm t JOIN hm y ON y.local_date = t.local_date - 1 AND y.local_hour = t.local_hour), cd AS (SELECT local_date FROM yd GROUP BY 1 HAVING count(*) = 24),
inp AS MATERIALIZED (SELECT x.strategy AS strategy, local_date, local_hour, ts_utc, x.f AS forecast, price AS actual, row_number() OVER (PARTITION BY x.strategy, local_date ORDER BY ts_utc) AS i FROM (
  SELECT *, unnest([{{'strategy': 'naive_previous_day', 'f': past}}, {{'strategy': 'ridge', 'f': SIGNAL}}, {{'strategy': 'perfect_foresight', 'f': price}}, {{'strategy': 'no_trade', 'f': 0::DOUBLE}}]) AS x FROM yd WHERE local_date IN (SELECT local_date FROM cd)))"""


def _d(value: float) -> str:
    """A double constant; a bare decimal would be one of another type."""
    return f"{float(value)!r}::DOUBLE"


def _moves(specs: Sequence[BatterySpec]) -> str:
    """Every allowed step: from (phase, charge) by k into (phase, charge), its preference and grid energy."""
    rows = []
    for spec in specs:
        step, leg = spec.soc_step_mwh, spec.leg_efficiency
        top, phases = round(spec.energy_mwh / step), 2 * spec.max_episodes_per_day
        up, down = (math.floor(x / step + 1e-9) for x in (spec.power_mw * leg, spec.power_mw / leg))
        for phase in range(phases):
            for state in range(top + 1):
                for pref, k in enumerate([0, *range(1, up + 1), *range(-1, -down - 1, -1)]):
                    into = phase + 1 if k and (k < 0) != (phase % 2 == 1) else phase
                    if into < phases and 0 <= state + k <= top:
                        grid = 0.0 if not k else -k * step / leg if k > 0 else -k * step * leg
                        rows.append(f"({_d(spec.energy_mwh)}, {phase}, {state}, {k}, {pref}, {into}, {state + k}, {_d(grid)})")
    return f"mv(energy, ph, st, k, pref, ph2, st2, grid) AS (VALUES {', '.join(rows)})"


def dispatch_sql(specs: Sequence[BatterySpec], prefix: str = "", signal: str = "abs(price)", with_inputs: bool = True, intervals: int = 24) -> str:
    """CTEs that end in ``<prefix>out``: the optimal schedule of every strategy, asset and day, settled.

    The dynamic programme unrolled: a table of best values per interval, backwards, and one
    of the states passed, forwards.
    """
    p, first = prefix, specs[0]
    fee = first.variable_cost_eur_mwh + first.degradation_cost_eur_mwh
    parts = [_INPUTS.replace("SIGNAL", signal)] if with_inputs else []
    parts.append(_moves(specs).replace("mv(", f"{p}mv(", 1))
    parts.append(f"{p}v{intervals + 1} AS (SELECT DISTINCT strategy, local_date, energy, ph2 AS ph, 0 AS st, 0.0::DOUBLE AS gain, 0 AS k FROM inp, {p}mv)")
    for i in range(intervals, 0, -1):
        parts.append(
            f"""{p}v{i} AS MATERIALIZED (SELECT strategy, local_date, energy, ph, st, gain, k FROM (SELECT *, row_number() OVER (PARTITION BY strategy, local_date, energy, ph, st ORDER BY gain DESC, pref) AS r FROM (
  SELECT n.strategy, n.local_date, n.energy, m.ph, m.st, m.k, m.pref, m.grid * i.forecast - abs(m.grid) * {_d(fee)} + n.gain AS gain FROM {p}v{i + 1} n JOIN {p}mv m ON m.energy = n.energy AND m.ph2 = n.ph AND m.st2 = n.st
  JOIN inp i ON i.strategy = n.strategy AND i.local_date = n.local_date AND i.i = {i})) WHERE r = 1)"""
        )
    parts.append(f"{p}f0 AS (SELECT DISTINCT strategy, local_date, energy, 0 AS ph2, 0 AS st2, 0 AS k, 0.0::DOUBLE AS grid, 0 AS i FROM inp, {p}mv)")
    for i in range(1, intervals + 1):
        parts.append(
            f"""{p}f{i} AS MATERIALIZED (SELECT s.strategy, s.local_date, s.energy, m.ph2, m.st2, m.k, m.grid, {i} AS i FROM {p}f{i - 1} s JOIN {p}v{i} v ON v.strategy = s.strategy AND v.local_date = s.local_date AND v.energy = s.energy AND v.ph = s.ph2 AND v.st = s.st2
  JOIN {p}mv m ON m.energy = v.energy AND m.ph = v.ph AND m.st = v.st AND m.k = v.k)"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM {p}f{i}" for i in range(1, intervals + 1))
    parts.append(
        f"""{p}out AS MATERIALIZED (SELECT inp.*, 1.0::DOUBLE AS duration_hours, 1.0::DOUBLE AS power_mw, energy::DOUBLE AS energy_mwh, grid AS action_mwh, st2 * {_d(first.soc_step_mwh)} AS soc_mwh, abs(k) * {_d(first.soc_step_mwh)} AS battery_throughput_mwh,
  greatest(0::DOUBLE, -grid) AS charge_mwh, greatest(0::DOUBLE, grid) AS discharge_mwh, grid * actual AS gross_revenue_eur, abs(grid) * {_d(first.variable_cost_eur_mwh)} AS operating_cost_eur, abs(grid) * {_d(first.degradation_cost_eur_mwh)} AS degradation_cost_eur,
  grid * actual - abs(grid) * {_d(first.variable_cost_eur_mwh)} - abs(grid) * {_d(first.degradation_cost_eur_mwh)} AS profit_eur FROM ({every}) s JOIN inp USING (strategy, local_date, i))"""
    )
    return ", ".join(parts)


_MONEY = ("profit_eur", "gross_revenue_eur", "operating_cost_eur", "degradation_cost_eur")


def _summary(source: str) -> str:
    return f"""(SELECT *, max(CASE WHEN strategy = 'perfect_foresight' THEN profit_eur END) OVER (PARTITION BY power_mw, energy_mwh) AS perfect FROM (SELECT strategy, power_mw, energy_mwh, count(DISTINCT local_date) AS days, count(*) AS intervals,
  {", ".join(f"sum({c}) AS {c}" for c in _MONEY)}, sum(battery_throughput_mwh) AS throughput_mwh FROM {source} GROUP BY ALL))"""


def _summary_query(ctes: str) -> str:
    return f"""WITH {ctes} SELECT strategy, power_mw, energy_mwh, days, intervals, {_r(*_MONEY, "throughput_mwh")}, round(throughput_mwh / (2 * energy_mwh), 6) AS equivalent_cycles, round(CASE WHEN perfect > 0 THEN profit_eur / perfect END, 6) AS capture_vs_perfect FROM {_summary("out")}"""


def _scenario(name: str, prefix: str, profit: str = "profit_eur", moved: str = "battery_throughput_mwh") -> str:
    return f"SELECT '{name}' AS scenario, strategy, count(DISTINCT local_date) AS days, round(sum({profit}), 6) AS profit_eur, round(sum({moved}), 6) AS throughput_mwh FROM {prefix}out GROUP BY strategy"


def _scenarios() -> str:
    spec = BatterySpec(energy_mwh=1.0)
    out = "((local_date - DATE '2025-01-01') % 20 + 20) % 20 = 0"
    weak = "past + 0.5 * (abs(price) - past)"
    ctes = [
        dispatch_sql([spec]),
        dispatch_sql([BatterySpec(energy_mwh=1.0, variable_cost_eur_mwh=2.0, degradation_cost_eur_mwh=3.0)], "c_", with_inputs=False),
        dispatch_sql([BatterySpec(energy_mwh=1.0, round_trip_efficiency=0.85)], "e_", with_inputs=False),
        dispatch_sql([BatterySpec(energy_mwh=1.0, max_episodes_per_day=2)], "t_", with_inputs=False),
    ]
    # The weaker signal changes one strategy's forecasts: the same programme over other inputs.
    signal = dispatch_sql([spec], "s_", with_inputs=False).replace(" inp", " inq").replace("inp.*", "inq.*")
    inq = f"inq AS MATERIALIZED (SELECT inp.* REPLACE (CASE WHEN strategy = 'ridge' THEN {weak} ELSE forecast END AS forecast) FROM inp JOIN yd USING (local_date, local_hour))".replace("abs(price)", "abs(yd.price)")
    ctes += [inq, signal]
    zeroed = f"CASE WHEN {out} THEN 0 ELSE profit_eur END", f"CASE WHEN {out} THEN 0 ELSE battery_throughput_mwh END"
    listed = [_scenario("base", ""), _scenario("cost_2_3", "c_"), _scenario("efficiency_85", "e_"), _scenario("signal_50", "s_"), _scenario("calendar_downtime", "", *zeroed), _scenario("two_episodes", "t_")]
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(listed)}"


_GATE = _UTC.format("(CAST({0} - 1 AS TIMESTAMP) + INTERVAL 12 HOUR)")
_BUILT = f"""{_PRICE}, {_LOAD}, {_GEN}, {_HM}, both_ AS (SELECT ts_utc, any_value(res) AS res, sum(gen_mw) AS gen_mw FROM gen WHERE fuel IN ('wind', 'solar') GROUP BY ts_utc HAVING count(*) = 2 AND count(DISTINCT fuel) = 2 AND count(DISTINCT res) = 1),
{_hourly("hl", "loads", "load_mw")}, {_hourly("hg", "both_", "gen_mw")}, rl AS (SELECT hl.local_date, hl.local_hour, load_mw - gen_mw AS r FROM hl JOIN hg USING (ts_utc)), rd AS (SELECT local_date, avg(r) AS r FROM rl GROUP BY 1 HAVING count(*) = 24),
dd AS (SELECT local_date, avg(price) AS mean_, arg_max(price, local_hour) AS end_ FROM hm GROUP BY 1 HAVING count(*) = 24),
cells AS (SELECT local_date, local_hour, price FROM hm UNION ALL SELECT DATE '2024-02-02', h::INT, NULL FROM range(24) t(h) WHERE (DATE '2024-02-02', h) NOT IN (SELECT (local_date, local_hour) FROM hm))"""
_RECORDED = f"""{_PRICE}, {_HM}, g AS (SELECT h::INT AS local_hour FROM range(24) t(h)), iss AS (SELECT g.local_hour, y.price AS forecast, a.price AS actual FROM g LEFT JOIN hm y ON y.local_date = DATE '2024-01-09' AND y.local_hour = g.local_hour
  LEFT JOIN hm a ON a.local_date = DATE '2024-01-10' AND a.local_hour = g.local_hour)"""
_ISSUE_DAY = f"""{_PRICE}, {_HM}, g AS (SELECT h::INT AS local_hour, TIMESTAMP '2024-01-09 23:00:00' + to_hours(h::INT) AS delivery_start_utc FROM range(24) t(h)),
iss AS (SELECT 'DE-LU' AS zone, 'naive_previous_day' AS model, 'naive_previous_day:' || sha256('{{"lag": 1}}') AS model_version, TIMESTAMP '2024-01-09 09:00:00' AS issued_at, DATE '2024-01-10' AS delivery_date, g.local_hour, delivery_start_utc, 1.0::DOUBLE AS delivery_duration_hours,
  y.price AS forecast, CAST(NULL AS DOUBLE) AS actual, CASE WHEN y.price IS NULL THEN 'abstain_missing_inputs' ELSE 'issued' END AS status, repeat('0', 64) AS input_sha256, 2 AS protocol_version, '{{"lag": 1}}' AS configuration, TIMESTAMP '2024-01-09 08:00:00' AS input_as_of,
  TIMESTAMP '2024-01-09 09:00:00' AS recorded_at, true AS eligible, 'pre_gate' AS eligibility_reason FROM g LEFT JOIN hm y ON y.local_date = DATE '2024-01-09' AND y.local_hour = g.local_hour AND y.local_hour <> 7),
idd AS (SELECT *, sha256('DE-LU|' || model_version || '|2024-01-10|2024-01-09 09:00:00|2024-01-09 08:00:00|' || input_sha256) AS issue_id FROM iss)"""


def protocol_sql() -> dict[str, str]:
    cover = "count(*) AS rows, min(ts_utc) AS first_ts_utc, max(ts_utc) AS last_ts_utc, count(DISTINCT strftime(ts_utc, '%Y-%m')) AS partitions"
    three = f"{_PRICE}, {_LOAD}, {_GEN}, al AS (SELECT 'price' AS dataset, ts_utc FROM price UNION ALL SELECT 'load', ts_utc FROM loads UNION ALL SELECT 'generation', ts_utc FROM gen)"
    sizes = [BatterySpec(energy_mwh=e) for e in (1.0, 2.0, 4.0)]
    return {
        "store_round_trip": f"WITH {_PRICE}, {_LATEST} SELECT 'DE-LU' AS zone, ts_utc, res::SMALLINT AS resolution_min, round(price, 6) AS price, 'EUR' AS currency FROM merged WHERE ts_utc >= TIMESTAMP '2024-01-10 05:00:00' AND ts_utc < TIMESTAMP '2024-02-20'",
        "store_checkpoint": f"WITH {three} SELECT d.dataset, max(ts_utc) AS last_ts_utc FROM (VALUES ('price'), ('load'), ('generation'), ('fundamentals')) AS d(dataset) LEFT JOIN al USING (dataset) GROUP BY 1",
        "stats_with_age": f"WITH {three} SELECT dataset, 'DE-LU' AS zone, count(*) AS rows, count(DISTINCT strftime(ts_utc, '%Y-%m')) AS partitions, max(ts_utc) AS last_ts_utc, round(epoch(TIMESTAMP '2024-02-01' - max(ts_utc)) / 3600, 1) AS age_hours FROM al GROUP BY 1",
        "store_partitions_checked": f"""WITH {_EV}, {_LOAD}, b AS (SELECT ts_utc, CASE WHEN hour(ts_utc) % 5 = 0 THEN -load_mw ELSE load_mw END AS v, 'x' AS source FROM loads), u AS (SELECT * FROM b UNION ALL SELECT ts_utc + INTERVAL 40 DAY, v, NULL FROM b),
  m AS (SELECT strftime(ts_utc, '%Y-%m') AS month, count(*) FILTER (source IS NULL) AS s, count(*) FILTER (v < 0 OR v > 2000000) AS l FROM u GROUP BY 1)
  SELECT 'load' AS dataset, 'DE-LU' AS zone, month, 'source' AS rule, s AS violations FROM m WHERE s > 0 UNION ALL SELECT 'load', 'DE-LU', month, 'load_mw', l FROM m WHERE l > 0""",
        "reference_round_trip": f"WITH {_CAP} SELECT 'DE' AS country, 'yearly' AS time_step, period, make_date(period::INT, 12, 31) AS as_of, technology, round(value, 6) AS value, 'GW' AS unit, is_planned, 'fixture' AS source FROM cap",
        "feed_price": f"""WITH {_HOURS} SELECT 'DE-LU' AS zone, h AS ts_utc, 60::SMALLINT AS resolution_min, round(mean_ + CASE WHEN day(h) % 2 = 0 THEN 100 ELSE 0 END, 6) AS price, 'EUR' AS currency, 'feed' AS source FROM hs
  WHERE h >= TIMESTAMP '2024-01-03' AND h < TIMESTAMP '2024-01-28'""",
        "feed_load": f"WITH {_HOURS} SELECT 'DE-LU' AS zone, h AS ts_utc, 60::SMALLINT AS resolution_min, round(load_, 6) AS load_mw, 'feed' AS source FROM hs WHERE load_ IS NOT NULL",
        "feed_generation": f"""WITH {_HOURS} SELECT 'DE-LU' AS zone, h AS ts_utc, 60::SMALLINT AS resolution_min, x.fuel AS fuel, round(x.v, 6) AS gen_mw, 'feed' AS source FROM (SELECT h, unnest([{{'fuel': 'solar', 'v': solar}}, {{'fuel': 'gas', 'v': gas}},
  {{'fuel': 'wind', 'v': CASE WHEN onshore IS NOT NULL OR offshore IS NOT NULL THEN coalesce(onshore, 0) + coalesce(offshore, 0) END}}]) AS x FROM hs) WHERE x.v IS NOT NULL""",
        "feed_fundamentals": f"""WITH {_FUND} SELECT 'DE-LU' AS zone, ts_utc, 60::SMALLINT AS resolution_min, x.series AS series, round(x.v, 6) AS forecast_mw, 'feed' AS source FROM (SELECT ts_utc, unnest([{{'series': 'load', 'v': load}}, {{'series': 'wind', 'v': wind}}, {{'series': 'solar', 'v': solar}}]) AS x FROM fd)
  WHERE x.v IS NOT NULL AND ts_utc < TIMESTAMP '2024-01-25'""",
        "feed_capacity": f"""WITH {_CAP} SELECT 'DE' AS country, 'yearly' AS time_step, period, make_date(period::INT, 12, 31) AS as_of, technology || CASE WHEN left(technology, 1)::INT % 2 = 1 THEN ' planned' ELSE '' END AS technology, round(value, 6) AS value, 'GW' AS unit,
  left(technology, 1)::INT % 2 = 1 AS is_planned, 'feed' AS source FROM cap WHERE NOT is_planned""",
        "feed_files": f"WITH {_HOURS} SELECT CAST(h AS DATE) AS day, count(*) AS n FROM hs WHERE h < TIMESTAMP '2024-01-08' GROUP BY 1",
        "http_waits": """SELECT a::INT AS attempt, s::INT AS status, r AS retry_after, round(least(120.0, CASE WHEN s = 429 THEN coalesce(TRY_CAST(r AS DOUBLE), 20.0 * a) ELSE 1.5 * 2 ** (a - 1) END), 6) AS seconds
  FROM range(1, 10) t(a), (VALUES (429), (503)) AS u(s), (VALUES (NULL), ('7'), ('soon'), ('999')) AS w(r)""",
        "http_requests": """SELECT dataset, place, kind, '2024-01-05' AS first, '2024-01-09' AS last FROM (VALUES ('price', 'DE-LU', NULL), ('load', 'de', NULL), ('generation', 'de', NULL), ('fundamentals', 'de', 'load'), ('fundamentals', 'de', 'wind_onshore'),
  ('fundamentals', 'de', 'wind_offshore'), ('fundamentals', 'de', 'solar')) AS t(dataset, place, kind)""",
        "ingest_results": f"""WITH {_PRICE}, {_LOAD}, c AS (SELECT 'price' AS dataset, ts_utc FROM price WHERE ts_utc < TIMESTAMP '2024-01-31' UNION ALL SELECT 'load', ts_utc FROM loads WHERE ts_utc < TIMESTAMP '2024-01-13'), k AS (SELECT dataset, count(*) AS rows, max(ts_utc) AS last_ts_utc FROM c WHERE ts_utc >= TIMESTAMP '2024-01-01' GROUP BY 1)
  SELECT 'DE-LU' AS zone, x.dataset, outcome, error, rows, last_ts_utc FROM (VALUES ('price', 'written', ''), ('load', 'failed', 'no answer'), ('fundamentals', 'empty', '')) AS x(dataset, outcome, error) LEFT JOIN k ON k.dataset = x.dataset""",
        "ingest_windows": f"""WITH {_PRICE}, {_LOAD}, w AS (SELECT 'price' AS dataset, least(TIMESTAMP '2024-02-01', max(ts_utc)) - INTERVAL 7 DAY AS s, TIMESTAMP '2024-02-03' AS e FROM price UNION ALL SELECT 'load', least(TIMESTAMP '2024-02-01', max(ts_utc)) - INTERVAL 7 DAY, TIMESTAMP '2024-02-01' FROM loads)
  SELECT dataset, s + to_days((4 * k)::INT) AS "start", least(e, s + to_days((4 * k + 4)::INT)) AS "end" FROM w, range(10) t(k) WHERE s + to_days((4 * k)::INT) < e""",
        "stream_upserts": f"WITH {_PRICE}, {_LATEST} SELECT 'DE-LU' AS zone, ts_utc, round(price, 6) AS price FROM merged",
        "stream_hourly": f"WITH {_PRICE}, {_HM} SELECT 'DE-LU' AS zone, ts_utc, round(price, 6) AS price FROM hm",
        "probe_log": f"""WITH {_EV}, {_GEN}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-01-12', INTERVAL 1 DAY)) AS DATE) AS d),
  sv AS (SELECT fuel AS series, CAST({_local("ts_utc")} AS DATE) AS d, count(DISTINCT date_trunc('hour', ts_utc)) AS n FROM gen GROUP BY 1, 2)
  SELECT strftime(a, '%Y-%m-%dT%H:%M:%S') AS checked_at_utc, 'DE-LU' AS zone, CAST(days.d AS VARCHAR) AS delivery_date, s AS series, CAST(24 AS BIGINT) AS hours_expected, coalesce(n, 0) AS hours_covered,
  CAST(floor(epoch({_GATE.format("days.d")} - a) / 60) AS BIGINT) AS minutes_before_gate FROM days CROSS JOIN (VALUES ('load'), ('wind'), ('solar')) AS t(s) CROSS JOIN (VALUES (TIMESTAMP '2024-01-09 08:00:00'), (TIMESTAMP '2024-01-09 09:00:00')) AS u(a)
  LEFT JOIN sv ON sv.series = s AND sv.d = days.d AND s IN ('wind', 'solar')""",
        "attempts_log": """SELECT 'n-' || n_nationkey AS attempt_id, 'DE-LU' AS zone, 'ridge' AS model, CAST(DATE '2024-01-10' + (n_nationkey % 5)::INT AS DATE) AS delivery_date, ['manual', 'schedule'][n_nationkey % 2 + 1] AS origin, '2024-01-09T09:00:00' AS started_at,
  CASE WHEN n_nationkey % 4 = 0 THEN 'started' ELSE ['issued', 'already_issued', 'partial', 'abstained', 'late', 'failed'][n_nationkey % 6 + 1] END AS status,
  CASE WHEN n_nationkey % 4 <> 0 THEN strftime(TIMESTAMP '2024-01-09 09:00:00' + to_minutes(n_nationkey::INT), '%Y-%m-%dT%H:%M:%S') END AS completed_at, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 6 = 5 THEN 'ValueError' END AS error_type FROM nation""",
        "audit_report": f"""WITH {_PRICE}, {_GEN}, a AS (SELECT 'price' AS dataset, 'all' AS fuel, ts_utc, res, price AS v FROM price UNION ALL SELECT 'generation', fuel, ts_utc, res, gen_mw FROM gen),
  s AS (SELECT *, epoch(lead(ts_utc) OVER (PARTITION BY dataset, fuel ORDER BY ts_utc) - (ts_utc + to_minutes(res))) AS gap FROM a)
  SELECT 'DE-LU' AS zone, dataset, fuel, count(*) AS rows, min(ts_utc) AS first, max(ts_utc + to_minutes(res)) AS last, round(sum(res) / 60.0, 6) AS observed_hours, count(*) FILTER (coalesce(gap < 0, false) OR v IS NULL) AS invalid FROM s GROUP BY 2, 3
  UNION ALL SELECT 'DE-LU', x.d, 'all', 0, NULL, NULL, NULL, 1 FROM (VALUES ('load'), ('fundamentals')) AS x(d)""",
        "panel_complete": f"""WITH {_FEATURES} SELECT local_date, local_hour, {_r("price", "price_d1", "price_d2", "price_d3", "price_d7", "price_d1_mean", "price_d7_mean")} FROM f WHERE price_d1 + price_d2 + price_d3 + price_d7 + price_d1_mean + price_d7_mean IS NOT NULL""",
        "panel_built": f"""WITH {_BUILT} SELECT c.local_date, c.local_hour, round(c.price, 6) AS price, round(l1.price, 6) AS price_d1, round(l7.price, 6) AS price_d7, round(CASE WHEN isodow(c.local_date) BETWEEN 2 AND 5 THEN l1.price ELSE l7.price END, 6) AS price_similar_day,
  round(y.mean_, 6) AS price_d1_mean, round(y.end_, 6) AS price_d1_end, round(k.mean_, 6) AS price_d7_mean, round(rl.r, 6) AS residual_d2, round(rd.r, 6) AS residual_d2_mean, CAST(isodow(c.local_date) AS INT) AS dow FROM cells c
  LEFT JOIN hm l1 ON l1.local_date = c.local_date - 1 AND l1.local_hour = c.local_hour LEFT JOIN hm l7 ON l7.local_date = c.local_date - 7 AND l7.local_hour = c.local_hour LEFT JOIN dd y ON y.local_date = c.local_date - 1 LEFT JOIN dd k ON k.local_date = c.local_date - 7
  LEFT JOIN rl ON rl.local_date = c.local_date - 2 AND rl.local_hour = c.local_hour LEFT JOIN rd ON rd.local_date = c.local_date - 2""",
        "vintages_retrospective": f"WITH {_FUND} SELECT ts_utc, {_GATE.format('CAST(' + _local('ts_utc') + ' AS DATE)')} AS published_at, {_r('load', 'wind', 'solar')} FROM fd WHERE coalesce(load, wind, solar) IS NOT NULL",
        "vintages_prospective": f"WITH {_FUND} SELECT ts_utc, TIMESTAMP '2024-01-09 08:00:00' AS published_at, {_r('load', 'wind', 'solar')} FROM fd WHERE coalesce(load, wind, solar) IS NOT NULL AND CAST({_local('ts_utc')} AS DATE) = DATE '2024-01-10'",
        "panel_with_fundamentals": f"""WITH {_PRICE}, {_HM}, {_FUND} SELECT local_date, local_hour, {_r("load", "wind", "solar")}, round(load - wind - solar, 6) AS residual_forecast, CASE WHEN coalesce(load, wind, solar) IS NOT NULL THEN 0::BIGINT END AS forecast_age_hours FROM hm LEFT JOIN fd USING (ts_utc)""",
        "ridge_walk_forward_2f": f"WITH {_RIDGE2} SELECT local_date, local_hour, round(sy / n + (x - sx / n) * bx + (z - sz / n) * bz, 6) AS forecast FROM b",
        "ridge_rolling_1f": f"""WITH {_FEATURES}, {_ridge1("price_d1", "ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING")} SELECT local_date, local_hour, round(my + (x - mx) * cx / (vx * 1.3), 6) AS forecast FROM rm WHERE place >= 30 AND local_date >= DATE '1995-10-01'""",
        "ridge_level_and_spread": f"""WITH {_FEATURES}, {_ridge1("price_d1", _EXPANDING)} SELECT z.zone, local_date, local_hour, round(z.s * (my + (x - mx) * cx / (vx * 1.1)), 3) AS forecast FROM rm, (VALUES ('A', 1), ('B', -1)) AS z(zone, s) WHERE n >= 30""",
        "ridge_day": f"""WITH {_FEATURES}, h AS (SELECT local_hour, count(*) AS n, avg(price_d1) AS mx, avg(price) AS my, var_pop(price_d1) AS vx, covar_pop(price, price_d1) AS cx FROM f WHERE price_d1 IS NOT NULL AND local_date < DATE '1998-01-01' GROUP BY 1)
  SELECT local_date, local_hour, round(my + (price_d1 - mx) * cx / (vx * 1.1), 6) AS forecast FROM f JOIN h USING (local_hour) WHERE local_date = DATE '1998-01-01' AND price_d1 IS NOT NULL AND n >= 30""",
        "ridge_coefficients_before": f"""WITH {_FEATURES}, k AS (SELECT *, row_number() OVER (PARTITION BY local_hour ORDER BY local_date DESC) AS place FROM f WHERE price_d1 IS NOT NULL AND local_date < DATE '1995-10-01'),
  c AS (SELECT local_hour, covar_pop(price, price_d1) / (var_pop(price_d1) * 1.1) AS coefficient, stddev_pop(price_d1) AS train_sd FROM k WHERE place <= 90 GROUP BY 1 HAVING count(*) > 1) SELECT local_hour, 'price_d1' AS feature, {_r("coefficient", "train_sd")}, round(coefficient * train_sd, 6) AS effect FROM c""",
        "ridge_alpha_choice": f"""WITH {_FEATURES}, {_ridge1("price_d1", _EXPANDING)} SELECT CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, round(avg(abs(y - (my + (x - mx) * cx / (vx * (1 + alpha))))), 6) AS mae FROM rm CROSS JOIN (VALUES (0.01), (0.03), (0.1), (0.3), (1.0), (3.0), (10.0)) AS a(alpha)
  WHERE n >= 30 AND local_date BETWEEN DATE '1995-10-01' AND DATE '1995-12-31' GROUP BY alpha ORDER BY avg(abs(y - (my + (x - mx) * cx / (vx * (1 + alpha))))), alpha LIMIT 1""",
        "tree_stump": f"WITH {_STUMP} SELECT local_date, local_hour, round(base + 0.5 * leaf, 6) AS forecast FROM ps",
        "tree_choice": f"""WITH {_STUMP}, e AS (SELECT place::INT AS place, count(*) AS n, avg(abs(y - base - rate * leaf)) AS mae FROM ps, (VALUES (0, 0.5), (1, 0.9)) AS a(place, rate) GROUP BY place) SELECT place, n, round(mae, 6) AS mae, place = (SELECT arg_min(place, mae) FROM e) AS chosen FROM e""",
        "backtest_scores": f"""WITH {_NAIVE}, {_backtest("price_d1")} SELECT model, n, {_r("mae", "rmse")}, round((1 - mae / (SELECT mae FROM sm WHERE model = 'naive_similar_day')) * 100, 6) AS skill_pct, round((1 - mae / (SELECT min(mae) FROM sm WHERE model LIKE 'naive%')) * 100, 6) AS skill_vs_best_baseline_pct FROM sm""",
        "backtest_metadata": f"""WITH {_NAIVE}, {_backtest("price_d1")} SELECT x.name AS name, x.value AS value FROM (SELECT unnest([{{'name': 'reference', 'value': 'naive_similar_day'}}, {{'name': 'alpha', 'value': CAST((SELECT alpha FROM al) AS DOUBLE)::VARCHAR}}, {{'name': 'validation_start', 'value': v0::VARCHAR}},
  {{'name': 'validation_end', 'value': v1::VARCHAR}}, {{'name': 'test_start', 'value': t0::VARCHAR}}, {{'name': 'test_end', 'value': t1::VARCHAR}}, {{'name': 'test_days', 'value': (SELECT count(DISTINCT local_date) FROM cs)::VARCHAR}}, {{'name': 'zone', 'value': 'DE-LU'}}, {{'name': 'min_train_days', 'value': '270'}}]) AS x FROM sp)""",
        "ablation_scores": f"""WITH {_NAIVE}, {_backtest("price_d1")}, {_backtest("price_d7", "_i")} SELECT 'DE-LU' AS zone, model, false AS include_fundamentals, n, {_r("mae")}, t0::VARCHAR AS test_start, t1::VARCHAR AS test_end FROM sm, sp WHERE model = 'ridge'
  UNION ALL SELECT 'DE-LU', model, true, n, round(mae, 6), t0::VARCHAR, t1::VARCHAR FROM sm_i, sp_i WHERE model = 'ridge'""",
        "release_round_trip": f"WITH {_PRED} SELECT model, local_date, count(*) AS n, round(avg(abs(actual - forecast)), 6) AS mae, round(avg(actual), 6) AS mean_actual, 1 AS run FROM pr GROUP BY 1, 2",
        "evidence_round_trip": f"WITH {_PRICE} SELECT ts_utc, round(price, 6) AS price, 2 AS issue FROM price UNION ALL SELECT ts_utc + INTERVAL 60 DAY, round(CASE WHEN ts_utc + INTERVAL 60 DAY >= TIMESTAMP '2024-03-01' THEN 0 ELSE price END, 6), 2 FROM price",
        "weakest_buckets": f"WITH {_scores()} SELECT scope, bucket, model, round((1 - mae / best) * 100, 6) AS skill_vs_best_baseline_pct FROM sk WHERE scope = 'hour' AND best > 0 ORDER BY (1 - mae / best), scope, bucket, model LIMIT 5",
        "published_predictions": f"WITH {_PRED} SELECT 'DE-LU' AS zone, model, CAST(local_date AS VARCHAR) AS local_date, local_hour, round(forecast, 2) AS forecast, round(actual, 2) AS actual FROM pr",
        "export_round_trip": f"WITH {_PRED} SELECT model, CAST(local_date AS VARCHAR) AS local_date, count(*) AS n, round(avg(abs(actual - forecast)), 6) AS mae, round(avg(actual), 6) AS mean_actual, 'validation,absent,others.json' AS differing FROM pr GROUP BY 1, 2",
        "forecast_preview_weeks": f"""WITH {_PRED}, wk AS (SELECT *, CAST(date_trunc('week', local_date) AS DATE) AS week FROM pr), n AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () - 1 AS last_ FROM (SELECT DISTINCT week FROM wk))
  SELECT model, local_date, local_hour, {_r("forecast", "actual")} FROM wk WHERE week IN (SELECT n.week FROM n, range(12) AS t(j) WHERE last_ < 12 OR n.i = CAST(round_even(t.j * last_ / 11.0, 0) AS BIGINT))""",
        "week_slice": f"WITH {_PRED} SELECT model, local_date, local_hour, {_r('forecast')} FROM pr WHERE local_date >= DATE '1995-10-02' AND local_date < DATE '1995-10-09'",
        "dispatch_full": f"""WITH {dispatch_sql(sizes)} SELECT ts_utc, local_date, local_hour, {_r("forecast", "actual")}, duration_hours, strategy, power_mw, energy_mwh, {_r("action_mwh", "soc_mwh", "battery_throughput_mwh", "charge_mwh", "discharge_mwh", "gross_revenue_eur", "operating_cost_eur", "degradation_cost_eur", "profit_eur")} FROM out""",
        "dispatch_summary": _summary_query(dispatch_sql([BatterySpec(energy_mwh=e) for e in (1.0, 4.0)])),
        "dispatch_two_episodes": f"WITH {dispatch_sql([BatterySpec(energy_mwh=1.0, max_episodes_per_day=2, variable_cost_eur_mwh=2.0)])} SELECT strategy, ts_utc, {_r('action_mwh', 'soc_mwh', 'profit_eur')} FROM out",
        "dispatch_last_day": f"WITH {dispatch_sql([BatterySpec(energy_mwh=2.0)])} SELECT strategy, local_date, local_hour, {_r('action_mwh', 'soc_mwh')} FROM out WHERE local_date = (SELECT max(local_date) FROM out)",
        "daily_margins": f"""WITH {dispatch_sql([BatterySpec(energy_mwh=2.0, variable_cost_eur_mwh=2.0, degradation_cost_eur_mwh=3.0)])} SELECT strategy, power_mw, energy_mwh, local_date, count(*) AS intervals, round(sum(duration_hours), 6) AS delivery_hours,
  {", ".join(f"round(sum({c}), 6) AS {c}" for c in (*_MONEY, "battery_throughput_mwh"))}, round(sum(battery_throughput_mwh) / (2 * energy_mwh), 6) AS equivalent_cycles FROM out GROUP BY strategy, power_mw, energy_mwh, local_date""",
        "study_daily": f"""WITH {dispatch_sql([BatterySpec(energy_mwh=e) for e in (1.0, 4.0)])} SELECT strategy, energy_mwh, local_date, count(*) AS intervals, round(sum(profit_eur), 6) AS profit_eur, round(sum(battery_throughput_mwh) / (2 * energy_mwh), 6) AS equivalent_cycles FROM out GROUP BY strategy, energy_mwh, local_date""",
        "study_saved": _summary_query(dispatch_sql([BatterySpec(energy_mwh=e) for e in (1.0, 4.0)])),
        "scenario_summaries": _scenarios(),
        "bootstrap_ci": f"""WITH {_DAILY}, pd AS (SELECT a.strategy, b.strategy AS baseline, a.power_mw, a.energy_mwh, a.local_date, (a.profit_eur - b.profit_eur) / a.power_mw AS delta FROM dm a JOIN dm b ON b.local_date = a.local_date AND b.strategy LIKE 'naive%' WHERE a.strategy = 'ridge'),
  bl AS (SELECT strategy, baseline, power_mw, energy_mwh, cal, sum(delta) AS total, count(*) AS days FROM (SELECT *, (local_date - min(local_date) OVER (PARTITION BY baseline)) // 7 AS cal FROM pd) GROUP BY ALL),
  nb AS (SELECT *, row_number() OVER (PARTITION BY baseline ORDER BY cal) - 1 AS block, count(*) OVER (PARTITION BY baseline) AS blocks, sum(days) OVER (PARTITION BY baseline) AS observed FROM bl),
  dr AS (SELECT DISTINCT blocks, r, i, ('0x' || substr(md5(r || '|' || i), 1, 8))::BIGINT % blocks AS block FROM (SELECT DISTINCT blocks FROM nb), range(2000) t(r), range(100000) u(i) WHERE i < blocks),
  mg AS (SELECT strategy, baseline, power_mw, energy_mwh, r, sum(total) / sum(days) * any_value(observed) AS margin FROM nb JOIN dr USING (blocks, block) WHERE nb.blocks >= 8 AND observed >= 56 GROUP BY ALL)
  SELECT l.strategy, l.baseline, l.power_mw, l.energy_mwh, round(quantile_cont(margin, 0.025), 6) AS ci_low_eur_mw, round(quantile_cont(margin, 0.975), 6) AS ci_high_eur_mw FROM (SELECT DISTINCT strategy, baseline, power_mw, energy_mwh FROM pd) l LEFT JOIN mg USING (strategy, baseline, power_mw, energy_mwh) GROUP BY ALL""",
        "annual_increment": f"""WITH {_DAILY}, t AS (SELECT strategy, power_mw, count(*) AS days, sum(profit_eur) AS p FROM dm GROUP BY 1, 2) SELECT strategy, days, round((p - (SELECT max(p) FROM t WHERE strategy LIKE 'naive%')) / power_mw / (days / 365.25), 6) AS annual_increment_eur_mw FROM t""",
        "competition": f"""WITH {_MARGIN}, k AS (SELECT strategy, count(*) AS n, covar_pop(battery_power_gw, eur_per_mw_day) / nullif(stddev_pop(battery_power_gw) * stddev_pop(eur_per_mw_day), 0) AS pearson_r, min(year) AS fitted_year_min, max(year) AS fitted_year_max FROM my WHERE year < '2001' AND strategy = 'ridge' GROUP BY 1)
  SELECT strategy, CAST(4 AS DOUBLE) AS energy_mwh, n, {_r("pearson_r")}, fitted_year_min, fitted_year_max FROM k WHERE n >= 3 AND pearson_r IS NOT NULL""",
        "market_tables_sizes": f"""WITH {_PRICE}, {_GEN}, {_lp()}, {_CAP} SELECT 'daily_prices' AS name, count(DISTINCT d) AS n FROM lp UNION ALL SELECT 'generation_mix', count(DISTINCT (strftime({_local("ts_utc")}, '%Y-%m'), fuel)) FROM gen WHERE fuel <> 'imports' UNION ALL SELECT 'capacity', count(*) FROM cap
  UNION ALL SELECT 'cannibalisation', 2 * count(DISTINCT year(d)) FROM lp UNION ALL SELECT 'price_shape', count(DISTINCT (year(d), h)) FROM lp UNION ALL SELECT 'capacity_price_yearly', count(DISTINCT year(d)) FROM lp WHERE year(d) = 2024""",
        "fit_cutoff": f"WITH {_PRICE} SELECT CAST(year({_local('max(ts_utc + to_minutes(res))')}) AS INT) AS year FROM price",
        "ledger_issue": f"WITH {_ISSUE_DAY} SELECT * REPLACE (round(forecast, 6) AS forecast) FROM idd",
        "ledger_store": f"""WITH {_ISSUE_DAY} SELECT idd.model, delivery_date, idd.local_hour, round(forecast, 6) AS forecast, round(a.price, 6) AS actual, CASE WHEN forecast IS NULL THEN 'abstain_missing_inputs' WHEN a.price IS NULL THEN 'issued' ELSE 'scored' END AS status, eligible, issue_id
  FROM idd LEFT JOIN hm a ON a.local_date = delivery_date AND a.local_hour = idd.local_hour""",
        "issue_recorded": f"WITH {_RECORDED} SELECT 'naive_previous_day' AS model, local_hour, round(forecast, 6) AS forecast, CASE WHEN forecast IS NULL THEN 'abstain_missing_inputs' ELSE 'issued' END AS status, true AS eligible, (SELECT max(local_date) FROM hm WHERE local_date < DATE '2024-01-10') AS last_known, 'naive' AS kind FROM iss",
        "battery_on_ledger": "",
        "attempt_window": f"""WITH {_RECORDED}, whole AS (SELECT count(forecast) = 24 AS ok FROM iss) SELECT delivery_date, 'DE-LU' AS zone, 'naive_previous_day' AS model, CAST(24 AS BIGINT) AS expected_hours, attempts, scheduled_attempts, failed_attempts, CASE WHEN delivery_date = DATE '2024-01-10' AND NOT ok THEN 'issued_unverified' ELSE status END AS status,
  delivery_date = DATE '2024-01-10' AND ok AS eligible FROM (VALUES (DATE '2024-01-09', 0, 0, 0, 'missing_attempt'), (DATE '2024-01-10', 2, 2, 1, 'issued'), (DATE '2024-01-11', 1, 0, 0, 'started'), (DATE '2024-01-12', 0, 0, 0, 'missing_attempt')) AS t(delivery_date, attempts, scheduled_attempts, failed_attempts, status), whole""",
    } | {"battery_on_ledger": _battery_on_ledger()}


def _battery_on_ledger() -> str:
    """The programme over the one issued day, if all its hours are forecast and settled."""
    day = "SELECT strategy, local_date, local_hour, ts_utc, forecast, actual, row_number() OVER (PARTITION BY strategy ORDER BY local_hour) AS i FROM"
    inputs = f"""{_RECORDED}, inp AS MATERIALIZED ({day} (SELECT x.strategy AS strategy, DATE '2024-01-10' AS local_date, local_hour, TIMESTAMP '2024-01-09 23:00:00' + to_hours(local_hour) AS ts_utc, x.f AS forecast, actual FROM (
  SELECT *, unnest([{{'strategy': 'naive_previous_day', 'f': forecast}}, {{'strategy': 'perfect_foresight', 'f': actual}}, {{'strategy': 'no_trade', 'f': 0::DOUBLE}}]) AS x FROM iss WHERE (SELECT count(forecast) = 24 AND count(actual) = 24 FROM iss))))"""
    return f"WITH {inputs}, {dispatch_sql([BatterySpec(energy_mwh=1.0)], with_inputs=False)} SELECT strategy, count(DISTINCT local_date) AS days, round(sum(profit_eur), 6) AS profit_eur FROM out GROUP BY strategy"

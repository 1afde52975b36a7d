"""The registered queries as DuckDB SQL over the same tables.

Left out, because SQL does not express them: the many-feature ridge, the default boosted
trees and the bootstrap with a seeded generator; each has a smaller twin that SQL does
express (two features, one split, draws by rule).
"""

from __future__ import annotations

_BERLIN = "({0} AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')"
_UTC = "({0} AT TIME ZONE 'Europe/Berlin' AT TIME ZONE 'UTC')"


def _local(ts: str) -> str:
    return _BERLIN.format(ts)


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_EV = """ev AS (SELECT event_id, ts, user_id, event_type, value,
  CASE WHEN ts < TIMESTAMP '2024-01-16' THEN date_trunc('hour', ts) ELSE time_bucket(INTERVAL 15 MINUTE, ts) END AS ts_utc,
  CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 60 ELSE 15 END AS res FROM events)"""
_PRICE = f"""{_EV}, price AS (SELECT ts_utc, res, avg(value) - 45 AS price FROM ev GROUP BY ts_utc, res)"""
_LOAD = """loads AS (SELECT ts_utc, res, 3 * sum(value) AS load_mw FROM ev GROUP BY ts_utc, res)"""
_GEN = """gen AS (SELECT ts_utc, res, CASE event_type WHEN 'view' THEN 'solar' WHEN 'click' THEN 'wind' WHEN 'signup' THEN 'gas'
  WHEN 'purchase' THEN 'hydro_pumped_storage' ELSE 'imports' END AS fuel, sum(value) AS gen_mw FROM ev GROUP BY ALL)"""


def _lp(source: str = "price") -> str:
    return f"""lp AS (SELECT *, CAST(loc AS DATE) AS d, CAST(hour(loc) AS INT) AS h, res / 60.0 AS w,
  CASE WHEN hour(loc) >= 8 AND hour(loc) < 20 AND isodow(loc) <= 5 THEN 'on_peak' ELSE 'off_peak' END AS block
  FROM (SELECT *, {_local("ts_utc")} AS loc FROM {source}))"""


def _label(period: str) -> str:
    return {"day": "strftime(d, '%Y-%m-%d')", "month": "strftime(d, '%Y-%m')", "year": "strftime(d, '%Y')", "all": "'all'"}[period]


def _blocks(period: str, source: str = "lp") -> str:
    def mean(mask: str) -> str:
        return f"sum(price * w) FILTER ({mask}) / nullif(sum(w) FILTER ({mask}), 0)"

    return f"""(SELECT {_label(period)} AS period, {mean("block = 'on_peak'")} AS on_peak, {mean("block = 'off_peak'")} AS off_peak,
  {mean("block = 'on_peak'")} - {mean("block = 'off_peak'")} AS spread, sum(price * w) / nullif(sum(w), 0) AS all_hours,
  count(*) FILTER (block = 'on_peak') AS n_on_peak, count(*) FILTER (block = 'off_peak') AS n_off_peak FROM {source} GROUP BY 1)"""


def _block_query(period: str) -> str:
    return f"WITH {_PRICE}, {_lp()} SELECT period, {_r('on_peak', 'off_peak', 'spread', 'all_hours')}, n_on_peak, n_off_peak FROM {_blocks(period)}"


def _spread(period: str) -> str:
    return f"""(SELECT {_label(period)} AS period, avg(s) AS mean_spread, median(s) AS median_spread, count(*) AS n_days
  FROM (SELECT d, max(price) - min(price) AS s, sum(w) AS hours FROM lp GROUP BY d) WHERE hours >= 23 GROUP BY 1)"""


def _negative(period: str) -> str:
    return f"(SELECT {_label(period)} AS period, 100 * coalesce(sum(w) FILTER (price < 0), 0) / nullif(sum(w), 0) AS negative_pct, sum(w) AS observed_hours FROM lp GROUP BY 1)"


def _capture(fuel: str, period: str) -> str:
    return f"""(SELECT period, CASE WHEN e > 0 THEN earned / e END AS capture_price, base AS baseload_price,
  CASE WHEN e > 0 THEN earned / e END / nullif(base, 0) AS capture_rate, e AS energy_mwh, hrs AS covered_hours FROM (
  SELECT {_label(period)} AS period, sum(g * hh) AS e, sum(price * g * hh) AS earned, sum(price * hh) / nullif(sum(hh), 0) AS base, sum(hh) AS hrs FROM (
   SELECT CAST({_local("s")} AS DATE) AS d, price, g, epoch(t - s) / 3600 AS hh FROM (
    SELECT greatest(a.ts_utc, b.ts_utc) AS s, least(a.ts_utc + to_minutes(a.res), b.ts_utc + to_minutes(b.res)) AS t, a.price, b.gen_mw AS g
    FROM price a JOIN gen b ON b.fuel = '{fuel}' AND a.ts_utc < b.ts_utc + to_minutes(b.res) AND b.ts_utc < a.ts_utc + to_minutes(a.res))) GROUP BY 1))"""


_CAPTURE_COLUMNS = ("capture_price", "baseload_price", "capture_rate", "energy_mwh", "covered_hours")


def _capture_query(fuel: str, period: str) -> str:
    return f"WITH {_PRICE}, {_GEN} SELECT period, {_r(*_CAPTURE_COLUMNS)} FROM {_capture(fuel, period)}"


def _hourly(name: str, source: str, column: str) -> str:
    """Complete UTC hours as local clock cells (January: every cell is one hour)."""
    return f"""{name} AS (SELECT CAST({_local("hr")} AS DATE) AS local_date, CAST(hour({_local("hr")}) AS INT) AS local_hour, hr AS ts_utc, v AS {column}, cov AS covered_hours FROM (
  SELECT hr, sum({column} * res / 60.0) / sum(res / 60.0) AS v, sum(res / 60.0) AS cov, min(ts_utc) AS f, max(ts_utc + to_minutes(res)) AS l,
    bool_and(prev IS NULL OR prev = ts_utc) AS ok, bool_and({column} IS NOT NULL) AS full_ FROM (
    SELECT *, date_trunc('hour', ts_utc) AS hr, lag(ts_utc + to_minutes(res)) OVER (PARTITION BY date_trunc('hour', ts_utc) ORDER BY ts_utc) AS prev FROM {source}) GROUP BY hr)
  WHERE ok AND full_ AND f = hr AND l = hr + INTERVAL 1 HOUR AND abs(cov - 1) < 1e-9)"""


_HM = _hourly("hm", "price", "price")
_PANEL = """p AS (SELECT CAST(o_orderdate AS DATE) AS local_date, CAST((o_orderkey % 4) * 6 AS INT) AS local_hour, avg(o_totalprice) / 997 - 150 AS price FROM orders GROUP BY 1, 2)"""


def _lag(days: int) -> str:
    return f"LEFT JOIN p AS l{days} ON l{days}.local_date = p.local_date - {days} AND l{days}.local_hour = p.local_hour"


_FEATURES = f"""{_PANEL}, ds AS (SELECT local_date, avg(price) AS mean_, min(price) AS min_, max(price) AS max_, arg_max(price, local_hour) AS end_ FROM p GROUP BY 1),
f AS (SELECT p.*, l1.price AS price_d1, l2.price AS price_d2, l3.price AS price_d3, l7.price AS price_d7, y.mean_ AS price_d1_mean, y.min_ AS price_d1_min,
  y.max_ AS price_d1_max, y.end_ AS price_d1_end, k.mean_ AS price_d7_mean, CASE WHEN isodow(p.local_date) BETWEEN 2 AND 5 THEN l1.price ELSE l7.price END AS price_similar_day
  FROM p {_lag(1)} {_lag(2)} {_lag(3)} {_lag(7)} LEFT JOIN ds y ON y.local_date = p.local_date - 1 LEFT JOIN ds k ON k.local_date = p.local_date - 7)"""
_NAIVE = f"""{_FEATURES}, nf AS (SELECT * FROM (SELECT 'naive_previous_day' AS model, local_date, local_hour, price_d1 AS forecast, price AS actual FROM f
  UNION ALL SELECT 'naive_previous_week', local_date, local_hour, price_d7, price FROM f UNION ALL SELECT 'naive_similar_day', local_date, local_hour, price_similar_day, price FROM f) WHERE forecast IS NOT NULL)"""
_PRED = f"""{_NAIVE}, pr AS (SELECT * FROM nf WHERE (local_date, local_hour) IN (SELECT (local_date, local_hour) FROM nf GROUP BY local_date, local_hour HAVING count(DISTINCT model) = 3))"""
_RIDGE = f"""{_FEATURES}, rows_ AS (SELECT local_date, local_hour, price AS y, price_d1 AS x FROM f WHERE price_d1 IS NOT NULL),
m AS (SELECT *, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(x * y) OVER w AS sxy FROM rows_
  WINDOW w AS (PARTITION BY local_hour ORDER BY local_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _ridge_forecast(alpha: str) -> str:
    return f"sy / n + (x - sx / n) * (sxy / n - sx / n * sy / n) / ((sxx / n - sx / n * sx / n) * (1 + {alpha}))"


def _frame(level: float) -> str:
    return f"quantile_cont(e, {level}) OVER w"


_QUANT = f"""{_PRED}, q AS (SELECT * REPLACE (CASE WHEN c = 56 THEN forecast + q10 END AS q10, CASE WHEN c = 56 THEN forecast + q50 END AS q50, CASE WHEN c = 56 THEN forecast + q90 END AS q90) FROM (
  SELECT *, count(e) OVER w AS c, {_frame(0.1)} AS q10, {_frame(0.5)} AS q50, {_frame(0.9)} AS q90 FROM (SELECT *, actual - forecast AS e FROM pr)
  WINDOW w AS (PARTITION BY model, local_hour ORDER BY local_date ROWS BETWEEN 56 PRECEDING AND 1 PRECEDING)))"""


def _regime(source: str) -> str:
    return f"""CASE WHEN actual < 0 THEN 'negative' WHEN actual >= (SELECT quantile_cont(actual, 0.95) FROM (SELECT DISTINCT local_date, local_hour, actual FROM {source})) THEN 'scarcity' ELSE 'normal' END"""


def _scores() -> str:
    def pinball(q: str, level: float) -> str:
        return f"avg(CASE WHEN {q} IS NOT NULL THEN greatest({level} * (actual - {q}), ({level} - 1) * (actual - {q})) END) AS pinball_{q}"

    whole = "q10 IS NOT NULL AND q50 IS NOT NULL AND q90 IS NOT NULL"
    return f"""{_QUANT}, lab AS (SELECT *, {_regime("q")} AS regime, CASE WHEN local_hour >= 8 AND local_hour < 20 AND isodow(local_date) <= 5 THEN 'on_peak' ELSE 'off_peak' END AS block FROM q),
sc AS (SELECT x.scope AS scope, x.bucket AS bucket, model, count(*) AS n, count(*) FILTER ({whole}) AS n_interval,
  100 * avg(CASE WHEN {whole} THEN CAST(actual BETWEEN q10 AND q90 AS INT) END) AS interval_coverage_pct, avg(CASE WHEN {whole} THEN q90 - q10 END) AS interval_mean_width,
  avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) ** 2)) AS rmse, avg(actual - forecast) AS bias, avg(actual) AS mean_actual,
  {pinball("q10", 0.1)}, {pinball("q50", 0.5)}, {pinball("q90", 0.9)}
  FROM (SELECT *, unnest([{{'scope': 'overall', 'bucket': 'all'}}, {{'scope': 'block', 'bucket': block}}, {{'scope': 'regime', 'bucket': regime}},
    {{'scope': 'year', 'bucket': CAST(year(local_date) AS VARCHAR)}}, {{'scope': 'hour', 'bucket': lpad(CAST(local_hour AS VARCHAR), 2, '0')}}]) AS x FROM lab) GROUP BY ALL),
sk AS (SELECT *, (pinball_q10 + pinball_q50 + pinball_q90) / 3 AS mean_pinball, max(CASE WHEN model = 'naive_similar_day' THEN mae END) OVER b AS ref, min(mae) OVER b AS best FROM sc WINDOW b AS (PARTITION BY scope, bucket))"""


_ISSUES = f"""{_PANEL}, g AS (SELECT p.local_date AS delivery_date, p.local_hour, m.model, l.price AS forecast, k FROM p CROSS JOIN (VALUES ('ridge', 1), ('ridge_da', 7)) AS m(model, lag)
  CROSS JOIN (VALUES (0), (1), (2)) AS t(k) LEFT JOIN p AS l ON l.local_date = p.local_date - m.lag AND l.local_hour = p.local_hour),
i0 AS (SELECT model, delivery_date, local_hour, forecast, CASE WHEN dayofyear(delivery_date) % 5 = 0 THEN forecast + 1 END AS actual, 'issued_waiting_for_actual' AS status,
  CASE WHEN dayofyear(delivery_date) % 7 = 0 THEN 1 ELSE 2 END AS protocol_version, model || '-' || strftime(delivery_date, '%Y-%m-%d') || '-' || k AS issue_id,
  CAST(delivery_date - 1 AS TIMESTAMP) + to_minutes(480 + 90 * k) AS issued_at, {_UTC.format("(CAST(delivery_date - 1 AS TIMESTAMP) + INTERVAL 12 HOUR)")} AS gate FROM g),
iss AS (SELECT *, CASE WHEN issued_at - INTERVAL 30 MINUTE > issued_at THEN 'inputs_after_prediction' WHEN CAST({_local("issued_at")} AS DATE) <> delivery_date - 1 THEN 'outside_issue_day'
  WHEN issued_at >= gate THEN 'late_prediction' WHEN issued_at + INTERVAL 20 MINUTE >= gate THEN 'late_recording' ELSE 'pre_gate' END AS reason FROM i0)"""
_SETTLED = f"""{_ISSUES}, st AS (SELECT issue_id, delivery_date, iss.local_hour, forecast, coalesce(o.price, iss.actual) AS actual,
  CASE WHEN forecast IS NULL THEN 'abstain_missing_inputs' WHEN reason <> 'pre_gate' THEN CASE WHEN coalesce(o.price, iss.actual) IS NOT NULL THEN 'diagnostic_scored' ELSE 'diagnostic_waiting_for_actual' END
  WHEN coalesce(o.price, iss.actual) IS NULL THEN 'issued_waiting_for_actual' ELSE 'scored' END AS status
  FROM iss LEFT JOIN (SELECT * FROM p WHERE day(local_date) <= 20) o ON o.local_date = delivery_date AND o.local_hour = iss.local_hour)"""
_DAILY = """dm0 AS (SELECT ['naive_previous_day', 'naive_previous_week', 'naive_similar_day', 'ridge'][o_orderkey % 4 + 1] AS strategy, CAST(o_orderdate AS DATE) AS local_date,
  avg(o_totalprice) / 997 - 150 AS profit_eur FROM orders GROUP BY 1, 2), dm AS (SELECT *, CAST(2 AS DOUBLE) AS power_mw, CAST(4 AS DOUBLE) AS energy_mwh FROM dm0 WHERE local_date IN (SELECT local_date FROM dm0 GROUP BY 1 HAVING count(*) = 4))"""
_CAP = """cap AS (SELECT strftime(o_orderdate, '%Y') AS period, o_orderpriority AS technology, sum(o_totalprice) / 1e6 AS value, strftime(o_orderdate, '%Y') = '2001' AS is_planned FROM orders GROUP BY ALL)"""
_ATT = """att AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'ridge' ELSE 'ridge_da' END AS model, CAST(ts AS DATE) AS delivery_date, ts AS stamp,
  CASE WHEN event_id % 2 = 0 THEN 'schedule' ELSE 'manual' END AS origin, CASE WHEN event_id % 7 = 0 THEN 'started' ELSE CASE event_type WHEN 'click' THEN 'issued' WHEN 'view' THEN 'partial'
  WHEN 'signup' THEN 'abstained' WHEN 'purchase' THEN 'late' ELSE 'failed' END END AS status FROM events)"""
_DRAW = """dd AS (SELECT strategy, power_mw, energy_mwh, greatest(0, max(greatest(0, top) - bal)) AS max_drawdown_eur FROM (SELECT *, max(bal) OVER w AS top FROM (
  SELECT *, sum(profit_eur) OVER (PARTITION BY strategy ORDER BY local_date) AS bal FROM dm) WINDOW w AS (PARTITION BY strategy ORDER BY local_date)) GROUP BY ALL)"""
_WORST = """wm AS (SELECT strategy, power_mw, energy_mwh, month AS worst_observed_month, profit AS worst_observed_month_eur, n AS worst_month_observed_days FROM (
  SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY profit, month) AS k FROM (SELECT strategy, power_mw, energy_mwh, strftime(local_date, '%Y-%m') AS month, sum(profit_eur) AS profit, count(*) AS n FROM dm GROUP BY ALL)) WHERE k = 1)"""
_TOP5 = "(SELECT sum(v) FROM (SELECT unnest(list_reverse_sort(list_filter(vs, lambda z: z > 0))[1:5]) AS v)) / nullif(list_sum(list_filter(vs, lambda z: z > 0)), 0)"
_MONTHLY = """mo AS (SELECT strategy, energy_mwh, strftime(local_date, '%Y-%m') AS month, sum(profit_eur) AS profit_eur, count(*) AS days FROM dm GROUP BY ALL)"""
_MARGIN = f"""{_DAILY}, {_MONTHLY}, {_CAP}, my AS (SELECT substr(month, 1, 4) AS year, strategy, energy_mwh, sum(profit_eur) AS profit_eur, CAST(sum(days) AS BIGINT) AS days,
  sum(profit_eur) / sum(days) AS eur_per_mw_day, battery_power_gw, battery_energy_gwh FROM mo JOIN (SELECT period, max(value) FILTER (technology = '1-URGENT') AS battery_power_gw,
  max(value) FILTER (technology = '2-HIGH') AS battery_energy_gwh FROM cap WHERE NOT is_planned GROUP BY period) c ON c.period = substr(month, 1, 4) GROUP BY ALL)"""


def _corr(x: str, y: str) -> str:
    return f"""SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) AS pearson_r, min(year) AS fitted_year_min, max(year) AS fitted_year_max
  FROM my WHERE strategy = 'ridge' AND year < '2001' AND {x} IS NOT NULL AND {y} IS NOT NULL"""


_STRATEGY_DAYS = f"""{_PRICE}, {_HM}, full_days AS (SELECT local_date FROM hm GROUP BY 1 HAVING count(*) = 24)"""
_LEG = "sqrt(0.9)"


def oracle_sql() -> dict[str, str]:
    found = {
        "local_time_attach": f"""WITH {_PRICE}, {_lp()} SELECT ts_utc, loc AS ts_local, d AS local_date, h AS local_hour, block,
  CAST(epoch({_UTC.format("CAST(d + 1 AS TIMESTAMP)")} - {_UTC.format("CAST(d AS TIMESTAMP)")}) / 3600 AS INT) AS day_hours, {_UTC.format("(CAST(d - 1 AS TIMESTAMP) + INTERVAL 12 HOUR)")} AS gate FROM lp""",
        "delivery_hours_grid": f"""WITH days AS (SELECT CAST(unnest([DATE '2025-03-29', DATE '2025-03-30', DATE '2025-03-31', DATE '2025-10-25', DATE '2025-10-26', DATE '2025-10-27']) AS DATE) AS delivery_date),
  u AS (SELECT delivery_date, unnest(generate_series({_UTC.format("CAST(delivery_date AS TIMESTAMP)")}, {_UTC.format("CAST(delivery_date + 1 AS TIMESTAMP)")} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t FROM days)
  SELECT delivery_date, CAST(hour({_local("t")}) AS INT) AS local_hour, min(t) AS delivery_start_utc, CAST(count(*) AS DOUBLE) AS delivery_duration_hours FROM u GROUP BY 1, 2""",
        "block_prices_day": _block_query("day"),
        "block_prices_month": _block_query("month"),
        "block_prices_all": _block_query("all"),
        "intraday_spread_month": f"WITH {_PRICE}, {_lp()} SELECT period, {_r('mean_spread', 'median_spread')}, n_days FROM {_spread('month')}",
        "hourly_shape_month": f"WITH {_PRICE}, {_lp()} SELECT strftime(d, '%Y-%m') AS period, h AS local_hour, round(sum(price * w) / sum(w), 6) AS price, round(sum(w), 6) AS observed_hours, count(*) AS n_intervals FROM lp GROUP BY 1, 2",
        "negative_share_month": f"WITH {_PRICE}, {_lp()} SELECT period, {_r('negative_pct', 'observed_hours')} FROM {_negative('month')}",
        "generation_mix_month": f"""WITH {_EV}, {_GEN}, {_lp("gen")}, e AS (SELECT strftime(d, '%Y-%m') AS period, fuel, sum(gen_mw * w) AS energy_mwh FROM lp WHERE fuel <> 'imports' GROUP BY 1, 2)
  SELECT period, fuel, round(energy_mwh, 6) AS energy_mwh, round(100 * energy_mwh / nullif(sum(energy_mwh) OVER (PARTITION BY period), 0), 6) AS share_pct FROM e""",
        "capture_rate_solar_month": _capture_query("solar", "month"),
        "capture_rate_wind_all": _capture_query("wind", "all"),
        "cannibalisation_month": f"WITH {_PRICE}, {_GEN} SELECT period, {_r(*_CAPTURE_COLUMNS)}, fuel FROM (SELECT *, 'solar' AS fuel FROM {_capture('solar', 'month')} UNION ALL SELECT *, 'wind' FROM {_capture('wind', 'month')})",
        "price_shape_pct": f"""WITH {_PRICE}, {_lp()}, b AS (SELECT * FROM {_blocks("year")}), s AS (SELECT strftime(d, '%Y') AS year, h AS local_hour, sum(price * w) / sum(w) AS price, sum(w) AS observed_hours, count(*) AS n_intervals FROM lp GROUP BY 1, 2)
  SELECT year, local_hour, round(price, 6) AS price, round(100 * price / nullif(all_hours, 0), 6) AS pct_of_baseload, round(all_hours, 6) AS baseload_price, round(observed_hours, 6) AS observed_hours, n_intervals FROM s LEFT JOIN b ON b.period = s.year""",
        "daily_price_segments": f"""WITH {_PRICE}, part AS (SELECT * REPLACE (CASE WHEN day(ts_utc) % 2 = 0 THEN ts_utc + INTERVAL 364 DAY ELSE ts_utc END AS ts_utc) FROM price), {_lp("part")}, b AS (SELECT * FROM {_blocks("day")})
  SELECT period AS date, {_r("on_peak", "off_peak", "spread", "all_hours")}, n_on_peak, n_off_peak, CAST(sum(gap) OVER (ORDER BY period) AS BIGINT) AS segment, 'EUR' AS currency, 'DE-LU' AS zone
  FROM (SELECT *, CAST(coalesce(CAST(period AS DATE) - lag(CAST(period AS DATE)) OVER (ORDER BY period), 1) > 1 AS INT) AS gap FROM b)""",
        "hourly_mean_complete": f"WITH {_PRICE}, {_HM} SELECT local_date, local_hour, ts_utc, {_r('price', 'covered_hours')} FROM hm",
        "residual_load_hourly": f"""WITH {_EV}, {_LOAD}, {_GEN}, both_ AS (SELECT ts_utc, any_value(res) AS res, sum(gen_mw) AS gen_mw FROM gen WHERE fuel IN ('wind', 'solar') GROUP BY ts_utc HAVING count(*) = 2 AND count(DISTINCT fuel) = 2 AND count(DISTINCT res) = 1),
  {_hourly("hl", "loads", "load_mw")}, {_hourly("hg", "both_", "gen_mw")} SELECT hl.local_date, hl.local_hour, round(load_mw - gen_mw, 6) AS residual_mw, round(hl.covered_hours, 6) AS covered_hours FROM hl JOIN hg USING (ts_utc)""",
        "cadence_by_day": f"""WITH {_PRICE}, s AS (SELECT ts_utc, CAST({_local("ts_utc")} AS DATE) AS day FROM price), t AS (SELECT day, CAST(epoch(ts_utc - lag(ts_utc) OVER (PARTITION BY day ORDER BY ts_utc)) / 60 AS INT) AS step FROM s),
  u AS (SELECT day, min(step) AS least_, list(step) FILTER (step IS NOT NULL) AS steps, count(*) AS n_stamps FROM t GROUP BY day)
  SELECT day, coalesce(least_, last_value(least_ IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(least_ IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS resolution_min,
  n_stamps, coalesce(len(list_filter(steps, lambda z: z % least_ <> 0)) = 0, true) AS regular FROM u""",
        "contract_violations": f"""WITH {_PRICE}, v AS (SELECT ts_utc, CASE WHEN price <= 30 THEN price * 1000 END AS price, CAST(floor(res + minute(ts_utc) / 45.0) AS INT) AS res FROM price)
  SELECT 'price' AS dataset, r.rule AS rule, CAST(r.n AS BIGINT) AS violations FROM (SELECT unnest([{{'rule': 'zone', 'n': 0}}, {{'rule': 'ts_utc', 'n': 0}}, {{'rule': 'source', 'n': 0}}, {{'rule': 'currency', 'n': 0}},
  {{'rule': 'resolution_min', 'n': count(*) FILTER (res NOT IN (1, 5, 15, 30, 60))}}, {{'rule': 'price', 'n': count(*) FILTER (price IS NULL OR price < -10000 OR price > 100000)}}, {{'rule': 'unique_key', 'n': count(*) - count(DISTINCT ts_utc)}}]) AS r FROM v)""",
        "store_upsert_latest": f"""WITH {_PRICE}, rev AS (SELECT ts_utc, price + 100 AS price FROM price WHERE hour(ts_utc) % 3 = 0)
  SELECT 'DE-LU' AS zone, ts_utc, round(price, 6) AS price FROM (SELECT ts_utc, CASE WHEN hour(ts_utc) % 3 = 0 THEN price + 100 ELSE price END AS price FROM price UNION ALL SELECT ts_utc + INTERVAL 40 DAY, price FROM rev)""",
        "store_coverage": f"""WITH {_PRICE}, {_LOAD}, {_GEN} SELECT 'DE-LU' AS zone, dataset, count(*) AS rows, min(ts_utc) AS first_ts_utc, max(ts_utc) AS last_ts_utc, count(DISTINCT strftime(ts_utc, '%Y-%m')) AS partitions
  FROM (SELECT 'price' AS dataset, ts_utc FROM price UNION ALL SELECT 'load', ts_utc FROM loads UNION ALL SELECT 'generation', ts_utc FROM gen) GROUP BY dataset""",
        "quality_audit": f"""WITH {_EV}, {_GEN}, s AS (SELECT *, epoch(lead(ts_utc) OVER (PARTITION BY fuel ORDER BY ts_utc) - (ts_utc + to_minutes(res))) AS gap FROM gen)
  SELECT 'DE-LU' AS zone, fuel, 'generation' AS dataset, count(*) AS rows, min(ts_utc) AS first, max(ts_utc + to_minutes(res)) AS last, round(sum(res) / 60.0, 6) AS observed_hours, round(coalesce(sum(gap) FILTER (gap > 0), 0) / 3600.0, 6) AS gap_hours,
  count(*) FILTER (coalesce(gap < 0, false) OR gen_mw IS NULL OR CAST(epoch(ts_utc) AS BIGINT) % (res * 60) <> 0) AS invalid, round(least(100.0, 100 * sum(res) / 60.0 / (epoch(max(ts_utc + to_minutes(res)) - min(ts_utc)) / 3600)), 6) AS coverage_pct FROM s GROUP BY fuel""",
        "freshness_report": f"""WITH {_PRICE}, {_LOAD}, {_GEN}, l AS (SELECT 'price' AS dataset, max(ts_utc) AS t FROM price UNION ALL SELECT 'load', min(ts_utc) FROM loads UNION ALL SELECT 'generation', max(ts_utc) FROM gen)
  SELECT 'DE-LU' AS zone, x.dataset, round(epoch(TIMESTAMP '2024-02-01' - t) / 3600, 6) AS lag_hours, CASE WHEN t IS NULL THEN 'MISSING' WHEN epoch(TIMESTAMP '2024-02-01' - t) / 3600 > 36 THEN 'STALE' ELSE 'ok' END AS severity
  FROM (VALUES ('price'), ('load'), ('generation'), ('fundamentals')) AS x(dataset) LEFT JOIN l ON l.dataset = x.dataset""",
        "probe_served_hours": f"""WITH {_EV}, {_GEN}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS delivery_date),
  sv AS (SELECT fuel AS series, CAST({_local("ts_utc")} AS DATE) AS delivery_date, count(DISTINCT date_trunc('hour', ts_utc)) AS n FROM gen GROUP BY 1, 2)
  SELECT f.series, days.delivery_date, CAST(24 AS BIGINT) AS hours_expected, coalesce(n, 0) AS hours_covered,
  CAST(floor(epoch({_UTC.format("(CAST(days.delivery_date - 1 AS TIMESTAMP) + INTERVAL 12 HOUR)")} - TIMESTAMP '2024-01-15 09:30:45') / 60) AS BIGINT) AS minutes_before_gate
  FROM days CROSS JOIN (VALUES ('wind'), ('solar'), ('gas'), ('nuclear')) AS f(series) LEFT JOIN sv ON sv.series = f.series AND sv.delivery_date = days.delivery_date""",
        "calendar_lags": f"WITH {_FEATURES} SELECT local_date, local_hour, {_r('price', 'price_d1', 'price_d2', 'price_d3', 'price_d7')} FROM f",
        "daily_stats_lag": f"WITH {_FEATURES} SELECT local_date, local_hour, {_r('price_d1_mean', 'price_d1_min', 'price_d1_max', 'price_d1_end', 'price_d7_mean')} FROM f",
        "similar_day": f"WITH {_FEATURES} SELECT local_date, local_hour, {_r('price_similar_day')} FROM f",
        "calendar_features": f"WITH {_PANEL} SELECT local_date, CAST(isodow(local_date) AS INT) AS dow, {', '.join(f'CAST(isodow(local_date) = {k} AS DOUBLE) AS dow_{k}' for k in range(2, 8))}, round(sin(2 * pi() * (dayofyear(local_date) - 1) / 365.25), 6) AS year_sin, round(cos(2 * pi() * (dayofyear(local_date) - 1) / 365.25), 6) AS year_cos FROM (SELECT DISTINCT local_date FROM p)",
        "point_in_time_fundamentals": f"""WITH {_PRICE}, {_HM}, vt AS (SELECT date_trunc('hour', ts) AS ts_utc, date_trunc('hour', ts) - to_hours(CAST((event_id % 6) * 8 AS INT)) AS published_at, avg(value) FILTER (event_type = 'signup') AS load,
  avg(value) FILTER (event_type = 'click') AS wind, avg(value) FILTER (event_type = 'view') AS solar FROM ev WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1, 2),
  c AS (SELECT hm.local_date, hm.local_hour, vt.*, {_UTC.format("(CAST(hm.local_date - 1 AS TIMESTAMP) + INTERVAL 12 HOUR)")} AS gate FROM hm JOIN vt USING (ts_utc)),
  b AS (SELECT *, row_number() OVER (PARTITION BY local_date, local_hour ORDER BY published_at DESC) AS k FROM c WHERE published_at <= gate)
  SELECT hm.local_date, hm.local_hour, {_r("load", "wind", "solar")}, CAST(floor(epoch(gate - published_at) / 3600) AS BIGINT) AS forecast_age_hours FROM hm LEFT JOIN b ON b.local_date = hm.local_date AND b.local_hour = hm.local_hour AND k = 1""",
        "fundamentals_hourly_wide": f"""WITH {_EV}, {_GEN}, m AS (SELECT date_trunc('hour', ts_utc) AS hr, fuel, sum(gen_mw * res / 60.0) / sum(res / 60.0) AS mw FROM gen GROUP BY 1, 2 HAVING sum(res) = 60)
  SELECT hr AS ts_utc, round(max(mw) FILTER (fuel = 'gas'), 6) AS load, round(max(mw) FILTER (fuel = 'wind'), 6) AS wind, round(max(mw) FILTER (fuel = 'solar'), 6) AS solar FROM m WHERE fuel IN ('gas', 'wind', 'solar') GROUP BY 1""",
        "sanitized_panel": f"WITH {_FEATURES} SELECT local_date, local_hour, round(CASE WHEN local_date < DATE '1998-01-01' THEN price END, 6) AS price, {_r('price_d1')} FROM f WHERE local_date <= DATE '1998-01-01'",
        "losing_buckets": f"WITH {_scores()} SELECT scope, bucket, round((1 - mae / best) * 100, 6) AS skill_vs_best_baseline_pct FROM sk WHERE model = 'naive_previous_day' AND best > 0 AND mae > best",
        "monthly_margins": f"WITH {_DAILY} SELECT strategy, power_mw, energy_mwh, strftime(local_date, '%Y-%m') AS month, count(*) AS days, round(sum(profit_eur), 6) AS profit_eur FROM dm GROUP BY ALL",
        "data_as_of": f"WITH {_EV}, {_GEN} SELECT max(ts_utc) AS data_as_of FROM gen",
        "naive_forecasts": f"WITH {_NAIVE} SELECT model, local_date, local_hour, {_r('forecast')} FROM nf",
        "ridge_walk_forward_1f": f"WITH {_RIDGE} SELECT local_date, local_hour, round({_ridge_forecast('0.1')}, 6) AS forecast FROM m WHERE n >= 30",
        "ridge_coefficients_1f": f"""WITH {_FEATURES}, c AS (SELECT local_hour, covar_pop(price, price_d1) / (var_pop(price_d1) * 1.1) AS coefficient, stddev_pop(price_d1) AS train_sd FROM f WHERE price_d1 IS NOT NULL GROUP BY 1)
  SELECT local_hour, 'price_d1' AS feature, {_r("coefficient", "train_sd")}, round(coefficient * train_sd, 6) AS effect FROM c""",
        "alpha_search_1f": f"""WITH {_RIDGE} SELECT CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, round(avg(abs(y - ({_ridge_forecast("alpha")}))), 6) AS mae FROM m CROSS JOIN (VALUES (0.01), (0.03), (0.1), (0.3), (1.0), (3.0), (10.0)) AS a(alpha)
  WHERE n >= 30 AND local_date BETWEEN DATE '1995-10-01' AND DATE '1995-12-31' GROUP BY alpha""",
        "common_sample": f"WITH {_PRED} SELECT model, local_date, local_hour, {_r('forecast')} FROM pr",
        "conformal_quantiles": f"WITH {_QUANT} SELECT model, local_date, local_hour, {_r('q10', 'q50', 'q90')} FROM q",
        "regime_labels": f"WITH {_PRED} SELECT model, local_date, local_hour, {_regime('pr')} AS regime FROM pr",
        "scoreboard": f"""WITH {_scores()} SELECT scope, bucket, model, n, n_interval, {_r("interval_coverage_pct", "interval_mean_width", "mae", "rmse", "bias", "mean_actual", "pinball_q10", "pinball_q50", "pinball_q90", "mean_pinball")},
  round(CASE WHEN ref > 0 THEN (1 - mae / ref) * 100 END, 6) AS skill_pct, round(CASE WHEN best > 0 THEN (1 - mae / best) * 100 END, 6) AS skill_vs_best_baseline_pct FROM sk""",
        "extreme_years": f"WITH {_scores()} SELECT model, arg_max(bucket, mae) AS worst_year, arg_min(bucket, mae) AS calmest_year FROM sk WHERE scope = 'year' GROUP BY model",
        "daily_errors": f"WITH {_PRED} SELECT model, local_date, count(*) AS n, round(avg(abs(actual - forecast)), 6) AS mae, round(avg(actual), 6) AS mean_actual FROM pr GROUP BY 1, 2",
        "validation_error": f"WITH {_PRED} SELECT model, count(*) AS n, round(avg(abs(actual - forecast)), 6) AS mae FROM pr WHERE local_date BETWEEN DATE '1995-10-01' AND DATE '1995-12-31' GROUP BY 1",
        "battery_complete_days": f"WITH {_STRATEGY_DAYS} SELECT local_date FROM full_days",
        "dispatch_two_state_profit": f"""WITH {_STRATEGY_DAYS} SELECT a.local_date, round(greatest(0, coalesce(max(0.5 * {_LEG} * b.price - 0.5 / {_LEG} * a.price), 0)), 6) AS profit_eur, CAST(24 AS BIGINT) AS intervals
  FROM hm a JOIN hm b ON a.local_date = b.local_date AND a.ts_utc < b.ts_utc WHERE a.local_date IN (SELECT local_date FROM full_days) GROUP BY 1""",
        "battery_coverage": f"""WITH {_STRATEGY_DAYS}, c AS (SELECT t.local_date, count(*) AS n FROM hm t JOIN hm y ON y.local_date = t.local_date - 1 AND y.local_hour = t.local_hour GROUP BY 1), k AS (SELECT count(*) AS n FROM c WHERE n = 24)
  SELECT 'naive_previous_day' AS model, (SELECT count(*) FROM c) AS candidate_days, k.n AS complete_days, k.n AS common_days, (SELECT count(*) FROM c) - k.n AS excluded_days FROM k
  UNION ALL SELECT 'ridge', (SELECT count(DISTINCT local_date) FROM hm), (SELECT count(*) FROM full_days), k.n, (SELECT count(DISTINCT local_date) FROM hm) - k.n FROM k""",
        "risk_metrics": f"""WITH {_DAILY}, {_DRAW}, {_WORST}, t AS (SELECT strategy, power_mw, energy_mwh, count(*) AS days, sum(profit_eur) AS profit_eur, min(profit_eur) AS worst_day_eur, count(*) FILTER (profit_eur < 0) AS loss_days, list(profit_eur) AS vs FROM dm GROUP BY ALL),
  best AS (SELECT strategy AS name, profit_eur AS p FROM t WHERE strategy LIKE 'naive%' ORDER BY profit_eur DESC, strategy LIMIT 1)
  SELECT strategy, power_mw, energy_mwh, days, {_r("profit_eur")}, round(profit_eur / power_mw, 6) AS profit_eur_mw, {_r("worst_day_eur")}, loss_days, {_r("max_drawdown_eur")}, worst_observed_month, {_r("worst_observed_month_eur")}, worst_month_observed_days,
  round({_TOP5}, 6) AS top_5_days_share_positive_margin, name AS best_naive, 'retrospective_in_sample' AS best_naive_selection, round((profit_eur - p) / power_mw, 6) AS incremental_vs_best_naive_eur_mw FROM t JOIN dd USING (strategy, power_mw, energy_mwh) JOIN wm USING (strategy, power_mw, energy_mwh), best""",
        "worst_month": f"WITH {_DAILY}, {_WORST} SELECT strategy, power_mw, energy_mwh, worst_observed_month, {_r('worst_observed_month_eur')}, worst_month_observed_days FROM wm",
        "drawdown": f"WITH {_DAILY}, {_DRAW} SELECT strategy, power_mw, energy_mwh, {_r('max_drawdown_eur')} FROM dd",
        "cumulative_margin": f"WITH {_DAILY}, t AS (SELECT strategy, power_mw, energy_mwh, strftime(local_date, '%Y-%m') AS month, sum(profit_eur) AS profit_eur, count(*) AS days FROM dm GROUP BY ALL) SELECT strategy, power_mw, energy_mwh, month, {_r('profit_eur')}, days, round(sum(t.profit_eur) OVER (PARTITION BY strategy ORDER BY month), 6) AS cumulative_eur FROM t",
        "paired_comparisons_point": f"""WITH {_DAILY}, pd AS (SELECT a.strategy, b.strategy AS baseline, a.power_mw, a.energy_mwh, a.local_date, (a.profit_eur - b.profit_eur) / a.power_mw AS delta, (a.local_date - min(a.local_date) OVER ()) // 7 AS blk
  FROM dm a JOIN dm b ON b.local_date = a.local_date AND b.strategy LIKE 'naive%' WHERE a.strategy = 'ridge'),
  t AS (SELECT strategy, baseline, power_mw, energy_mwh, count(*) AS paired_days, count(DISTINCT blk) AS calendar_blocks, sum(delta) AS incremental_eur_mw, avg(delta) AS mean_daily_incremental_eur_mw, count(*) FILTER (delta < 0) AS underperform_days, list(delta) AS vs FROM pd GROUP BY ALL)
  SELECT strategy, baseline, power_mw, energy_mwh, paired_days, calendar_blocks, {_r("incremental_eur_mw", "mean_daily_incremental_eur_mw")}, underperform_days, round({_TOP5}, 6) AS top_5_days_share_positive_incremental,
  round(t.incremental_eur_mw - (SELECT coalesce(sum(v), 0) FROM (SELECT unnest(list_reverse_sort(list_filter(vs, lambda z: z > 0))[1:5]) AS v)), 6) AS incremental_without_best_5_days_eur_mw, 7 AS block_days,
  CASE WHEN calendar_blocks < 8 THEN 'insufficient_blocks' WHEN paired_days < 56 THEN 'insufficient_days' ELSE 'exploratory' END AS status FROM t""",
        "weaken_signal": f"""WITH {_PRED} SELECT CASE WHEN a.model = 'naive_similar_day' THEN 'ridge' ELSE a.model END AS model, a.local_date, a.local_hour,
  round(CASE WHEN a.model = 'naive_similar_day' THEN b.forecast + 0.5 * (a.forecast - b.forecast) ELSE a.forecast END, 6) AS forecast FROM pr a LEFT JOIN pr b ON b.model = 'naive_previous_day' AND b.local_date = a.local_date AND b.local_hour = a.local_hour""",
        "calendar_outages": f"WITH {_DAILY} SELECT strategy, local_date, round(CASE WHEN (((local_date - DATE '2025-01-01') % 20) + 20) % 20 = 0 THEN 0 ELSE profit_eur END, 6) AS profit_eur FROM dm",
        "ledger_timing": f"WITH {_ISSUES} SELECT model, reason AS eligibility_reason, count(*) AS n FROM iss GROUP BY 1, 2",
        "ledger_reconcile": f"WITH {_SETTLED} SELECT issue_id, delivery_date, local_hour, {_r('forecast', 'actual')}, status FROM st",
        "ledger_status_counts": f"WITH {_SETTLED} SELECT status, count(*) AS n FROM st GROUP BY 1",
        "ledger_canonical": f"""WITH {_ISSUES}, v AS (SELECT * FROM iss WHERE reason = 'pre_gate' AND protocol_version = 2), u AS (SELECT model, delivery_date, issued_at, issue_id, count(*) AS n, count(forecast) AS k FROM v GROUP BY ALL),
  w AS (SELECT u.*, row_number() OVER (PARTITION BY model, u.delivery_date ORDER BY issued_at, issue_id) AS place FROM u JOIN (SELECT local_date, count(*) AS cells FROM p GROUP BY 1) c ON c.local_date = u.delivery_date WHERE k = n AND n = cells)
  SELECT issue_id, model, delivery_date, issued_at, local_hour, {_r("forecast")} FROM v WHERE issue_id IN (SELECT issue_id FROM w WHERE place = 1)""",
        "ledger_append_merge": f"""WITH {_ISSUES}, a AS (SELECT *, day(delivery_date) AS dd FROM iss) SELECT issue_id, local_hour, round(CASE WHEN dd < 10 THEN actual WHEN dd % 2 = 0 THEN coalesce(forecast * 2, CASE WHEN dd <= 15 THEN actual END) WHEN dd <= 15 THEN actual END, 6) AS actual,
  CASE WHEN dd < 10 THEN status WHEN dd <= 15 AND NOT coalesce(dd % 2 = 0 AND forecast IS NOT NULL, false) AND actual IS NOT NULL THEN status ELSE 'scored' END AS status FROM a""",
        "attempts_best_status": f"""WITH {_ATT}, b AS (SELECT model, delivery_date, arg_min(status, list_position(['issued', 'partial', 'abstained', 'late', 'failed', 'started'], status)) AS best FROM att GROUP BY 1, 2)
  SELECT b.model, count(*) AS days, count(*) FILTER (best = 'issued') AS issued, count(*) FILTER (best = 'partial') AS partial, count(*) FILTER (best = 'abstained') AS abstained, count(*) FILTER (best = 'late') AS late,
  count(*) FILTER (best IN ('failed', 'started')) AS failed, any_value(m.as_of) AS as_of FROM b JOIN (SELECT model, max(stamp) AS as_of FROM att GROUP BY 1) m USING (model) GROUP BY b.model""",
        "attempts_report": f"""WITH {_ATT}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS delivery_date),
  e AS (SELECT *, status = 'issued' AND event_id % 3 = 0 AS ok FROM att WHERE model = 'ridge'), t AS (SELECT delivery_date, count(*) AS attempts, count(*) FILTER (origin = 'schedule') AS sch, count(*) FILTER (status = 'failed') AS fl, bool_or(ok) AS ok, list_distinct(list(status)) AS s FROM e GROUP BY 1)
  SELECT days.delivery_date, CAST(24 AS BIGINT) AS expected_hours, coalesce(attempts, 0) AS attempts, coalesce(sch, 0) AS scheduled_attempts, coalesce(fl, 0) AS failed_attempts,
  CASE WHEN attempts IS NULL THEN 'missing_attempt' WHEN ok THEN 'issued' WHEN list_contains(s, 'started') THEN 'started' WHEN list_contains(s, 'issued') THEN 'issued_unverified' WHEN list_contains(s, 'partial') THEN 'partial' WHEN list_contains(s, 'abstained') THEN 'abstained'
  WHEN list_contains(s, 'late') THEN 'late' WHEN list_contains(s, 'failed') THEN 'failed' ELSE 'missing_attempt' END AS status, coalesce(ok, false) AS eligible, CASE WHEN ok THEN 'ridge-' || strftime(days.delivery_date, '%Y-%m-%d') || '-0' END AS issue_id
  FROM days LEFT JOIN t USING (delivery_date)""",
        "capacity_price_yearly": f"""WITH {_PRICE}, {_GEN}, {_lp()}, {_CAP}, c AS (SELECT CASE WHEN period = '2000' THEN '2024' ELSE period END AS year, technology, value FROM cap WHERE NOT is_planned)
  SELECT b.period AS year, {_r("spread")}, round(100 * b.spread / nullif(all_hours, 0), 6) AS spread_pct_of_price, round(all_hours, 6) AS baseload_price, round(s.value, 6) AS solar_capacity_gw, round((SELECT sum(value) FROM c w WHERE w.year = b.period AND technology IN ('2-HIGH', '3-MEDIUM')), 6) AS wind_capacity_gw,
  {_r("negative_pct")}, round(cs.capture_rate, 6) AS solar_capture_rate, round(cw.capture_rate, 6) AS wind_capture_rate, round(mean_spread, 6) AS intraday_spread, round(median_spread, 6) AS intraday_spread_median, n_days AS intraday_n_days, round(100 * mean_spread / nullif(all_hours, 0), 6) AS intraday_spread_pct_of_price
  FROM {_blocks("year")} b JOIN c s ON s.year = b.period AND s.technology = '1-URGENT' LEFT JOIN {_negative("year")} n ON n.period = b.period LEFT JOIN {_capture("solar", "year")} cs ON cs.period = b.period LEFT JOIN {_capture("wind", "year")} cw ON cw.period = b.period LEFT JOIN {_spread("year")} i ON i.period = b.period""",
        "battery_margin_yearly": f"WITH {_MARGIN} SELECT year, strategy, energy_mwh, {_r('profit_eur')}, days, {_r('eur_per_mw_day', 'battery_power_gw', 'battery_energy_gwh')} FROM my",
        "correlations": f"WITH {_MARGIN} SELECT x, y, n, round(pearson_r, 6) AS pearson_r, fitted_year_min, fitted_year_max FROM ({_corr('battery_power_gw', 'eur_per_mw_day')} UNION ALL {_corr('battery_energy_gwh', 'days')} UNION ALL {_corr('energy_mwh', 'days')}) WHERE n >= 3 AND pearson_r IS NOT NULL AND NOT isnan(pearson_r)",
        "extrapolation_flags": f"""WITH {_CAP}, rl AS (SELECT technology, max(value) AS realised_max_gw, arg_max(period, value) AS realised_max_year FROM cap WHERE NOT is_planned AND period < '2001' GROUP BY 1)
  SELECT t.target AS planned_technology, t.tech AS technology, {_r("realised_max_gw")}, realised_max_year, round(c.value, 6) AS planned_gw, c.value > realised_max_gw AS exceeds_realised_max
  FROM (VALUES ('1-URGENT', '1-URGENT'), ('1-URGENT', '2-HIGH'), ('5-LOW', '5-LOW')) AS t(target, tech) JOIN cap c ON c.technology = t.target AND c.is_planned AND c.period = '2001' JOIN rl ON rl.technology = t.tech""",
        "fleet_duration": f"WITH {_CAP} SELECT period, round(max(value) FILTER (technology = '2-HIGH') / nullif(max(value) FILTER (technology = '1-URGENT'), 0), 6) AS duration_hours FROM cap WHERE NOT is_planned GROUP BY 1",
    }
    from .oracles_protocol import protocol_sql

    return found | protocol_sql()

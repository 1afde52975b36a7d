"""Registered queries: one per operator, over facts derived from the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.expr import rounded
from wattline.functions.ship import ship_package
from wattline.functions.timeaxis import DE_LU, attach_block, attach_local_time, day_hours, delivery_hours, market_gate, utc_literal
from wattline.functions.work import saved, work_folder
from wattline.operators import intervals, ledger, models, pit, prices, quality, risk, scoring, storage, trees
from wattline.plans import backtest, exports, issuing, publishing, registry, study
from wattline.plans.backtest import BacktestResult
from wattline.plans.panel import Panel, build_panel, price_features, sanitized
from wattline.sources import contracts, evidence, feeds, fixtures, logs, store
from wattline.sources import ledger_store as ledger_files
from wattline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Dates that part the multi-year panel into training, validation and test.
VALIDATION = (dt.date(1995, 10, 1), dt.date(1995, 12, 31))
TREE_SPLIT = dt.date(1998, 1, 1)
NOW = dt.datetime(2024, 2, 1)


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return rounded(build(spark, sf_dir))

    _QUERIES[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Local time and prices


@query
def local_time_attach(spark, d):
    rows = attach_block(attach_local_time(fixtures.price(spark, d), DE_LU), DE_LU)
    return rows.select("ts_utc", "ts_local", "local_date", "local_hour", "block", day_hours(F.col("local_date"), DE_LU).alias("day_hours"), market_gate(F.col("local_date"), DE_LU).alias("gate"))


@query
def delivery_hours_grid(spark, d):
    days = spark.sql("select explode(sequence(date'2025-03-29', date'2025-03-31')) delivery_date union all select explode(sequence(date'2025-10-25', date'2025-10-27'))")
    return delivery_hours(days, DE_LU)


@query
def block_prices_day(spark, d):
    return prices.block_prices(fixtures.price(spark, d), DE_LU, "day")


@query
def block_prices_month(spark, d):
    return prices.block_prices(fixtures.price(spark, d), DE_LU, "month")


@query
def block_prices_all(spark, d):
    return prices.block_prices(fixtures.price(spark, d), DE_LU, "all")


@query
def intraday_spread_month(spark, d):
    return prices.intraday_spread(fixtures.price(spark, d), DE_LU, "month")


@query
def hourly_shape_month(spark, d):
    return prices.hourly_shape(fixtures.price(spark, d), DE_LU, "month")


@query
def negative_share_month(spark, d):
    return prices.negative_share(fixtures.price(spark, d), DE_LU, "month")


@query
def generation_mix_month(spark, d):
    return prices.generation_mix(fixtures.generation(spark, d), DE_LU, "month")


@query
def capture_rate_solar_month(spark, d):
    return prices.capture_rate(fixtures.price(spark, d), fixtures.generation(spark, d), DE_LU, "solar", "month")


@query
def capture_rate_wind_all(spark, d):
    return prices.capture_rate(fixtures.price(spark, d), fixtures.generation(spark, d), DE_LU, "wind", "all")


@query
def price_shape_pct(spark, d):
    return prices.price_shape(fixtures.price(spark, d), DE_LU)


@query
def daily_price_segments(spark, d):
    # Every other day moves a year ahead, so that days have gaps between them.
    moved = F.when(F.dayofmonth("ts_utc") % 2 == 0, F.timestamp_add("DAY", F.lit(364), F.col("ts_utc"))).otherwise(F.col("ts_utc"))
    return prices.daily_price_segments(fixtures.price(spark, d).withColumn("ts_utc", moved), DE_LU)


@query
def cannibalisation_month(spark, d):
    return exports.cannibalisation(fixtures.price(spark, d), fixtures.generation(spark, d), DE_LU, period="month")


# Intervals, store and audits


@query
def hourly_mean_complete(spark, d):
    return intervals.hourly_mean(fixtures.price(spark, d), DE_LU, "price")


@query
def residual_load_hourly(spark, d):
    return intervals.residual_load(fixtures.load(spark, d), fixtures.generation(spark, d), DE_LU)


@query
def cadence_by_day(spark, d):
    return intervals.cadence_by_day(fixtures.price(spark, d), DE_LU)


@query
def contract_violations(spark, d):
    rows = fixtures.price(spark, d).withColumn("price", F.when(F.col("price") > 30, F.lit(None)).otherwise(F.col("price") * 1000))
    return contracts.violations(rows.withColumn("resolution_min", (F.col("resolution_min") + F.minute("ts_utc") / 45).cast("short")), "price")


@query
def store_upsert_latest(spark, d):
    rows = fixtures.price(spark, d).select("zone", "ts_utc", "price")
    revised = rows.where(F.hour("ts_utc") % 3 == 0).withColumn("price", F.col("price") + 100)
    late = revised.withColumn("ts_utc", F.timestamp_add("DAY", F.lit(40), F.col("ts_utc")))
    return store.upserted(rows, revised.unionByName(late), ("zone", "ts_utc"))


def _store(spark, d, *names: str) -> store.FactStore:
    """A fresh store that holds the fixtures of the datasets."""
    facts = store.FactStore(spark, work_folder(spark, "store"))
    for name in names or ("price", "load", "generation"):
        facts.write(getattr(fixtures, name)(spark, d), name)
    return facts


def _revised(spark, d):
    """Every third hour revised, and the same rows again 40 days later."""
    rows = fixtures.price(spark, d)
    revised = rows.where(F.hour("ts_utc") % 3 == 0).withColumn("price", F.col("price") + 100)
    return revised.unionByName(revised.withColumn("ts_utc", F.timestamp_add("DAY", F.lit(40), F.col("ts_utc"))))


@query
def store_coverage(spark, d):
    return _store(spark, d).coverage().drop("bytes")


@query
def store_round_trip(spark, d):
    facts = _store(spark, d, "price")
    facts.write(_revised(spark, d), "price")
    return facts.read("price", "DE-LU", dt.datetime(2024, 1, 10, 5), dt.datetime(2024, 2, 20)).select("zone", "ts_utc", "resolution_min", "price", "currency")


@query
def store_checkpoint(spark, d):
    facts = _store(spark, d)
    rows = [(name, facts.last_ingested(name, "DE-LU")) for name in ("price", "load", "generation", "fundamentals")]
    return spark.createDataFrame(rows, "dataset string, last_ts_utc timestamp_ntz")


@query
def store_partitions_checked(spark, d):
    facts = store.FactStore(spark, work_folder(spark, "store"))
    broken = fixtures.load(spark, d).withColumn("load_mw", F.when(F.hour("ts_utc") % 5 == 0, -F.col("load_mw")).otherwise(F.col("load_mw")))
    facts.write(broken.unionByName(broken.withColumn("ts_utc", F.timestamp_add("DAY", F.lit(40), F.col("ts_utc"))).withColumn("source", F.lit(None).cast("string"))), "load", validate_first=False)
    return facts.broken_partitions()


@query
def stats_with_age(spark, d):
    from wattline.cli import coverage_with_age

    return coverage_with_age(_store(spark, d), NOW).select("dataset", "zone", "rows", "partitions", "last_ts_utc", "age_hours")


def _capacity_table(spark, d):
    return fixtures.capacity(spark, d).withColumns({"country": F.lit("DE"), "as_of": F.make_date(F.col("period").cast("int"), F.lit(12), F.lit(31)), "unit": F.lit("GW"), "source": F.lit("fixture")})


@query
def reference_round_trip(spark, d):
    root = work_folder(spark, "reference")
    store.write_reference(_capacity_table(spark, d).where("period < '1995'"), root, "capacity", ("technology", "as_of"))
    store.write_reference(_capacity_table(spark, d), root, "capacity", ("technology", "as_of"))
    store.write_reference(_capacity_table(spark, d).where("false"), root, "capacity", ("technology", "as_of"))
    empty = store.read_reference(spark, root, "fundamentals_ablation").select(F.col("model").alias("technology"))
    return store.read_reference(spark, root, "capacity").join(empty, "technology", "left_anti")


# Feeds, ingest, streams, logs


@query
def feed_price(spark, d):
    return feeds.facts("price", fixtures.price_payloads(spark, d), DE_LU, start=dt.datetime(2024, 1, 3), end=dt.datetime(2024, 1, 28))


@query
def feed_load(spark, d):
    return feeds.facts("load", fixtures.power_payloads(spark, d), DE_LU)


@query
def feed_generation(spark, d):
    return feeds.facts("generation", fixtures.power_payloads(spark, d), DE_LU)


@query
def feed_fundamentals(spark, d):
    return feeds.facts("fundamentals", fixtures.forecast_payloads(spark, d), DE_LU, end=dt.datetime(2024, 1, 25))


@query
def feed_capacity(spark, d):
    return feeds.installed_power(fixtures.capacity_payloads(spark, d), DE_LU)


@query
def feed_files(spark, d):
    """The same prices through saved files and the registry of sources."""
    folder = work_folder(spark, "payloads")
    fixtures.price_payloads(spark, d).select("payload").write.option("maxRecordsPerFile", 1).text(f"{folder}/price")
    fetch = feeds.fetcher(spark, "files", folder)
    rows = fetch("price", DE_LU, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8))
    return rows.groupBy(F.to_date("ts_utc").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def http_waits(spark, d):
    from wattline.sources.http import ATTEMPTS, wait_before

    rows = [(a, s, r, float(wait_before(a, s, r))) for a in range(1, ATTEMPTS + 4) for s in (429, 503) for r in (None, "7", "soon", "999")]
    return spark.createDataFrame(rows, "attempt int, status int, retry_after string, seconds double")


@query
def http_requests(spark, d):
    from wattline.sources.http import requests_for

    rows = [(name, r.get("bzn") or r.get("country"), r.get("production_type"), r["start"], r["end"]) for name in DE_LU.datasets for r in requests_for(name, DE_LU, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9))]
    return spark.createDataFrame(rows, "dataset string, place string, kind string, first string, last string")


@query
def ingest_results(spark, d):
    """Chunks of price and load; load fails after its first chunk, which is kept."""
    facts = store.FactStore(spark, work_folder(spark, "store"))

    def fetch(dataset, zone, start, end):
        if dataset == "load" and start > dt.datetime(2024, 1, 1):
            raise RuntimeError("no answer")
        rows = getattr(fixtures, dataset)(spark, d) if dataset != "fundamentals" else contracts.empty_frame(spark, dataset)
        return rows.where((F.col("ts_utc") >= utc_literal(start)) & (F.col("ts_utc") < utc_literal(end)))

    results = ingest.ingest(facts, [DE_LU], fetch, NOW, ["price", "load", "fundamentals"], (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)), 12)
    outcomes = spark.createDataFrame([(r.zone, r.dataset, r.outcome, r.error) for r in results], "zone string, dataset string, outcome string, error string")
    return outcomes.join(facts.coverage().select("zone", "dataset", "rows", "last_ts_utc"), ["zone", "dataset"], "left")


@query
def ingest_windows(spark, d):
    """The window of each dataset, cut into chunks."""
    last = _store(spark, d, "price", "load").last_ingested
    rows = []
    for name in ("price", "load"):
        start, end = ingest.resolve_window(NOW, last(name, "DE-LU"), name)
        rows += [(name, *w) for w in feeds.chunks(start, end, 4)]
    return spark.createDataFrame(rows, "dataset string, start timestamp_ntz, end timestamp_ntz")


@query
def stream_upserts(spark, d):
    """Facts that arrive in two batches, the second one revised."""
    folder = work_folder(spark, "stream")
    facts = store.FactStore(spark, f"{folder}/store")
    for rows in (fixtures.price(spark, d), _revised(spark, d)):
        contracts.conform(rows, "price").write.mode("append").parquet(f"{folder}/in")
        ingest.stream_upserts(spark, f"{folder}/in", "price", facts, f"{folder}/checkpoint").awaitTermination()
    return facts.read("price").select("zone", "ts_utc", "price")


@query
def stream_hourly(spark, d):
    """Complete hours of a streamed month; a row far ahead lets the watermark pass them all."""
    folder = work_folder(spark, "stream")
    rows = contracts.conform(fixtures.price(spark, d), "price")
    ahead = rows.limit(1).withColumn("ts_utc", utc_literal(dt.datetime(2025, 1, 1)))
    rows.unionByName(ahead).write.parquet(f"{folder}/in")
    stream = ingest.stream_hourly(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "price")
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema("zone string, ts_utc timestamp_ntz, price double").parquet(f"{folder}/out")


@query
def probe_log(spark, d):
    path = work_folder(spark, "probe")
    days = spark.sql("select explode(sequence(date'2024-01-10', date'2024-01-12')) delivery_date")
    served = fixtures.generation(spark, d).where(F.col("fuel").isin("wind", "solar")).withColumnRenamed("fuel", "series")
    for at in (dt.datetime(2024, 1, 9, 8), dt.datetime(2024, 1, 9, 9)):
        rows = quality.served_hours(served, DE_LU, days, at)
        logs.append_probe(rows.select(F.lit(at.isoformat()).alias("checked_at_utc"), F.lit("DE-LU").alias("zone"), F.col("delivery_date").cast("string"), "series", "hours_expected", "hours_covered", "minutes_before_gate"), path)
    return logs.read_probe(spark, path)


@query
def attempts_log(spark, d):
    """Attempts of the nations: started, most of them finished, read back."""
    root, at = work_folder(spark, "attempts"), dt.datetime(2024, 1, 9, 9)
    for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect():  # 25 rows
        key = r["n_nationkey"]
        logs.start_attempt(root, f"n-{key}", "DE-LU", "ridge", dt.date(2024, 1, 10) + dt.timedelta(days=key % 5), logs.ORIGINS[key % 2], at)
        if key % 4:
            logs.finish_attempt(root, f"n-{key}", logs.STATUSES[key % 6], at + dt.timedelta(minutes=key), error_type="ValueError" if key % 6 == 5 else None)
    return logs.read_attempts(spark, root).select("attempt_id", "zone", "model", "delivery_date", "origin", "started_at", "status", "completed_at", "error_type")


# Audits


@query
def quality_audit(spark, d):
    return quality.inspect(fixtures.generation(spark, d), "generation")


@query
def audit_report(spark, d):
    facts = _store(spark, d, "price", "generation")
    found = quality.report({name: facts.read(name) for name in DE_LU.datasets}, DE_LU)
    return found.select("zone", "dataset", "fuel", "rows", "first", "last", "observed_hours", "invalid")


@query
def freshness_report(spark, d):
    latest = store_coverage(spark, d).select("zone", "dataset", F.when(F.col("dataset") == "load", F.col("first_ts_utc")).otherwise(F.col("last_ts_utc")).alias("last_ts_utc"))
    declared = spark.createDataFrame([("DE-LU", x) for x in DE_LU.datasets], "zone string, dataset string")
    return quality.freshness(latest, declared, NOW)


@query
def probe_served_hours(spark, d):
    served = fixtures.generation(spark, d).withColumnRenamed("fuel", "series")
    days = spark.sql("select explode(sequence(date'2024-01-10', date'2024-02-02')) delivery_date")
    return quality.served_hours(served, DE_LU, days, dt.datetime(2024, 1, 15, 9, 30, 45), ("wind", "solar", "gas", "nuclear"))


# Panel features


def _panel(spark, d):
    return price_features(fixtures.panel_prices(spark, d))


@query
def calendar_lags(spark, d):
    return _panel(spark, d).select("local_date", "local_hour", "price", "price_d1", "price_d2", "price_d3", "price_d7")


@query
def daily_stats_lag(spark, d):
    return _panel(spark, d).select("local_date", "local_hour", "price_d1_mean", "price_d1_min", "price_d1_max", "price_d1_end", "price_d7_mean")


@query
def similar_day(spark, d):
    return _panel(spark, d).select("local_date", "local_hour", "price_similar_day")


@query
def calendar_features(spark, d):
    return pit.with_calendar(fixtures.panel_prices(spark, d).select("local_date").distinct())


@query
def panel_complete(spark, d):
    features = ("price_d1", "price_d2", "price_d3", "price_d7", "price_d1_mean", "price_d7_mean")
    return Panel(DE_LU, _panel(spark, d), features).complete().select("local_date", "local_hour", "price", *features)


def _built(spark, d, **more) -> Panel:
    return build_panel(fixtures.price(spark, d), DE_LU, fixtures.load(spark, d), fixtures.generation(spark, d), **more)


@query
def panel_built(spark, d):
    """The panel of the month, with the cells of a delivery day to come."""
    cells = issuing.day_grid(spark, DE_LU, dt.date(2024, 2, 2)).select(F.col("delivery_date").alias("local_date"), "local_hour")
    columns = ("price", "price_d1", "price_d7", "price_similar_day", "price_d1_mean", "price_d1_end", "price_d7_mean", "residual_d2", "residual_d2_mean", "dow")
    return _built(spark, d, delivery=cells).frame.select("local_date", "local_hour", *columns)


def _published(spark, d):
    """Hourly facts of load, wind and solar, as a provider would publish them."""
    return feeds.facts("fundamentals", fixtures.forecast_payloads(spark, d), DE_LU)


@query
def vintages_retrospective(spark, d):
    return pit.retrospective_vintages(_published(spark, d), DE_LU)


@query
def vintages_prospective(spark, d):
    return pit.prospective_vintages(_published(spark, d), DE_LU, dt.date(2024, 1, 10), dt.datetime(2024, 1, 9, 8))


@query
def panel_with_fundamentals(spark, d):
    frame = _built(spark, d, vintages=pit.retrospective_vintages(_published(spark, d), DE_LU)).frame
    return frame.select("local_date", "local_hour", "load", "wind", "solar", "residual_forecast", "forecast_age_hours")


@query
def point_in_time_fundamentals(spark, d):
    cells = intervals.hourly_mean(fixtures.price(spark, d), DE_LU, "price").select("local_date", "local_hour")
    return pit.point_in_time(cells, fixtures.vintages(spark, d), DE_LU, ("load", "wind", "solar"))


@query
def fundamentals_hourly_wide(spark, d):
    rows = fixtures.generation(spark, d).withColumn("series", F.when(F.col("fuel") == "gas", "load").otherwise(F.col("fuel"))).where(F.col("series").isin("load", "wind", "solar"))
    return pit.hourly_wide(rows.withColumnRenamed("gen_mw", "forecast_mw"))


@query
def sanitized_panel(spark, d):
    panel = Panel(DE_LU, _panel(spark, d), ("price_d1", "price_d7"))
    return sanitized(panel, TREE_SPLIT).frame.select("local_date", "local_hour", "price", "price_d1")


# Models and scores


@query
def naive_forecasts(spark, d):
    return models.naive_forecasts(_panel(spark, d))


@query
def ridge_walk_forward_1f(spark, d):
    return models.ridge_walk_forward(_panel(spark, d), ["price_d1"], alpha=0.1, min_train_rows=30)


@query
def ridge_walk_forward_full(spark, d):
    features = ["price_d1", "price_d2", "price_d3", "price_d7", "price_d1_mean", "price_d1_min", "price_d1_max", "price_d1_end", "price_d7_mean"]
    return models.ridge_walk_forward(_panel(spark, d), features, alpha=0.1, min_train_rows=60)


@query
def ridge_coefficients_1f(spark, d):
    return models.ridge_coefficients(_panel(spark, d), ["price_d1"], alpha=0.1)


@query
def alpha_search_1f(spark, d):
    return models.alpha_search(_panel(spark, d), ["price_d1"], *VALIDATION)


@query
def ridge_walk_forward_2f(spark, d):
    return models.ridge_walk_forward(_panel(spark, d), ["price_d1", "price_d7"], alpha=0.1, min_train_rows=30)


@query
def ridge_rolling_1f(spark, d):
    return models.ridge_walk_forward(_panel(spark, d), ["price_d1"], alpha=0.3, min_train_rows=30, window=60, start=VALIDATION[0])


@query
def ridge_level_and_spread(spark, d):
    """A feature whose level is large beside its spread, in two zones, and one that never varies."""
    wide = _panel(spark, d).withColumn("far", F.col("price_d1") / 1e3 + 1e5).withColumn("still", F.lit(7.0))
    both = wide.withColumn("zone", F.lit("A")).unionByName(wide.withColumn("price", -F.col("price")).withColumn("zone", F.lit("B")))
    return models.ridge_walk_forward(both, ["far", "still"], alpha=0.1, min_train_rows=30).withColumn("forecast", F.round("forecast", 3))


@query
def ridge_day(spark, d):
    return models.ridge_predict_day(_panel(spark, d), ["price_d1"], TREE_SPLIT, alpha=0.1)


@query
def ridge_coefficients_before(spark, d):
    return models.ridge_coefficients(_panel(spark, d), ["price_d1"], alpha=0.1, before=VALIDATION[0], window=90)


@query
def ridge_alpha_choice(spark, d):
    return models.alpha_search(_panel(spark, d), ["price_d1"], *VALIDATION).orderBy("mae", "alpha").limit(1)


STUMP = trees.TreeSettings(rounds=1, leaves=2, rate=0.5, least_rows=40, ridge=1.0)


@query
def tree_stump(spark, d):
    """One split on yesterday's price, refitted for one month of days at a time."""
    panel = _panel(spark, d).withColumn("price_d1", F.round("price_d1", -1)).where("local_hour = 0")
    return trees.boosted_forecasts(panel, ["price_d1"], TREE_SPLIT, dt.date(1998, 3, 31), settings=STUMP, min_train_days=60, refit_every_days=10_000)


@query
def tree_choice(spark, d):
    """The better of two single splits on a validation window."""
    panel = _panel(spark, d).withColumn("price_d1", F.round("price_d1", -1)).where("local_hour = 0")
    grid = (STUMP, trees.TreeSettings(rounds=1, leaves=2, rate=0.9, least_rows=40, ridge=1.0))
    best, search = trees.select_settings(panel, ["price_d1"], TREE_SPLIT, dt.date(1998, 3, 31), grid=grid, min_train_days=60, refit_every_days=10_000)
    return search.withColumn("chosen", F.col("place") == F.lit(grid.index(best)))


@query
def boosted_forecasts(spark, d):
    """The default trees on the last month of the panel, refitted daily."""
    features = ["price_d1", "price_d2", "price_d3", "price_d7", "price_d1_mean", "price_d1_min", "price_d1_max", "price_d1_end", "price_d7_mean"]
    last = _panel(spark, d).agg(F.max("local_date")).first()[0]
    return trees.boosted_forecasts(_panel(spark, d), features, last - dt.timedelta(days=6), min_train_days=60)


def _run(spark, d, feature: str) -> BacktestResult:
    return backtest.run(Panel(DE_LU, _panel(spark, d), (feature,)), 270, 90, (0.1, 1.0))


@query
def backtest_scores(spark, d):
    return _run(spark, d, "price_d1").scores.where("scope = 'overall'").select("model", "n", "mae", "rmse", "skill_pct", "skill_vs_best_baseline_pct")


@query
def backtest_metadata(spark, d):
    found = _run(spark, d, "price_d1").metadata()
    rows = [(k, str(found[k])) for k in ("reference", "alpha", "validation_start", "validation_end", "test_start", "test_end", "test_days", "zone", "min_train_days")]
    return spark.createDataFrame(rows, "name string, value string")


@query
def ablation_scores(spark, d):
    """Two protocols side by side: yesterday's price, and last week's, as the one feature."""
    panel = _panel(spark, d)
    rows = backtest.fundamentals_ablation(Panel(DE_LU, panel, ("price_d1",)), Panel(DE_LU, panel, ("price_d7",)), alphas=(0.1, 1.0))
    return rows.drop("skill_vs_best_baseline_pct", "rmse")


@query
def release_round_trip(spark, d):
    root = work_folder(spark, "releases")
    evidence.save_release({"daily": scoring.daily_errors(_predictions(spark, d))}, {"run": 1}, root)
    tables, metadata = evidence.read_release(spark, root)
    return tables["daily"].withColumn("run", F.lit(metadata["run"]))


@query
def evidence_round_trip(spark, d):
    """Rows of the store through content-addressed months; the second manifest shares all but one of them."""
    root, rows = work_folder(spark, "evidence"), fixtures.price(spark, d)
    far = rows.unionByName(rows.withColumn("ts_utc", F.timestamp_add("DAY", F.lit(60), F.col("ts_utc"))))
    evidence.save_evidence(root, {"price": far}, {"issue": 1})
    name = evidence.save_evidence(root, {"price": far.withColumn("price", F.when(F.col("ts_utc") >= utc_literal(dt.datetime(2024, 3, 1)), 0.0).otherwise(F.col("price")))}, {"issue": 2})
    tables, metadata = evidence.read_evidence(spark, root, name)
    return tables["price"].select("ts_utc", "price", F.lit(metadata["issue"]).alias("issue"))


def _predictions(spark, d):
    """Naive forecasts on their common sample, with the realised price."""
    panel = fixtures.panel_prices(spark, d)
    forecasts = pit.common_sample(models.naive_forecasts(price_features(panel)), len(models.NAIVE))
    return forecasts.join(panel.withColumnRenamed("price", "actual"), ["local_date", "local_hour"])


@query
def common_sample(spark, d):
    return _predictions(spark, d).select("model", "local_date", "local_hour", "forecast")


@query
def conformal_quantiles(spark, d):
    return scoring.with_quantiles(_predictions(spark, d)).select("model", "local_date", "local_hour", "q10", "q50", "q90")


@query
def regime_labels(spark, d):
    return scoring.with_regime(_predictions(spark, d)).select("model", "local_date", "local_hour", "regime")


def _scores(spark, d):
    return scoring.scoreboard(scoring.with_quantiles(_predictions(spark, d)), DE_LU, "naive_similar_day", risk.BASELINES)


@query
def scoreboard(spark, d):
    return _scores(spark, d)


@query
def losing_buckets(spark, d):
    return scoring.losing(_scores(spark, d), "naive_previous_day").select("scope", "bucket", "skill_vs_best_baseline_pct")


@query
def weakest_buckets(spark, d):
    return scoring.weakest(_scores(spark, d).where("scope = 'hour'"), 5).select("scope", "bucket", "model", "skill_vs_best_baseline_pct")


@query
def published_predictions(spark, d):
    return exports.published(exports.rounded_predictions(_predictions(spark, d), DE_LU)).select("zone", "model", "local_date", "local_hour", "forecast", "actual")


@query
def export_round_trip(spark, d):
    """Tables and a fact, exported and read back; what a rebuild finds to differ."""
    folder = work_folder(spark, "export")
    tables = {"errors": scoring.daily_errors(_predictions(spark, d)), "validation": scoring.validation_error(_predictions(spark, d), *VALIDATION)}
    exports.export_all(tables, folder, {"facts": {"x": 1.0}})
    near = {"errors": tables["errors"].withColumn("mae", F.col("mae") * (1 + 1e-9)), "validation": tables["validation"].withColumn("n", F.col("n") + 1), "absent": tables["errors"]}
    differing = exports.export_differences(near, folder) + exports.fact_differences({"facts": {"x": 1.0 + 1e-9}, "others": {}}, folder)
    return spark.read.parquet(f"{folder}/errors").withColumn("differing", F.lit(",".join(differing)))


@query
def extreme_years(spark, d):
    return scoring.extreme_years(_scores(spark, d))


@query
def daily_errors(spark, d):
    return scoring.daily_errors(_predictions(spark, d))


@query
def validation_error(spark, d):
    return scoring.validation_error(_predictions(spark, d), *VALIDATION)


@query
def forecast_preview_weeks(spark, d):
    return pit.preview_weeks(_predictions(spark, d)).select("model", "local_date", "local_hour", "forecast", "actual")


@query
def week_slice(spark, d):
    return pit.week_slice(_predictions(spark, d), dt.date(1995, 10, 2)).select("model", "local_date", "local_hour", "forecast")


# Battery and risk


def _hours(spark, d):
    """Complete clock hours of the price fixture as delivery intervals."""
    cells = intervals.hourly_mean(fixtures.price(spark, d), DE_LU, "price")
    return cells.select("ts_utc", "local_date", "local_hour", F.col("price").alias("forecast"), F.col("price").alias("actual"), F.col("covered_hours").alias("duration_hours"))


@query
def battery_complete_days(spark, d):
    return storage.complete_days(storage.prepared(_hours(spark, d), DE_LU), DE_LU).select("local_date").distinct()


@query
def dispatch_two_state_profit(spark, d):
    rows = storage.complete_days(storage.prepared(_hours(spark, d), DE_LU), DE_LU).withColumn("strategy", F.lit("perfect_foresight"))
    out = storage.dispatch(rows, [storage.BatterySpec(energy_mwh=0.5)])
    return out.groupBy("local_date").agg(F.sum("profit_eur").alias("profit_eur"), F.count(F.lit(1)).alias("intervals"))


def _strategies(spark, d):
    rows = _hours(spark, d)
    past = rows.select(F.date_add("local_date", 1).alias("local_date"), "local_hour", F.col("actual").alias("forecast"))
    named = rows.drop("forecast").join(past, ["local_date", "local_hour"]).withColumn("model", F.lit("naive_previous_day"))
    flat = rows.withColumn("forecast", F.abs("forecast")).withColumn("model", F.lit("ridge"))
    inputs, coverage = storage.compared(named.unionByName(flat.select(*named.columns)), DE_LU, ("naive_previous_day", "ridge"))
    return inputs, coverage


@query
def dispatch_full(spark, d):
    return storage.dispatch(_strategies(spark, d)[0], [storage.BatterySpec(energy_mwh=e) for e in (1.0, 2.0, 4.0)])


@query
def dispatch_two_episodes(spark, d):
    return storage.dispatch(_strategies(spark, d)[0], [storage.BatterySpec(energy_mwh=1.0, max_episodes_per_day=2, variable_cost_eur_mwh=2.0)]).select("strategy", "ts_utc", "action_mwh", "soc_mwh", "profit_eur")


@query
def dispatch_last_day(spark, d):
    out = storage.dispatch(_strategies(spark, d)[0], [storage.BatterySpec(energy_mwh=2.0)])
    return exports.last_day(out).select("strategy", "local_date", "local_hour", "action_mwh", "soc_mwh")


def _models_input(spark, d):
    """Predictions of two models over the month, as the study reads them; written once, read by every scenario."""
    rows = _hours(spark, d)
    past = rows.select(F.date_add("local_date", 1).alias("local_date"), "local_hour", F.col("actual").alias("forecast"))
    named = rows.drop("forecast").join(past, ["local_date", "local_hour"]).withColumn("model", F.lit("naive_previous_day"))
    both = named.unionByName(rows.withColumn("forecast", F.abs("forecast")).withColumn("model", F.lit("ridge")).select(*named.columns))
    return saved(spark, both, f"{work_folder(spark, 'predictions')}/rows")


MODELS = ("naive_previous_day", "ridge")


@query
def study_daily(spark, d):
    found = study.evaluate(_models_input(spark, d), DE_LU, MODELS, (1.0, 4.0))
    return found.daily.select("strategy", "energy_mwh", "local_date", "intervals", "profit_eur", "equivalent_cycles")


@query
def study_saved(spark, d):
    root, rows = work_folder(spark, "study"), _models_input(spark, d)
    study.save_study(study.evaluate(rows, DE_LU, MODELS, (1.0, 4.0)), rows, {"sizes": [1.0, 4.0]}, root)
    return evidence.read_release(spark, root)[0]["summary"]


@query
def scenario_summaries(spark, d):
    rows = _models_input(spark, d)
    base = study.evaluate(rows, DE_LU, MODELS, (1.0,))
    return study.scenario_tables(rows, DE_LU, base, MODELS, (1.0,), ("base", "cost_2_3", "efficiency_85", "signal_50", "calendar_downtime", "two_episodes")).select("scenario", "strategy", "days", "profit_eur", "throughput_mwh")


@query
def dispatch_summary(spark, d):
    return storage.summarize(storage.dispatch(_strategies(spark, d)[0], [storage.BatterySpec(energy_mwh=e) for e in (1.0, 4.0)]))


@query
def battery_coverage(spark, d):
    return _strategies(spark, d)[1]


@query
def daily_margins(spark, d):
    rows = storage.dispatch(_strategies(spark, d)[0], [storage.BatterySpec(energy_mwh=2.0, variable_cost_eur_mwh=2.0, degradation_cost_eur_mwh=3.0)])
    return risk.daily_margins(rows)


@query
def risk_metrics(spark, d):
    return risk.risk_metrics(fixtures.daily_margins(spark, d))


@query
def worst_month(spark, d):
    return risk.worst_month(fixtures.daily_margins(spark, d))


@query
def drawdown(spark, d):
    return risk.drawdown(fixtures.daily_margins(spark, d))


@query
def cumulative_margin(spark, d):
    return risk.cumulative_margin(fixtures.daily_margins(spark, d))


@query
def monthly_margins(spark, d):
    return exports.monthly_margins(fixtures.daily_margins(spark, d))


@query
def data_as_of(spark, d):
    return exports.data_as_of(store_coverage(spark, d))


@query
def paired_comparisons_point(spark, d):
    return risk.paired_points(fixtures.daily_margins(spark, d))


@query
def bootstrap_ci(spark, d):
    """Intervals from draws by rule, which any engine can repeat."""

    def draws(blocks):
        cells = spark.range(2000).select(F.col("id").cast("int").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"))
        place = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("resample").cast("string"), F.col("i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % blocks
        return cells.select("resample", place.cast("int").alias("block"))

    return risk.bootstrap_intervals(fixtures.daily_margins(spark, d), draws=draws)


@query
def bootstrap_seeded(spark, d):
    return risk.paired_comparisons(fixtures.daily_margins(spark, d)).select("strategy", "baseline", "paired_days", "ci_low_eur_mw", "ci_high_eur_mw")


@query
def annual_increment(spark, d):
    return risk.annualised(risk.risk_metrics(fixtures.daily_margins(spark, d))).select("strategy", "days", "annual_increment_eur_mw")


@query
def competition(spark, d):
    margins = exports.margin_yearly(_monthly(spark, d).withColumn("energy_mwh", F.lit(4.0)), fixtures.capacity(spark, d), {"1-URGENT": "battery_power_gw", "2-HIGH": "battery_energy_gwh"})
    return publishing.competition(margins, "2001")


@query
def market_tables_sizes(spark, d):
    """How many rows each published market table has."""
    capacity = _capacity_table(spark, d).withColumn("period", F.when(F.col("period") == "1995", "2024").otherwise(F.col("period"))).withColumn("technology", F.when(F.col("technology") == "1-URGENT", "Solar AC").otherwise(F.col("technology")))
    tables = publishing.market_tables(fixtures.price(spark, d), fixtures.generation(spark, d), capacity, DE_LU)
    rows = [tables[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in ("daily_prices", "generation_mix", "capacity", "cannibalisation", "price_shape", "capacity_price_yearly")]
    return reduce(DataFrame.unionByName, rows)


@query
def fit_cutoff(spark, d):
    return spark.createDataFrame([(exports.fit_cutoff(fixtures.price(spark, d), DE_LU),)], "year int")


@query
def weaken_signal(spark, d):
    rows = _predictions(spark, d).withColumn("model", F.when(F.col("model") == "naive_similar_day", "ridge").otherwise(F.col("model")))
    return risk.weaken_signal(rows, 0.5).select("model", "local_date", "local_hour", "forecast")


@query
def calendar_outages(spark, d):
    return risk.calendar_outages(fixtures.daily_margins(spark, d), 20).select("strategy", "local_date", "profit_eur")


# Ledger


def _issues(spark, d):
    rows = fixtures.issues(spark, d).withColumn("eligibility_reason", ledger.timing_reason(DE_LU))
    return rows.withColumn("eligible", F.col("eligibility_reason") == "pre_gate")


def _settled(spark, d):
    actuals = fixtures.panel_prices(spark, d).where(F.dayofmonth("local_date") <= 20)
    return ledger.reconcile(_issues(spark, d), actuals)


@query
def ledger_timing(spark, d):
    return _issues(spark, d).groupBy("model", "eligibility_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def ledger_reconcile(spark, d):
    return _settled(spark, d).select("issue_id", "delivery_date", "local_hour", "forecast", "actual", "status")


@query
def ledger_status_counts(spark, d):
    return ledger.status_counts(_settled(spark, d))


def _canonical(spark, d):
    return ledger.canonical(_issues(spark, d), fixtures.panel_prices(spark, d).select(F.col("local_date").alias("delivery_date"), "local_hour"))


@query
def ledger_canonical(spark, d):
    return _canonical(spark, d).select("issue_id", "model", "delivery_date", "issued_at", "local_hour", "forecast")


@query
def ledger_append_merge(spark, d):
    rows = _issues(spark, d)
    stored = rows.where(F.dayofmonth("delivery_date") <= 15)
    incoming = rows.where(F.dayofmonth("delivery_date") >= 10).withColumn("actual", F.when(F.dayofmonth("delivery_date") % 2 == 0, F.col("forecast") * 2)).withColumn("status", F.lit("scored"))
    return ledger.appended(stored, incoming).select("issue_id", "local_hour", "actual", "status")


@query
def attempts_best_status(spark, d):
    return ledger.best_attempts(fixtures.attempts(spark, d))


@query
def attempts_report(spark, d):
    tries = fixtures.attempts(spark, d).where("model = 'ridge'")
    ids = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-03')) delivery_date").select("delivery_date", F.concat(F.lit("ridge-"), F.date_format("delivery_date", "yyyy-MM-dd"), F.lit("-0")).alias("issue_id"))
    days = delivery_hours(ids, DE_LU).groupBy("delivery_date").agg(F.count(F.lit(1)).alias("expected_hours"))
    return ledger.attempt_report(tries, ids, days)


def _issue_rows(spark, d):
    """One issue of a day from yesterday's prices, with an hour left out."""
    day = dt.date(2024, 1, 10)
    hours = intervals.hourly_mean(fixtures.price(spark, d), DE_LU, "price")
    past = hours.where(F.col("local_date") == F.lit(day - dt.timedelta(days=1))).select(F.lit(day).alias("local_date"), "local_hour", F.col("price").alias("forecast"))
    return ledger.issue(issuing.day_grid(spark, DE_LU, day), past.where("local_hour <> 7"), DE_LU, "naive_previous_day", '{"lag": 1}', dt.datetime(2024, 1, 9, 9), dt.datetime(2024, 1, 9, 8), "0" * 64)


@query
def ledger_issue(spark, d):
    return _issue_rows(spark, d)


@query
def ledger_store(spark, d):
    """An issue appended, settled and appended again; then appended once more without outcomes."""
    book = ledger_files.LedgerStore(spark, work_folder(spark, "ledger"))
    book.append(_issue_rows(spark, d), DE_LU)
    book.append(ledger.reconcile(book.read(DE_LU), intervals.hourly_mean(fixtures.price(spark, d), DE_LU, "price")), DE_LU)
    book.append(_issue_rows(spark, d), DE_LU)
    return book.read(DE_LU).select("model", "delivery_date", "local_hour", "forecast", "actual", "status", "eligible", "issue_id")


def _recorded(spark, d):
    """A day issued with its evidence, the naive forecast from the built panel."""
    book, day = ledger_files.LedgerStore(spark, work_folder(spark, "ledger")), dt.date(2024, 1, 10)
    facts = {"price": fixtures.price(spark, d), "load": fixtures.load(spark, d), "generation": fixtures.generation(spark, d)}
    at = dt.datetime(2024, 1, 9, 9)
    rows = issuing.record_issue(book, _built(spark, d), registry.get_model("naive_previous_day"), day, at, facts, dict.fromkeys(facts, at), clock=lambda: at)
    return book, rows


@query
def issue_recorded(spark, d):
    """What the evidence of an issue holds, after every digest was derived again."""
    book, rows = _recorded(spark, d)
    issued, panel, model, _ = issuing.read_issue(book, rows.first()["issue_id"], DE_LU)
    seen = panel.frame.where("price is not null").agg(F.max("local_date").alias("last_known"))  # one row
    return issued.join(F.broadcast(seen)).select("model", "local_hour", "forecast", "status", "eligible", "last_known", F.lit(model.kind).alias("kind"))


@query
def battery_on_ledger(spark, d):
    """The dispatch of canonical, settled issues only."""
    book, _ = _recorded(spark, d)
    scored = issuing.scored_predictions(book, intervals.hourly_mean(fixtures.price(spark, d), DE_LU, "price"), DE_LU)
    inputs, _ = storage.compared(scored, DE_LU, ("naive_previous_day",))
    return storage.summarize(storage.dispatch(inputs, [storage.BatterySpec(energy_mwh=1.0)])).select("strategy", "days", "profit_eur")


@query
def attempt_window(spark, d):
    """The report of a window of days around one issued day."""
    from wattline.cli import attempt_days

    book, rows = _recorded(spark, d)
    at = dt.datetime(2024, 1, 9, 9)
    for name, status, found in (("a", "failed", None), ("b", "issued", rows.first()["issue_id"])):
        logs.start_attempt(book.root, name, "DE-LU", "naive_previous_day", dt.date(2024, 1, 10), "schedule", at)
        logs.finish_attempt(book.root, name, status, at, found)
    logs.start_attempt(book.root, "c", "DE-LU", "naive_previous_day", dt.date(2024, 1, 11), "manual", at)
    return attempt_days(spark, book, DE_LU, "naive_previous_day", dt.date(2024, 1, 9), dt.date(2024, 1, 12)).drop("issue_id")


# Yearly tables


@query
def capacity_price_yearly(spark, d):
    capacity = fixtures.capacity(spark, d).withColumn("period", F.when(F.col("period") == "2000", "2024").otherwise(F.col("period")))
    return exports.capacity_price_yearly(fixtures.price(spark, d), fixtures.generation(spark, d), capacity, DE_LU, "1-URGENT", ("2-HIGH", "3-MEDIUM"))


def _monthly(spark, d):
    daily = fixtures.daily_margins(spark, d)
    return daily.groupBy("strategy", "energy_mwh", F.date_format("local_date", "yyyy-MM").alias("month")).agg(F.sum("profit_eur").alias("profit_eur"), F.count(F.lit(1)).alias("days"))


@query
def battery_margin_yearly(spark, d):
    return exports.margin_yearly(_monthly(spark, d), fixtures.capacity(spark, d), {"1-URGENT": "battery_power_gw", "2-HIGH": "battery_energy_gwh"})


@query
def correlations(spark, d):
    yearly = exports.margin_yearly(_monthly(spark, d), fixtures.capacity(spark, d), {"1-URGENT": "battery_power_gw", "2-HIGH": "battery_energy_gwh"})
    return exports.correlations(yearly.where("strategy = 'ridge'"), [("battery_power_gw", "eur_per_mw_day"), ("battery_energy_gwh", "days"), ("energy_mwh", "days")], "2001")


@query
def extrapolation_flags(spark, d):
    return exports.extrapolation_flags(fixtures.capacity(spark, d), {"1-URGENT": ("1-URGENT", "2-HIGH"), "5-LOW": ("5-LOW",)}, "2001", "2001")


@query
def fleet_duration(spark, d):
    return exports.fleet_duration(fixtures.capacity(spark, d), "1-URGENT", "2-HIGH")

"""Views that turn the star-schema test tables into canonical facts.

The tables hold no market data, so each fact is derived by a fixed rule; plans/oracles.py
states the same rules in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.timeaxis import truncated, utc_literal

SWITCH = dt.datetime(2024, 1, 16)  # hourly products before, quarter-hours after
FUEL_OF = {"view": "solar", "click": "wind", "signup": "gas", "purchase": "hydro_pumped_storage", "error": "imports"}
SERIES_OF = {"view": "solar", "click": "wind", "signup": "load"}
STATUS_OF = {"click": "issued", "view": "partial", "signup": "abstained", "purchase": "late", "error": "failed"}


def _mapped(column: str, mapping: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col(column)]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    hourly = F.col("ts") < utc_literal(SWITCH)
    start = F.when(hourly, truncated(F.col("ts"))).otherwise(truncated(F.col("ts"), 15))
    return events.withColumn("ts_utc", start).withColumn("resolution_min", F.when(hourly, 60).otherwise(15).cast("short")).withColumn("zone", F.lit("DE-LU")).withColumn("source", F.lit("fixture"))


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("zone", "ts_utc", "resolution_min").agg((F.avg("value") - 45).alias("price"))
    return rows.select("zone", "ts_utc", "resolution_min", "price", F.lit("EUR").alias("currency"), F.lit("fixture").alias("source"))


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("zone", "ts_utc", "resolution_min").agg((F.sum("value") * 3).alias("load_mw"))
    return rows.select("zone", "ts_utc", "resolution_min", "load_mw", F.lit("fixture").alias("source"))


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("fuel", _mapped("event_type", FUEL_OF))
    return rows.groupBy("zone", "ts_utc", "resolution_min", "fuel").agg(F.sum("value").alias("gen_mw")).withColumn("source", F.lit("fixture"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly forecasts in several vintages: ts_utc, published_at, load, wind, solar."""
    rows = _events(spark, sf_dir).withColumn("series", _mapped("event_type", SERIES_OF)).where("series is not null")
    hour = truncated(F.col("ts"))
    published = F.timestamp_add("HOUR", (-(F.col("event_id") % 6) * 8).cast("int"), hour)
    return rows.groupBy(hour.alias("ts_utc"), published.alias("published_at")).pivot("series", ["load", "wind", "solar"]).agg(F.avg("value"))


def panel_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year prices of four clock hours a day: local_date, local_hour, price."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = [F.to_date("o_orderdate").alias("local_date"), ((F.col("o_orderkey") % 4) * 6).cast("int").alias("local_hour")]
    return orders.groupBy(*keys).agg((F.avg("o_totalprice") / 997 - 150).alias("price"))


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly capacities: one technology per order priority; the last year counts as planned."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.groupBy(F.date_format("o_orderdate", "yyyy").alias("period"), F.col("o_orderpriority").alias("technology")).agg((F.sum("o_totalprice") / 1e6).alias("value"))
    return rows.withColumn("is_planned", F.col("period") == "2001").withColumn("time_step", F.lit("yearly"))


def daily_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily margins of four strategies on common days, in the schema of the risk operators."""
    names = F.array(F.lit("naive_previous_day"), F.lit("naive_previous_week"), F.lit("naive_similar_day"), F.lit("ridge"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("strategy", F.get(names, (F.col("o_orderkey") % 4).cast("int")))
    rows = orders.groupBy("strategy", F.to_date("o_orderdate").alias("local_date")).agg((F.avg("o_totalprice") / 997 - 150).alias("profit_eur"))
    whole = rows.groupBy("local_date").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("local_date")
    return rows.join(whole, "local_date", "left_semi").select("strategy", F.lit(2.0).alias("power_mw"), F.lit(4.0).alias("energy_mwh"), "local_date", "profit_eur")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast attempts, one per event; one in seven never completed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    model = F.when(F.col("user_id") % 2 == 0, "ridge").otherwise("ridge_da")
    day = F.to_date("ts")
    status = F.when(F.col("event_id") % 7 == 0, "started").otherwise(_mapped("event_type", STATUS_OF))
    return events.select(
        F.col("event_id").alias("attempt_id"),
        F.lit("DE-LU").alias("zone"),
        model.alias("model"),
        day.alias("delivery_date"),
        F.when(F.col("event_id") % 2 == 0, "schedule").otherwise("manual").alias("origin"),
        F.col("ts").alias("stamp"),
        status.alias("status"),
        F.concat_ws("-", model, F.date_format(day, "yyyy-MM-dd"), (F.col("event_id") % 3).cast("string")).alias("issue_id"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger issues: three a day and model, some late, some incomplete, from lagged prices."""
    prices = panel_prices(spark, sf_dir)
    models = F.explode(F.array(F.struct(F.lit("ridge").alias("model"), F.lit(1).alias("lag")), F.struct(F.lit("ridge_da").alias("model"), F.lit(7).alias("lag")))).alias("m")
    grid = prices.select(F.col("local_date").alias("delivery_date"), "local_hour", models).select("delivery_date", "local_hour", "m.*")
    past = prices.select(F.col("local_date").alias("past"), "local_hour", F.col("price").alias("forecast"))
    rows = grid.withColumn("past", F.expr("date_sub(delivery_date, lag)")).join(past, ["past", "local_hour"], "left").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    midnight = F.date_sub("delivery_date", 1).cast("timestamp_ntz")
    issued = F.timestamp_add("MINUTE", (F.lit(8 * 60) + F.col("k") * 90).cast("int"), midnight)
    return rows.select(
        F.lit("DE-LU").alias("zone"),
        "model",
        issued.alias("issued_at"),
        "delivery_date",
        "local_hour",
        "forecast",
        F.when((F.dayofyear("delivery_date") % 5) == 0, F.col("forecast") + 1).alias("actual"),
        F.lit("issued_waiting_for_actual").alias("status"),
        F.when((F.dayofyear("delivery_date") % 7) == 0, 1).otherwise(2).alias("protocol_version"),
        F.concat_ws("-", "model", F.date_format("delivery_date", "yyyy-MM-dd"), F.col("k").cast("string")).alias("issue_id"),
        F.timestamp_add("MINUTE", F.lit(-30), issued).alias("input_as_of"),
        F.timestamp_add("MINUTE", F.lit(20), issued).alias("recorded_at"),
    )


# Provider payloads, as JSON text made from the events of each hour

#: Event type -> the provider's label, and its forecast series.
LABEL_OF = {"view": "Solar", "click": "Wind onshore", "purchase": "Wind offshore", "signup": "Fossil gas"}
FORECAST_OF = {"view": "solar", "click": "wind_onshore", "purchase": "wind_offshore", "signup": "load"}
REVISED = dt.datetime(2024, 3, 1)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour: its day, unix second, mean value, and the sums of each event type (null without any)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = truncated(F.col("ts")).alias("hour")
    sums = [F.sum(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in (*LABEL_OF, "error")]
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("hour"))
    return events.groupBy(hour).agg(F.avg("value").alias("mean"), *sums).withColumns({"day": F.to_date("hour"), "s": seconds})


def price_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload a day; even days are sent again, later, with prices 100 higher."""
    hours = _hourly(spark, sf_dir)
    listed = hours.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("s", "mean"))).alias("p"))
    first = listed.select("day", "p", F.lit(0.0).alias("add"), utc_literal(SWITCH).alias("stamp"))
    again = listed.where(F.dayofmonth("day") % 2 == 0).select("day", "p", F.lit(100.0).alias("add"), utc_literal(REVISED).alias("stamp"))
    body = F.struct(F.transform("p", lambda x: x["s"]).alias("unix_seconds"), F.transform("p", lambda x: x["mean"] + F.col("add")).alias("price"), F.lit("EUR / MWh").alias("unit"))
    return first.unionByName(again).select("stamp", F.to_json(body).alias("payload"))


def power_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload a day: generation labels, a derived one, and load - on even days under its fallback label only."""
    hours = _hourly(spark, sf_dir)
    listed = hours.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("s", *LABEL_OF, "error"))).alias("p"))
    series = lambda name, field: F.struct(name.alias("name"), F.transform("p", lambda x: x[field]).alias("data"))
    load = F.when(F.dayofmonth("day") % 2 == 0, "Load (incl. self-consumption)").otherwise("Load")
    types = [series(F.lit(label), t) for t, label in LABEL_OF.items()] + [series(load, "error"), series(F.lit("Residual load"), "error")]
    return listed.select(F.to_json(F.struct(F.transform("p", lambda x: x["s"]).alias("unix_seconds"), F.array(*types).alias("production_types")), {"ignoreNullFields": "false"}).alias("payload"))


def forecast_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per series."""
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(t).alias("v")) for t, name in FORECAST_OF.items()])).alias("x")
    rows = _hourly(spark, sf_dir).select("s", kinds).groupBy("x.name").agg(F.array_sort(F.collect_list(F.struct("s", "x.v"))).alias("p"))
    body = F.struct(F.transform("p", lambda x: x["s"]).alias("unix_seconds"), F.transform("p", lambda x: x["v"]).alias("forecast_values"), F.col("name").alias("production_type"))
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def capacity_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed power of every year and technology; those of odd rank are planned ones."""
    rows = capacity(spark, sf_dir).where("not is_planned")
    name = F.when(F.substring("technology", 1, 1).cast("int") % 2 == 1, F.concat("technology", F.lit(" planned"))).otherwise(F.col("technology"))
    types = rows.select(name.alias("name"), "period", "value").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("p"))
    years = rows.select("period").distinct().agg(F.sort_array(F.collect_list("period")).alias("time"))  # one row
    filled = F.transform("time", lambda y: F.element_at(F.map_from_entries("p"), y))
    one = types.join(F.broadcast(years)).select("time", F.struct("name", filled.alias("data")).alias("t"))
    return one.groupBy("time").agg(F.array_sort(F.collect_list("t")).alias("production_types")).select(F.to_json(F.struct("time", "production_types"), {"ignoreNullFields": "false"}).alias("payload"))

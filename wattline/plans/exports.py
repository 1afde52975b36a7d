"""Yearly tables, correlations and flags for publication; export and its check."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.expr import correlation, is_finite, ratio
from wattline.functions.files import exists, read_file, replace_file
from wattline.functions.timeaxis import Zone, plus_minutes, to_local
from wattline.operators.prices import block_prices, capture_rate, intraday_spread, negative_share


def cannibalisation(prices: DataFrame, generation: DataFrame, zone: Zone, fuels: Sequence[str] = ("solar", "wind"), period: str = "year") -> DataFrame:
    parts = [capture_rate(prices, generation, zone, f, period).withColumn("fuel", F.lit(f)) for f in fuels]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def capacity_price_yearly(prices: DataFrame, generation: DataFrame, capacity: DataFrame, zone: Zone, solar: str = "Solar AC", wind: Sequence[str] = ("Wind onshore", "Wind offshore")) -> DataFrame:
    """Realised solar and wind capacity per year beside the price metrics of that year."""
    built = capacity.where((F.col("time_step") == "yearly") & ~F.col("is_planned")).withColumnRenamed("period", "year")
    sun = built.where(F.col("technology") == solar).select("year", F.col("value").alias("solar_capacity_gw"))
    air = built.where(F.col("technology").isin(*wind)).groupBy("year").agg(F.sum("value").alias("wind_capacity_gw"))
    spread = block_prices(prices, zone, "year").select(F.col("period").alias("year"), "spread", (ratio(F.col("spread"), F.col("all_hours")) * 100).alias("spread_pct_of_price"), F.col("all_hours").alias("baseload_price"))
    day = intraday_spread(prices, zone, "year").select(F.col("period").alias("year"), F.col("mean_spread").alias("intraday_spread"), F.col("median_spread").alias("intraday_spread_median"), F.col("n_days").alias("intraday_n_days"))
    below = negative_share(prices, zone, "year").select(F.col("period").alias("year"), "negative_pct")
    joined = spread.join(sun, "year").join(air, "year", "left").join(below, "year", "left")
    for fuel in ("solar", "wind"):
        joined = joined.join(capture_rate(prices, generation, zone, fuel, "year").select(F.col("period").alias("year"), F.col("capture_rate").alias(f"{fuel}_capture_rate")), "year", "left")
    joined = joined.join(day, "year", "left")
    return joined.withColumn("intraday_spread_pct_of_price", ratio(F.col("intraday_spread"), F.col("baseload_price")) * 100)


def fit_cutoff(intervals: DataFrame, zone: Zone) -> int | None:
    """The local year in which the last interval ends: fitted years lie before it."""
    end = F.max(plus_minutes(F.col("ts_utc"), F.col("resolution_min")))
    return intervals.agg(F.year(to_local(end, zone)).alias("y")).first()["y"]


def correlations(yearly: DataFrame, pairs: Sequence[tuple[str, str]], before_year: str, where: Column | None = None) -> DataFrame:
    """Pearson's r of column pairs over complete years with both values; at least three years."""
    rows = yearly.where(F.col("year") < before_year)
    if where is not None:
        rows = rows.where(where)
    listed = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")) for x, y in pairs])).alias("p")
    points = rows.select("year", listed).select("year", "p.*").where(is_finite(F.col("vx")) & is_finite(F.col("vy")))
    fitted = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("vx"), F.col("vy")).alias("pearson_r"), F.min("year").alias("fitted_year_min"), F.max("year").alias("fitted_year_max"))
    return fitted.where("n >= 3 and pearson_r is not null")


def extrapolation_flags(capacity: DataFrame, targets: Mapping[str, Sequence[str]], before_year: str, target_year: str) -> DataFrame:
    """Whether a planned target lies above the realised maximum of its technologies."""
    yearly = capacity.where(F.col("time_step") == "yearly")
    built = yearly.where(~F.col("is_planned") & (F.col("period") < before_year)).groupBy("technology").agg(F.max("value").alias("realised_max_gw"), F.max_by("period", "value").alias("realised_max_year"))
    planned = yearly.where(F.col("is_planned") & (F.col("period") == target_year)).select(F.col("technology").alias("planned_technology"), F.col("value").alias("planned_gw"))
    pairs = F.create_map(*[x for t, techs in targets.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in techs]))])
    listed = planned.withColumn("technology", F.explode(pairs[F.col("planned_technology")]))
    return listed.join(built, "technology").select("planned_technology", "technology", "realised_max_gw", "realised_max_year", "planned_gw", (F.col("planned_gw") > F.col("realised_max_gw")).alias("exceeds_realised_max"))


def margin_yearly(monthly: DataFrame, capacity: DataFrame, fleet: Mapping[str, str]) -> DataFrame:
    """Yearly margin per MW and day beside the fleet: ``fleet`` maps technologies to columns."""
    wide = capacity.where((F.col("time_step") == "yearly") & ~F.col("is_planned")).groupBy(F.col("period").alias("year")).pivot("technology", list(fleet)).agg(F.first("value"))
    wide = wide.select("year", *[F.col(f"`{t}`").alias(c) for t, c in fleet.items()])
    margin = monthly.groupBy(F.substring("month", 1, 4).alias("year"), "strategy", "energy_mwh").agg(F.sum("profit_eur").alias("profit_eur"), F.sum("days").alias("days"))
    return margin.withColumn("eur_per_mw_day", ratio(F.col("profit_eur"), F.col("days"))).join(wide, "year")


def fleet_duration(capacity: DataFrame, power: str, energy: str) -> DataFrame:
    """Energy over power of a fleet by year."""
    pick = lambda t: F.max(F.when(F.col("technology") == t, F.col("value")))
    return capacity.where("time_step = 'yearly' and not is_planned").groupBy("period").agg(ratio(pick(energy), pick(power)).alias("duration_hours"))


def published(frame: DataFrame) -> DataFrame:
    """Dates as ISO text, exact columns first in the sort order, floats last."""
    text = {c: F.date_format(c, "yyyy-MM-dd") for c, k in frame.dtypes if k == "date"}
    text |= {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c, k in frame.dtypes if k.startswith("timestamp")}
    exact = [c for c, k in frame.dtypes if k not in ("double", "float")]
    floats = [c for c, k in frame.dtypes if k in ("double", "float")]
    return frame.withColumns(text).orderBy(*exact, *floats) if text else frame.orderBy(*exact, *floats)


def export_all(tables: Mapping[str, DataFrame], folder: str, facts: Mapping[str, object] | None = None) -> None:
    """Each result table as a Parquet folder of one file, each fact as a JSON file."""
    for name, frame in tables.items():
        published(frame).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
    for name, value in (facts or {}).items():
        replace_file(SparkSession.active(), f"{folder}/{name}.json", json.dumps(value, indent=2, sort_keys=True, default=str).encode())


def close(stored: object, fresh: object, relative: float = 1e-6, absolute: float = 1e-9) -> bool:
    """Whether two JSON values agree, numbers within a tolerance."""
    if isinstance(stored, dict) and isinstance(fresh, dict):
        return stored.keys() == fresh.keys() and all(close(stored[k], fresh[k], relative, absolute) for k in stored)
    if isinstance(stored, list) and isinstance(fresh, list):
        return len(stored) == len(fresh) and all(close(x, y, relative, absolute) for x, y in zip(stored, fresh, strict=True))
    if isinstance(stored, float) and isinstance(fresh, (int, float)):
        return math.isclose(stored, fresh, rel_tol=relative, abs_tol=absolute)
    return stored == fresh


def fact_differences(facts: Mapping[str, object], folder: str) -> list[str]:
    """Names of JSON facts that are absent or differ from a rebuild."""
    spark, differing = SparkSession.active(), []
    for name, value in facts.items():
        path = f"{folder}/{name}.json"
        fresh = json.loads(json.dumps(value, default=str))
        if not exists(spark, path) or not close(json.loads(read_file(spark, path)), fresh):
            differing.append(f"{name}.json")
    return differing


def export_differences(tables: Mapping[str, DataFrame], folder: str, relative: float = 1e-6, absolute: float = 1e-9) -> list[str]:
    """Names of exported tables that differ from a rebuild, floats within a tolerance."""
    differing = []
    for name, frame in tables.items():
        fresh = published(frame)
        if not exists(frame.sparkSession, f"{folder}/{name}"):
            differing.append(name)
            continue
        stored = frame.sparkSession.read.parquet(f"{folder}/{name}")
        if fresh.dtypes != stored.dtypes:
            differing.append(name)
            continue
        floats = [c for c, k in fresh.dtypes if k in ("double", "float")]
        keys = [c for c in fresh.columns if c not in floats]
        left = fresh.select(*keys, *[F.col(c).alias(f"l_{c}") for c in floats])
        right = stored.select(*keys, *[F.col(c).alias(f"r_{c}") for c in floats])
        met = None
        for k in keys:
            test = left[k].eqNullSafe(right[k])
            met = test if met is None else met & test
        joined = left.withColumn("in_l", F.lit(1)).join(right.withColumn("in_r", F.lit(1)), met, "full")
        far = F.col("in_l").isNull() | F.col("in_r").isNull()
        for c in floats:
            a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
            far = far | ~F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b))), a.isNull() & b.isNull())
        if joined.where(far).limit(1).count():
            differing.append(name)
    return differing


def rounded_predictions(predictions: DataFrame, zone: Zone) -> DataFrame:
    """Predictions as published: cents, no UTC stamp, with their zone."""
    kept = [F.round(c, 2).alias(c) if kind == "double" else F.col(c) for c, kind in predictions.dtypes if c != "ts_utc"]
    return predictions.select(*kept, F.lit(zone.code).alias("zone"))


def monthly_margins(daily: DataFrame) -> DataFrame:
    """Monthly roll-up of daily margins, with the days it covers."""
    month = F.date_format("local_date", "yyyy-MM").alias("month")
    return daily.groupBy("strategy", "power_mw", "energy_mwh", month).agg(F.count(F.lit(1)).alias("days"), F.sum("profit_eur").alias("profit_eur"))


def last_day(dispatched: DataFrame) -> DataFrame:
    """The dispatch of the latest day, as an example."""
    latest = dispatched.agg(F.max("local_date").alias("latest"))  # one row
    return dispatched.join(F.broadcast(latest), F.col("local_date") == F.col("latest")).drop("latest")


def data_as_of(coverage: DataFrame, measured: Sequence[str] = ("load", "generation")) -> DataFrame:
    """Latest observed instant of measured datasets; prices run ahead and do not count."""
    return coverage.where(F.col("dataset").isin(*measured)).agg(F.max("last_ts_utc").alias("data_as_of"))

"""Interval algebra: overlap join, integrity-checked resampling, cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.expr import require, require_unique, weighted_mean
from wattline.functions.timeaxis import Zone, attach_local_time, cell_hours, hours_between, interval_hours, plus_minutes, to_local, truncated


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("zone",)) -> DataFrame:
    """Intersections of two series of intervals [ts_utc, end_utc) that do not overlap themselves.

    Both sides are cut at UTC hours and joined on (keys, hour): an equi-join that spreads
    evenly, where a bare range condition would plan a nested loop.
    """

    def cut(frame: DataFrame, side: str) -> DataFrame:
        first, last = truncated(F.col("ts_utc")), truncated(F.expr("end_utc - interval 1 microsecond"))
        hours = F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("hour")
        whole = frame.where("ts_utc < end_utc").select("*", hours)
        start, end = F.greatest("ts_utc", "hour"), F.least("end_utc", plus_minutes(F.col("hour"), F.lit(60)))
        return whole.select(*keys, "hour", *[c for c in frame.columns if c not in (*keys, "ts_utc", "end_utc")], start.alias(f"s{side}"), end.alias(f"e{side}"))

    joined = cut(left, "l").join(cut(right, "r"), [*keys, "hour"])
    start, end = F.greatest("sl", "sr"), F.least("el", "er")
    met = joined.where(start < end).withColumn("ts_utc", start).withColumn("end_utc", end)
    return met.withColumn("hours", hours_between(F.col("ts_utc"), F.col("end_utc"))).drop("hour", "sl", "el", "sr", "er")


def hourly_mean(frame: DataFrame, zone: Zone, column: str) -> DataFrame:
    """One weighted value per local clock hour, from complete contiguous UTC hours only.

    A gap, overlap, duplicate or null drops the whole hour; the repeated autumn hour
    averages its two UTC hours and counts only if both are complete.
    """
    rows = frame.select("ts_utc", "resolution_min", column).withColumn("hour", truncated(F.col("ts_utc"))).withColumn("end", plus_minutes(F.col("ts_utc"), F.col("resolution_min")))
    before = F.lag("end").over(Window.partitionBy("hour").orderBy("ts_utc"))
    rows = rows.withColumn("follows", before.isNull() | (F.col("ts_utc") == before)).withColumn("h", interval_hours())
    complete = (
        rows.groupBy("hour")
        .agg(
            F.min("ts_utc").alias("first"),
            F.max("end").alias("last"),
            F.sum("h").alias("covered_hours"),
            F.every(F.col("follows") & F.col(column).isNotNull()).alias("sound"),
            weighted_mean(F.col(column), F.col("h")).alias(column),
        )
        .where("sound and first = hour")
        .where((F.col("last") == plus_minutes(F.col("hour"), F.lit(60))) & (F.abs(F.col("covered_hours") - 1) < 1e-9))
        .select(F.col("hour").alias("ts_utc"), column, "covered_hours")
    )
    cells = attach_local_time(complete, zone).groupBy("local_date", "local_hour")
    found = cells.agg(F.min("ts_utc").alias("ts_utc"), weighted_mean(F.col(column), F.col("covered_hours")).alias(column), F.sum("covered_hours").alias("covered_hours"))
    whole = F.col("covered_hours") == cell_hours(F.col("local_date"), F.col("local_hour"), zone)
    return found.where(whole).select("local_date", "local_hour", "ts_utc", column, "covered_hours")


def residual_load(load: DataFrame, generation: DataFrame, zone: Zone, fuels: tuple[str, ...] = ("wind", "solar")) -> DataFrame:
    """Hourly load minus wind and solar, where both are present once at one resolution."""
    both = (
        generation.where(F.col("fuel").isin(*fuels))
        .groupBy("ts_utc")
        .agg(
            F.sum("gen_mw").alias("gen_mw"),
            F.first("resolution_min").alias("resolution_min"),
            F.countDistinct("resolution_min").alias("resolutions"),
            F.countDistinct("fuel").alias("fuels"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("gen_mw").isNull()).alias("missing"),
        )
        .where(f"fuels = {len(fuels)} and n = {len(fuels)} and resolutions = 1 and missing = 0")
    )
    keys = ["local_date", "local_hour", "ts_utc", "covered_hours"]
    joined = hourly_mean(load, zone, "load_mw").join(hourly_mean(both, zone, "gen_mw"), keys)
    return joined.select("local_date", "local_hour", (F.col("load_mw") - F.col("gen_mw")).alias("residual_mw"), "covered_hours")


def cadence_by_day(stamps: DataFrame, zone: Zone) -> DataFrame:
    """Per local day: measured resolution, number of stamps, and whether steps are regular.

    A day with one stamp takes its neighbour's cadence, the earlier one first.
    """
    rows = stamps.select("ts_utc").withColumn("day", F.to_date(to_local(F.col("ts_utc"), zone)))
    step = F.timestamp_diff("MINUTE", F.lag("ts_utc").over(Window.partitionBy("day").orderBy("ts_utc")), F.col("ts_utc"))
    days = rows.withColumn("step", step).groupBy("day").agg(F.min("step").alias("least"), F.collect_list("step").alias("steps"), F.count(F.lit(1)).alias("n_stamps"))
    in_order = Window.orderBy("day")  # one row per day
    earlier = F.last("least", True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("least", True).over(in_order.rowsBetween(0, Window.unboundedFollowing))
    regular = ~F.exists("steps", lambda s: s % F.col("least") != 0)
    return days.select("day", F.coalesce("least", earlier, later).cast("int").alias("resolution_min"), "n_stamps", F.coalesce(regular, F.lit(True)).alias("regular"))


def with_cadence(stamps: DataFrame, zone: Zone) -> DataFrame:
    """(ts_utc, resolution_min) of a provider's time axis; raises on any irregular axis."""
    axis = stamps.select("ts_utc")
    require_unique(axis, ["ts_utc"], "duplicate timestamps in the provider's response")
    days = cadence_by_day(axis, zone)
    require(days, ~F.col("regular"), "irregular timestamp spacing")
    require(days, F.col("resolution_min").isNull(), "cannot measure a cadence from a single observation")
    require(days, ~F.col("resolution_min").isin(15, 60), "unsupported timestamp cadence")
    found = axis.withColumn("day", F.to_date(to_local(F.col("ts_utc"), zone))).join(days, "day").select("ts_utc", F.col("resolution_min").cast("short"))
    require(found, (epoch_seconds(F.col("ts_utc")) % (F.col("resolution_min") * 60)) != 0, "timestamps are not aligned to their intervals")
    return found


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a UTC wall clock, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def with_gaps(frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds end_utc and gap_seconds to the next interval (negative where they overlap)."""
    rows = frame.withColumn("end_utc", plus_minutes(F.col("ts_utc"), F.col("resolution_min")))
    following = F.lead("ts_utc").over(Window.partitionBy(*keys).orderBy("ts_utc"))
    return rows.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.col("end_utc"), following))

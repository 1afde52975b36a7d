"""Audits of stored facts: integrity per series, freshness, served coverage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.expr import is_finite, ratio
from wattline.functions.timeaxis import Zone, delivery_hours, hours_between, interval_hours, market_gate, truncated, utc_literal
from wattline.sources.contracts import SERIES, contract

from .intervals import epoch_seconds, with_gaps

#: Hours a series may lag; absorbs one missed run and the provider's own delay.
MAX_LAG_HOURS = 36.0


def inspect(frame: DataFrame, dataset: str) -> DataFrame:
    """Per zone and fuel or series: rows, span, observed and gap hours, coverage, invalid rows."""
    c = contract(dataset)
    label = F.col(c.label) if c.label else F.lit("all")
    rows = with_gaps(frame.withColumn("fuel", label), ("zone", "fuel"))
    minutes = F.col("resolution_min").cast("long")
    misaligned = F.when(minutes > 0, epoch_seconds(F.col("ts_utc")) % (minutes * 60) != 0)
    bad = F.coalesce(F.col("gap_seconds") < 0, F.lit(False)) | ~F.coalesce(is_finite(F.col(c.value)), F.lit(False)) | (minutes <= 0) | F.coalesce(misaligned, F.lit(False))
    audited = rows.groupBy("zone", "fuel").agg(
        F.lit(dataset).alias("dataset"),
        F.count(F.lit(1)).alias("rows"),
        F.min("ts_utc").alias("first"),
        F.max("end_utc").alias("last"),
        F.sum(interval_hours()).alias("observed_hours"),
        (F.coalesce(F.sum(F.when(F.col("gap_seconds") > 0, F.col("gap_seconds"))), F.lit(0)) / 3600.0).alias("gap_hours"),
        F.count_if(bad).alias("invalid"),
    )
    span = hours_between(F.col("first"), F.col("last"))
    return audited.withColumn("coverage_pct", F.least(F.lit(100.0), ratio(F.col("observed_hours"), span) * 100))


def report(facts: dict[str, DataFrame], zone: Zone) -> DataFrame:
    """Audit of every declared dataset; one that is missing altogether counts as invalid."""
    parts = []
    for name in zone.datasets:
        found = inspect(facts[name].where(F.col("zone") == zone.code), name)
        declared = found.sparkSession.createDataFrame([(zone.code, name)], "z string, d string")
        joined = declared.join(found, (F.col("z") == F.col("zone")) & (F.col("d") == F.col("dataset")), "left")
        parts.append(joined.select(F.col("z").alias("zone"), F.col("d").alias("dataset"), F.coalesce("fuel", F.lit("all")).alias("fuel"), F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last", "observed_hours", "gap_hours", "coverage_pct", F.coalesce("invalid", F.lit(1)).alias("invalid")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def freshness(latest: DataFrame, declared: DataFrame, now: dt.datetime, limit: float = MAX_LAG_HOURS) -> DataFrame:
    """zone, dataset, lag_hours, severity and its rank: missing first, then the most stale."""
    lag = hours_between(F.col("last_ts_utc"), utc_literal(now))
    rows = declared.join(latest, ["zone", "dataset"], "left").select("zone", "dataset", lag.alias("lag_hours"))
    severity = F.when(F.col("lag_hours").isNull(), "MISSING").when(F.col("lag_hours") > limit, "STALE").otherwise("ok")
    return rows.withColumn("severity", severity)


def served_hours(facts: DataFrame, zone: Zone, days: DataFrame, checked_at: dt.datetime, declared: Sequence[str] = SERIES) -> DataFrame:
    """Per declared series and delivery day: distinct UTC hours served, hours expected, minutes to the gate.

    A series that serves nothing at all has a row of zero hours for every day.
    """
    expected = delivery_hours(days, zone).groupBy("delivery_date").agg(F.sum("delivery_duration_hours").cast("long").alias("hours_expected"))
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone.timezone), F.col("ts_utc")))
    served = facts.groupBy("series", local.alias("delivery_date")).agg(F.countDistinct(truncated(F.col("ts_utc"))).alias("hours_covered"))
    grid = expected.withColumn("series", F.explode(F.array(*[F.lit(s) for s in declared])))
    gate = F.floor(F.timestamp_diff("SECOND", utc_literal(checked_at), market_gate(F.col("delivery_date"), zone)) / 60)
    return grid.join(served, ["series", "delivery_date"], "left").select("series", "delivery_date", "hours_expected", F.coalesce("hours_covered", F.lit(0)).alias("hours_covered"), gate.alias("minutes_before_gate"))

"""Price and generation analytics: every mean is weighted by interval length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.expr import ratio, weighted_mean
from wattline.functions.timeaxis import Zone, attach_block, attach_local_time, interval_hours, period_label, plus_minutes

from .intervals import overlap_join

#: A day counts for the within-day range from this many observed hours.
LEAST_DAY_HOURS = 23.0


def _local(prices: DataFrame, zone: Zone, period: str) -> DataFrame:
    rows = attach_local_time(prices, zone).withColumn("h", interval_hours())
    return rows.withColumn("period", period_label(period))


def block_prices(prices: DataFrame, zone: Zone, period: str = "month") -> DataFrame:
    """On-peak, off-peak, their spread and the overall mean per period."""
    rows = attach_block(_local(prices, zone, period), zone)
    on, off = F.col("block") == "on_peak", F.col("block") == "off_peak"
    price, h = F.col("price"), F.col("h")
    return (
        rows.groupBy("period")
        .agg(
            weighted_mean(price, h, on).alias("on_peak"),
            weighted_mean(price, h, off).alias("off_peak"),
            weighted_mean(price, h).alias("all_hours"),
            F.count_if(on).alias("n_on_peak"),
            F.count_if(off).alias("n_off_peak"),
        )
        .select("period", "on_peak", "off_peak", (F.col("on_peak") - F.col("off_peak")).alias("spread"), "all_hours", "n_on_peak", "n_off_peak")
    )


def intraday_spread(prices: DataFrame, zone: Zone, period: str = "year") -> DataFrame:
    """Mean and median of the daily max - min, over days with enough observed hours."""
    days = _local(prices, zone, period).groupBy("period", "local_date").agg((F.max("price") - F.min("price")).alias("s"), F.sum("h").alias("hours"))
    days = days.where(F.col("hours") >= LEAST_DAY_HOURS)
    return days.groupBy("period").agg(F.avg("s").alias("mean_spread"), F.median("s").alias("median_spread"), F.count(F.lit(1)).alias("n_days"))


def hourly_shape(prices: DataFrame, zone: Zone, period: str = "year") -> DataFrame:
    rows = _local(prices, zone, period)
    return rows.groupBy("period", "local_hour").agg(weighted_mean(F.col("price"), F.col("h")).alias("price"), F.sum("h").alias("observed_hours"), F.count(F.lit(1)).alias("n_intervals"))


def negative_share(prices: DataFrame, zone: Zone, period: str = "year") -> DataFrame:
    """Percent of observed hours strictly below zero."""
    rows = _local(prices, zone, period)
    below = F.coalesce(F.sum(F.when(F.col("price") < 0, F.col("h"))), F.lit(0.0))
    return rows.groupBy("period").agg((ratio(below, F.sum("h")) * 100).alias("negative_pct"), F.sum("h").alias("observed_hours"))


def capture_rate(prices: DataFrame, generation: DataFrame, zone: Zone, fuel: str, period: str = "month") -> DataFrame:
    """Price earned by one fuel against the mean price of the same covered spans."""
    side = lambda frame, value: frame.select("zone", "ts_utc", plus_minutes(F.col("ts_utc"), F.col("resolution_min")).alias("end_utc"), value)
    spans = overlap_join(side(prices, "price"), side(generation.where(F.col("fuel") == fuel), "gen_mw"))
    spans = attach_local_time(spans, zone).withColumn("period", period_label(period)).withColumn("energy", F.col("gen_mw") * F.col("hours"))
    sums = spans.groupBy("period").agg(
        F.sum("energy").alias("energy_mwh"), F.sum("hours").alias("covered_hours"), F.sum(F.col("price") * F.col("energy")).alias("earned"), weighted_mean(F.col("price"), F.col("hours")).alias("baseload_price")
    )
    capture = F.when(F.col("energy_mwh") > 0, ratio(F.col("earned"), F.col("energy_mwh")))
    return sums.withColumn("capture_price", capture).select("period", "capture_price", "baseload_price", ratio(F.col("capture_price"), F.col("baseload_price")).alias("capture_rate"), "energy_mwh", "covered_hours")


def generation_mix(generation: DataFrame, zone: Zone, period: str = "month") -> DataFrame:
    """Energy per fuel and its share of the period's total, without net imports."""
    rows = _local(generation.where(F.col("fuel") != "imports"), zone, period)
    energy = rows.groupBy("period", "fuel").agg(F.coalesce(F.sum(F.col("gen_mw") * F.col("h")), F.lit(0.0)).alias("energy_mwh"))
    total = F.sum("energy_mwh").over(Window.partitionBy("period"))
    return energy.withColumn("share_pct", ratio(F.col("energy_mwh"), total) * 100)


def price_shape(prices: DataFrame, zone: Zone) -> DataFrame:
    """Hourly shape of each year as a percentage of that year's baseload."""
    base = block_prices(prices, zone, "year").select("period", F.col("all_hours").alias("baseload_price"))
    shape = hourly_shape(prices, zone, "year").join(base, "period", "left")
    return shape.select(F.col("period").alias("year"), "local_hour", "price", (ratio(F.col("price"), F.col("baseload_price")) * 100).alias("pct_of_baseload"), "baseload_price", "observed_hours", "n_intervals")


def daily_price_segments(prices: DataFrame, zone: Zone) -> DataFrame:
    """Daily block prices with a running segment number that rises after each gap in days."""
    days = block_prices(prices, zone, "day").withColumnRenamed("period", "date")
    # A calendar of days: small however long the price history is, so one window partition is fine.
    in_order = Window.orderBy("date")
    gap = F.coalesce(F.datediff(F.to_date("date"), F.lag(F.to_date("date")).over(in_order)), F.lit(1)) > 1
    days = days.withColumn("gap", gap.cast("int"))
    return days.withColumn("segment", F.sum("gap").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("gap").withColumn("currency", F.lit(zone.currency)).withColumn("zone", F.lit(zone.code))

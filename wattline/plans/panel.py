"""The forecasting panel: complete local hours with features known before the gate."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.expr import is_finite, require_unique
from wattline.functions.timeaxis import Zone, day_hours
from wattline.operators.intervals import hourly_mean, residual_load
from wattline.operators.pit import calendar_lags, daily_stats, point_in_time, with_calendar, with_similar_day

BASE_FEATURES = (
    "price_d1", "price_d2", "price_d3", "price_d7", "price_d1_mean", "price_d1_min", "price_d1_max", "price_d1_end", "price_d7_mean",
    "residual_d2", "residual_d2_mean", "dow_2", "dow_3", "dow_4", "dow_5", "dow_6", "dow_7", "year_sin", "year_cos",
)
FUNDAMENTAL_FEATURES = ("load", "wind", "solar", "residual_forecast", "forecast_age_hours")


@dataclass(frozen=True)
class Panel:
    zone: Zone
    frame: DataFrame
    features: tuple[str, ...] = BASE_FEATURES
    target: str = "price"

    def complete(self) -> DataFrame:
        return self.frame.dropna(subset=[self.target, *self.features])


def price_features(cells: DataFrame, zone: Zone | None = None) -> DataFrame:
    """Price lags and daily statistics on local cells (local_date, local_hour, price[, covered_hours]).

    With a zone, daily statistics come from complete local days only.
    """
    out = calendar_lags(cells, {f"price_d{days}": ("price", days) for days in (1, 2, 3, 7)})
    weighted = cells if "covered_hours" in cells.columns else cells.withColumn("covered_hours", F.lit(1.0))
    expected = day_hours(F.col("local_date"), zone).cast("double") if zone else None
    stats = daily_stats(weighted, expected=expected)
    # Each day's statistics go to the two dates at which they are features.
    to = F.explode(F.array(F.lit(1), F.lit(7))).alias("k")
    copies = stats.select("mean", "min", "max", "end", "local_date", to).select(F.expr("date_add(local_date, k)").alias("local_date"), "k", "mean", "min", "max", "end")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    days = copies.groupBy("local_date").agg(*[at(c, 1).alias(f"price_d1_{c}") for c in ("mean", "min", "max", "end")], at("mean", 7).alias("price_d7_mean"))
    return with_similar_day(out.join(days, "local_date", "left"))


def build_panel(prices: DataFrame, zone: Zone, load: DataFrame, generation: DataFrame, vintages: DataFrame | None = None, delivery: DataFrame | None = None) -> Panel:
    """Target and features per local hour; ``delivery`` adds cells without a target.

    Price lags are one day or more, residual load is two days old, forecasts enter only
    if they were published by the row's own gate.
    """
    codes = {r[0] for r in prices.select("zone").distinct().limit(2).collect()}
    if codes - {zone.code}:
        raise ValueError(f"the panel expects zone {zone.code}, got {sorted(codes)}")
    cells = hourly_mean(prices, zone, "price")
    if delivery is not None:
        blank = delivery.join(cells.select("local_date", "local_hour"), ["local_date", "local_hour"], "left_anti")
        cells = cells.unionByName(blank, allowMissingColumns=True)
    frame = price_features(cells, zone)
    residual = residual_load(load, generation, zone)
    two_days = residual.select(F.date_add("local_date", 2).alias("local_date"), "local_hour", F.col("residual_mw").alias("residual_d2"))
    mean = residual.groupBy("local_date").agg(F.try_divide(F.sum(F.col("residual_mw") * F.col("covered_hours")), F.sum("covered_hours")).alias("m"), F.sum("covered_hours").alias("h"))
    mean = mean.where(F.col("h") == day_hours(F.col("local_date"), zone)).select(F.date_add("local_date", 2).alias("local_date"), F.col("m").alias("residual_d2_mean"))
    frame = frame.join(two_days, ["local_date", "local_hour"], "left").join(mean, "local_date", "left")
    features = BASE_FEATURES
    if vintages is not None:
        frame = point_in_time(frame, vintages, zone, ("load", "wind", "solar"))
        frame = frame.withColumn("residual_forecast", F.col("load") - F.col("wind") - F.col("solar"))
        features = BASE_FEATURES + FUNDAMENTAL_FEATURES
    return Panel(zone, with_calendar(frame), features)


def sanitized(panel: Panel, delivery: dt.date) -> Panel:
    """The panel as it may be seen when ``delivery`` is forecast: nothing later, no target that day."""
    names = (panel.target, *panel.features)
    if panel.target in panel.features:
        raise ValueError("the target must not be a feature")
    if missing := {"local_date", "local_hour", *names} - set(panel.frame.columns):
        raise ValueError(f"the panel lacks {sorted(missing)}")
    day = F.lit(delivery)
    frame = panel.frame.where(F.col("local_date") <= day)
    require_unique(frame, ["local_date", "local_hour"], "duplicate panel hours")
    counts = frame.agg(*[F.count_if(~is_finite(F.col(c).cast("double"))).alias(c) for c in names]).first()
    if broken := [c for c in names if counts[c]]:
        raise ValueError(f"{', '.join(broken)} must be finite or null")
    return replace(panel, frame=frame.withColumn(panel.target, F.when(F.col("local_date") < day, F.col(panel.target))))

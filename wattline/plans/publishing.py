"""The published tables: market, forecast and battery, and the two JSON facts beside them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.timeaxis import Zone
from wattline.operators import pit, prices
from wattline.operators.risk import SCENARIOS
from wattline.sources.evidence import read_release
from wattline.sources.store import FactStore, read_reference

from . import exports
from .backtest import BacktestResult
from .study import evaluate, scenario_tables

#: What is set against each other, and which built fleets a plan is read against.
CORRELATED = (("solar_capacity_gw", "solar_capture_rate"), ("solar_capacity_gw", "negative_pct"), ("wind_capacity_gw", "wind_capture_rate"), ("solar_capacity_gw", "spread_pct_of_price"))
PLANNED = {"Solar planned (EEG 2023)": ("Solar AC", "Solar DC"), "Wind onshore planned (EEG 2023)": ("Wind onshore",), "Wind offshore planned (WindSeeG)": ("Wind offshore",)}
PLANNED_YEAR = "2030"
FLEET = {"Battery storage (power)": "battery_power_gw", "Battery storage (capacity)": "battery_energy_gwh"}
COMPETING = ("perfect_foresight", "ridge", "boosted_trees")
SIZES = (1.0, 2.0, 4.0)


def release_tables(result: BacktestResult) -> dict[str, DataFrame]:
    """What a frozen release of a backtest holds."""
    return {"predictions": result.predictions, "scores": result.scores, "daily": result.daily, "coefficients": result.coefficients, "search": result.search}


def release_predictions(tables: Mapping[str, DataFrame], zone: Zone) -> DataFrame:
    """Every prediction of a release, rounded as the battery tables read them."""
    return exports.rounded_predictions(tables["predictions"], zone)


def market_tables(price: DataFrame, generation: DataFrame, capacity: DataFrame, zone: Zone) -> dict[str, DataFrame]:
    cutoff = str(exports.fit_cutoff(price, zone))
    yearly = exports.capacity_price_yearly(price, generation, capacity, zone)
    tag = lambda frame: frame.withColumn("zone", F.lit(zone.code))
    return {
        "daily_prices": prices.daily_price_segments(price, zone),
        "generation_mix": tag(prices.generation_mix(generation, zone).withColumnRenamed("period", "month")),
        "capacity": tag(capacity),
        "cannibalisation": tag(exports.cannibalisation(price, generation, zone)),
        "price_shape": prices.price_shape(price, zone),
        "capacity_price_yearly": tag(yearly),
        "capacity_price_correlation": tag(exports.correlations(yearly, CORRELATED, cutoff)),
        "capacity_extrapolation_flags": tag(exports.extrapolation_flags(capacity, PLANNED, cutoff, PLANNED_YEAR)),
    }


def competition(margins: DataFrame, before_year: str) -> DataFrame:
    """Fleet power against yearly margin, for each competing strategy and size."""
    parts = []
    for strategy in COMPETING:
        for size in SIZES:
            mine = (F.col("strategy") == strategy) & (F.col("energy_mwh") == size)
            found = exports.correlations(margins, [("battery_power_gw", "eur_per_mw_day")], before_year, mine)
            parts.append(found.select(F.lit(strategy).alias("strategy"), F.lit(size).alias("energy_mwh"), "n", "pearson_r", "fitted_year_min", "fitted_year_max"))
    return reduce(DataFrame.unionByName, parts)


def battery_tables(predictions: DataFrame, capacity: DataFrame, zone: Zone, before_year: str) -> dict[str, DataFrame]:
    """Dispatch economics of all models of a release."""
    models = sorted(r[0] for r in predictions.select("model").distinct().collect())
    study = evaluate(predictions, zone, models, SIZES)
    stresses = scenario_tables(predictions, zone, study, models, SIZES)
    costs = [name for name in SCENARIOS if name == "base" or name.startswith("cost_")]
    monthly = exports.monthly_margins(study.daily)
    margins = exports.margin_yearly(monthly.where(F.col("strategy").isin(*COMPETING)), capacity, FLEET)
    found = {
        "battery_monthly": monthly,
        "battery_dispatch_example": exports.last_day(study.dispatch),
        "battery_summary": study.summary,
        "battery_risk": study.risk,
        "battery_comparisons": study.comparisons,
        "battery_coverage": study.coverage,
        "battery_costs": stresses.where(F.col("scenario").isin(*costs)),
        "battery_sensitivities": stresses.where(~F.col("scenario").isin(*costs) | (F.col("scenario") == "base")),
        "battery_margin_yearly": margins,
        "battery_competition_correlation": competition(margins, before_year),
    }
    return {name: frame.withColumn("zone", F.lit(zone.code)) for name, frame in found.items()}


def site_tables(store: FactStore, reference: str, releases: str, zone: Zone) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """All published tables and JSON facts, from the store, the reference tables and the frozen release."""
    spark = store.spark
    price, generation = store.read("price", zone.code), store.read("generation", zone.code)
    capacity = read_reference(spark, reference, "capacity")
    release, metadata = read_release(spark, releases)
    predictions = release_predictions(release, zone).persist()
    last = predictions.agg(F.max("local_date")).first()[0]
    tag = lambda frame: frame.withColumn("zone", F.lit(zone.code))
    tables = {
        **market_tables(price, generation, capacity, zone),
        "fundamentals_ablation": read_reference(spark, reference, "fundamentals_ablation"),
        "forecast_scores": tag(release["scores"]),
        "forecast_daily": tag(release["daily"]),
        "forecast_preview": pit.preview_weeks(predictions),
        **battery_tables(predictions.drop("zone"), capacity, zone, str((last + dt.timedelta(days=1)).year)),
    }
    as_of = exports.data_as_of(store.coverage().where(F.col("zone") == zone.code)).first()[0]
    return tables, {"data_as_of": {"data_as_of": as_of.isoformat() if as_of else None}, "forecast": {"runs": [metadata]}}

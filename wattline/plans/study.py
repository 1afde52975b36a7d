"""Battery study: dispatch of all strategies, economics, and the fixed stresses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.timeaxis import Zone
from wattline.operators.risk import BASELINES, SCENARIOS, Stress, calendar_outages, check_daily, daily_margins, paired_comparisons, risk_metrics, weaken_signal
from wattline.operators.storage import BatterySpec, compared, dispatch, summarize
from wattline.sources.evidence import fingerprint, save_release


@dataclass(frozen=True)
class Study:
    dispatch: DataFrame
    summary: DataFrame
    coverage: DataFrame
    daily: DataFrame
    risk: DataFrame
    comparisons: DataFrame


def evaluate(
    predictions: DataFrame, zone: Zone, models: Sequence[str], sizes_mwh: Sequence[float] = (1.0, 2.0, 4.0), spec: BatterySpec | None = None, baselines: Sequence[str] = BASELINES, block_days: int = 7,
    resamples: int = 2000, seed: int = 20260914,
) -> Study:
    """Dispatch of all strategies over their common settled days, and its economics."""
    base = spec or BatterySpec()
    if "zone" in predictions.columns and predictions.where(F.col("zone") != zone.code).limit(1).count():
        raise ValueError(f"the study expects predictions of {zone.code} only")
    inputs, coverage = compared(predictions, zone, models)
    dispatched = dispatch(inputs, [replace(base, energy_mwh=float(s)) for s in sizes_mwh]).persist()
    if not dispatched.limit(1).count():
        raise ValueError("no complete settled day is common to all models")
    daily = daily_margins(dispatched)
    check_daily(daily)
    used = [b for b in baselines if b in models]
    return Study(dispatched, summarize(dispatched), coverage, daily, risk_metrics(daily, used), paired_comparisons(daily, used, block_days, resamples, seed))


def scenario_tables(predictions: DataFrame, zone: Zone, base: Study, models: Sequence[str], sizes_mwh: Sequence[float] = (1.0, 2.0, 4.0), names: Sequence[str] = tuple(SCENARIOS)) -> DataFrame:
    """Summary of every stress; scenarios that leave schedules alone reuse the base dispatch."""
    parts = []
    for stress in map(Stress.named, names):
        rows = base.dispatch
        if stress.replans:
            signal = predictions if stress.signal is None else weaken_signal(predictions, stress.signal)
            inputs, _ = compared(signal, zone, models)
            rows = dispatch(inputs, [BatterySpec(energy_mwh=float(size), **stress.asset) for size in sizes_mwh])
            days, known = rows.select("local_date").distinct(), base.dispatch.select("local_date").distinct()
            if days.exceptAll(known).limit(1).count() or known.exceptAll(days).limit(1).count():
                raise ValueError(f"scenario {stress.name} covers other days than the base")
        if stress.outage_days is not None:
            rows = calendar_outages(rows, stress.outage_days)
        parts.append(summarize(rows).withColumn("scenario", F.lit(stress.name)))
    return reduce(DataFrame.unionByName, parts)


def save_study(study: Study, predictions: DataFrame, assumptions: Mapping[str, object], root: str) -> str:
    """Freeze a study's tables with what it assumes and a fingerprint of what it read."""
    tables = {name: getattr(study, name) for name in ("summary", "coverage", "daily", "risk", "comparisons")}
    metadata = {"kind": "battery study", "assumptions": dict(assumptions), "predictions": fingerprint(predictions, None)}
    return save_release(tables, metadata, root)

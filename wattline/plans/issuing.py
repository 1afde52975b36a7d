"""Issuing a forecast: evidence first, then the ledger; and what may count afterwards."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.expr import is_finite
from wattline.functions.files import create_file, exists, read_file
from wattline.functions.timeaxis import Zone, delivery_hours, utc_literal
from wattline.functions.work import saved, work_folder
from wattline.operators import ledger
from wattline.operators.intervals import residual_load
from wattline.sources.evidence import fingerprint, read_evidence, save_evidence, source_digest
from wattline.sources.ledger_store import LedgerStore

from .panel import Panel, sanitized
from .registry import ModelConfig, forecast_day, get_model, restored  # noqa: F401

#: The fuels that the panel's residual load reads; only these are kept as evidence.
RESIDUAL_FUELS = ("wind", "solar")
FIXED = tuple(f.split()[0] for f in ledger.ISSUE_SCHEMA.split(", ") if f.split()[0] not in ledger.MUTABLE)

Clock = Callable[[], dt.datetime]


def now_utc() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def day_grid(spark: SparkSession, zone: Zone, day: dt.date) -> DataFrame:
    return delivery_hours(spark.range(1).select(F.lit(day).alias("delivery_date")), zone)


def configuration_of(model: ModelConfig, min_train_rows: int) -> str:
    return json.dumps({"model": asdict(model), "code": source_digest()[0], "min_train_rows": min_train_rows}, sort_keys=True)


def prepare_issue(panel: Panel, model: ModelConfig, day: dt.date, issued_at: dt.datetime, input_as_of: dt.datetime, min_train_rows: int = 30, allow_late: bool = False) -> tuple[DataFrame, Panel]:
    """The rows of one issue, and the panel as it was seen (worked out once, as a work table)."""
    spark = panel.frame.sparkSession
    seen = saved(spark, panel.frame.where(F.col("local_date") <= F.lit(day)), f"{work_folder(spark, 'panel')}/seen")
    safe = sanitized(replace(panel, frame=seen), day)
    forecasts = forecast_day(model, safe, day, min_train_rows)
    rows = ledger.issue(day_grid(spark, panel.zone, day), forecasts, panel.zone, model.name, configuration_of(model, min_train_rows), issued_at, input_as_of, fingerprint(safe.frame, None), allow_late=allow_late)
    return rows, safe


def _kept_sources(sources: Mapping[str, DataFrame], zone: Zone) -> dict[str, DataFrame]:
    """Generation only of the fuels that matter, after checking that they give the same residual load."""
    kept = dict(sources)
    if "generation" in kept:
        few = kept["generation"].where(F.col("fuel").isin(*RESIDUAL_FUELS))
        if "load" in kept:
            whole, part = (residual_load(kept["load"], g, zone) for g in (kept["generation"], few))
            if whole.exceptAll(part).limit(1).count() or part.exceptAll(whole).limit(1).count():
                raise ValueError("the residual load reads fuels that would not be kept; widen RESIDUAL_FUELS")
        kept["generation"] = few
    return kept


def record_issue(
    store: LedgerStore, panel: Panel, model: ModelConfig, day: dt.date, input_as_of: dt.datetime, sources: Mapping[str, DataFrame] | None = None, observed_at: Mapping[str, dt.datetime] | None = None,
    min_train_rows: int = 30, allow_late: bool = False, clock: Clock = now_utc,
) -> DataFrame:
    """Forecast a day, store its evidence, sample the recording clock, and append to the ledger.

    Timing is judged again with the clock of the recording: what is late by then is
    diagnostic, and refused unless that is allowed.
    """
    sources, observed_at = dict(sources or {}), dict(observed_at or {})
    if set(sources) != set(observed_at):
        raise ValueError("every source needs the time at which it was read")
    if any(stamp > input_as_of for stamp in observed_at.values()):
        raise ValueError("a source was read after the input cutoff")
    spark = store.spark
    rows, safe = prepare_issue(panel, model, day, clock(), input_as_of, min_train_rows, allow_late)
    rows = rows.persist()
    try:
        first = rows.select("issue_id", "issued_at", "input_sha256", "configuration").first()
        marker = f"{store.root}/issues/{first['issue_id']}.json"
        if exists(spark, marker):
            raise FileExistsError(f"issue {first['issue_id']} has evidence already")
        kept = {f"source_{k}": v for k, v in _kept_sources(sources, panel.zone).items()}
        inputs = save_evidence(store.root, {"input_panel": safe.frame, **kept}, {"issue_id": first["issue_id"]})
        recorded = clock()
        if recorded < first["issued_at"]:
            raise ValueError("the recording clock runs behind the forecast's")
        final = ledger.conformed(ledger.with_timing(rows.withColumn("recorded_at", utc_literal(recorded)), panel.zone))
        if final.where("not eligible").limit(1).count() and not allow_late:
            raise ledger.LateIssueError("recorded after the gate")
        facts = {"issue_id": first["issue_id"], "inputs": inputs, "model": asdict(model), "input_sha256": first["input_sha256"], "configuration": first["configuration"], "zone": panel.zone.code,
                 "features": list(safe.features), "target": safe.target, "observed_at": {k: v.isoformat() for k, v in observed_at.items()}}
        manifest = save_evidence(store.root, {"issued": final}, facts)
        create_file(spark, marker, json.dumps({"manifest": manifest}).encode())
        store.append(final, panel.zone)
        return store.read(panel.zone).where(F.col("issue_id") == first["issue_id"])
    finally:
        rows.unpersist()


def read_issue(store: LedgerStore, issue_id: str, zone: Zone) -> tuple[DataFrame, Panel, ModelConfig, dict[str, object]]:
    """An issue's rows, panel and model from its evidence, all digests derived again."""
    spark = store.spark
    name = json.loads(read_file(spark, f"{store.root}/issues/{issue_id}.json"))["manifest"]
    tables, facts = read_evidence(spark, store.root, name)
    inputs, _ = read_evidence(spark, store.root, str(facts["inputs"]))
    panel = Panel(zone, inputs["input_panel"], tuple(facts["features"]), str(facts["target"]))
    if facts["issue_id"] != issue_id or fingerprint(panel.frame, None) != facts["input_sha256"]:
        raise ValueError(f"the evidence of {issue_id} does not match its inputs")
    issued = ledger.conformed(tables["issued"])
    same = (F.col("issue_id") == issue_id) & (F.col("input_sha256") == facts["input_sha256"]) & (F.col("configuration") == facts["configuration"])
    model = restored(facts["model"])
    if issued.where(~same).limit(1).count() or json.loads(str(facts["configuration"]))["model"] != json.loads(json.dumps(asdict(model))):
        raise ValueError(f"the evidence of {issue_id} does not match what was issued")
    return issued, panel, model, facts


def canonical_verified(store: LedgerStore, issues: DataFrame, zone: Zone) -> DataFrame:
    """The canonical issues, after comparing their rows with what their evidence holds.

    Missing or altered evidence raises, so that no later issue can take the place of an
    earlier one. One id per model and day comes to the driver; rows stay on the cluster.
    """
    spark = store.spark
    days = issues.select("delivery_date").distinct()
    chosen = ledger.canonical(issues, delivery_hours(days, zone)).persist()
    ids = sorted(r[0] for r in chosen.select("issue_id").distinct().collect())
    kept = None
    for issue_id in ids:
        name = json.loads(read_file(spark, f"{store.root}/issues/{issue_id}.json"))["manifest"]
        tables, _ = read_evidence(spark, store.root, name)
        part = ledger.conformed(tables["issued"]).select(*FIXED)
        kept = part if kept is None else kept.unionByName(part)
    if kept is not None:
        now = chosen.select(*FIXED)
        if now.exceptAll(kept).limit(1).count() or kept.exceptAll(now).limit(1).count():
            raise ValueError("the ledger differs from the evidence of its issues")
    return chosen


def canonical_issue(store: LedgerStore, zone: Zone, model: str, day: dt.date) -> str | None:
    """The id of the canonical issue on record for a model and day, if there is one."""
    rows = store.read(zone).where((F.col("model") == model) & (F.col("delivery_date") == F.lit(day)))
    found = canonical_verified(store, rows, zone).select("issue_id").first()
    return found[0] if found else None


def outcome_of(rows: DataFrame) -> str:
    """How an attempt ends that led to these rows."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count("forecast").alias("known"), F.count_if(~F.col("eligible")).alias("late")).first()
    if facts["late"]:
        return "late"
    return "abstained" if not facts["known"] else "issued" if facts["known"] == facts["n"] else "partial"


def scored_predictions(store: LedgerStore, actuals: DataFrame, zone: Zone) -> DataFrame:
    """Canonical forecasts whose outcome is known, as predictions."""
    settled = ledger.reconcile(store.read(zone), actuals)
    rows = canonical_verified(store, settled, zone).where("status = 'scored'")
    return rows.where(is_finite(F.col("actual"))).select("model", F.col("delivery_date").alias("local_date"), "local_hour", "forecast", "actual")

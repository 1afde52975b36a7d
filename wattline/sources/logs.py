"""Append-only logs: the probe's CSV and the attempts' JSON events."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.files import create_file, exists, read_file
from wattline.functions.timeaxis import get_zone

PROBE_SCHEMA = "checked_at_utc string, zone string, delivery_date string, series string, hours_expected bigint, hours_covered bigint, minutes_before_gate bigint"
STARTED = "attempt_id string, zone string, model string, delivery_date date, origin string, started_at string"
COMPLETED = "attempt_id string, status string, completed_at string, issue_id string, error_type string"
#: How an attempt may end.
STATUSES = ("issued", "already_issued", "partial", "abstained", "late", "failed")
ORIGINS = ("manual", "schedule", "workflow_dispatch")
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def append_probe(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE_SCHEMA).option("header", True).csv(path)


def _event(root: str, identifier: str, name: str) -> str:
    if not _IDENTIFIER.fullmatch(identifier):
        raise ValueError(f"bad attempt id {identifier!r}")
    return f"{root.rstrip('/')}/attempts/{identifier}/{name}.json"


def _stored(path: str) -> dict[str, object] | None:
    spark = SparkSession.active()
    return json.loads(read_file(spark, path)) if exists(spark, path) else None


def _record(path: str, event: dict[str, object]) -> None:
    create_file(SparkSession.active(), path, json.dumps(event, sort_keys=True).encode())


def attempt(root: str, identifier: str) -> dict[str, object] | None:
    """An attempt's start with its completion over it, or nothing."""
    started = _stored(_event(root, identifier, "started"))
    ended = _stored(_event(root, identifier, "completed"))
    return None if started is None else {**started, "status": "started", **(ended or {})}


def start_attempt(root: str, identifier: str, zone: str, model: str, delivery: dt.date, origin: str, now: dt.datetime) -> dict[str, object]:
    """Record an attempt before any input is read; repeating the same start is harmless."""
    get_zone(zone)
    if origin not in ORIGINS:
        raise ValueError(f"origin must be one of {ORIGINS}, got {origin!r}")
    event = {"attempt_id": identifier, "zone": zone, "model": model, "delivery_date": delivery.isoformat(), "origin": origin, "started_at": now.isoformat()}
    known = attempt(root, identifier)
    if known is None:
        _record(_event(root, identifier, "started"), event)
        return {**event, "status": "started"}
    if any(known[k] != event[k] for k in event if k != "started_at"):
        raise ValueError(f"attempt {identifier} was started differently")
    return known


def finish_attempt(root: str, identifier: str, status: str, now: dt.datetime, issue_id: str | None = None, error_type: str | None = None, if_open: bool = False) -> dict[str, object]:
    """Close an attempt once; an error is kept as the name of its class, never its text."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}, got {status!r}")
    known = attempt(root, identifier)
    if known is None:
        raise ValueError(f"attempt {identifier} was never started")
    if known["status"] != "started":
        if if_open:
            return known
        raise ValueError(f"attempt {identifier} is closed already")
    if now.isoformat() < str(known["started_at"]):
        raise ValueError(f"attempt {identifier} cannot end before it starts")
    if issue_id is not None and not re.fullmatch(r"[0-9a-f]{64}", issue_id):
        raise ValueError("an issue id is 64 hexadecimal digits")
    if error_type is not None and not re.fullmatch(r"[A-Za-z_]\w{0,119}", error_type):
        raise ValueError("an error is named by its class")
    event = {"attempt_id": identifier, "status": status, "completed_at": now.isoformat(), "issue_id": issue_id, "error_type": error_type}
    _record(_event(root, identifier, "completed"), event)
    return {**known, **event}


def read_attempts(spark: SparkSession, root: str) -> DataFrame:
    """Attempts with their outcome; one without a completion is still ``started``."""
    started = spark.read.schema(STARTED).option("multiLine", True).json(f"{root}/attempts/*/started.json")
    try:
        ended = spark.read.schema(COMPLETED).option("multiLine", True).json(f"{root}/attempts/*/completed.json")
        ended.limit(1).count()
    except Exception as error:  # no attempt has ended yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        ended = spark.createDataFrame([], COMPLETED)
    return started.join(ended, "attempt_id", "left").withColumn("status", F.coalesce("status", F.lit("started")))

"""Forecast ledger: timing rules, settlement, canonical selection, append, attempts."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.expr import is_finite, require, require_unique
from wattline.functions.timeaxis import Zone, market_gate, to_local, utc_literal

KEYS = ("zone", "model", "issued_at", "delivery_date", "local_hour")
MUTABLE = ("actual", "status")
#: Best first; statuses outside this list do not count.
ATTEMPT_RANK = ("issued", "partial", "abstained", "late", "failed", "started")
#: How an unverified day is labelled, in order of precedence.
UNVERIFIED = (("started", "started"), ("issued", "issued_unverified"), ("partial", "partial"), ("abstained", "abstained"), ("late", "late"), ("failed", "failed"))


#: What an issue fixes for good; its digest is the issue's id.
IDENTITY = ("zone", "model_version", "delivery_date", "issued_at", "input_as_of", "input_sha256")
#: Columns of the ledger.
ISSUE_SCHEMA = (
    "zone string, model string, model_version string, issued_at timestamp_ntz, delivery_date date, local_hour int, delivery_start_utc timestamp_ntz, "
    "delivery_duration_hours double, forecast double, actual double, status string, input_sha256 string, protocol_version int, issue_id string, "
    "configuration string, input_as_of timestamp_ntz, recorded_at timestamp_ntz, eligible boolean, eligibility_reason string"
)
PROTOCOL = 2


class LateIssueError(ValueError):
    """A forecast that was made or recorded outside its window."""


def identity() -> Column:
    """The id that follows from a row's own evidence."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in IDENTITY]), 256)


def version_of(model: str | Column, configuration: str | Column) -> Column:
    """A model's name and the digest of how it is configured."""
    return F.concat(F.col(model) if isinstance(model, str) else model, F.lit(":"), F.sha2(F.col(configuration) if isinstance(configuration, str) else configuration, 256))


def timing_reason(zone: Zone, issued: str = "issued_at", recorded: str = "recorded_at", as_of: str = "input_as_of", delivery: str = "delivery_date") -> Column:
    """Why an issue is or is not eligible; the first rule that applies."""
    gate = market_gate(F.col(delivery), zone)
    issue_day = F.to_date(to_local(F.col(issued), zone))
    return (
        F.when(F.col(as_of) > F.col(issued), "inputs_after_prediction")
        .when(issue_day != F.date_sub(F.col(delivery), 1), "outside_issue_day")
        .when(F.col(issued) >= gate, "late_prediction")
        .when(F.col(recorded) >= gate, "late_recording")
        .otherwise("pre_gate")
    )


def validate(issues: DataFrame) -> DataFrame:
    """Keys are unique, forecasts finite, and an issue's facts the same in all its rows."""
    require_unique(issues, KEYS, "duplicate ledger rows")
    require(issues, ~is_finite(F.col("forecast")), "forecasts must be finite or null")
    facts = [c for c in ("eligible", "protocol_version", "recorded_at", "input_as_of") if c in issues.columns]
    constant = issues.groupBy("issue_id").agg(*[F.countDistinct(c).alias(c) for c in facts])
    bad = F.lit(False)
    for c in facts:
        bad = bad | (F.col(c) > 1)
    require(constant, bad, "metadata must be constant within an issue")
    return issues


def verified(issues: DataFrame, zone: Zone) -> DataFrame:
    """Rows of the ledger whose timing, model version and identity follow from their own evidence.

    Every rule is a column expression; one pass counts what breaks them.
    """
    missing = [f.split()[0] for f in ISSUE_SCHEMA.split(", ") if f.split()[0] not in issues.columns]
    if missing:
        raise ValueError(f"ledger columns are missing: {missing}")
    validate(issues)
    current = F.col("protocol_version") == PROTOCOL
    reason = timing_reason(zone)
    facts = ("zone", "model", "model_version", "issued_at", "delivery_date", "input_sha256", "issue_id", "configuration", "input_as_of", "recorded_at", "eligible", "eligibility_reason")
    rules = {
        "issue metadata must not be null": reduce(or_, [F.col(c).isNull() for c in facts]),
        "the ledger holds another zone": F.col("zone") != zone.code,
        "eligibility does not follow from timing": (F.col("eligibility_reason") != reason) | (F.col("eligible") != (reason == "pre_gate")),
        "the model version does not follow from its configuration": F.col("model_version") != version_of("model", "configuration"),
        "the issue id does not follow from its evidence": F.col("issue_id") != identity(),
    }
    counts = issues.agg(*[F.count_if(current & F.coalesce(rule, F.lit(True))).alias(f"r{i}") for i, rule in enumerate(rules.values())]).first()
    broken = [name for i, name in enumerate(rules) if counts[f"r{i}"]]
    if broken:
        raise ValueError("; ".join(broken))
    return issues


def with_timing(rows: DataFrame, zone: Zone) -> DataFrame:
    """Adds eligibility and what an issue's rows wait for; hours without a forecast stay as abstentions."""
    rows = rows.withColumn("eligibility_reason", timing_reason(zone))
    rows = rows.withColumn("eligible", F.col("eligibility_reason") == "pre_gate")
    status = F.when(F.col("forecast").isNull(), "abstain_missing_inputs").when(F.col("eligible"), "issued").otherwise("diagnostic_issued")
    return rows.withColumn("status", status)


def issue(
    grid: DataFrame, forecasts: DataFrame, zone: Zone, model: str, configuration: str, issued_at: dt.datetime, input_as_of: dt.datetime, input_sha256: str,
    recorded_at: dt.datetime | None = None, allow_late: bool = False,
) -> DataFrame:
    """One issue over a delivery grid (delivery_hours); a late one raises unless it is allowed.

    ``configuration``: the model's settings as JSON text.
    """
    if input_as_of > issued_at:
        raise ValueError("inputs cannot be later than the forecast made from them")
    cells = ["delivery_date", "local_hour"]
    given = forecasts.select(F.col("local_date").alias("delivery_date"), "local_hour", F.col("forecast").cast("double"))
    require_unique(given, cells, "a model may give one forecast per delivery hour")
    require(given, ~is_finite(F.col("forecast")), "forecasts must be finite or null")
    if given.join(grid, cells, "left_anti").limit(1).count():
        raise ValueError("a model may only forecast hours of the delivery grid")
    stamps = {"issued_at": issued_at, "input_as_of": input_as_of, "recorded_at": recorded_at or issued_at}
    rows = grid.join(given, cells, "left").withColumns(
        {
            "zone": F.lit(zone.code),
            "model": F.lit(model),
            "configuration": F.lit(configuration),
            "input_sha256": F.lit(input_sha256),
            "protocol_version": F.lit(PROTOCOL),
            "actual": F.lit(None).cast("double"),
            **{name: utc_literal(value) for name, value in stamps.items()},
        }
    )
    rows = rows.withColumn("model_version", version_of("model", "configuration"))
    rows = with_timing(rows.withColumn("issue_id", identity()), zone)
    reasons = {r[0] for r in rows.select("eligibility_reason").distinct().collect()}  # one row: one delivery day
    if reasons - {"pre_gate"} and not allow_late:
        raise LateIssueError(f"outside the window before the gate: {', '.join(sorted(reasons))}")
    return conformed(rows)


def conformed(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(name).cast(kind) for name, kind in (f.split() for f in ISSUE_SCHEMA.split(", "))])


def reconcile(issues: DataFrame, actuals: DataFrame) -> DataFrame:
    """Attach realised hourly prices (local_date, local_hour, price); identity is never touched."""
    observed = actuals.select(F.col("local_date").alias("delivery_date"), "local_hour", F.col("price").alias("observed"))
    rows = issues.join(observed, ["delivery_date", "local_hour"], "left").withColumn("actual", F.coalesce("observed", "actual"))
    known = F.col("actual").isNotNull()
    status = (
        F.when(F.col("forecast").isNull(), "abstain_missing_inputs")
        .when(~F.col("eligible") & known, "diagnostic_scored")
        .when(~F.col("eligible"), "diagnostic_waiting_for_actual")
        .when(known, "scored")
        .otherwise("issued_waiting_for_actual")
    )
    return rows.withColumn("status", status).select(*issues.columns)


def canonical(issues: DataFrame, expected: DataFrame, protocol: int = 2) -> DataFrame:
    """The earliest complete eligible issue per zone, model and day, chosen as a unit.

    ``expected``: delivery_date and local_hour of every cell. Outcomes are never read.
    Whether an issue's evidence is whole is checked by ``plans.issuing.canonical_verified``.
    """
    valid = issues.where(F.col("eligible") & (F.col("protocol_version") == protocol))
    cells = expected.groupBy("delivery_date").agg(F.sort_array(F.collect_set("local_hour")).alias("cells"))
    units = valid.groupBy("zone", "model", "delivery_date", "issued_at", "issue_id").agg(F.count_if(F.col("forecast").isNull()).alias("missing"), F.sort_array(F.collect_list("local_hour")).alias("hours"))
    whole = units.join(cells, "delivery_date").where("missing = 0 and hours = cells")
    first = Window.partitionBy("zone", "model", "delivery_date").orderBy("issued_at", "issue_id")
    chosen = whole.withColumn("place", F.row_number().over(first)).where("place = 1").select("issue_id")
    return valid.join(chosen, "issue_id", "left_semi").select(*issues.columns)


def appended(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ledger after an append: overlapping rows must agree on everything but the outcome.

    A null incoming outcome never erases a stored one.
    """
    keys = list(KEYS)
    fixed = [c for c in stored.columns if c not in MUTABLE]
    old = stored.join(incoming.select(*keys), keys, "left_semi").select(*fixed)
    new = incoming.join(stored.select(*keys), keys, "left_semi").select(*fixed)
    if old.exceptAll(new).limit(1).count() or new.exceptAll(old).limit(1).count():
        raise ValueError("an append may not change issued forecasts")
    known = stored.select(*keys, F.col("actual").alias("__actual"), F.col("status").alias("__status"))
    merged = incoming.join(known, keys, "left")
    kept = F.col("actual").isNull() & F.col("__actual").isNotNull()
    merged = merged.withColumn("status", F.when(kept, F.col("__status")).otherwise(F.col("status"))).withColumn("actual", F.coalesce("actual", "__actual"))
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(merged.select(*stored.columns))


def attempt_report(attempts: DataFrame, canonical_ids: DataFrame, days: DataFrame) -> DataFrame:
    """One row per expected day (delivery_date, expected_hours), attempted or not.

    A day is issued only if an issued attempt refers to its canonical issue.
    """
    seen = attempts.join(canonical_ids.select("delivery_date", F.col("issue_id").alias("canonical_id")), "delivery_date", "left")
    has = lambda state: F.count_if(F.col("status") == state) > 0
    label = F.lit("missing_attempt")
    for state, name in reversed(UNVERIFIED):
        label = F.when(has(state), name).otherwise(label)
    verified = F.count_if((F.col("status") == "issued") & (F.col("issue_id") == F.col("canonical_id"))) > 0
    per_day = seen.groupBy("delivery_date").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("origin") == "schedule").alias("scheduled_attempts"),
        F.count_if(F.col("status") == "failed").alias("failed_attempts"),
        F.when(verified, "issued").otherwise(label).alias("status"),
        verified.alias("eligible"),
        F.max(F.when(F.col("issue_id") == F.col("canonical_id"), F.col("canonical_id"))).alias("issue_id"),
    )
    rows = days.join(per_day, "delivery_date", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    eligible = F.coalesce("eligible", F.lit(False))
    return rows.select("delivery_date", "expected_hours", zero("attempts"), zero("scheduled_attempts"), zero("failed_attempts"), F.coalesce("status", F.lit("missing_attempt")).alias("status"), eligible.alias("eligible"), F.when(eligible, F.col("issue_id")).alias("issue_id"))


def best_attempts(attempts: DataFrame) -> DataFrame:
    """Per model: days by the best status of their attempts; failed counts include started ones."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ATTEMPT_RANK]), F.col("status"))
    best = attempts.withColumn("rank", rank).where("rank > 0").groupBy("model", "delivery_date").agg(F.min_by("status", "rank").alias("best"))
    count = lambda *states: F.count_if(F.col("best").isin(*states))
    counts = best.groupBy("model").agg(F.count(F.lit(1)).alias("days"), *[count(s).alias(s) for s in ATTEMPT_RANK[:4]], count("failed", "started").alias("failed"))
    latest = attempts.groupBy("model").agg(F.max("stamp").alias("as_of"))  # over all attempts, ranked or not
    return counts.join(latest, "model")


def status_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

import datetime as dt

import pytest
from .frames import one, utc
from pyspark.sql import functions as F

from wattline.functions.timeaxis import DE_LU
from wattline.operators import ledger
from wattline.plans import exports, issuing
from wattline.sources.ledger_store import LedgerStore

DAY = dt.date(2026, 1, 10)


def issue(spark, name="i", at=utc(2026, 1, 9, 8), hours=(0, 1), forecast=1.0, protocol=2, eligible=True, actual=None, status="issued_waiting_for_actual"):
    rows = [("DE-LU", "ridge", at, DAY, h, forecast, actual, status, protocol, name, eligible) for h in hours]
    return spark.createDataFrame(rows, "zone string, model string, issued_at timestamp_ntz, delivery_date date, local_hour int, forecast double, actual double, status string, protocol_version int, issue_id string, eligible boolean")


def cells(spark, hours=(0, 1)):
    return spark.createDataFrame([(DAY, h) for h in hours], "delivery_date date, local_hour int")


@pytest.mark.parametrize(
    ("as_of", "issued", "recorded", "reason"),
    [
        ((9, 0), (8, 0), (8, 1), "inputs_after_prediction"),
        ((8, 0), (11, 0), (11, 1), "late_prediction"),
        ((8, 0), (10, 59), (11, 0), "late_recording"),
        ((8, 0), (10, 0), (10, 5), "pre_gate"),
    ],
)
def test_timing(spark, as_of, issued, recorded, reason):
    rows = spark.createDataFrame([(DAY, utc(2026, 1, 9, *as_of), utc(2026, 1, 9, *issued), utc(2026, 1, 9, *recorded))], "delivery_date date, input_as_of timestamp_ntz, issued_at timestamp_ntz, recorded_at timestamp_ntz")
    assert one(rows.select(ledger.timing_reason(DE_LU).alias("r")))["r"] == reason


def test_issue_day_is_local(spark):
    rows = spark.createDataFrame([(DAY, utc(2026, 1, 8, 20), utc(2026, 1, 8, 22), utc(2026, 1, 8, 22))], "delivery_date date, input_as_of timestamp_ntz, issued_at timestamp_ntz, recorded_at timestamp_ntz")
    assert one(rows.select(ledger.timing_reason(DE_LU).alias("r")))["r"] == "outside_issue_day"


def test_canonical_is_the_earliest_complete_eligible_issue(spark):
    early_partial = issue(spark, "a", utc(2026, 1, 9, 6), hours=(0,))
    abstained = issue(spark, "b", utc(2026, 1, 9, 7), forecast=None)
    good = issue(spark, "c", utc(2026, 1, 9, 8))
    later = issue(spark, "d", utc(2026, 1, 9, 9))
    late = issue(spark, "e", utc(2026, 1, 9, 5), eligible=False)
    old = issue(spark, "f", utc(2026, 1, 9, 4), protocol=1)
    frames = early_partial
    for part in (abstained, good, later, late, old):
        frames = frames.unionByName(part)
    found = ledger.canonical(frames, cells(spark))
    assert {r["issue_id"] for r in found.collect()} == {"c"} and found.count() == 2


def test_reconcile(spark):
    frames = issue(spark, "a").unionByName(issue(spark, "b", eligible=False)).unionByName(issue(spark, "c", forecast=None))
    actual = spark.createDataFrame([(DAY, 0, 7.0)], "local_date date, local_hour int, price double")
    found = {(r["issue_id"], r["local_hour"]): (r["status"], r["actual"]) for r in ledger.reconcile(frames, actual).collect()}
    assert found[("a", 0)] == ("scored", 7.0) and found[("a", 1)] == ("issued_waiting_for_actual", None)
    assert found[("b", 0)][0] == "diagnostic_scored" and found[("b", 1)][0] == "diagnostic_waiting_for_actual" and found[("c", 0)][0] == "abstain_missing_inputs"


def test_append_keeps_outcomes_and_refuses_changes(spark):
    stored = issue(spark, "a", actual=5.0, status="scored")
    merged = ledger.appended(stored, issue(spark, "a", hours=(0,)))
    assert {r["local_hour"]: (r["actual"], r["status"]) for r in merged.collect()} == {0: (5.0, "scored"), 1: (5.0, "scored")}
    assert ledger.appended(stored, issue(spark, "z", utc(2026, 1, 9, 9))).count() == 4
    with pytest.raises(ValueError, match="may not change"):
        ledger.appended(stored, issue(spark, "a", forecast=2.0))
    with pytest.raises(ValueError, match="duplicate"):
        ledger.validate(stored.unionByName(stored))


def whole_issue(spark, hour=8, recorded=None, allow_late=False, left_out=7):
    grid = issuing.day_grid(spark, DE_LU, DAY)
    forecasts = grid.where(F.col("local_hour") != left_out).select(F.col("delivery_date").alias("local_date"), "local_hour", F.col("local_hour").cast("double").alias("forecast"))
    return ledger.issue(grid, forecasts, DE_LU, "ridge", '{"alpha": 0.1}', utc(2026, 1, 9, hour), utc(2026, 1, 9, 7), "0" * 64, recorded, allow_late)


def test_issue_keeps_abstentions_and_refuses_late_ones(spark):
    rows = whole_issue(spark)
    assert {r["local_hour"]: r["status"] for r in rows.collect()} == {h: "abstain_missing_inputs" if h == 7 else "issued" for h in range(24)}
    assert rows.where("not eligible or actual is not null").count() == 0
    with pytest.raises(ledger.LateIssueError, match="late_prediction"):
        whole_issue(spark, 12)
    with pytest.raises(ledger.LateIssueError, match="late_recording"):
        whole_issue(spark, 10, utc(2026, 1, 9, 12))
    late = whole_issue(spark, 12, allow_late=True)
    assert {r["status"] for r in late.where("local_hour <> 7").collect()} == {"diagnostic_issued"} and late.where("eligible").count() == 0
    with pytest.raises(ValueError, match="later"):
        whole_issue(spark, 6)


def test_ledger_rows_must_follow_from_their_evidence(spark):
    rows = whole_issue(spark).persist()
    assert ledger.verified(rows, DE_LU).count() == 24
    changes = {
        "eligibility": F.lit("late_prediction").alias("eligibility_reason"),
        "version": F.lit('{"alpha": 9}').alias("configuration"),
        "id": F.lit("1" * 64).alias("input_sha256"),
        "another zone": F.lit("FR").alias("zone"),
    }
    for message, column in changes.items():
        name = column._jc.toString().split(" AS ")[-1]
        with pytest.raises(ValueError, match=message):
            ledger.verified(rows.withColumn(name, column), DE_LU)
    with pytest.raises(ValueError, match="missing"):
        ledger.verified(rows.drop("configuration"), DE_LU)


def test_ledger_store_keeps_issues_and_fills_outcomes(spark, tmp_path):
    book = LedgerStore(spark, str(tmp_path))
    assert book.read(DE_LU).count() == 0
    assert book.append(whole_issue(spark), DE_LU) == 1
    settled = ledger.reconcile(book.read(DE_LU), spark.createDataFrame([(DAY, 3, 30.0)], "local_date date, local_hour int, price double"))
    book.append(settled, DE_LU)
    book.append(whole_issue(spark), DE_LU)  # a retry without outcomes erases none
    assert book.read(DE_LU).count() == 24 and one(book.read(DE_LU).where("status = 'scored'"))["actual"] == 30.0
    with pytest.raises(ValueError, match="may not change"):
        book.append(whole_issue(spark).withColumn("forecast", F.col("forecast") + 1), DE_LU)


def tries(spark, rows):
    return spark.createDataFrame([(DAY + dt.timedelta(days=d), "ridge", s, o, i, utc(2026, 1, 9)) for d, s, o, i in rows], "delivery_date date, model string, status string, origin string, issue_id string, stamp timestamp_ntz")


def test_attempt_report_covers_every_day(spark):
    rows = tries(spark, [(0, "issued", "schedule", "c"), (0, "failed", "manual", None), (1, "issued", "manual", "other"), (2, "late", "manual", None), (2, "started", "manual", None)])
    ids = spark.createDataFrame([(DAY, "c")], "delivery_date date, issue_id string")
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i), 24) for i in range(4)], "delivery_date date, expected_hours long")
    found = {r["delivery_date"].day: r for r in ledger.attempt_report(rows, ids, days).collect()}
    assert [found[d]["status"] for d in (10, 11, 12, 13)] == ["issued", "issued_unverified", "started", "missing_attempt"]
    assert (found[10]["attempts"], found[10]["failed_attempts"], found[10]["issue_id"], found[11]["issue_id"]) == (2, 1, "c", None)


def test_best_attempts(spark):
    rows = tries(spark, [(0, "failed", "m", None), (0, "partial", "m", None), (1, "started", "m", None), (2, "already_issued", "m", None)])
    found = one(ledger.best_attempts(rows))
    assert (found["days"], found["partial"], found["failed"], found["issued"]) == (2, 1, 1, 0)


def test_export_round_trip_and_difference(spark, tmp_path):
    table = spark.createDataFrame([(DAY, "a", 1.0), (DAY, "b", None)], "d date, k string, v double")
    exports.export_all({"t": table}, str(tmp_path))
    assert exports.export_differences({"t": table}, str(tmp_path)) == []
    near, far = (table.withColumn("v", F.col("v") * (1 + x)) for x in (1e-8, 1e-3))
    assert exports.export_differences({"t": near}, str(tmp_path)) == [] and exports.export_differences({"t": far}, str(tmp_path)) == ["t"]
    assert spark.read.parquet(str(tmp_path / "t")).first()["d"] == "2026-01-10"
    facts = {"f": {"x": [1.0, "a"]}}
    exports.export_all({"t": table}, str(tmp_path), facts)
    assert exports.fact_differences({"f": {"x": [1.0 + 1e-9, "a"]}}, str(tmp_path)) == [] and exports.fact_differences({"f": {"x": [1.1, "a"]}, "g": 1}, str(tmp_path)) == ["f.json", "g.json"]


def test_correlations_skip_constants(spark):
    yearly = spark.createDataFrame([(str(y), float(y), 2.0 * y, 5.0) for y in range(2019, 2024)], "year string, x double, y double, c double")
    found = one(exports.correlations(yearly, [("x", "y"), ("x", "c")], "2023"))
    assert found["n"] == 4 and found["pearson_r"] == pytest.approx(1) and found["fitted_year_max"] == "2022"

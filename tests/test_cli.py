"""The commands end to end, on a store of made-up months.

They run hundreds of small jobs, some minutes in all: only with WATTLINE_SLOW set. What they
call is covered by the registered queries and their SQL.
"""

import datetime as dt
import functools
import json
import os
import shutil

import pytest
from .frames import HOUR, utc
from pyspark.sql import functions as F

from wattline import cli
from wattline.functions.timeaxis import DE_LU
from wattline.plans import issuing, publishing, study
from wattline.sources.store import FactStore, read_reference, write_reference

pytestmark = pytest.mark.skipif(not os.environ.get("WATTLINE_SLOW"), reason="set WATTLINE_SLOW to run the commands end to end")
START, DAYS = utc(2025, 11, 1, 23), 66
TODAY = utc(2026, 1, 5, 8)


def hours(spark, name, values, **more):
    rows = [("DE-LU", START + i * HOUR, float(values(i))) for i in range(DAYS * 24)]
    frame = spark.createDataFrame(rows, f"zone string, ts_utc timestamp_ntz, {name} double")
    return frame.withColumns({"resolution_min": F.lit(60).cast("short"), "source": F.lit("t"), **{k: F.lit(v) for k, v in more.items()}})


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cli"))
    store = FactStore(spark, f"{root}/store")
    store.write(hours(spark, "price", lambda i: 40 + 20 * ((i % 24) in (8, 9, 18, 19)) + i // 24 % 7 - (50 if i % 24 == 13 else 0), currency="EUR"), "price")
    store.write(hours(spark, "load_mw", lambda i: 900 + i % 24), "load")
    wind, solar = hours(spark, "gen_mw", lambda i: 100 + i % 5, fuel="wind"), hours(spark, "gen_mw", lambda i: 10 * (8 < i % 24 < 16), fuel="solar")
    store.write(wind.unionByName(solar), "generation")
    series = [hours(spark, "forecast_mw", lambda i, k=k: 100 * k + i % 24, series=s) for k, s in enumerate(("load", "wind", "solar"), 1)]
    store.write(series[0].unionByName(series[1]).unionByName(series[2]), "fundamentals")
    capacity = spark.createDataFrame([("DE", "yearly", str(y), dt.date(y, 12, 31), t, float(y - 2000), "GW", False, "t") for y in (2024, 2025) for t in ("Solar AC", "Wind onshore", "Battery storage (power)", "Battery storage (capacity)")], "country string, time_step string, period string, as_of date, technology string, value double, unit string, is_planned boolean, source string")
    write_reference(capacity, f"{root}/reference", "capacity", ("technology", "as_of"))
    return root, ["--store", f"{root}/store", "--reference", f"{root}/reference", "--ledger", f"{root}/ledger", "--releases", f"{root}/releases"]


def test_facts(spark, places, capsys):
    root, args = places
    assert cli.main(["validate", *args]) == 0 and cli.main(["stats", *args]) == 0 and cli.main(["audit", *args]) == 0
    assert cli.main(["freshness", *args]) == 1 and cli.main(["freshness", "--no-strict", *args]) == 0
    assert cli.main(["probe-fundamentals", "--date", "2026-01-04", "--log", f"{root}/probe", *args]) == 0
    assert cli.main(["ingest", "--dry-run", *args]) == 0
    payload = {"unix_seconds": [int((utc(2026, 1, 6) + i * HOUR).replace(tzinfo=dt.UTC).timestamp()) for i in range(3)], "price": [1, 2, 3], "unit": "EUR / MWh"}
    spark.createDataFrame([(json.dumps(payload),)], "value string").write.text(f"{root}/payloads/price")
    extra = ["--store", f"{root}/other", "--payloads", f"{root}/payloads", "--dataset", "price"]
    assert cli.main(["backfill", "--years", "2", "--chunk-days", "1000", *extra]) == 0
    assert FactStore(spark, f"{root}/other").read("price").count() == 3
    assert cli.main(["ingest", "--dataset", "load", *extra[:4]]) == 1  # no such payloads


def test_issue_settle_and_dispatch(spark, places, monkeypatch, capsys):
    root, args = places
    monkeypatch.setattr(issuing, "now_utc", lambda: TODAY)
    for model in ("ridge", "naive_previous_day", "ridge_da"):
        assert cli.main(["issue", "--model", model, "--id", f"a-{model}", *args]) == 0, capsys.readouterr().out
    assert cli.main(["issue", "--model", "ridge", *args]) == 0 and "already issued" in capsys.readouterr().out
    assert cli.main(["issue", "--model", "ridge", "--id", "a-ridge", *args]) == 1  # closed
    monkeypatch.setattr(issuing, "now_utc", lambda: TODAY + 6 * HOUR)
    assert cli.main(["issue", "--model", "naive_previous_week", "--id", "late", *args]) == 1 and "late" in capsys.readouterr().out
    assert cli.main(["issue", "--model", "naive_previous_week", "--allow-late", "--id", "diagnostic", *args]) == 1
    assert cli.main(["reconcile", *args]) == 0
    assert cli.main(["battery", "--energy", "1", "--out", f"{root}/battery", *args]) == 0
    summary = {r["strategy"]: r for r in spark.read.parquet(f"{root}/battery/DE-LU_summary").collect()}
    assert set(summary) == {"ridge", "ridge_da", "naive_previous_day", "perfect_foresight", "no_trade"} and all(r["days"] == 1 for r in summary.values())
    assert summary["perfect_foresight"]["profit_eur"] >= summary["ridge"]["profit_eur"] > 0
    window = ["--model", "ridge", "--first", "2026-01-05", "--last", "2026-01-07"]
    assert cli.main(["forecast-attempt", "report", *window, *args]) == 0 and "eligible 1 of 3" in capsys.readouterr().out
    assert cli.main(["forecast-attempt", "start", "--id", "x", "--date", "2026-01-07", *args]) == 0 and cli.main(["forecast-attempt", "finish", "--id", "x", "--status", "failed", *args]) == 0
    assert cli.main(["forecast-attempt", "finish", "--id", "x", *args]) == 1 and cli.main(["forecast-attempt", "finish", "--id", "x", "--if-open", *args]) == 0


def test_altered_evidence_stops_the_ledger(spark, places, tmp_path):
    root, args = places
    from wattline.sources.ledger_store import LedgerStore

    book = LedgerStore(spark, str(tmp_path))
    price = FactStore(spark, f"{root}/store").read("price")
    panel = cli._panel(spark, cli.parser().parse_args(["battery", *args]))
    rows = issuing.record_issue(book, panel, issuing.get_model("naive_previous_day"), dt.date(2026, 1, 4), utc(2026, 1, 3, 7), {"price": price}, {"price": utc(2026, 1, 3, 6)}, clock=lambda: utc(2026, 1, 3, 8))
    name = rows.first()["issue_id"]
    issued, seen, model, facts = issuing.read_issue(book, name, DE_LU)
    assert issued.count() == 24 and model.kind == "naive" and seen.frame.where("local_date >= date'2026-01-04' and price is not null").count() == 0
    assert issuing.canonical_issue(book, DE_LU, "naive_previous_day", dt.date(2026, 1, 4)) == name
    manifest = json.loads((tmp_path / "issues" / f"{name}.json").read_text())["manifest"]
    listed = json.loads((tmp_path / "blobs" / manifest).read_text())["tables"]["issued"]
    (tmp_path / "blobs" / next(iter(listed.values()))).write_bytes(b"other")
    with pytest.raises(ValueError, match="altered"):
        issuing.canonical_issue(book, DE_LU, "naive_previous_day", dt.date(2026, 1, 4))
    with pytest.raises(ValueError, match="cutoff"):
        issuing.record_issue(book, panel, issuing.get_model("naive_previous_day"), dt.date(2026, 1, 4), utc(2026, 1, 3, 5), {"price": price}, {"price": utc(2026, 1, 3, 6)}, clock=lambda: utc(2026, 1, 3, 8))


def test_backtest_release_tables_and_study(spark, places, monkeypatch, capsys):
    root, args = places
    monkeypatch.setattr(publishing, "SIZES", (1.0,))
    monkeypatch.setattr(publishing, "scenario_tables", functools.partial(study.scenario_tables, names=("base", "calendar_downtime")))
    split = ["--train-days", "34", "--validation-days", "5"]
    assert cli.main(["backtest", "--save-release", *split, *args]) == 0
    assert cli.main(["backtest", "--save-release", *split, *args]) == 0 and "exists" in capsys.readouterr().out
    assert cli.main(["fundamentals-ablation", *split, *args]) == 0
    found = read_reference(spark, f"{root}/reference", "fundamentals_ablation").collect()
    assert {(r["model"], r["include_fundamentals"]) for r in found} == {("ridge", False), ("ridge", True)}
    assert cli.main(["export", "--out", f"{root}/site", *args]) == 0
    written = capsys.readouterr().out
    assert all(name in written for name in ("daily_prices", "capacity_price_correlation", "capacity_extrapolation_flags", "forecast_preview", "battery_sensitivities", "battery_competition_correlation", "data_as_of.json", "forecast.json"))
    assert cli.main(["export", "--out", f"{root}/site", "--check", *args]) == 0
    shutil.rmtree(f"{root}/site/price_shape")
    assert cli.main(["export", "--out", f"{root}/site", "--check", *args]) == 1 and "price_shape" in capsys.readouterr().out
    command = ["battery-study", "--energy", "1", "--resamples", "100", "--out", f"{root}/studies", *args]
    assert cli.main(command) == 0 and cli.main(command) == 1  # never overwritten

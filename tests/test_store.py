import datetime as dt
import io
import json
import os
import subprocess
import sys
import urllib.error

import pytest
from .frames import HOUR, one, prices, utc
from pyspark.sql import functions as F

from wattline.functions.timeaxis import DE_LU
from wattline.operators import quality
from wattline.sources import evidence, feeds, http, logs
from wattline.sources.contracts import CONTRACTS, conform, contract, empty_frame, validated, violations
from wattline.sources.store import FactStore
from wattline.streaming.ingest import exit_code, ingest, resolve_window, stream_hourly, stream_upserts


def facts(spark, rows):
    return prices(spark, rows).withColumn("currency", F.lit("EUR")).withColumn("source", F.lit("t"))


def test_upsert_is_idempotent_and_incoming_wins(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    first = facts(spark, [(utc(2026, 1, 31, 22) + h * HOUR, h) for h in range(4)])
    assert store.write(first, "price") == 2 and store.write(first, "price") == 2
    assert store.read("price").count() == 4
    store.write(facts(spark, [(utc(2026, 1, 31, 23), 99), (utc(2026, 2, 3), 5)]), "price")
    assert one(store.read("price").where(F.col("ts_utc") == utc(2026, 1, 31, 23)))["price"] == 99
    assert store.read("price", start=utc(2026, 2, 1)).count() == 3
    assert store.last_ingested("price", "DE-LU") == utc(2026, 2, 3)
    covered = one(store.coverage())
    assert (covered["rows"], covered["partitions"], covered["last_ts_utc"]) == (5, 2, utc(2026, 2, 3)) and covered["bytes"] > 0
    assert store.write(empty_frame(spark, "price"), "price") == 0


def test_empty_store(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    assert store.read("load").columns == contract("load").schema.names and store.last_ingested("load", "DE-LU") is None
    assert store.coverage().count() == 0
    with pytest.raises(KeyError):
        store.read("nothing")


def test_zone_and_month_prune_partitions(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    store.write(facts(spark, [(utc(2026, m, 1), 1) for m in (1, 2, 3)]), "price")
    plan = store.read("price", "DE-LU", start=utc(2026, 3, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_all_violations_are_reported_at_once(spark):
    bad = facts(spark, [(utc(2026, 1, 1), 1e9), (utc(2026, 1, 1), None, 7)])
    found = {r["rule"]: r["violations"] for r in violations(conform(bad, "price"), "price").collect()}
    assert found["price"] == 2 and found["resolution_min"] == 1 and found["unique_key"] == 1 and found["zone"] == 0
    with pytest.raises(ValueError, match="price .2..*unique_key|unique_key.*price"):
        validated(bad, "price")
    with pytest.raises(ValueError, match="unexpected"):
        conform(bad.withColumn("x", F.lit(1)), "price")
    assert set(CONTRACTS) == {"price", "load", "generation", "fundamentals"}


def payload(spark, value):
    return spark.createDataFrame([(json.dumps(value),)], "payload string")


START = int(dt.datetime(2026, 1, 1, tzinfo=dt.UTC).timestamp())


def test_price_payload(spark):
    seconds = [START + 3600 * i for i in range(4)]
    found = feeds.price_facts(payload(spark, {"unix_seconds": seconds, "price": [1, None, 3, 4], "unit": "EUR / MWh"}), DE_LU, end=utc(2026, 1, 1, 3)).orderBy("ts_utc").collect()
    assert [(r["price"], r["resolution_min"]) for r in found] == [(1, 60), (3, 60)]
    with pytest.raises(ValueError):
        feeds.price_facts(payload(spark, {"unix_seconds": seconds, "price": [1] * 4, "unit": "GBP / MWh"}), DE_LU)


def test_power_payload(spark):
    seconds = [START + 900 * i for i in range(8)]
    types = [{"name": n, "data": [float(i + 1)] * 8} for i, n in enumerate(("Wind onshore", "Wind offshore", "Load (incl. self-consumption)", "Load", "Residual load"))]
    rows = payload(spark, {"unix_seconds": seconds, "production_types": types})
    assert {(r["fuel"], r["gen_mw"], r["resolution_min"]) for r in feeds.generation_facts(rows, DE_LU).collect()} == {("wind", 3.0, 15)}
    assert {r["load_mw"] for r in feeds.load_facts(rows, DE_LU).collect()} == {4.0}
    with pytest.raises(ValueError, match="unrecognised"):
        feeds.generation_facts(payload(spark, {"unix_seconds": seconds, "production_types": [{"name": "Fusion", "data": [1.0] * 8}]}), DE_LU)
    both = [{"name": n, "data": [1.0] * 8} for n in ("Battery Storage (Power)", "Battery")]
    with pytest.raises(ValueError, match="net and gross"):
        feeds.generation_facts(payload(spark, {"unix_seconds": seconds, "production_types": both}), DE_LU)


def test_overlapping_payloads_give_each_interval_once(spark):
    seconds = [START + 3600 * i for i in range(48)]
    frame = lambda rows: spark.createDataFrame([(dt.datetime(2026, 1, 3 + i), json.dumps(v)) for i, v in enumerate(rows)], "stamp timestamp_ntz, payload string")
    price = lambda at, value: {"unix_seconds": at, "price": [value] * len(at), "unit": "EUR / MWh"}
    found = feeds.price_facts(frame([price(seconds, 1.0), price(seconds[24:], 2.0)]), DE_LU).groupBy("price").count()
    assert {r["price"]: r["count"] for r in found.collect()} == {1.0: 24, 2.0: 24}
    with pytest.raises(ValueError, match="duplicate"):
        feeds.price_facts(frame([price([*seconds, seconds[0]], 1.0)]), DE_LU)
    with pytest.raises(ValueError, match="EUR"):
        feeds.price_facts(frame([price(seconds, 1.0), {"unix_seconds": seconds, "price": [1.0] * 48}]), DE_LU)
    power = lambda at, **series: {"unix_seconds": at, "production_types": [{"name": n.replace("_", " "), "data": [v] * len(at)} for n, v in series.items()]}
    fallback = power(seconds[24:], **{"Load (incl. self-consumption)": 9.0})
    loads = feeds.load_facts(frame([power(seconds[:24], **{"Load": 5.0, "Load (incl. self-consumption)": 6.0}), fallback]), DE_LU).groupBy("load_mw").count()
    assert {r["load_mw"]: r["count"] for r in loads.collect()} == {5.0: 24, 9.0: 24}


def test_every_document_of_a_saved_file_counts(spark, tmp_path):
    body = lambda day, value: {"unix_seconds": [START + 86400 * day + 3600 * i for i in range(24)], "price": [value] * 24, "unit": "EUR / MWh", "note": {"text": "} {"}}
    lines = [json.dumps(body(0, 9.0)), json.dumps(body(1, 2.0)) + " \r", "", json.dumps(body(2, 3.0), indent=1), json.dumps(body(0, 1.0))]
    (tmp_path / "several.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "one.json").write_text(json.dumps(body(3, 4.0), indent=1))
    payloads = feeds.saved_payloads(spark, str(tmp_path))
    assert payloads.count() == 5
    found = feeds.price_facts(payloads, DE_LU).groupBy("price").count()
    assert {r["price"]: r["count"] for r in found.collect()} == {1.0: 24, 2.0: 24, 3.0: 24, 4.0: 24}


def test_sources_by_name():
    assert set(feeds.SOURCES) == {"files", "http"} and callable(feeds.get_source("http"))
    with pytest.raises(KeyError):
        feeds.get_source("carrier pigeon")
    asked = http.requests_for("fundamentals", DE_LU, utc(2026, 1, 1), utc(2026, 1, 3))
    assert [r["production_type"] for r in asked] == list(http.FORECAST_TYPES) and asked[0]["end"] == "2026-01-03"


def test_wind_forecast_needs_both_parts(spark):
    seconds = [START + 3600 * i for i in range(3)]
    rows = payload(spark, {"unix_seconds": seconds, "forecast_values": [1, 2, 3], "production_type": "wind_onshore"}).unionByName(
        payload(spark, {"unix_seconds": seconds, "forecast_values": [10, None, 30], "production_type": "wind_offshore"})
    )
    found = feeds.fundamentals_facts(rows, DE_LU).orderBy("ts_utc").collect()
    assert [(r["ts_utc"].hour, r["forecast_mw"]) for r in found] == [(0, 11), (2, 33)]


def test_installed_power(spark):
    rows = payload(spark, {"time": ["2024", "2025"], "production_types": [{"name": "Solar AC", "data": [1.0, None]}, {"name": "Solar planned", "data": [2.0, 3.0]}, {"name": "Battery storage (capacity)", "data": [None, 4.0]}]})
    found = {(r["technology"], r["period"]): r for r in feeds.installed_power(rows, DE_LU).collect()}
    assert len(found) == 4 and found[("Solar planned", "2025")]["is_planned"] and found[("Battery storage (capacity)", "2025")]["unit"] == "GWh"
    assert found[("Solar AC", "2024")]["as_of"] == dt.date(2024, 12, 31)


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def test_retries_wait_and_give_up():
    waits, answers = [], [urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "7"}, None), urllib.error.HTTPError("u", 503, "busy", None, None), Answer(b"{}")]

    def opened(url, timeout):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert http.fetch("u", opened, waits.append) == "{}" and waits == [7.0, 3.0]
    assert http.wait_before(9, 503, None) == 120.0 and http.wait_before(2, 429, None) == 40.0

    def refuse(url, timeout):
        raise urllib.error.HTTPError("u", 404, "no", None, None)

    with pytest.raises(http.SourceError, match="404"):
        http.fetch("u", refuse, waits.append)

    def down(url, timeout):
        raise urllib.error.URLError("down")

    for body in (b"<html>", b"[1]", b"\xff"):
        with pytest.raises(http.SourceError, match="JSON"):
            http.fetch("u", lambda url, timeout, body=body: Answer(body), waits.append)
    waits.clear()
    with pytest.raises(http.SourceError, match="6 attempts"):
        http.fetch("u", down, waits.append)
    assert len(waits) == 5


def test_http_source_plans_one_partition_per_request():
    reader = http.JsonHttpSource({"url": "http://h/price", "requests": json.dumps([{"a": 1}, {"a": 2}])}).reader(None)
    assert [p.url for p in reader.partitions()] == ["http://h/price?a=1", "http://h/price?a=2"]


def test_ingest_isolates_failures_and_tiles_windows(spark, tmp_path):
    store, asked = FactStore(spark, str(tmp_path)), []

    def fetch(dataset, zone, start, end):
        asked.append((dataset, start, end))
        if dataset == "load":
            raise RuntimeError("upstream is down")
        if dataset != "price":
            return empty_frame(spark, dataset)
        return facts(spark, [(start, 1.0)])

    now = utc(2026, 3, 1)
    results = ingest(store, [DE_LU], fetch, now, bounds=(utc(2026, 1, 1), utc(2026, 1, 11)), chunk_days=4)
    assert {r.dataset: r.outcome for r in results} == {"price": "written", "load": "failed", "generation": "empty", "fundamentals": "empty"}
    assert exit_code(results) == 1 and [a[1:] for a in asked if a[0] == "price"] == [(utc(2026, 1, 1), utc(2026, 1, 5)), (utc(2026, 1, 5), utc(2026, 1, 9)), (utc(2026, 1, 9), utc(2026, 1, 11))]
    assert resolve_window(now, utc(2026, 5, 1), "price") == (utc(2026, 2, 22), utc(2026, 3, 3))
    with pytest.raises(ValueError):
        ingest(store, [DE_LU], fetch, now, bounds=(now, now))


def test_stream_converges_by_key(spark, tmp_path):
    store, source = FactStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    conform(facts(spark, [(utc(2026, 1, 1, h), h) for h in range(3)]), "price").write.parquet(source)
    query = stream_upserts(spark, source, "price", store, str(tmp_path / "ck"))
    query.awaitTermination()
    conform(facts(spark, [(utc(2026, 1, 1, 2), 50), (utc(2026, 1, 1, 3), 3)]), "price").write.mode("append").parquet(source)
    query = stream_upserts(spark, source, "price", store, str(tmp_path / "ck"))
    query.awaitTermination()
    assert [r["price"] for r in store.read("price").orderBy("ts_utc").collect()] == [0, 1, 50, 3]


def test_later_files_win_within_a_batch(spark, tmp_path):
    store, source = FactStore(spark, str(tmp_path / "store")), tmp_path / "in"
    for value, at in ((7, 3000), (9, 5000), (8, 4000)):
        part = tmp_path / f"part{value}"
        conform(facts(spark, [(utc(2026, 1, 1), value)]), "price").coalesce(1).write.parquet(str(part))
        (file,) = part.glob("*.parquet")
        source.mkdir(exist_ok=True)
        file.rename(source / f"{value}.parquet")
        os.utime(source / f"{value}.parquet", (1_700_000_000 + at, 1_700_000_000 + at))
    stream_upserts(spark, str(source), "price", store, str(tmp_path / "ck")).awaitTermination()
    assert one(store.read("price"))["price"] == 9


def test_bounds_do_not_depend_on_the_hosts_zone(tmp_path):
    """A fresh engine on a host of another zone reads the same rows."""
    code = f"""
import datetime as dt
from pyspark.sql import SparkSession, functions as F
from wattline.sources.store import FactStore
from wattline.sources.fixtures import SWITCH
from wattline.functions.timeaxis import utc_literal
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').config('spark.sql.session.timeZone', 'UTC').getOrCreate()
rows = spark.sql("select 'DE-LU' zone, timestamp_ntz'2024-01-15 23:00:00' + make_dt_interval(0, h) ts_utc, cast(60 as short) resolution_min, cast(h as double) price, 'EUR' currency, 't' source from (select explode(sequence(0, 3)) h)")
store = FactStore(spark, r'{tmp_path}/store')
store.write(rows, 'price')
print('KEPT', store.read('price', start=SWITCH, end=dt.datetime(2024, 1, 16, 2)).count(), spark.range(1).select(utc_literal(dt.datetime(2024, 1, 16, tzinfo=dt.timezone(dt.timedelta(hours=2)))).cast('string')).first()[0])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], env={**os.environ, "TZ": "America/New_York", "PYTHONPATH": root}, capture_output=True, text=True, timeout=300, check=False)
    assert "KEPT 2 2024-01-15 22:00:00" in done.stdout, done.stderr[-2000:]


def test_streamed_hours_wait_for_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(utc(2026, 1, 1, 0, 15 * i), float(i), 15) for i in range(4)] + [(utc(2026, 1, 1, 1), 9.0, 15), (utc(2026, 1, 20), 1.0)]
    conform(facts(spark, rows), "price").write.parquet(source)
    stream = spark.readStream.schema(contract("price").schema).parquet(source)
    query = stream_hourly(stream, "price").writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["ts_utc"], r["price"]) for r in spark.table("hours").collect()] == [(utc(2026, 1, 1), 1.5)]


def test_freshness_orders_by_need(spark):
    latest = spark.createDataFrame([("DE-LU", "price", utc(2026, 1, 1)), ("DE-LU", "load", utc(2026, 1, 3))], "zone string, dataset string, last_ts_utc timestamp_ntz")
    declared = spark.createDataFrame([("DE-LU", d) for d in DE_LU.datasets], "zone string, dataset string")
    found = {r["dataset"]: r["severity"] for r in quality.freshness(latest, declared, utc(2026, 1, 3, 12)).collect()}
    assert found == {"price": "STALE", "load": "ok", "generation": "MISSING", "fundamentals": "MISSING"}


def test_missing_dataset_is_invalid(spark):
    empty = {name: empty_frame(spark, name) for name in CONTRACTS}
    found = quality.report(empty, DE_LU).collect()
    assert len(found) == 4 and {r["invalid"] for r in found} == {1}


def test_attempt_log(spark, tmp_path):
    root, now = str(tmp_path), dt.datetime(2026, 1, 1, 9)
    logs.start_attempt(root, "a-1", "DE-LU", "ridge", dt.date(2026, 1, 2), "schedule", now)
    logs.start_attempt(root, "a-1", "DE-LU", "ridge", dt.date(2026, 1, 2), "schedule", now)
    assert one(logs.read_attempts(spark, root))["status"] == "started"
    logs.finish_attempt(root, "a-1", "issued", now, "0" * 64)
    logs.start_attempt(root, "a-2", "DE-LU", "ridge", dt.date(2026, 1, 2), "manual", now)
    assert {r["attempt_id"]: r["status"] for r in logs.read_attempts(spark, root).collect()} == {"a-1": "issued", "a-2": "started"}
    for broken in (lambda: logs.finish_attempt(root, "a-1", "issued", now), lambda: logs.finish_attempt(root, "a-3", "issued", now), lambda: logs.finish_attempt(root, "a-2", "great", now), lambda: logs.start_attempt(root, "../x", "DE-LU", "m", dt.date(2026, 1, 2), "manual", now), lambda: logs.start_attempt(root, "a-4", "DE-LU", "m", dt.date(2026, 1, 2), "whim", now), lambda: logs.finish_attempt(root, "a-2", "late", now - HOUR), lambda: logs.finish_attempt(root, "a-2", "failed", now, error_type="it broke"), lambda: logs.finish_attempt(root, "a-2", "issued", now, "id"), lambda: logs.start_attempt(root, "a-1", "DE-LU", "other", dt.date(2026, 1, 2), "schedule", now)):
        with pytest.raises(ValueError):
            broken()
    assert logs.finish_attempt(root, "a-1", "failed", now, if_open=True)["status"] == "issued"


def test_probe_log_appends(spark, tmp_path):
    rows = spark.createDataFrame([("t", "DE-LU", "2026-01-01", "load", 24, 20, 30)], logs.PROBE_SCHEMA)
    for _ in range(2):
        logs.append_probe(rows, str(tmp_path / "log"))
    assert logs.read_probe(spark, str(tmp_path / "log")).count() == 2


def test_release_is_frozen_and_tamper_evident(spark, tmp_path):
    table = spark.createDataFrame([(1, 0.5)], "a int, b double")
    name = evidence.save_release({"t": table}, {"run": 1}, str(tmp_path))
    tables, metadata = evidence.read_release(spark, str(tmp_path))
    assert one(tables["t"]) == {"a": 1, "b": 0.5} and metadata == {"run": 1}
    with pytest.raises(FileExistsError):
        evidence.save_release({"t": table}, {"run": 1}, str(tmp_path))
    (file,) = (tmp_path / name / "t").glob("*.parquet")
    file.write_bytes(b"x")
    with pytest.raises(ValueError, match="altered"):
        evidence.read_release(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        evidence.read_release(spark, str(tmp_path / "nowhere"))
    blob = evidence.write_blob(str(tmp_path), b"data")
    assert evidence.read_blob(str(tmp_path), blob) == b"data"
    (tmp_path / "blobs" / blob).write_bytes(b"other")
    with pytest.raises(ValueError, match="altered"):
        evidence.read_blob(str(tmp_path), blob)


def test_evidence_is_shared_by_month_and_verified(spark, tmp_path):
    rows = facts(spark, [(utc(2026, m, 1), m) for m in (1, 2)])
    first = evidence.save_evidence(str(tmp_path), {"price": rows}, {"issue": 1})
    revised = rows.withColumn("price", F.when(F.col("ts_utc") == utc(2026, 2, 1), 9.0).otherwise(F.col("price")))
    second = evidence.save_evidence(str(tmp_path), {"price": revised}, {"issue": 2})
    blobs = [p for p in (tmp_path / "blobs").iterdir() if not p.name.startswith(".")]
    assert first != second and len(blobs) == 6  # two manifests, three months (January shared), the sources
    tables, metadata = evidence.read_evidence(spark, str(tmp_path), first)
    assert metadata == {"issue": 1} and tables["price"].count() == 2
    with pytest.raises(ValueError):
        evidence.digest({"x": float("nan")})
    assert evidence.fingerprint(rows) == evidence.fingerprint(rows.repartition(3)) != evidence.fingerprint(revised)


def test_model_registry_is_frozen():
    from wattline.plans import registry

    assert registry.get_model("ridge_da").fundamentals and registry.policy_id("ridge") != registry.policy_id("ridge_da")
    with pytest.raises(KeyError):
        registry.get_model("oracle")

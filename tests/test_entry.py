"""The registered queries against their SQL, and the parsing of the command line."""

import glob
import math
import os

import pytest

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries that need more rows than the smallest tables have.
NEED_ROWS = (
    "tree_stump", "tree_choice", "backtest_scores", "backtest_metadata", "ablation_scores", "dispatch_full", "dispatch_summary", "dispatch_two_episodes", "dispatch_last_day", "daily_margins", "study_daily", "study_saved", "scenario_summaries",
    "panel_built", "panel_complete", "ridge_walk_forward_2f", "ridge_level_and_spread", "bootstrap_ci", "ledger_store", "issue_recorded", "battery_on_ledger", "attempt_window", "weakest_buckets", "week_slice", "export_round_trip",
)
#: Of the queries over stores, streams, ledger and battery, each of many jobs, these run by default; all with WATTLINE_SLOW.
BY_DEFAULT = (
    "feed_price", "feed_load", "feed_generation", "feed_fundamentals", "feed_capacity", "http_waits", "http_requests", "store_round_trip", "attempts_log", "ledger_issue", "ridge_rolling_1f", "ridge_walk_forward_2f", "ridge_level_and_spread",
    "tree_stump", "dispatch_full", "bootstrap_ci", "vintages_prospective", "week_slice", "stream_hourly", "evidence_round_trip",
)
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return v


def _names():
    from wattline.plans import oracles
    from wattline.plans.oracles_protocol import protocol_sql

    left_out = set() if os.environ.get("WATTLINE_SLOW") else set(protocol_sql()) - set(BY_DEFAULT)
    return sorted(set(oracles.oracle_sql()) - left_out)


@pytest.fixture(scope="module")
def duck():
    found = {}
    for folder in (SF, LARGER):
        connection = found[folder] = duckdb.connect()
        connection.execute("set TimeZone='UTC'")
        for path in glob.glob(f"{folder}/*.parquet"):
            connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return found


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, duck, name):
    from wattline.plans import oracles, queries

    folder = LARGER if name in NEED_ROWS else SF
    frame = queries.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    result = duck[folder].execute(oracles.oracle_sql()[name])
    given = [c[0] for c in result.description]
    assert sorted(given) == columns
    expected = [tuple(_value(row[given.index(c)]) for c in columns) for row in result.fetchall()]
    found = [tuple(_value(row[c]) for c in columns) for row in frame.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_feed_files_saves_each_payload_by_itself(spark, duck):
    """However many tasks write the payloads, and in whatever order."""
    from wattline.plans import oracles, queries

    changed = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        found = {(r["day"], r["n"]) for r in queries.queries()["feed_files"](spark, LARGER).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == set(duck[LARGER].execute(oracles.oracle_sql()["feed_files"]).fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_command_parses():
    from wattline.cli import parser

    commands = ["ingest", "backfill", "capacity", "probe-fundamentals", "validate", "stats", "freshness", "audit", "export", "backtest", "fundamentals-ablation", "issue", "forecast-attempt", "reconcile", "battery", "battery-study"]
    for command in commands:
        assert callable(parser().parse_args([command]).handler)


def test_exit_codes_on_an_empty_store(spark, tmp_path):
    from wattline import cli

    args = ["--store", str(tmp_path)]
    assert cli.main(["freshness", *args]) == 1 and cli.main(["freshness", "--no-strict", *args]) == 0
    assert cli.main(["audit", *args]) == 1 and cli.main(["stats", *args]) == 0 and cli.main(["validate", *args]) == 0
    assert cli.main(["ingest", "--dry-run", *args]) == 0

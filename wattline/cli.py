"""Command line: thin wrappers; the exit code is the contract (1 on any failure).

Places: --store (facts), --reference (small tables), --ledger (issues, attempts, evidence),
--releases (frozen runs); each can be set by an environment variable of its own.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import logging
import os
import sys
import uuid
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ship import ship_package
from wattline.functions.timeaxis import ZONES, Zone, delivery_hours, get_zone, hours_between, utc_literal
from wattline.operators import ledger, quality, risk, scoring, storage
from wattline.operators.intervals import hourly_mean
from wattline.operators.pit import prospective_vintages, retrospective_vintages
from wattline.plans import exports, issuing, publishing
from wattline.plans.backtest import fundamentals_ablation, run
from wattline.plans.panel import Panel, build_panel
from wattline.plans.registry import MODELS, get_model
from wattline.plans.study import evaluate, save_study, scenario_tables
from wattline.sources import feeds, logs
from wattline.sources.evidence import read_release, save_release
from wattline.sources.ledger_store import LedgerStore
from wattline.sources.store import FactStore, write_reference
from wattline.streaming.ingest import CHUNK_DAYS, exit_code, ingest, summarised

log = logging.getLogger("wattline")


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("wattline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    return spark


def _tomorrow(zone: Zone, now: dt.datetime | None = None) -> dt.date:
    """The next delivery day by the market's clock."""
    now = now or issuing.now_utc()
    return now.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(zone.timezone)).date() + dt.timedelta(days=1)


def _show(frame: DataFrame, rows: int = 200) -> None:
    frame.show(rows, truncate=False)


def _zones(args) -> list[Zone]:
    return [get_zone(z) for z in args.zone] if args.zone else list(ZONES.values())


def _zone(args) -> Zone:
    return get_zone((args.zone or ["DE-LU"])[0])


# Facts


def _ingest(spark, args, bounds=None) -> int:
    now = issuing.now_utc()
    targets = [(z.code, d) for z in _zones(args) for d in (args.dataset or z.datasets)]
    if args.dry_run:
        print("\n".join(f"{z} {d}" for z, d in targets))
        return 0
    fetch = feeds.fetcher(spark, args.source, args.url if args.source == "http" else args.payloads)
    back = dt.timedelta(days=getattr(args, "days", 7))
    results = ingest(FactStore(spark, args.store), _zones(args), fetch, now, args.dataset or None, bounds, args.chunk_days, back)
    print("\n".join(f"{r.zone} {r.dataset} {r.outcome} {r.partitions} {r.error}" for r in results))
    print(" | ".join(f"{k} {v}" for k, v in summarised(results).items()))
    return exit_code(results)


def _backfill(spark, args) -> int:
    now = issuing.now_utc()
    return _ingest(spark, args, (now - dt.timedelta(days=max(1, round(365 * args.years))), now))


def _capacity(spark, args) -> int:
    zone = _zone(args)
    parts = [feeds.installed_power(feeds.saved_payloads(spark, f"{args.payloads}/capacity_{step}"), zone, step) for step in ("yearly", "monthly")]
    rows = parts[0].unionByName(parts[1])
    write_reference(rows, args.reference, "capacity", ("technology", "as_of"))
    return int(not rows.limit(1).count())


def _probe(spark, args) -> int:
    zone, now = _zone(args), issuing.now_utc()
    day = args.date or _tomorrow(zone, now)
    days = spark.range(1).select(F.lit(day).alias("delivery_date"))
    start = dt.datetime.combine(day, dt.time()) - dt.timedelta(days=1)
    if args.payloads or args.source == "http":
        fetch = feeds.fetcher(spark, args.source, args.url if args.source == "http" else args.payloads)
        served = fetch("fundamentals", zone, start, start + dt.timedelta(days=3))
    else:
        served = FactStore(spark, args.store).read("fundamentals", zone.code, start)
    rows = quality.served_hours(served, zone, days, now)
    rows = rows.select(F.lit(now.isoformat()).alias("checked_at_utc"), F.lit(zone.code).alias("zone"), F.col("delivery_date").cast("string"), "series", "hours_expected", "hours_covered", "minutes_before_gate")
    logs.append_probe(rows, args.log)
    _show(rows)
    return 0


def _validate(spark, args) -> int:
    broken = FactStore(spark, args.store).broken_partitions().persist()
    _show(broken)
    return int(broken.limit(1).count() > 0)


def coverage_with_age(store: FactStore, now: dt.datetime) -> DataFrame:
    return store.coverage().withColumn("age_hours", F.round(hours_between(F.col("last_ts_utc"), utc_literal(now)), 1))


def _stats(spark, args) -> int:
    rows = coverage_with_age(FactStore(spark, args.store), issuing.now_utc()).persist()
    _show(rows.select("dataset", "zone", "rows", "partitions", F.round(F.col("bytes") / 1024).cast("long").alias("kb"), "first_ts_utc", "last_ts_utc", "age_hours"))
    total = rows.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    print(f"rows {total['rows'] or 0} | bytes {total['bytes'] or 0}")
    return 0


def _freshness(spark, args) -> int:
    store = FactStore(spark, args.store)
    declared = spark.createDataFrame([(z.code, d) for z in ZONES.values() for d in z.datasets], "zone string, dataset string")
    rows = quality.freshness(store.coverage().select("zone", "dataset", "last_ts_utc"), declared, issuing.now_utc()).persist()
    _show(rows.orderBy(F.col("lag_hours").isNull().desc(), F.desc("lag_hours")))
    return int(args.strict and rows.where("severity <> 'ok'").limit(1).count() > 0)


def _audit(spark, args) -> int:
    store, zone = FactStore(spark, args.store), _zone(args)
    rows = quality.report({d: store.read(d, zone.code) for d in zone.datasets}, zone).persist()
    _show(rows)
    return int(rows.where("invalid > 0").limit(1).count() > 0)


# Backtest, tables, study


def _panel(spark, args, fundamentals: bool = False) -> Panel:
    store, zone = FactStore(spark, args.store), _zone(args)
    vintages = retrospective_vintages(store.read("fundamentals", zone.code), zone) if fundamentals else None
    return build_panel(store.read("price", zone.code), zone, store.read("load", zone.code), store.read("generation", zone.code), vintages)


def _backtest(spark, args) -> int:
    result = run(_panel(spark, args, args.include_fundamentals), args.train_days, args.validation_days, trees=args.trees)
    scores = result.scores if args.scope == "all" else result.scores.where(F.col("scope") == args.scope)
    _show(scores.orderBy("scope", "bucket", "mae"))
    fitted = result.scores.where(~F.col("model").isin(*risk.BASELINES))
    print(f"fitted models lost to a naive in {fitted.where('skill_vs_best_baseline_pct <= 0').count()} buckets; weakest:")
    _show(scoring.weakest(fitted))
    print(json.dumps(result.metadata()))
    if args.save_release:
        try:
            print(save_release(publishing.release_tables(result), result.metadata(), args.releases))
        except FileExistsError as error:
            print(error)
    return 0


def _ablation(spark, args) -> int:
    rows = fundamentals_ablation(_panel(spark, args), _panel(spark, args, True), min_train_days=args.train_days, validation_days=args.validation_days, trees=args.trees).persist()
    write_reference(rows, args.reference, "fundamentals_ablation", ("model", "include_fundamentals"))
    _show(rows)
    return 0


def _export(spark, args) -> int:
    tables, facts = publishing.site_tables(FactStore(spark, args.store), args.reference, args.releases, _zone(args))
    if args.check:
        differing = exports.export_differences(tables, args.out) + exports.fact_differences(facts, args.out)
        print("\n".join(differing) or "no difference")
        return int(bool(differing))
    exports.export_all(tables, args.out, facts)
    print("\n".join(sorted([*tables, *(f"{name}.json" for name in facts)])))
    return 0


def _models(frame: DataFrame) -> list[str]:
    return sorted(r[0] for r in frame.select("model").distinct().collect())


def _actuals(spark, args) -> DataFrame:
    zone = _zone(args)
    return hourly_mean(FactStore(spark, args.store).read("price", zone.code), zone, "price")


def _battery(spark, args) -> int:
    """Dispatch on canonical, settled forecasts of the ledger only."""
    zone, store = _zone(args), LedgerStore(spark, args.ledger)
    scored = issuing.scored_predictions(store, _actuals(spark, args), zone).persist()
    if not scored.limit(1).count():
        print("no complete scored delivery day yet")
        return 0
    inputs, coverage = storage.compared(scored, zone, _models(scored))
    dispatched = storage.dispatch(inputs, [storage.BatterySpec(energy_mwh=e) for e in args.energy]).persist()
    tables = {"dispatch": dispatched, "summary": storage.summarize(dispatched), "coverage": coverage}
    _show(tables["coverage"])
    _show(tables["summary"])
    if args.out:
        exports.export_all({f"{zone.code}_{name}": frame for name, frame in tables.items()}, args.out)
    return 0


def _study(spark, args) -> int:
    zone = _zone(args)
    if args.predictions:
        rows = spark.read.parquet(args.predictions).withColumn("local_date", F.to_date("local_date"))
    else:
        rows = publishing.release_predictions(read_release(spark, args.releases)[0], zone)
    costs = {"variable_cost_eur_mwh": args.variable_cost, "degradation_cost_eur_mwh": args.degradation_cost}
    try:
        rows = rows.drop("zone").persist()
        study = evaluate(rows, zone, _models(rows), args.energy, storage.BatterySpec(**costs), block_days=args.block_days, resamples=args.resamples, seed=args.seed)
        if args.out:
            assumptions = {**costs, "sizes_mwh": args.energy, "block_days": args.block_days, "resamples": args.resamples, "seed": args.seed, "zone": zone.code, "models": _models(rows)}
            print(save_study(study, rows, assumptions, args.out))
    except (ValueError, FileExistsError) as error:
        print(error)
        return 1
    for frame in (study.coverage, study.summary, risk.annualised(study.risk), study.comparisons):
        _show(frame)
    if args.stresses:
        _show(scenario_tables(rows, zone, study, _models(rows), args.energy))
    return 0


# Ledger


def _issue(spark, args) -> int:
    """Forecast one delivery day before the gate, keep its evidence, add it to the ledger."""
    zone, store = _zone(args), LedgerStore(spark, args.ledger)
    identifier = args.id or uuid.uuid4().hex
    known = logs.attempt(args.ledger, identifier)
    try:
        model = get_model(args.model)
        day = args.date or (dt.date.fromisoformat(str(known["delivery_date"])) if known else _tomorrow(zone))
        begun = logs.start_attempt(args.ledger, identifier, zone.code, args.model, day, str(known["origin"]) if known else args.origin, issuing.now_utc())
        if begun["status"] != "started":
            raise ValueError(f"attempt {identifier} is closed; use a new one")
    except (KeyError, ValueError) as error:
        print(error)
        return 1
    try:
        prior = None if args.allow_late else issuing.canonical_issue(store, zone, args.model, day)
        if prior:
            logs.finish_attempt(args.ledger, identifier, "already_issued", issuing.now_utc(), prior)
            print(f"already issued as {prior[:12]}")
            return 0
        facts, sources, observed = FactStore(spark, args.store), {}, {}
        for name in zone.datasets:
            sources[name], observed[name] = facts.read(name, zone.code), issuing.now_utc()
        vintages = prospective_vintages(sources["fundamentals"], zone, day, observed["fundamentals"]) if model.fundamentals else None
        if vintages is not None:  # earlier days keep what was published by their own gates
            vintages = retrospective_vintages(sources["fundamentals"].where(F.col("ts_utc") < utc_literal(dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=2))), zone).unionByName(vintages)
        as_of = issuing.now_utc()
        cells = issuing.day_grid(spark, zone, day).select(F.col("delivery_date").alias("local_date"), "local_hour")
        panel = build_panel(sources["price"], zone, sources["load"], sources["generation"], vintages, cells)
        rows = issuing.record_issue(store, panel, model, day, as_of, sources, observed, allow_late=args.allow_late, clock=issuing.now_utc)
        status = issuing.outcome_of(rows)
        logs.finish_attempt(args.ledger, identifier, status, issuing.now_utc(), rows.first()["issue_id"])
    except Exception as error:  # the attempt records how it ended
        log.debug("issue failed", exc_info=True)
        status = "late" if isinstance(error, ledger.LateIssueError) else "failed"
        logs.finish_attempt(args.ledger, identifier, status, issuing.now_utc(), error_type=type(error).__name__, if_open=True)
        print(f"{status}: {type(error).__name__}: {error}")
        return 1
    print(status)
    return int(status != "issued")


def attempt_days(spark, store: LedgerStore, zone: Zone, model: str, first: dt.date, last: dt.date) -> DataFrame:
    """The report of a window of delivery days, attempted or not."""
    if first > last:
        raise ValueError("the report's first day must not follow its last")
    get_model(model)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("delivery_date"))
    expected = delivery_hours(days, zone).groupBy("delivery_date").agg(F.count(F.lit(1)).alias("expected_hours"))
    tries = logs.read_attempts(spark, store.root).where((F.col("zone") == zone.code) & (F.col("model") == model))
    chosen = issuing.canonical_verified(store, store.read(zone), zone).where(F.col("model") == model).select("delivery_date", "issue_id").distinct()
    return ledger.attempt_report(tries, chosen, expected).select("delivery_date", F.lit(zone.code).alias("zone"), F.lit(model).alias("model"), "expected_hours", "attempts", "scheduled_attempts", "failed_attempts", "status", "eligible", "issue_id")


def _attempt(spark, args) -> int:
    zone = _zone(args)
    try:
        if args.action == "report":
            if not (args.first and args.last):
                raise ValueError("a report needs --first and --last")
            rows = attempt_days(spark, LedgerStore(spark, args.ledger), zone, args.model, args.first, args.last).persist()
            _show(rows.orderBy("delivery_date"))
            print(f"eligible {rows.where('eligible').count()} of {rows.count()} days")
        elif not args.id:
            raise ValueError("start and finish need --id")
        elif args.action == "start":
            get_model(args.model)
            print(logs.start_attempt(args.ledger, args.id, zone.code, args.model, args.date or _tomorrow(zone), args.origin, issuing.now_utc()))
        else:
            print(logs.finish_attempt(args.ledger, args.id, args.status, issuing.now_utc(), args.issue, if_open=args.if_open))
    except (KeyError, ValueError) as error:
        print(error)
        return 1
    return 0


def _reconcile(spark, args) -> int:
    zone, store = _zone(args), LedgerStore(spark, args.ledger)
    settled = ledger.reconcile(store.read(zone), _actuals(spark, args))
    store.append(settled, zone)
    _show(ledger.status_counts(store.read(zone)))
    return 0


def _place(flag: str, folder: str) -> tuple[str, dict]:
    """A folder option whose default can be set by WATTLINE_<NAME>."""
    return f"--{flag}", {"default": os.environ.get(f"WATTLINE_{flag.upper()}", folder)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wattline")
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, handler, *flags):
        sub = commands.add_parser(name)
        sub.set_defaults(handler=handler)
        places = (_place("store", "data/curated"), _place("reference", "data/reference"), _place("ledger", "data/forecasts"), _place("releases", "data/experiments"))
        for flag, options in (*places, ("--zone", {"action": "append"}), *flags):
            sub.add_argument(flag, **options)

    date = {"type": dt.date.fromisoformat, "default": None}
    feed = (("--payloads", {"default": "data/payloads"}), ("--source", {"choices": sorted(feeds.SOURCES), "default": "files"}), ("--url", {"default": os.environ.get("WATTLINE_URL", "")}))
    common = (*feed, ("--dataset", {"action": "append"}), ("--dry-run", {"action": "store_true"}), ("--chunk-days", {"type": int, "default": CHUNK_DAYS}))
    split = (("--train-days", {"type": int, "default": 270}), ("--validation-days", {"type": int, "default": 90}), ("--trees", {"action": "store_true"}))
    energy = ("--energy", {"type": float, "nargs": "+", "default": [1.0, 2.0, 4.0]})
    model = ("--model", {"default": "ridge", "choices": sorted(MODELS)})
    origin = ("--origin", {"default": "manual", "choices": logs.ORIGINS})
    command("ingest", _ingest, *common, ("--days", {"type": int, "default": 7}))
    command("backfill", _backfill, *common, ("--years", {"type": float, "default": 2.0}))
    command("capacity", _capacity, *feed)
    command("probe-fundamentals", _probe, ("--payloads", {"default": None}), *feed[1:], ("--date", date), ("--log", {"default": "data/probe"}))
    command("validate", _validate)
    command("stats", _stats)
    command("freshness", _freshness, ("--strict", {"action": argparse.BooleanOptionalAction, "default": True}))
    command("audit", _audit)
    command("export", _export, ("--out", {"default": "data/exports"}), ("--check", {"action": "store_true"}))
    command("backtest", _backtest, *split, ("--scope", {"default": "overall", "choices": ("overall", "block", "regime", "year", "hour", "all")}), ("--include-fundamentals", {"action": "store_true"}), ("--save-release", {"action": "store_true"}))
    command("fundamentals-ablation", _ablation, *split)
    command("issue", _issue, ("--date", date), ("--id", {"default": None}), model, origin, ("--allow-late", {"action": "store_true"}))
    command(
        "forecast-attempt", _attempt, ("action", {"nargs": "?", "choices": ("start", "finish", "report"), "default": "report"}), ("--id", {"default": None}), model, origin, ("--date", date),
        ("--status", {"default": "failed", "choices": logs.STATUSES}), ("--issue", {"default": None}), ("--if-open", {"action": "store_true"}), ("--first", date), ("--last", date),
    )
    command("reconcile", _reconcile)
    command("battery", _battery, energy, ("--out", {"default": None}))
    command(
        "battery-study", _study, ("--predictions", {"default": None}), energy, ("--variable-cost", {"type": float, "default": 0.0}), ("--degradation-cost", {"type": float, "default": 0.0}), ("--block-days", {"type": int, "default": 7}),
        ("--resamples", {"type": int, "default": 2000}), ("--seed", {"type": int, "default": 20260914}), ("--stresses", {"action": "store_true"}), ("--out", {"default": None}),
    )
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return int(args.handler(_spark(), args) or 0)


if __name__ == "__main__":
    sys.exit(main())

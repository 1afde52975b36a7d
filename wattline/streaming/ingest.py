"""Ingest as batch and as a stream: windows, isolation of failures, keyed upserts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattline.functions.timeaxis import Zone
from wattline.sources.contracts import conform, contract
from wattline.sources.feeds import chunks
from wattline.sources.store import FactStore

#: Re-read this far back, this far ahead, at most this many days a request.
LOOKBACK = dt.timedelta(days=7)
AHEAD = {"price": dt.timedelta(days=2), "fundamentals": dt.timedelta(days=2)}
CHUNK_DAYS = 60

Fetch = Callable[[str, Zone, dt.datetime, dt.datetime], DataFrame]


@dataclass(frozen=True)
class IngestResult:
    zone: str
    dataset: str
    outcome: str  # written, empty or failed
    partitions: int = 0
    error: str = ""


def resolve_window(now: dt.datetime, last: dt.datetime | None, dataset: str, back: dt.timedelta = LOOKBACK) -> tuple[dt.datetime, dt.datetime]:
    """[min(now, last) - back, now + ahead): late revisions are read again."""
    return min(now, last or now) - back, now + AHEAD.get(dataset, dt.timedelta())


def ingest(
    store: FactStore, zones: Iterable[Zone], fetch: Fetch, now: dt.datetime, datasets: Iterable[str] | None = None, bounds: tuple[dt.datetime, dt.datetime] | None = None, chunk_days: int = CHUNK_DAYS,
    back: dt.timedelta = LOOKBACK,
) -> list[IngestResult]:
    """Fetch, validate and upsert each target; one failing target does not stop the others.

    Every chunk is durable by itself, so a failure keeps what came before it.
    """
    if bounds and bounds[0] >= bounds[1]:
        raise ValueError("the window must start before it ends")
    results = []
    for zone in zones:
        for dataset in datasets or zone.datasets:
            written = 0
            try:
                start, end = bounds or resolve_window(now, store.last_ingested(dataset, zone.code), dataset, back)
                for low, high in chunks(start, end, min(chunk_days, CHUNK_DAYS)):
                    written += store.write(fetch(dataset, zone, low, high), dataset)
                results.append(IngestResult(zone.code, dataset, "written" if written else "empty", written))
            except Exception as error:  # the outcome carries it; other targets go on
                results.append(IngestResult(zone.code, dataset, "failed", written, str(error).splitlines()[0] if str(error) else type(error).__name__))
    return results


def summarised(results: Iterable[IngestResult]) -> dict[str, int]:
    """How many targets ended in each way."""
    listed = list(results)
    return {outcome: sum(r.outcome == outcome for r in listed) for outcome in ("written", "empty", "failed")}


def exit_code(results: Iterable[IngestResult]) -> int:
    return int(any(r.outcome == "failed" for r in results))


def stream_upserts(spark: SparkSession, source: str, dataset: str, store: FactStore, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Upsert Parquet facts as they arrive: each micro-batch is one keyed merge.

    Later files revise earlier ones: within a batch the row from the file with the latest
    modification time counts, by name if two are equal; of rows of one file the largest.
    Replays of a batch change nothing, since the merge is by key.
    """
    schema = contract(dataset).schema
    facts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    facts = facts.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("turn"))

    def merge(batch: DataFrame, _: int) -> None:
        key = list(contract(dataset).key)
        rest = [c for c in schema.names if c not in key]
        latest = batch.groupBy(*key).agg(F.max(F.struct("turn", *rest)).alias("x")).select(*key, *[f"x.{c}" for c in rest])
        store.write(conform(latest, dataset), dataset, validate_first=False)

    return facts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_hourly(facts: DataFrame, column: str, lateness: str = "7 days") -> DataFrame:
    """Tumbling UTC hours of a fact stream, emitted once complete and past the watermark."""
    # Instants by arithmetic: casts between the two timestamp types would go through the session zone.
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    hours = facts.withColumn("ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts_utc")))).withColumn("h", F.col("resolution_min").cast("double") / 60)
    grouped = hours.withWatermark("ts", lateness).groupBy("zone", F.window("ts", "1 hour"))
    minutes = F.minute("ts_utc") + F.second("ts_utc") / 60
    sums = grouped.agg(
        F.try_divide(F.sum(F.col(column) * F.col("h")), F.sum("h")).alias(column),
        F.sum("h").alias("covered_hours"),
        F.count_if(F.col(column).isNull()).alias("missing"),
        F.sort_array(F.collect_list(F.struct(minutes.alias("at"), F.col("resolution_min").cast("double").alias("long")))).alias("parts"),
    )
    # Intervals must tile the hour: each starts where the one before it ends.
    tiled = F.aggregate("parts", F.lit(0.0), lambda end, p: F.when(F.abs(p["at"] - end) < 1e-9, p["at"] + p["long"]).otherwise(F.lit(float("nan"))))
    whole = (F.abs(F.col("covered_hours") - 1) < 1e-9) & (F.col("missing") == 0) & (F.abs(tiled - 60) < 1e-9)
    return sums.where(whole).select("zone", F.timestamp_add("MICROSECOND", F.unix_micros("window.start"), epoch).alias("ts_utc"), column)

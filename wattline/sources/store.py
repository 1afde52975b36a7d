"""Upserting Parquet store of interval facts: one folder per dataset, zone and UTC month."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from wattline.functions.timeaxis import utc_literal
from wattline.functions.work import dropped, saved

from .contracts import CONTRACTS, conform, contract, empty_frame, validated, violations


class FactStore:
    """Facts by dataset, zone and month; revised intervals converge by key.

    Writers of different months do not disturb each other; of two that rewrite one month at
    the same time the later one wins.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        contract(name)
        return f"{self.root}/{name}"

    def _raw(self, name: str) -> DataFrame | None:
        schema = T.StructType([*contract(name).schema.fields, T.StructField("month", T.StringType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException:
            return None

    def read(self, name: str, zone: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """Facts of one dataset; zone and time bounds prune folders, then row groups."""
        frame = self._raw(name)
        if frame is None:
            return empty_frame(self.spark, name)
        if zone:
            frame = frame.where(F.col("zone") == zone)
        if start:
            first = utc_literal(start)
            frame = frame.where((F.col("ts_utc") >= first) & (F.col("month") >= F.date_format(first, "yyyy-MM")))
        if end:
            last = utc_literal(end)
            frame = frame.where((F.col("ts_utc") < last) & (F.col("month") <= F.date_format(last, "yyyy-MM")))
        return conform(frame.drop("month"), name)

    def write(self, frame: DataFrame, name: str, validate_first: bool = True) -> int:
        """Upsert by key, incoming rows win; returns the number of partitions rewritten.

        Every write has a stage folder of its own: what comes in is worked out once, and the
        merge is written beside the target that it reads.
        """
        stage = f"{self.root}/.stage/{name}-{uuid.uuid4().hex}"
        try:
            incoming = saved(self.spark, conform(frame, name), f"{stage}/incoming")
            if validate_first:
                validated(incoming, name)
            incoming = incoming.withColumn("month", F.date_format("ts_utc", "yyyy-MM"))
            touched = [tuple(r) for r in incoming.select("zone", "month").distinct().collect()]  # partitions, not rows
            if not touched:
                return 0
            merged = incoming
            stored = self._raw(name)
            if stored is not None:
                keep = reduce(or_, [(F.col("zone") == z) & (F.col("month") == m) for z, m in touched])
                merged = upserted(stored.where(keep), incoming, contract(name).key)
            merged = saved(self.spark, merged.repartition("zone", "month").sortWithinPartitions(*contract(name).key), f"{stage}/merged")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("zone", "month").parquet(self.path(name))
            return len(touched)
        finally:
            dropped(self.spark, stage)

    def last_ingested(self, name: str, zone: str) -> dt.datetime | None:
        return self.read(name, zone).agg(F.max("ts_utc")).first()[0]

    def broken_partitions(self) -> DataFrame:
        """(dataset, zone, month, rule, violations): every rule of every partition that is not kept."""
        parts = []
        for name in CONTRACTS:
            raw = self._raw(name)
            if raw is not None:
                parts.append(violations(raw, name, ("zone", "month")))
        if not parts:
            return self.spark.createDataFrame([], "dataset string, zone string, month string, rule string, violations long")
        return reduce(DataFrame.unionByName, parts).where("violations > 0")

    def coverage(self) -> DataFrame:
        """dataset, zone, rows, first and last start, partitions, bytes."""
        parts = []
        for name in CONTRACTS:
            raw = self._raw(name)
            if raw is None:
                continue
            files = raw.select("zone", "month", "ts_utc", "_metadata.file_path", "_metadata.file_size")
            per_file = files.groupBy("zone", "month", "file_path").agg(F.max("file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("ts_utc").alias("lo"), F.max("ts_utc").alias("hi"))
            parts.append(
                per_file.groupBy("zone").agg(
                    F.lit(name).alias("dataset"), F.sum("rows").alias("rows"), F.min("lo").alias("first_ts_utc"), F.max("hi").alias("last_ts_utc"), F.countDistinct("month").alias("partitions"), F.sum("bytes").alias("bytes")
                )
            )
        if not parts:
            return self.spark.createDataFrame([], "zone string, dataset string, rows long, first_ts_utc timestamp_ntz, last_ts_utc timestamp_ntz, partitions long, bytes long")
        return reduce(DataFrame.unionByName, parts)


def upserted(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Union of both, one row per key, incoming rows first."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy(*key).orderBy(F.desc("__new"))
    return both.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank", "__new")


#: Small tables that are replaced wholesale.
REFERENCE: dict[str, str] = {
    "capacity": "country string, time_step string, period string, as_of date, technology string, value double, unit string, is_planned boolean, source string",
    "fundamentals_ablation": "zone string, model string, include_fundamentals boolean, n bigint, mae double, rmse double, skill_vs_best_baseline_pct double, test_start string, test_end string",
}


def write_reference(frame: DataFrame, root: str, name: str, order: tuple[str, ...]) -> None:
    """Replace a reference table wholesale; an empty frame changes nothing."""
    schema = T.StructType.fromDDL(_reference(name))
    table = frame.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    if table.limit(1).count():
        table.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(f"{root.rstrip('/')}/{name}")


def read_reference(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A reference table, or an empty one of its type while there is none."""
    schema = _reference(name)
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _reference(name: str) -> str:
    if name not in REFERENCE:
        raise KeyError(f"unknown reference table {name!r}; known: {sorted(REFERENCE)}")
    return REFERENCE[name]

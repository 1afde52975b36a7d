"""The forecast ledger on disk: issued rows never change, outcomes may be filled in."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wattline.functions.timeaxis import Zone
from wattline.functions.work import dropped, saved
from wattline.operators.ledger import ISSUE_SCHEMA, KEYS, appended, conformed, verified


class LedgerStore:
    """Parquet by zone and delivery month; every read and append is validated."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def path(self) -> str:
        return f"{self.root}/ledger"

    def _raw(self, zone: Zone) -> DataFrame | None:
        try:
            rows = self.spark.read.schema(f"{ISSUE_SCHEMA}, month string").parquet(self.path)
        except AnalysisException:
            return None
        return rows.where(F.col("zone") == zone.code)

    def read(self, zone: Zone) -> DataFrame:
        rows = self._raw(zone)
        if rows is None:
            return self.spark.createDataFrame([], ISSUE_SCHEMA)
        return verified(conformed(rows), zone)

    def append(self, issues: DataFrame, zone: Zone) -> int:
        """Add issues or fill in outcomes; returns the number of months rewritten."""
        stage = f"{self.root}/.stage/{uuid.uuid4().hex}"
        try:
            incoming = verified(saved(self.spark, conformed(issues), f"{stage}/incoming"), zone)
            month = F.date_format("delivery_date", "yyyy-MM")
            months = [r[0] for r in incoming.select(month).distinct().collect()]  # months, not rows
            if not months:
                return 0
            merged, stored = incoming, self._raw(zone)
            if stored is not None:
                touched = reduce(or_, [F.col("month") == m for m in months])
                merged = appended(conformed(stored.where(touched)), incoming)
            merged = merged.withColumn("month", month).repartition("month").sortWithinPartitions(*KEYS)
            merged = saved(self.spark, merged, f"{stage}/merged")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("zone", "month").parquet(self.path)
            return len(months)
        finally:
            dropped(self.spark, stage)

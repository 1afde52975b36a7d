"""Work tables on the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .ship import ship_package

_OWN_DIRS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the setting is absent and everything runs on one machine (tests) a folder
    is made here; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _OWN_DIRS:
        folder = tempfile.mkdtemp(prefix="wattline-work-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN_DIRS[context.applicationId] = "file://" + folder
    return _OWN_DIRS[context.applicationId]


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of one operator."""
    ship_package(spark)
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(spark: SparkSession, frame: DataFrame, path: str) -> DataFrame:
    """Write a work table and read it back: cuts lineage and survives lost executors."""
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete work tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)

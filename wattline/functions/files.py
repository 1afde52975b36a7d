"""Small files on any Hadoop file system, written by the driver: manifests, events, blobs."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _target(spark, path)
    return bool(system.exists(target))


def read_file(spark: SparkSession, path: str) -> bytes:
    target, system = _target(spark, path)
    if not system.exists(target):
        raise FileNotFoundError(path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    target, system = _target(spark, path)
    stream = system.create(target, False)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def create_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file that must not exist yet; readers see it whole or not at all."""
    if exists(spark, path):
        raise FileExistsError(path)
    _swap_in(spark, path, data)


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Replace a file through a temporary one beside it: never left truncated."""
    target, system = _target(spark, path)
    if system.exists(target):
        system.delete(target, False)
    _swap_in(spark, path, data)


def _swap_in(spark: SparkSession, path: str, data: bytes) -> None:
    folder, _, name = path.rpartition("/")
    temporary = f"{folder}/.part-{name}-{uuid.uuid4().hex}"
    _put(spark, temporary, data)
    source, system = _target(spark, temporary)
    if not system.rename(source, _target(spark, path)[0]):
        system.delete(source, False)
        raise FileExistsError(path)

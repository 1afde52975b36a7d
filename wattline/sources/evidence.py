"""Content-addressed evidence and frozen releases: verified on every read.

Everything lies on a Hadoop file system; tables are written and checked by Spark, only
manifests and one blob at a time pass the driver.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
from collections.abc import Iterable, Mapping
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.files import create_file, exists, read_file, replace_file


def digest(value: object) -> str:
    """SHA-256 of a value's canonical JSON; values that JSON cannot hold exactly are refused."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, allow_nan=False).encode()).hexdigest()


def fingerprint(frame: DataFrame, digits: int | None = 6) -> str:
    """Order-free digest of a frame's rows and types; floats are rounded first, or taken exactly.

    Row hashes are added and xor-ed where the rows are, so nothing is sorted or gathered.
    """
    exact = lambda c: F.col(f"`{c}`")
    rows = frame.select(*[F.round(exact(c), digits).alias(c) if digits is not None and kind in ("double", "float") else exact(c) for c, kind in frame.dtypes])
    one = F.xxhash64(*[F.coalesce(exact(c).cast("string"), F.lit("\0null")) for c in rows.columns])
    total = rows.select(one.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 40)))).first()
    return digest([[list(t) for t in frame.dtypes], *total])


def _sums(spark: SparkSession, paths: Iterable[str], pattern: str = "*") -> dict[str, str]:
    """SHA-256 by file name, worked out where the files are read."""
    listed = list(paths)
    if not listed:
        return {}
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(listed)
    try:
        return {r["path"].rpartition("/")[2]: r["sum"] for r in files.select("path", F.sha2("content", 256).alias("sum")).collect()}
    except Exception as error:  # the file system's own checksum found the change first
        if "Checksum" in str(error):
            raise ValueError("a stored file was altered") from error
        raise


def _folder(root: str, *parts: str) -> str:
    return "/".join([str(root).rstrip("/"), *parts])


# Blobs


def write_blob(root: str, data: bytes) -> str:
    """Store bytes under their own digest; equal content is stored once."""
    spark, name = SparkSession.active(), hashlib.sha256(data).hexdigest()
    path = _folder(root, "blobs", name)
    if not exists(spark, path):
        create_file(spark, path, data)
    return name


def blob_path(root: str, name: str) -> str:
    if not re.fullmatch(r"[0-9a-f]{64}", name):
        raise ValueError(f"bad blob name {name!r}")
    return _folder(root, "blobs", name)


def read_blob(root: str, name: str) -> bytes:
    try:
        data = read_file(SparkSession.active(), blob_path(root, name))
    except Exception as error:
        if "Checksum" in str(error):
            raise ValueError(f"blob {name} was altered") from error
        raise
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError(f"blob {name} was altered")
    return data


# Releases


def save_release(tables: Mapping[str, DataFrame], metadata: Mapping[str, object], root: str) -> str:
    """Freeze result tables under an id made from their metadata; refuses to overwrite."""
    spark = next(iter(tables.values())).sparkSession
    identifier = digest(dict(metadata))[:20]
    folder = _folder(root, identifier)
    if exists(spark, folder):
        raise FileExistsError(f"release {identifier} exists")
    sums = {}
    for name, frame in tables.items():
        frame.coalesce(1).write.option("compression", "zstd").parquet(_folder(folder, name))
        sums[name] = sorted(_sums(spark, [_folder(folder, name)], "*.parquet").values())
    # The manifest comes last: a release without one is incomplete.
    create_file(spark, _folder(folder, "run.json"), json.dumps({"metadata": dict(metadata), "sha256": sums}, sort_keys=True).encode())
    replace_file(spark, _folder(root, "current.json"), json.dumps({"release": identifier}).encode())
    return identifier


def read_release(spark: SparkSession, root: str, identifier: str | None = None) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """Tables and metadata of a release, every file checked against its checksum; raises while there is none."""
    if identifier is None:
        if not exists(spark, _folder(root, "current.json")):
            raise FileNotFoundError(f"no frozen release under {root}: save one first")
        identifier = json.loads(read_file(spark, _folder(root, "current.json")))["release"]
    if not re.fullmatch(r"[0-9a-f]{20}", identifier):
        raise ValueError(f"bad release id {identifier!r}")
    folder = _folder(root, identifier)
    manifest = json.loads(read_file(spark, _folder(folder, "run.json")))
    if digest(manifest["metadata"])[:20] != identifier:
        raise ValueError(f"release {identifier} does not match its metadata")
    tables = {}
    for name, expected in manifest["sha256"].items():
        if sorted(_sums(spark, [_folder(folder, name)], "*.parquet").values()) != expected:
            raise ValueError(f"{name} of release {identifier} was altered")
        tables[name] = spark.read.parquet(_folder(folder, name))
    return tables, manifest["metadata"]


# Evidence


def source_digest() -> tuple[str, bytes]:
    """Digest and content of this package's own source files, as one JSON text."""
    root = Path(__file__).resolve().parents[1]
    files = {str(p.relative_to(root)): p.read_text(encoding="utf-8") for p in sorted(root.rglob("*.py"))} if root.is_dir() else {}
    data = json.dumps(files, sort_keys=True).encode()
    return hashlib.sha256(data).hexdigest(), data


def _months(frame: DataFrame, stamp: str | None) -> DataFrame:
    """(month, data): the sorted rows of every month as the bytes of one Parquet file."""
    month = F.date_format(stamp, "yyyy-MM") if stamp else F.lit("all")
    rows = frame.withColumn("__month", month)

    def packed(part: pa.Table) -> pa.Table:
        name, table = part.column("__month")[0].as_py(), part.drop_columns(["__month"])
        table = table.sort_by([(c, "ascending") for c, k in zip(table.column_names, table.schema.types, strict=True) if not pa.types.is_nested(k)])
        out = io.BytesIO()
        pq.write_table(table.replace_schema_metadata(None).combine_chunks(), out, compression="zstd", coerce_timestamps="us")
        return pa.table({"month": [name], "data": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy("__month").applyInArrow(packed, "month string, data binary")


def save_evidence(root: str, tables: Mapping[str, DataFrame], metadata: Mapping[str, object], stamps: Iterable[str] = ("ts_utc", "local_date", "delivery_date")) -> str:
    """Store the inputs of one issue as content-addressed monthly blobs; returns their manifest's name.

    Unchanged months of a later issue are the same blobs. Months come to the driver one by
    one. The package's own sources are kept beside them.
    """
    listed: dict[str, dict[str, str]] = {}
    for name, frame in tables.items():
        stamp = next((c for c in stamps if c in frame.columns), None)
        listed[name] = {row["month"]: write_blob(root, row["data"]) for row in _months(frame, stamp).toLocalIterator()}
    code, data = source_digest()
    write_blob(root, data)
    return write_blob(root, json.dumps({"metadata": dict(metadata), "tables": listed, "code": code}, sort_keys=True).encode())


def read_evidence(spark: SparkSession, root: str, name: str) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """Tables and metadata of a manifest; every blob is verified before it is read."""
    manifest = json.loads(read_blob(root, name))
    read_blob(root, manifest["code"])
    blobs = sorted({b for months in manifest["tables"].values() for b in months.values()})
    if _sums(spark, [blob_path(root, b) for b in blobs]) != {b: b for b in blobs}:
        raise ValueError(f"evidence {name} was altered")
    tables = {table: spark.read.parquet(*[blob_path(root, b) for b in months.values()]) for table, months in manifest["tables"].items() if months}
    return tables, manifest["metadata"]

"""Shared pieces of the pipeline operators: Arrow helpers, worker memory, names; work tables come along."""

from __future__ import annotations

import contextlib
import ctypes
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.work import dropped, saved, shared_root, work_folder  # noqa: F401

#: ASCII white space that separates words in every contract of this subpackage.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: Rows turned into Python objects at a time; bounds a worker's memory on long texts.
ROWS_AT_ONCE = 256

def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def merged(spark: SparkSession, frame: DataFrame, of: int = 8) -> DataFrame:
    """``frame`` in a partition for ``of`` of a shuffle, two per core at least, if it has more.

    Each partition becomes a file when the table is written, and on a local file system an
    executor starts helper processes for each file. The partitions of a task are worked
    through one after another: a Python worker holds one of them at a time.
    """
    return frame.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-shuffle_partitions(spark) // of)))


#: Seconds after which an idle Python worker lets go of what it remembers.
IDLE_SECONDS = 3.0
_WORKER: dict = {"owner": None, "kept": {}, "timer": None, "lock": threading.Lock()}


def worker_memory(owner: str) -> dict:
    """What one operator keeps in a reused Python worker; another operator's is let go first."""
    if _WORKER["owner"] != owner:
        _WORKER["owner"], _WORKER["kept"] = owner, {}
    return _WORKER["kept"]


def _trim() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def _let_go() -> None:
    with _WORKER["lock"]:
        _WORKER["owner"], _WORKER["kept"] = None, {}
    _trim()


@contextlib.contextmanager
def lean_worker(owner: str):
    """Around the work of a partition or batch.

    Python workers outlive their tasks, so without this the peaks of all operators add
    up: freed memory goes back at the end, and what is remembered between tasks goes
    when no further task of the operator comes soon.
    """
    with _WORKER["lock"]:
        if _WORKER["timer"] is not None:
            _WORKER["timer"].cancel()
            _WORKER["timer"] = None
        worker_memory(owner)
    try:
        yield
    finally:
        _trim()
        timer = threading.Timer(IDLE_SECONDS, _let_go)
        timer.daemon = True
        with _WORKER["lock"]:
            if _WORKER["timer"] is not None:
                _WORKER["timer"].cancel()
            _WORKER["timer"] = timer
        timer.start()


def lean(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A partition function that runs inside ``lean_worker``."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker(owner):
            yield from run(batches)

    return wrapped


def fresh_name(frame: DataFrame, stem: str) -> str:
    """A column name that ``frame`` does not have (names are compared without case)."""
    taken = {c.lower() for c in frame.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        name, n = f"__{stem}_{n}", n + 1
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of a column's text form, modulo; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that only a few rows are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches at about ``limit`` bytes of one binary or text column.

    A single longer value still comes whole: no text is ever shortened.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)

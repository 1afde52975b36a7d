"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight vector over hashed text features gives a latent score; ordered thresholds
cut it into grades: P(grade <= k) = sigmoid(threshold_k - score). Documents get the
expected grade and the tail probability P(grade >= k) on which selection rests.

Features of a text: the buckets of its distinct lower-cased words (edge punctuation
removed) and of binned shares of shouted words, symbols, separators and repetition, all
hashed into ``1 << bits`` weights; a bucket counts once per text, in training as in
scoring. Training uses at most ``max_rows`` graded ids, picked by a hash of the id (a
documented bound); every document is scored over its whole text.

Defined cases: null or empty text has only the shape features; without labelled rows
all weights are zero and everything is kept (tail probability 1); rows with a null
grade or id are not used to train; of several grades of one id the smallest counts, of
several texts the one whose features sort first; repeated rows are scored each by itself;
other columns, whatever their names, are ignored; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ship import ship_package

from ._common import by_bytes, fresh_name, lean, lean_worker, worker_memory

#: Characters stripped from the edges of a word before it is hashed.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SHARES = (0.0, 0.02, 0.1, 0.3, 0.6)


def _shape(text: str, words: list[str], distinct: set[str]) -> list[bytes]:
    """Names of the shape features of one text: one for each edge that a share exceeds."""
    n = max(1, len(words))
    measures = {
        b"symbols": sum(map(text.count, "#*$%&<>")) / n,
        b"bars": text.count("|") / n,
        b"shouts": text.count("!") / n,
        b"upper": sum(map(str.isupper, distinct)) / max(1, len(distinct)),
        b"repeats": 1 - len(distinct) / n if len(words) > 20 else 0.0,
    }
    names = [b"\0%s>%d" % (name, i) for name, value in measures.items() for i, edge in enumerate(_SHARES) if value > edge]
    names.append(b"\0length>%d" % min(6, len(words).bit_length() // 2))
    return names


def _bucket(name: bytes, bits: int) -> int:
    return zlib.crc32(name) & ((1 << bits) - 1)


class _WordBuckets(dict):
    """Word -> bucket, remembered up to a bound."""

    def __init__(self, bits: int, most: int = 300_000):
        super().__init__()
        self.bits, self.most = bits, most

    def __missing__(self, word: str) -> int:
        value = _bucket(word.strip(EDGES).lower().encode(), self.bits)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Ascending distinct buckets of a text."""
        words = (text or "").split()
        distinct = set(words)
        found = set(map(self.__getitem__, distinct))
        found.update(_bucket(x, self.bits) for x in _shape(text or "", words, distinct))
        return np.array(sorted(found), np.int32)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # float32, shared by all thresholds
    thresholds: np.ndarray  # ascending; one less than there are grades

    @property
    def bits(self) -> int:
        return int(len(self.weights)).bit_length() - 1

    def cumulative(self, latent: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each threshold k."""
        return _sigmoid(self.thresholds[None, :] - latent[:, None])

    def expected(self, latent: np.ndarray) -> np.ndarray:
        return len(self.thresholds) - self.cumulative(latent).sum(axis=1)

    def tail(self, latent: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= ``grade``)."""
        if grade <= 0 or not len(self.thresholds):
            return np.ones(len(latent))
        return 1 - _sigmoid(self.thresholds[grade - 1] - latent)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, rounds: int = 300, penalty: float = 1e-4, least_rows: int = 3, least_z: float = 3.5) -> OrdinalModel:
    """Maximum likelihood by full-batch Adam over the bounded sample.

    Buckets whose share of rows below every threshold differs from the sample's by less
    than ``least_z`` standard errors carry no weight: rare words would only be learned
    by heart.
    """
    weights = np.zeros(1 << bits, np.float32)
    if not len(features):
        return OrdinalModel(weights, np.full(n_grades - 1, -60.0))
    sizes = np.array([len(f) for f in features])
    flat = np.concatenate(features)
    rows_of = np.bincount(flat, minlength=1 << bits)
    z = np.zeros(1 << bits)
    for k in range(n_grades - 1):  # how far rows with a feature fall on one side of a threshold
        below = (grades <= k).astype(float)
        apart = np.bincount(flat, np.repeat(below - below.mean(), sizes), minlength=1 << bits)
        z = np.maximum(z, np.abs(apart) / np.maximum(1e-9, below.std() * np.sqrt(np.maximum(1, rows_of))))
    names = np.flatnonzero((rows_of >= min(least_rows, len(features))) & (z >= least_z))
    renamed = np.full(1 << bits, -1)
    renamed[names] = np.arange(len(names))
    row = np.repeat(np.arange(len(features)), sizes)
    held = renamed[flat] >= 0
    row, column = row[held], renamed[flat[held]]
    shares = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades)
    shares = np.clip(shares, 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(shares / (1 - shares)) + np.arange(n_grades - 1) * 1e-3)
    parameters = [np.zeros(len(names)), np.concatenate(([theta[0]], np.log(np.maximum(1e-3, np.diff(theta)))))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for step in range(1, rounds + 1):
        w, cut = parameters
        theta = np.concatenate(([cut[0]], cut[0] + np.cumsum(np.exp(cut[1:]))))
        latent = np.bincount(row, w[column], minlength=len(features))
        s = np.hstack([np.zeros((len(features), 1)), _sigmoid(theta[None, :] - latent[:, None]), np.ones((len(features), 1))])
        at = np.arange(len(features))
        low, high = s[at, grades], s[at, grades + 1]
        chance = np.maximum(1e-12, high - low)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        d_latent = (d_high - d_low) / len(features)  # of the negative log likelihood
        d_theta = np.zeros(n_grades + 1)
        np.add.at(d_theta, grades + 1, -d_high / len(features))
        np.add.at(d_theta, grades, d_low / len(features))
        d_theta = d_theta[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradients = [np.bincount(column, d_latent[row], minlength=len(names)) + penalty * w / len(names) ** 0.5, np.concatenate(([tail[0]], tail[1:] * np.exp(cut[1:])))]
        for p, g, (m, v) in zip(parameters, gradients, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, cut = parameters
    weights[names] = w
    return OrdinalModel(weights, np.concatenate(([cut[0]], cut[0] + np.cumsum(np.exp(cut[1:])))))


def train(docs: DataFrame, grades: DataFrame, n_grades: int, bits: int = 18, max_rows: int = 20_000) -> OrdinalModel:
    """Model from ``docs`` (doc_id, text) and ``grades`` (doc_id, grade 0..n_grades-1)."""
    ship_package(docs.sparkSession)
    usable = grades.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("doc_id").agg(F.min(F.col("grade").cast("int")).alias("grade"))
    # A filter by hash leaves little more than the sample to sort.
    part = min(1.0, 1.2 * max_rows / max(1, usable.count()))
    place = F.xxhash64("doc_id")
    sample = usable.where(F.pmod(place, F.lit(1 << 20)) < F.lit(int(part * (1 << 20)) + 1)).orderBy(place, "doc_id").limit(max_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _WordBuckets(bits)
        for batch in by_bytes(batches, "text", 1_000_000):
            rows = [buckets.of(text).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(rows, pa.binary())], ["doc_id", "grade", "f"])

    # The sample has max_rows rows at most, so it may be broadcast; one row per id comes back.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.mapInArrow(lean("ordinal", hashed), "doc_id long, grade int, f binary").groupBy("doc_id", "grade").agg(F.min("f").alias("f"))
    rows = rows.toArrow().sort_by("doc_id")
    # Copies would pass a few rows off as many: each text counts once with each grade.
    once = dict.fromkeys(zip(rows.column("f").to_pylist(), rows.column("grade").to_pylist(), strict=True))
    return fit([np.frombuffer(f, np.int32) for f, _ in once], np.array([g for _, g in once], np.int64), n_grades, bits)


def _latent(texts: list[str | None], model: OrdinalModel, buckets: _WordBuckets) -> np.ndarray:
    return np.array([model.weights[buckets.of(text)].sum(dtype=np.float64) for text in texts])


def tail_column(model: OrdinalModel, wanted: int):
    """P(grade >= ``wanted``) as a column function of a text; whole rows stay where they are."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def tail(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        with lean_worker("ordinal"):
            buckets = worker_memory("ordinal").setdefault(model.bits, _WordBuckets(model.bits))
            parts = [model.tail(_latent(part.column("text").to_pylist(), model, buckets), wanted) for part in by_bytes(iter([batch]), "text", 1_000_000)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return tail


def grade_texts(docs: DataFrame, model: OrdinalModel, wanted: int, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` plus expected_grade and tail_probability (of ``wanted`` or better)."""
    whole = fresh_name(docs, "text")
    rows = docs.select(*keep, F.col(text).cast("string").alias(whole))
    schema = rows.drop(whole).schema.add("expected_grade", "double").add("tail_probability", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _WordBuckets(model.bits)
        for batch in by_bytes(batches, whole, 1_000_000):
            latent = _latent(batch.column(whole).to_pylist(), model, buckets)
            columns = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.expected(latent)), pa.array(model.tail(latent, wanted))], [*keep, "expected_grade", "tail_probability"])

    return rows.mapInArrow(lean("ordinal", score), schema)


def rating_grade() -> Column:
    """Grades of the ``labels`` table: 0 toxic, 1 poor, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)


def _trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", rating_grade().alias("grade"))
    return train(docs, labels, 3)


def op3_quality_classifier(spark: SparkSession, sf_dir: str, least_tail: float = 0.5) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    graded = grade_texts(docs, _trained(spark, docs, sf_dir), wanted=2)
    return graded.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= least_tail).alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least_tail: float = 0.5) -> DataFrame:
    """Keep documents that are good with at least ``least_tail`` probability.

    Null and empty texts are judged by their shape alone; rows that repeat an id or a text
    are judged each and equal texts alike; without any usable label everything stays; all
    columns, whatever their names, come back unchanged; an empty table gives no rows.
    """
    model = _trained(spark, docs, sf_dir)
    return docs.where(tail_column(model, 2)(F.col("text")) >= least_tail)

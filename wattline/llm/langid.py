"""Language identification by bit-sliced Bloom filters over character n-grams.

One filter array holds, per slot, a bitmask with one bit per language (beyond 64
languages, a further array for each 64 of them): testing an
n-gram reads a few slots, and the AND of their masks names every language whose
filter holds that n-gram. A document is decided by per-language popcounts of those
masks, corrected for each filter's false-positive rate.

Training keeps an n-gram for a language if its relative frequency there is at least
``floor`` (so no language holds more than 1/floor n-grams per order: a proven bound
on what reaches the driver) and at least ``share`` of its highest relative frequency
in any language. The filter arrays are broadcast with the tasks; their size depends on
the number of languages only (16 MB for each 64 at the default ``bits``).

Defined cases: null text, or text without a letter, is ``und`` with score 0; a text
whose n-grams are all unknown gets the most frequent training language with score 0;
ties go to the language with more training texts, then to the smaller name; without
any labelled row every prediction is ``und``. Repeated rows are scored each by
itself and alike; columns besides the named ones are ignored, whatever their names; null
ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import by_bytes, crc_mod, dropped, fresh_name, lean, lean_worker, saved, work_folder

UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> 16-bit code of its lower-case letter, 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint16)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            lower = ord(char.lower()[0])
            table[point] = lower if 0 < lower < 0x10000 else (lower * 40503 & 0x7FFF) | 0x8000
    return table


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts, each followed by two gaps, and where texts start."""
    joined = "".join(text + "  " for text in texts)
    points = np.frombuffer(("  " + joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([2] + [len(text) + 2 for text in texts[:-1]])
    return _letters()[points], starts


def _grams(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams whose inner characters are letters, and their positions.

    Gaps may stand at either end only, so no n-gram spans two words or two texts.
    """
    wide = codes.astype(np.uint64)
    n = len(codes) - order + 1
    key = np.full(n, order, np.uint64)
    for i in range(order):
        key = key * np.uint64(0x100000001B3) ^ wide[i : n + i]
    inner = codes[1 : n + 1] > 0
    for i in range(2, max(2, order - 1)):
        inner = inner & (codes[i : n + i] > 0)
    at = np.flatnonzero(inner)
    return key[at] * np.uint64(0x9E3779B97F4A7C15), at


@dataclass(frozen=True)
class LanguageFilter:
    """A trained set of bit-sliced filters."""

    languages: tuple[str, ...]  # by training texts, most first
    slots: np.ndarray  # one bitmask per slot; one row of them per 64 languages
    hashes: int
    orders: tuple[int, ...]
    fill: np.ndarray  # share of slots set, by language

    @staticmethod
    def build(languages, grams: np.ndarray, masks: np.ndarray, bits: int, hashes: int, orders) -> LanguageFilter:
        """``masks``: per n-gram one 64-bit word, or a row with a word per 64 languages."""
        masks = masks.reshape(len(grams), _words(languages))
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.iinfo(k).bits), np.uint64)
        slots = np.zeros((_words(languages), 1 << bits), kind)
        for h in range(hashes):
            at = _slot(grams, h, bits)
            for word in range(len(slots)):
                np.bitwise_or.at(slots[word], at, masks[:, word].astype(kind))
        fill = np.array([np.count_nonzero(_bit(slots, i)) for i in range(len(languages))]) / (1 << bits)
        return LanguageFilter(tuple(languages), slots, hashes, tuple(orders), fill)

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that hold each n-gram, one row per 64 languages."""
        bits = self.slots.shape[1].bit_length() - 1
        found = self.slots[:, _slot(grams, 0, bits)]
        for h in range(1, self.hashes):
            found = found & self.slots[:, _slot(grams, h, bits)]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which share of a text's n-grams its language knows."""
        if not texts:
            return [], np.zeros(0), np.zeros(0)
        codes, starts = _codes([text or "" for text in texts])
        letters = np.add.reduceat((codes > 0).astype(np.int64), starts)
        hits = np.zeros((len(texts), len(self.languages)))
        seen = np.zeros(len(texts))
        edges = np.append(starts, len(codes))
        for order in self.orders:
            grams, at = _grams(codes, order)
            found = self.containing(grams)
            cuts = np.searchsorted(at, edges - 1)
            seen += np.diff(cuts)
            for i in range(len(self.languages)):
                total = np.concatenate(([0], np.cumsum(_bit(found, i), dtype=np.int64)))
                hits[:, i] += np.diff(total[cuts])
        wrong = self.fill**self.hashes
        corrected = np.maximum(0.0, (hits - seen[:, None] * wrong) / np.maximum(1e-9, 1 - wrong))
        total = corrected.sum(axis=1)
        best = corrected.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        chosen, score, known = [], np.zeros(len(texts)), np.zeros(len(texts))
        for i in range(len(texts)):
            if not letters[i] or not self.languages:
                chosen.append(UNDETERMINED)
                continue
            chosen.append(self.languages[best[i]])
            if total[i] > 0:
                score[i] = corrected[i, best[i]] / total[i]
                known[i] = corrected[i, best[i]] / seen[i]
        return chosen, score, known


def _words(languages) -> int:
    return max(1, -(-len(languages) // 64))


def _bit(masks: np.ndarray, i: int) -> np.ndarray:
    """0 or 1 for each column of ``masks``: the bit of language ``i``."""
    kind = masks.dtype.type
    return masks[i // 64] >> kind(i % 64) & kind(1)


def _slot(grams: np.ndarray, h: int, bits: int) -> np.ndarray:
    mixed = grams ^ grams >> np.uint64(29 + h)
    return mixed * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)[h]) >> np.uint64(64 - bits)


def _count_grams(orders: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            unique, where = np.unique(keys, return_inverse=True)
            return unique, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in by_bytes(batches, "text", 1_000_000):
            of: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                of.setdefault(lang, []).append(text)
            for lang, texts in of.items():
                codes, _ = _codes(texts)
                parts = held.setdefault(lang, [])
                for order in orders:
                    parts.append(np.unique(_grams(codes, order)[0], return_counts=True))
                if len(parts) > 16:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            keys, counts = merged(parts)
            for start in range(0, len(keys), 100_000):
                k = keys[start : start + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k)), pa.array(k), pa.array(counts[start : start + 100_000])], ["lang", "gram", "n"]
                )

    return count


def sampled(labelled: DataFrame, max_rows: int, path: str) -> tuple[list[str], DataFrame]:
    """All languages, those with most texts first, and distinct rows (text, lang) to learn from.

    The bound is shared out evenly, so that a rare language still learns from enough rows.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("key"))
    counted = rows.select("lang", "key").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    each = max(1, max_rows // max(1, len(counted)))
    # A filter by hash leaves little more than the sample; of that the smallest hashes are taken.
    parts = [(r["lang"], int(min(1.0, (1.2 * each + 20) / r["count"]) * (1 << 20)) + 1) for r in counted]
    parts = F.broadcast(spark.createDataFrame(parts, "lang string, part long"))
    near = rows.join(parts, "lang").where(F.pmod("key", F.lit(1 << 20)) < F.col("part")).groupBy("lang", "key").agg(F.min("text").alias("text"))
    near = saved(spark, near, path)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    taken = near.select("lang", "key", place.alias("place")).where(F.col("place") <= each).select("lang", "key")
    return [r["lang"] for r in counted], near.join(F.broadcast(taken), ["lang", "key"], "left_semi").select("text", "lang")


def train(
    labelled: DataFrame,
    max_rows: int = 20_000,
    orders: tuple[int, ...] = (3, 4),
    bits: int = 21,
    hashes: int = 3,
    floor: float = 5e-6,
    share: float = 0.25,
) -> LanguageFilter:
    """Filters from rows (text, lang); at most ``max_rows`` distinct ones, picked by a hash
    (one per language, if there are more languages than that).

    A text counts once per language, however many copies of it there are.

    The sample bound keeps training a small job at every corpus size; the languages
    themselves are counted over all labelled texts, and every one of them is learned.
    """
    spark, folder = labelled.sparkSession, work_folder(labelled.sparkSession, "langid")
    languages, drawn = sampled(labelled, max_rows, f"{folder}/near")
    if not languages:
        return LanguageFilter((), np.zeros((1, 1 << bits), np.uint8), hashes, tuple(orders), np.zeros(0))
    grams = drawn.mapInArrow(lean("langid", _count_grams(tuple(orders))), "lang string, gram long, n long")
    grams = saved(spark, grams.groupBy("gram", "lang").agg(F.sum("n").alias("n")), f"{folder}/grams")
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals = F.broadcast(spark.createDataFrame([(lang, i, float(totals[lang])) for i, lang in enumerate(languages) if lang in totals], "lang string, place int, total double"))
    # A group holds one row per language at most.
    chosen = (
        grams.join(totals, "lang").select("gram", "place", (F.col("n") / F.col("total")).alias("p"))
        .groupBy("gram")
        .agg(F.max("p").alias("top"), F.collect_list(F.struct("place", "p")).alias("by"))
        .where(F.col("top") >= floor)
        .select(
            "gram",
            F.transform(F.filter("by", lambda x: (x["p"] >= floor) & (x["p"] >= share * F.col("top"))), lambda x: x["place"]).alias("places"),
        )
        .toArrow()
    )
    dropped(spark, folder)
    keys = chosen.column("gram").to_numpy().view(np.uint64)
    places = chosen.column("places").combine_chunks()
    place = places.flatten().to_numpy().astype(np.int64)
    gram = np.repeat(np.arange(len(keys)), pa.compute.list_value_length(places).to_numpy())
    masks = np.zeros((len(keys), _words(languages)), np.uint64)
    np.bitwise_or.at(masks, (gram, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return LanguageFilter.build(languages, keys, masks, bits, hashes, orders)


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus lang_pred and score for every row of ``docs``."""
    whole = fresh_name(docs, "text")
    rows = docs.select(*keep, F.col(text).cast("string").alias(whole))
    schema = rows.drop(whole).schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, whole, 1_000_000):
            langs, scores = model.predict(batch.column(whole).to_pylist())
            columns = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(lean("langid", score), schema)


def language_column(model: LanguageFilter):
    """The same judgement as a column function of a text: struct<lang_pred, score, known>.

    Only texts travel to Python; whole rows stay where they are.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<lang_pred: string, score: double, known: double>")
    def judge(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        with lean_worker("langid"):
            parts = [model.judge(part.column("text").to_pylist()) for part in by_bytes(iter([batch]), "text", 1_000_000)]
        langs = pa.array([lang for part in parts for lang in part[0]], pa.string())
        scores, known = (pa.array(np.concatenate([part[k] for part in parts]) if parts else np.zeros(0)) for k in (1, 2))
        return pa.StructArray.from_arrays([langs, scores, known], ["lang_pred", "score", "known"])

    return judge


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least_known: float = 0.5) -> DataFrame:
    """Keep documents of whose n-grams their language knows at least a share ``least_known``.

    That share does not depend on the number of languages, as ``score`` does. No margin
    over the second language is asked for: close languages share most n-grams.

    Null texts and texts without a letter go; rows with a null language teach nothing and
    are judged like others, and without any label every row goes; rows that repeat an id or
    a text are judged each and equal texts alike; all columns, whatever their names, come
    back unchanged; an empty table gives no rows.
    """
    model = train(docs)
    judgement = fresh_name(docs, "language")
    judged = docs.withColumn(judgement, language_column(model)(F.col("text").cast("string")))
    return judged.where((F.col(f"{judgement}.lang_pred") != UNDETERMINED) & (F.col(f"{judgement}.known") >= least_known)).drop(judgement)

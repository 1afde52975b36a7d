"""Document scores by prediction by partial matching over bytes.

The model is a byte-context trie learned from all training texts: for every context of
up to ``ORDER`` bytes, how often each byte followed. A byte's probability comes from its
longest known context; every distinct byte of a context gives half an occurrence to the
escape (method D), which a byte new to the context pays, and in the next shorter context
the bytes already ruled out are excluded. Below order 0 all remaining bytes are equal.

The probability of a byte depends on its context alone, so it is worked out once per
distinct n-gram: n-gram counts are summed over the corpus, every family of contexts that
end in the same three bytes meets in one place and forms its part of the trie (orders 5
to 3), what order 2 says is joined to each n-gram, and only orders 1 and 0 - at most
65,792 counts - are gathered on the driver. Families are dealt to as many tasks as keep
``TRIE_ROWS`` n-grams each. Documents are read in chunks (a piece of a file split); a
chunk asks for its own distinct words and n-grams and gets their counts and code lengths
back as work tables on the shared folder, one file per shelf; how many shelves there are
follows the number of shuffle partitions, not the data. What moves is one row per chunk
and distinct key; texts never move, and no dictionary of the whole corpus is ever held in
one place.

A text is scored as its lower-cased (A-Z) words, joined by one blank, and an end.

Defined cases: null text is the empty text (the end alone); repeated rows are scored
each; texts are scored whole; without training rows every count is 0 and bytes are
equally likely; null ids count as the empty text in crc32 and stay null; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, dropped, lean, saved, shuffle_partitions, sliced, text_of, work_folder
from .warc import filesystem

ORDER = 5
END = b"\n"  # cannot occur inside a normalised text
U = np.uint64
#: Bytes of text in one chunk; bounds the dictionaries that a worker holds.
CHUNK_BYTES = 48_000_000
#: Distinct n-grams that one task arranges as a trie, on average.
TRIE_ROWS = 1_000_000


def normalised(text: str) -> tuple[list[bytes], bytes]:
    """The words of a text, and the byte string that the model predicts."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return words, b" ".join(words) + END


def context_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One key per predicted byte (its ORDER context bytes, then itself); bytes per text.

    Every text is preceded by ORDER ends.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    a = np.frombuffer((END * ORDER).join([b"", *texts]), np.uint8).astype(U)
    n = len(a) - ORDER
    key = np.zeros(n, U)
    for i in range(ORDER + 1):
        key = key << U(8) | a[i : n + i]
    # Positions whose window reaches from one text into the next predict nothing.
    ends = np.cumsum(lengths + ORDER) - ORDER
    between = (ends[:-1, None] + np.arange(ORDER)).ravel()
    return (np.delete(key, between) if len(between) else key), lengths


class _Chunks:
    """Names the chunk of each row: the file split it lies in, and how far into it."""

    def __init__(self, limit: int):
        self.limit, self.read = limit, {}

    def of(self, split: int, text: str) -> int:
        before = self.read.get(split, 0)
        self.read[split] = before + len(text)
        name = split if before < self.limit else xxhash.xxh64_intdigest(b"%d|%d" % (split, before // self.limit))
        return name - (1 << 64) if name >= 1 << 63 else name


def _located(docs: DataFrame, held_out) -> DataFrame:
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    return docs.select("doc_id", text_of().alias("text"), held_out.alias("held_out"), split.alias("split"))


def _runs(batches: Iterator[pa.RecordBatch], chunks: _Chunks, most: int = 1_000_000) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (doc_id, text, held_out) of one chunk at a time, a few MB each."""
    chunk, rows, size = None, [], 0
    for batch in sliced(batches):
        for doc_id, text, held, split in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out", "split")), strict=True):
            here = chunks.of(split, text)
            if rows and (here != chunk or size > most):
                yield chunk, rows
                rows, size = [], 0
            chunk = here
            rows.append((doc_id, text, held))
            size += len(text)
    if rows:
        yield chunk, rows


_REQUEST = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])


def _requests(limit: int):
    """Distinct words and n-grams of each chunk, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            key = np.concatenate([k for k, _ in parts])
            order = np.argsort(key, kind="stable")
            key, count = key[order], np.concatenate([c for _, c in parts])[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            return key[starts], np.add.reduceat(count, starts)

        def rows() -> Iterator[pa.RecordBatch]:
            for listed, name in ((list(words), "word"), (None, "gram")):
                if name == "word":
                    keys, counts, kind = listed, np.fromiter(words.values(), np.int64, len(words)), pa.binary()
                else:
                    keys, counts = merged(grams)
                    keys, kind = keys.view(np.int64), pa.int64()
                for a in range(0, len(keys), 50_000):
                    part = pa.array(keys[a : a + 50_000], kind)
                    columns = {"chunk": pa.array(np.full(len(part), chunk)), "n": pa.array(counts[a : a + 50_000]), name: part}
                    yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(part), f.type)) for f in _REQUEST], schema=_REQUEST)

        chunk, words, grams = None, Counter(), []
        for here, listed in _runs(batches, _Chunks(limit)):
            if here != chunk and chunk is not None:
                yield from rows()
                words, grams = Counter(), []
            chunk = here
            for held in (False, True):
                texts = [normalised(text) for _, text, h in listed if h == held]
                if not texts:
                    continue
                for split, _ in texts:
                    if held:
                        for word in split:
                            if word not in words:
                                words[word] = 0
                    else:
                        words.update(split)
                key, count = np.unique(context_keys([t for _, t in texts])[0], return_counts=True)
                grams.append((key, np.zeros(len(key), np.int64) if held else count))
            if len(grams) > 12:
                grams = [merged(grams)]
        if chunk is not None:
            yield from rows()

    return run


def _group(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the place of each row's value, and the first row of each value (sorted input)."""
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    return ids[starts], place, starts


def code_lengths(keys: np.ndarray, counts: np.ndarray, second: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each n-gram's last byte after its context.

    ``keys``: distinct n-grams of whole families (all that share their last three context
    bytes); ``second``: per n-gram what its order-2 context says - the count of the byte, the
    total, the distinct bytes, and how often order 1 has those bytes; ``pairs``: 256 x 256
    counts of (byte, next byte) in the whole corpus.
    """
    # Level by level, from the longest context: per row, the count of the byte there, the
    # context's total and distinct bytes, and what the next longer context has excluded.
    out = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    before, byte = (keys >> U(8) & U(255)).astype(np.int64), (keys & U(255)).astype(np.int64)
    singles = pairs.sum(axis=0)
    seen_after = ((pairs > 0) * singles[None, :]).sum(axis=1)  # by order 0, of the bytes seen after each byte
    excluded_distinct = np.zeros(len(keys))  # bytes seen in the next longer context
    longer: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # its rows' context, first rows, and whether seen
    for order in range(ORDER, -1, -1):
        if order > 2:
            key = keys & U((1 << 8 * (order + 1)) - 1)
            by = np.argsort(key, kind="stable")
            inverse = np.empty(len(by), np.int64)
            _, place, starts = _group(key[by])
            inverse[by] = place
            entry = np.add.reduceat(counts[by], starts)  # count of each distinct (context, byte)
            _, context, first = _group(key[by][starts] >> U(8))
            total = np.add.reduceat(entry, first)[context][inverse]
            distinct = np.add.reduceat((entry > 0).astype(np.int64), first)[context][inverse]
            count = entry[inverse]
        elif order == 2:
            count, total, distinct = second[:, 0], second[:, 1], second[:, 2]
        elif order == 1:
            count, total, distinct = pairs[before, byte], pairs.sum(axis=1)[before], (pairs > 0).sum(axis=1)[before]
        else:
            count, total, distinct = singles[byte], np.full(len(keys), singles.sum()), np.full(len(keys), (singles > 0).sum())
        # Occurrences here of the bytes that the next longer context has seen.
        if order == ORDER:
            taken = np.zeros(len(keys))
        elif order >= 2:
            # Each distinct (longer context, byte) adds its count here once.
            of, once, seen = longer
            taken = np.bincount(of[once], np.where(seen[once], count[once], 0), minlength=of.max() + 1)[of]
        else:
            taken = second[:, 3] if order == 1 else seen_after[before]
        left, fresh = total - taken, distinct - excluded_distinct
        hit = open_ & (count > 0)
        out[hit] += np.log10((count[hit] - 0.5) / left[hit])
        open_ &= ~hit
        escape = open_ & (fresh > 0)
        out[escape] += np.log10(0.5 * fresh[escape] / left[escape])
        excluded_distinct = distinct.astype(float)
        if order > 2:
            longer = context[inverse], by[starts], count > 0
    out[open_] -= np.log10(np.maximum(1, 256 - excluded_distinct[open_]))
    return out


_SECOND = ("byte_count", "total", "distinct", "order1")


def _trie(pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        gram = table.column("gram").to_numpy()
        second = np.column_stack([table.column(c).to_numpy() for c in _SECOND])
        length = code_lengths(gram.view(U), table.column("c").to_numpy(), second, pairs)
        for a in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(gram[a : a + 100_000]), pa.array(length[a : a + 100_000])], ["gram", "logp"])

    return run


def _second_order(spark: SparkSession, summed: DataFrame, folder: str) -> tuple[DataFrame, np.ndarray]:
    """What the last two context bytes say of each next byte (at most 2**24 rows), and all pair counts."""
    counts = saved(spark, summed.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("three")).agg(F.sum("c").alias("byte_count")), f"{folder}/three")
    counts = counts.withColumn("pair", F.col("three").bitwiseAND(F.lit(0xFFFF)))
    pair_counts = counts.groupBy("pair").agg(F.sum("byte_count").alias("n"))
    pairs = np.zeros((256, 256), np.int64)  # orders 1 and 0: at most 65,536 rows
    for r in pair_counts.collect():
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    counts = counts.join(F.broadcast(pair_counts), "pair").withColumn("context", F.shiftright("three", 8))
    known = F.col("byte_count") > 0
    contexts = counts.groupBy("context").agg(F.sum("byte_count").alias("total"), F.count_if(known).alias("distinct"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("order1"))
    return saved(spark, counts.join(contexts, "context").select("three", *_SECOND), f"{folder}/second"), pairs


class _Lengths:
    """n-gram -> code length for one chunk: a hashed table, and a search for what collides."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.grams, self.logs = grams[order], logs[order]
        self.shift = U(64 - max(10, (4 * len(grams)).bit_length()))
        slot = self._slot(self.grams)
        self.table = np.zeros(1 << int(U(64) - self.shift), U)
        self.place = np.zeros(len(self.table), np.int32)
        self.table[slot], self.place[slot] = self.grams, np.arange(len(self.grams))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        place = self.place[slot]
        missed = np.flatnonzero(self.table[slot] != keys)
        if len(missed):
            at = np.searchsorted(self.grams, keys[missed])
            if (at >= len(self.grams)).any() or (self.grams[at] != keys[missed]).any():
                raise LookupError("a text changed between the two passes")
            place[missed] = at
        return self.logs[place]


def _scores(folder: str, shelves: int, limit: int, train_tokens: int, train_texts: int, distinct: int, keep: list[str]):
    scale = math.log10(train_tokens + 0.5 * (distinct + 1))

    def load(kind: str, chunk: int) -> pa.Table:
        fs, root = filesystem(f"{folder}/{kind}/shelf={chunk % shelves}")
        if fs.get_file_info(root).type == pafs.FileType.NotFound:  # a chunk of empty texts asks for no word
            return pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64()), "gram": pa.array([], pa.int64()), "logp": pa.array([], pa.float64())})
        return pads.dataset(root, filesystem=fs, format="parquet").to_table(filter=pads.field("chunk") == chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, place, lengths = None, {}, None
        for here, rows in _runs(batches, _Chunks(limit)):
            if here != chunk:
                chunk, place, lengths = here, {}, None  # lets go of the last chunk first
                table = load("words", chunk)
                counts = table.column("c").to_numpy()
                logs, known = np.log10(counts + 0.5), counts > 0
                place = {word: i for i, word in enumerate(table.column("word").to_pylist())}
                table = load("grams", chunk)
                lengths = _Lengths(table.column("gram").to_numpy().view(U), table.column("logp").to_numpy())
            texts, base, n_tokens, n_known = [], [], [], []
            for _, text, _ in rows:
                words, line = normalised(text)
                texts.append(line)
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                n_tokens.append(len(words) + 1)
                n_known.append(int(np.count_nonzero(known[at])) + (train_texts > 0))
                base.append(math.fsum(logs[at].tolist()) + math.log10(train_texts + 0.5) - scale * (len(words) + 1))
            keys, sizes = context_keys(texts)
            starts = np.cumsum(sizes) - sizes
            score = np.add.reduceat(lengths.of(keys), starts)
            ids, held = [r[0] for r in rows], [r[2] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                 pa.array([train_tokens] * len(rows), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], keep)

    return run


def score_documents(spark: SparkSession, docs: DataFrame, held_out, from_files: bool = True, limit: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``docs`` (doc_id, text); rows with ``held_out`` teach nothing. Rows that do not come
    straight from a file scan are written to the work folder first.
    """
    folder = work_folder(spark, "ppm")
    if not from_files:
        docs = saved(spark, docs.select("doc_id", "text"), f"{folder}/docs")
    rows = _located(docs.withColumn("doc_id", F.col("doc_id").cast("long")), held_out)
    asked = saved(spark, rows.mapInArrow(lean("ppm", _requests(limit)), "chunk long, word binary, gram long, n long"), f"{folder}/asked")
    train_texts = docs.where(~held_out).select("doc_id").count()
    shelves = shuffle_partitions(spark)
    shelf = F.pmod(F.col("chunk"), F.lit(shelves)).cast("int").alias("shelf")

    def put(frame: DataFrame, kind: str) -> None:
        """One file per shelf, in the order of its chunks, so that a chunk's rows are found by row group."""
        frame.repartitionById(shelves, F.col("shelf")).sortWithinPartitions("chunk").write.option("compression", "zstd").partitionBy("shelf").parquet(f"{folder}/{kind}")

    # A word has one row per chunk that holds it.
    words = asked.where(F.col("word").isNotNull())
    sums = saved(spark, words.groupBy("word").agg(F.sum("n").alias("c")), f"{folder}/sums")
    facts = sums.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    train_tokens, distinct = int(facts[0] or 0) + train_texts, int(facts[1]) + (train_texts > 0)
    put(words.select("chunk", "word").join(sums, "word").select("chunk", "word", "c", shelf), "words")

    grams = asked.where(F.col("gram").isNotNull()).select("chunk", "gram", "n")
    summed = saved(spark, grams.groupBy("gram").agg(F.sum("n").alias("c")), f"{folder}/summed")
    second, pairs = _second_order(spark, summed, folder)
    tasks = max(shuffle_partitions(spark), -(-summed.count() // TRIE_ROWS))
    family = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))
    known = summed.join(second, F.col("gram").bitwiseAND(F.lit(0xFFFFFF)) == F.col("three")).select("gram", "c", *_SECOND)
    known = known.repartition(tasks, family).mapInArrow(lean("ppm", _trie(pairs)), "gram long, logp double")
    put(grams.select("chunk", "gram").join(known, "gram").select("chunk", "gram", "logp", shelf), "grams")
    dropped(spark, *(f"{folder}/{name}" for name in ("asked", "sums", "summed", "three", "second")))

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(lean("ppm", _scores(folder, shelves, limit, train_tokens, train_texts, distinct, names)), schema)


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(spark, docs, crc_mod(F.col("doc_id"), 5) == 1)

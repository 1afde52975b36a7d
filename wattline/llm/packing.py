"""Packing documents into token sequences along a space-filling curve.

Each text becomes a hashed vector of byte trigrams, projected to a few dimensions by
a fixed random matrix; the projected point's index on a Hilbert curve is the sort key.
Documents are range-partitioned by (curve key, hash of id and text) - the hash splits any
number of equal keys; only rows equal in both stay together - and each partition packs its
documents one after another, so neighbours on the curve share sequences. The bounds of the
partitions come from the keys of a sample of rows, about ``PER_BOUND`` for each partition,
drawn by that hash; every row's key is worked out once. Documents are cut freely at
sequence ends; the tail of a
partition goes into sequences of falling powers of two, which need no padding, so that
padding stays nil however many partitions there are.

Token ids come from the tokenizers library; since its pre-tokenizer never joins text
across white space, each distinct blank-separated chunk is encoded once per worker and
remembered up to a bound.

Only tokenizers whose pre-tokenizer splits at white space and whose words end in one
marker are supported; others are refused.

Defined cases: null text is the empty text and yields the end id alone; repeated rows
are packed each; ties on the curve are ordered by hash, then id; an empty table yields no
piece; other columns are ignored, whatever their names; rows with null ids are packed with a
null id.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_bytes, lean, lean_worker, shuffle_partitions, text_of, worker_memory
from .bpe import tokenizer_path

_VECTOR = 1024
#: Rows whose keys are drawn for each bound between two partitions.
PER_BOUND = 50
_WORD_END = "</w>"
#: Marks that may follow a word inside a chunk; the library splits them off as one pre-token.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_hashes() -> np.ndarray:
    """Three random maps from a byte to vector places; a trigram's place is their XOR."""
    return np.random.RandomState(29).randint(0, _VECTOR, (3, 256)).astype(np.int16)


def hashed_vectors(texts: list[bytes]) -> np.ndarray:
    """Unit vectors of hashed byte trigrams; the zero vector for texts under 3 bytes."""
    out = np.zeros((len(texts), _VECTOR))
    first, second, third = _byte_hashes()
    a = np.frombuffer(b"".join(texts), np.uint8)
    places = (first[a[:-2]] ^ second[a[1:-1]] ^ third[a[2:]]).astype(np.intp) if len(a) > 2 else np.zeros(0, np.intp)
    start = 0
    for i, text in enumerate(texts):
        if len(text) > 2:  # trigrams that reach into the next text are left out
            out[i] = np.bincount(places[start : start + len(text) - 2], minlength=_VECTOR)
        start += len(text)
    np.sqrt(out, out)
    out /= np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->i", out, out)))[:, None]
    return out


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of unsigned integer coordinates.

    Skilling's transform (2004): undo the excess rotations and reflections from the top
    bit down, then Gray-decode, and interleave the axes.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[dims - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


def curve_keys(texts: list[bytes], dims: int = 4, bits: int = 12, seed: int = 17) -> np.ndarray:
    directions = np.random.RandomState(seed).normal(size=(_VECTOR, dims))
    spread = hashed_vectors(texts) @ directions
    side = 1 << bits
    cells = np.clip((spread + 4.0) / 8.0 * side, 0, side - 1).astype(np.int64)
    return hilbert_index(cells, bits)


class _Chunks(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes, remembered up to a bound.

    Two generations of half the bound each: when the young one is full it becomes the old
    one, from which chunks that are still in use come back, so frequent ones stay known.
    """

    def __init__(self, spec: str, most: int = 1_000_000):
        super().__init__()
        self.old: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(spec), most
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            return self.fill([chunk])[chunk]
        self[chunk] = found
        return found

    def fill(self, chunks: list[str]) -> dict[str, bytes]:
        """Encode unknown chunks: plain words together, everything else one by one."""
        if len(self) + len(chunks) > self.most // 2:
            self.old = dict(self)
            self.clear()
        parts, odd = {}, set()
        for chunk in chunks:
            if chunk in self.old:
                self[chunk] = self.old[chunk]
                continue
            word = chunk.rstrip(_MARKS)
            if word.isalpha():
                parts[chunk] = word
            else:
                odd.add(chunk)
        odd.update(chunk[len(word) :] for chunk, word in parts.items())
        self.update((word, self.old[word]) for word in set(parts.values()) if word in self.old)
        words = [word for word in set(parts.values()) if word not in self]
        for start in range(0, len(words), 2_000):
            self._plain(words[start : start + 2_000])
        self._each([chunk for chunk in odd if chunk not in self])
        for chunk, word in parts.items():
            self[chunk] = self[word] + self[chunk[len(word) :]]
        return self

    def _plain(self, words: list[str]) -> None:
        """Words of letters are one pre-token each, so ids split after every word-end token."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or (len(ids) and stops[-1] != len(ids)):
            return self._each(words)
        data, start = ids.tobytes(), 0
        for word, stop in zip(words, (4 * stops).tolist(), strict=True):
            self[word] = data[start:stop]
            start = stop

    def _each(self, chunks: list[str]) -> None:
        for start in range(0, len(chunks), 10_000):
            part = chunks[start : start + 10_000]
            for chunk, encoding in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[chunk] = array("I", encoding.ids).tobytes()


def _chunks_of(spec: str) -> _Chunks:
    kept, key = worker_memory("packing"), zlib.crc32(spec.encode())
    if key not in kept:
        kept[key] = _Chunks(spec)
    return kept[key]


def _split(text: str) -> list[str]:
    """Blank-separated chunks; lower-cased where that surely equals the library's own."""
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").split(" ")


def _token_bytes(texts: list[str], chunks: _Chunks, end: bytes) -> Iterator[bytes]:
    split = [_split(text) for text in texts]
    new = set().union(*split).difference(chunks)
    chunks.fill(list(new))
    get = chunks.__getitem__
    for words in split:
        yield b"".join(map(get, words)) + end


_SPAN = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, curve_key long"
PIECE_SCHEMA = f"{_SPAN}, ids array<int>"
DIGEST_SCHEMA = f"{_SPAN}, ids_crc32 long"
STAGE_SCHEMA = f"{PIECE_SCHEMA}, ids_crc32 long"


class _Packer:
    """Fills sequences of one partition; keeps the unfinished one to cut it at the end."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence, self.used = size, first, 0
        self.rows: list[tuple] = []
        self.open: list[tuple] = []

    def add(self, doc_id, key: int, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while start < n:
            length = min(self.size - self.used, n - start)
            self.open.append((doc_id, start, ids[4 * start : 4 * (start + length)], n, key))
            start, self.used = start + length, self.used + length
            if self.used == self.size:
                self.close()

    def close(self) -> None:
        offset = 0
        for doc_id, start, ids, n, key in self.open:
            self.rows.append((doc_id, start, len(ids) // 4, n, self.sequence, offset, key, ids))
            offset += len(ids) // 4
        self.sequence, self.used, self.open = self.sequence + 1, 0, []

    def finish(self) -> None:
        """Cut the last, short sequence into falling powers of two."""
        pieces, left, self.open, self.used = self.open, self.used, [], 0
        for doc_id, start, ids, n, key in pieces:
            while ids:
                room = (1 << (left.bit_length() - 1)) - self.used
                part, ids = ids[: 4 * room], ids[4 * room :]
                self.open.append((doc_id, start, part, n, key))
                start, self.used = start + len(part) // 4, self.used + len(part) // 4
                if len(part) == 4 * room:
                    left -= self.used
                    self.close()

    def taken(self, schema: str) -> pa.RecordBatch:
        """Finished pieces, with their ids, the digests of these, or both."""
        columns = list(zip(*self.rows, strict=True)) or [()] * 8
        self.rows = []
        arrays = [pa.array(c, pa.int64()) for c in columns[:-1]]
        names = [field.split()[0] for field in schema.split(", ")]
        if "ids" in names:
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in columns[-1]]))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(columns[-1]), np.int32))))
        if "ids_crc32" in names:
            arrays.append(pa.array(list(map(zlib.crc32, columns[-1])), pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, names)


def curve_ordered(spark: SparkSession, docs: DataFrame, dims: int, bits: int) -> DataFrame:
    """``docs`` (doc_id, text) with curve_key, range-partitioned and sorted by it."""
    from pyspark.sql.functions import arrow_udf

    def keys_of(texts: pa.Array) -> np.ndarray:
        with lean_worker("packing"):
            keys = [curve_keys([t.encode() for t in texts.slice(i, 128).to_pylist()], dims, bits) for i in range(0, len(texts), 128)]
        return np.concatenate(keys) if keys else np.zeros(0, np.int64)

    @arrow_udf("long")
    def key_of(texts: pa.Array) -> pa.Array:
        return pa.array(keys_of(texts))

    parts = shuffle_partitions(spark)
    tied = docs.withColumn("tie", F.xxhash64("doc_id", "text"))
    part = min(1.0, PER_BOUND * parts / max(1, docs.count()))
    drawn = tied.where(F.pmod(F.xxhash64("tie"), F.lit(1 << 30)) <= F.lit(int(part * (1 << 30))))
    # About PER_BOUND rows per partition, two numbers each; rows equal in id and text count once.
    drawn = drawn.groupBy("tie").agg(F.first("text").alias("text")).select(key_of("text").alias("curve_key"), "tie")
    drawn = drawn.toArrow().sort_by([("curve_key", "ascending"), ("tie", "ascending")])
    at = np.arange(1, parts) * drawn.num_rows // parts
    bounds = spark.sparkContext.broadcast([drawn.column(c).to_numpy()[at] if drawn.num_rows else np.zeros(0, np.int64) for c in ("curve_key", "tie")])

    @arrow_udf("struct<curve_key: long, part: int>")
    def placed(texts: pa.Array, ties: pa.Array) -> pa.Array:
        keys, (key_bounds, tie_bounds) = keys_of(texts), bounds.value
        low, high = np.searchsorted(key_bounds, keys), np.searchsorted(key_bounds, keys, "right")
        place = low.copy()
        ties = ties.to_numpy()
        for i in np.flatnonzero(high > low):  # a bound with the very same key: the tie decides
            place[i] += np.searchsorted(tie_bounds[low[i] : high[i]], ties[i])
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(place.astype(np.int32))], ["curve_key", "part"])

    keyed = tied.withColumn("at", placed("text", "tie")).select("doc_id", "text", "tie", "at.curve_key", "at.part")
    return keyed.repartitionById(parts, F.col("part")).sortWithinPartitions("curve_key", "tie", "doc_id")


def pack(spark: SparkSession, docs: DataFrame, spec: str, size: int = 2048, end_id: int = 1, dims: int = 4, bits: int = 12, digests: bool = False, ids: bool = False) -> DataFrame:
    """Pieces of all documents: which ids of which text lie where in which sequence.

    ``spec``: the tokenizer's JSON text. ``size`` must be a power of two. With ``digests``
    each piece carries the crc32 of its ids (little-endian, 32 bits) in their place,
    or beside them with ``ids`` too.
    """
    schema = PIECE_SCHEMA if not digests else STAGE_SCHEMA if ids else DIGEST_SCHEMA
    end = array("I", [end_id]).tobytes()
    shared = spark.sparkContext.broadcast(spec)  # the vocabulary file: fixed size

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks_of(shared.value)
        packer = _Packer(size, TaskContext.get().partitionId() << 40)
        for batch in by_bytes(batches, "text", 4_000_000):
            encoded = _token_bytes(batch.column("text").to_pylist(), chunks, end)
            for doc_id, key, found in zip(batch.column("doc_id").to_pylist(), batch.column("curve_key").to_pylist(), encoded, strict=True):
                packer.add(doc_id, key, found)
            yield packer.taken(schema)
        packer.finish()
        yield packer.taken(schema)

    ordered = curve_ordered(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), dims, bits)
    return ordered.mapInArrow(lean("packing", packed), schema)


def load_spec(path: str | None = None) -> str:
    """The tokenizer's JSON text; refuses tokenizers that do not split text at white space into marked words."""
    with open(path or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    blanks = any(s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    words = any(s["type"] == "Split" and s["invert"] and s["behavior"] == "Removed" and "[^\\s" in s["pattern"].get("Regex", "") for s in splits)
    if spec["model"]["type"] != "BPE" or spec["model"].get("end_of_word_suffix") != _WORD_END or spec["model"].get("dropout") or not blanks or not words:
        raise ValueError("only BPE of white-space separated words that end in </w> is supported")
    if any(s["type"] not in ("NFC", "Replace", "Lowercase") for s in steps) or any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
        raise ValueError("unsupported normalizer or added-token option")
    return text


def op1_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), load_spec(path), digests=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Pieces with their token ids, and the crc32 of these; the cases are those of ``pack``.

    Null texts yield the end id alone, null ids are kept, rows that repeat an id or a text
    are packed each, an empty table yields no piece, and of the input's columns only doc_id
    and text are read, so others may have any name.
    """
    return pack(spark, docs, load_spec(path), digests=True, ids=True)

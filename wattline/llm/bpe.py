"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a partition (up to a memory bound at a time) are laid out in
one symbol array. An index maps every mergeable pair to all its positions. Active
ranks are applied in ascending order: one step rewrites every occurrence of a pair in
all pieces at once, unlinks the right halves, and enters the pairs that arise into
the lists of their own ranks. Each piece is thus merged once however often it occurs,
and documents are strings of pieces.

Tokenizer files are read on the driver from a path parameter and travel to executors
as compact arrays. Added tokens that stand in a text become their own ids, as in the
library's default mode; they are matched leftmost, longest first.

Defined cases: null text is the empty text (no ids, the digest of the empty string);
repeated rows are encoded each; texts of any length are encoded whole; null ids stay
null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from ._common import by_bytes, lean, sliced

#: Fixed value: the published pattern that cuts text into pieces before any merge.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by the published rule."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(shifted)) for b in range(256)]


@dataclass(frozen=True)
class ByteBpe:
    """A tokenizer as arrays: rank r merges (left[r], right[r]) into made[r]."""

    base: np.ndarray  # id of each single byte
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    added: tuple[tuple[str, int], ...]
    token_bytes: tuple[bytes, ...]  # by id

    @staticmethod
    def load(path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        pre = spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("unsupported BPE model option")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("unsupported added-token option")
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(byte_of[c] for c in token)
        for t in added:
            token_bytes[t["id"]] = t["content"].encode()
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        left, right = (np.array([vocab[p[side]] for p in pairs], np.int64) for side in (0, 1))
        # Ascending order is exact only if both parts of a merge come from lower ranks.
        born = np.full(size, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        rank = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("merges must be listed after the merges that make their parts")
        base = np.array([vocab[c] for c in characters], np.int64)
        return ByteBpe(base, left, right, made, tuple((t["content"], t["id"]) for t in added), tuple(token_bytes))

    def decode(self, ids: list[int]) -> str:
        """Text of a row of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's ids start (one more entry)."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        symbols = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbols)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        filled = lengths > 0
        after[ends[filled] - 1] = -1
        before[(ends - lengths)[filled]] = -1

        width = np.int64(len(self.token_bytes))
        order = np.argsort(self.left * width + self.right)
        keys = (self.left * width + self.right)[order]

        def rank_at(at: np.ndarray) -> np.ndarray:
            """Rank of the pair that starts at each position; -1 if none merges it."""
            key = symbols[at] * width + symbols[after[at]]
            found = np.searchsorted(keys, key)
            found[found == len(keys)] = 0
            return np.where(keys[found] == key, order[found], -1)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            ranks = rank_at(at)
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            by = np.argsort(ranks, kind="stable")
            at, ranks = at[by], ranks[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        if len(keys):
            enter(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            listed = index.pop(rank)
            at = np.unique(np.concatenate(listed)) if len(listed) > 1 else np.sort(listed[0])
            a, b = self.left[rank], self.right[rank]
            follow = after[at]
            live = (symbols[at] == a) & (follow >= 0)
            at, follow = at[live], follow[live]
            live = symbols[follow] == b
            at, follow = at[live], follow[live]
            if a == b and len(at) > 1:  # overlapping occurrences: every second one of a run
                joined = np.concatenate(([False], at[1:] == follow[:-1]))
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                odd = (np.arange(len(at)) - start) % 2 == 1
                at, follow = at[~odd], follow[~odd]
            if not len(at):
                continue
            symbols[at] = self.made[rank]
            symbols[follow] = -1
            beyond = after[follow]
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            ahead = before[at]
            # A neighbour that merged in this same step is entered once, from its own side.
            enter(np.unique(np.concatenate((ahead[ahead >= 0], at[beyond >= 0]))))
        kept = symbols >= 0
        counts = np.concatenate(([0], np.cumsum(kept)))
        return symbols[kept], counts[np.concatenate(([0], ends))]


class _Numbers(dict):
    """Piece -> number, in order of first sight."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class _Encoder:
    """Pieces and documents of one round, until memory bounds call for a flush."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.find = regex.compile(PIECE_PATTERN).findall
        texts = sorted((t for t, _ in bpe.added), key=len, reverse=True)
        self.added = dict(bpe.added)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, texts)) + ")") if texts else None
        self.reset()

    def reset(self) -> None:
        self.numbers, self.specials, self.rows = _Numbers(), {}, []

    def add(self, text: str) -> None:
        get = self.numbers.__getitem__
        if self.cut is None or not self.cut.search(text):
            self.rows.append(np.fromiter(map(get, self.find(text)), np.int32))
            return
        out: list[int] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:  # an added token: a piece of its own that no pattern can make
                number = get("\0added\0" + part)
                self.specials[number] = self.added[part]
                out.append(number)
            else:
                out.extend(map(get, self.find(part)))
        self.rows.append(np.array(out, np.int32))

    def flush(self) -> list[np.ndarray]:
        """The ids of every text added so far."""
        pieces = [b"" if i in self.specials else p.encode() for i, p in enumerate(self.numbers)]
        ids, starts = self.bpe.encode_pieces(pieces)
        ids, counts = ids.astype(np.int32), np.diff(starts)
        if self.specials:  # an added token's piece is that one id
            extra = np.fromiter(self.specials.values(), np.int32, len(self.specials))
            at = np.fromiter(self.specials, np.int64, len(self.specials))
            starts = starts[:-1].copy()
            starts[at] = len(ids) + np.arange(len(at))
            counts[at] = 1
            ids = np.concatenate((ids, extra))
        results = []
        for row in self.rows:
            n = counts[row]
            ends = np.cumsum(n)
            places = np.arange(ends[-1] if len(ends) else 0)
            results.append(ids[places + np.repeat(starts[row] - ends + n, n)])
        self.reset()
        return results


Batches = Iterator[pa.RecordBatch]


def _encoded(bpe: ByteBpe, keep: tuple[str, ...], most_pieces: int, most_bytes: int) -> Callable[[Batches], Batches]:
    """Batches with a ``__text`` column -> batches of ``keep`` and the ids of each text."""

    def encode(batches: Batches) -> Batches:
        encoder, held, size = _Encoder(bpe), [], 0

        def result() -> Batches:
            found, at = encoder.flush(), 0
            for part in held:
                listed = found[at : at + part.num_rows]
                at += part.num_rows
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in listed]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *listed])))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*keep, "ids"])

        for batch in by_bytes(batches, "__text", 1_000_000):
            size += batch.column("__text").nbytes
            for value in batch.column("__text").to_pylist():
                encoder.add(value or "")
            held.append(batch.select(list(keep)))
            if len(encoder.numbers) > most_pieces or size > most_bytes:
                yield from result()
                held, size = [], 0
        if held:
            yield from result()

    return encode


def _digested(bpe: ByteBpe, keep: tuple[str, ...]) -> Callable[[Batches], Batches]:
    """Batches with ids -> number of ids, digest of the ids, digest of the text they decode to."""
    names = list(map(str, range(len(bpe.token_bytes))))

    def digest(batches: Batches) -> Batches:
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            offsets, flat = batch.column("ids").offsets.to_pylist(), batch.column("ids").values.to_numpy()
            for a, b in zip(offsets, offsets[1:], strict=False):
                ids = flat[a:b].tolist()
                counts.append(b - a)
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_texts.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_texts(docs: DataFrame, bpe: ByteBpe, keep: tuple[str, ...] = ("doc_id",), text: str = "text", most_pieces: int = 300_000, most_bytes: int = 24_000_000) -> DataFrame:
    """Columns ``keep`` plus ``ids`` (array<int>) of every text.

    A round ends at ``most_pieces`` distinct pieces or ``most_bytes`` of text; it always
    takes whole texts.
    """
    rows = docs.select(*keep, docs[text].alias("__text"))
    schema = rows.drop("__text").schema.add("ids", ArrayType(IntegerType()))
    return rows.mapInArrow(lean("bpe", _encoded(bpe, keep, most_pieces, most_bytes)), schema)


def decode_ids(encoded: DataFrame, bpe: ByteBpe, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Columns ``keep`` plus ``text``, the text that each row's ids stand for (null ids: null)."""
    rows = encoded.select(*keep, encoded[ids].alias("__ids"))
    schema = rows.drop("__ids").schema.add("text", "string")

    def decode(batches: Batches) -> Batches:
        for batch in sliced(batches):
            texts = [None if x is None else bpe.decode(x) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(lean("bpe", decode), schema)


def encoding_digests(docs: DataFrame, bpe: ByteBpe, keep: tuple[str, ...] = ("doc_id",), text: str = "text", most_pieces: int = 300_000, most_bytes: int = 24_000_000) -> DataFrame:
    """Digests of what ``encode_texts`` and ``decode_ids`` give, taken where the ids are made.

    The same encoder and decoder run; only the digests leave the workers.
    """
    rows = docs.select(*keep, docs[text].alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    encode, digest = _encoded(bpe, keep, most_pieces, most_bytes), _digested(bpe, keep)
    return rows.mapInArrow(lean("bpe", lambda batches: digest(encode(batches))), schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_encoding(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    bpe = ByteBpe.load(path or tokenizer_path("byte_bpe_50k.json"))
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), bpe)

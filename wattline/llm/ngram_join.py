"""Exact Jaccard self-join on word shingles by universe partitioning.

A text's set is its distinct 5-word shingles as 64-bit hashes. Two sets whose Jaccard
similarity reaches the threshold differ in at most H tokens, H being a share of their
sizes. Hashing the token universe into segments, some segment of the two sets is then
equal, or - for segments that count double - differs by one token at most. So each set
indexes the subsets that fall into its segments, and for double segments also their
one-deletion neighbourhoods. Equal subsets of one segment make candidates.

* Size bands: sizes are cut at powers of two (wider for low thresholds). Sets meet in
  their own band's partition and, near a band edge, in the partition of that edge.
* Allocation: per partition, the number of segments and of double segments is the one
  with the lowest estimated cost (index entries, dearer if they hold a single token).
* A set walks its segments in a fixed order, skips empty ones, and stops as soon as the
  weights of its own non-empty segments exceed H: whichever set stops first, one of its
  segments must match. Sets that cannot reach H this way index everything, empty
  segments included, so no pair is lost.

Candidates are verified exactly on the sets. Groups of equal subsets become stars first;
after those links are merged into components, every group that still spans several
components has its cross-component pairs tested against size and parity-bitmap bounds
(block by block) and, where these leave them possible, verified. Hence each link is
either verified or lies inside a component; no group is capped. Groups of more than
``hot`` sets (texts that share a very common passage) are not paired all against all:
linked sets also share one of their rarest tokens, so the members of all such groups are
regrouped by those tokens, rarest first by their number of such members, and only sets
that share one of them are tested.

Links are then counted: every pair of different sets inside a component is compared
exactly, block by block, so a component of c sets costs c*c/2 comparisons. Counts leave a
task per set, not per pair. ``n_links`` of a document is the number of other documents
whose set reaches the threshold with its own, copies of equal sets included.

Equal sets are merged beforehand. Signatures travel in blobs per bucket, so the shuffle
moves a few bytes per entry. Components come from alternating large-star and small-star
steps over work tables; nothing but counts reaches the driver.

Defined cases: null text, or text without a word, has the empty set and links with
nothing; fewer than five words are one shingle; rows with a null id are returned with a
null component and null links; of several texts under one id the one whose set has the
smallest digest counts, alone and everywhere (it is picked before the index is used), and
each id is returned once; extra columns are ignored; an empty table gives no rows.
Different shingles share a 64-bit hash with negligible chance (about n*n/2**65).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import by_bytes, dropped, fresh_name, lean, merged, saved, shuffle_partitions, sliced, text_of, work_folder, worker_memory

U = np.uint64
_MIX_A, _MIX_B, _ODD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * _MIX_A
    x = (x ^ (x >> U(27))) * _MIX_B
    return x ^ (x >> U(31))


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    hashes = worker_memory("ngramjoin").setdefault("words", _WordHashes())
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, n, U)
    for i in range(n):
        out = _mix(out * _ODD + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens per cell; four to eight cells per token (a power of two, 256 at least).

    Each differing token flips one cell, so differing cells bound differing tokens from below.
    """
    cells = max(256, 1 << (4 * len(tokens) - 1).bit_length()) if len(tokens) else 256
    odd = np.bincount((tokens & U(cells - 1)).astype(np.intp), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap with ``size`` bytes: cells that fall together add their parities."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


class Threshold:
    """Similarity num / den and the size arithmetic that follows from it."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den

    def largest(self, size: int) -> int:
        """The largest partner of a set."""
        return size * self.den // self.num

    def smallest(self, size: int) -> int:
        return -(-size * self.num // self.den)

    def apart(self, a, b):
        """The most tokens in which linked sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common > 0 and self.den * common >= self.num * (len(a) + len(b) - common)

    def edges(self) -> Iterator[int]:
        """Lower edges of the size bands."""
        edge = 1
        while True:
            yield edge
            edge = max(edge + 1, -(-edge * max(2 * self.num, self.den) // self.num))


class Partition:
    """One division of the token universe, for sets of ``low`` to ``high`` tokens."""

    def __init__(self, number: int, low: int, high: int, needed, cost_single: float = 3.0):
        self.number, self.needed = number, needed
        most = max(needed(low), needed(high))
        best = None
        for step in range(33):
            segments = max(1, round(most / 2 * 4 ** (step / 32)))
            doubles = max(0, most - segments)
            while doubles < segments and self._weight(segments, doubles, high) < most:
                doubles += max(1, segments // 50)
            doubles = min(doubles, segments)
            if segments + doubles < most:
                continue
            sizes = (low, round(math.sqrt(low * high)), high)
            cost = sum(self._cost(segments, doubles, size, needed(size), cost_single) / size for size in sizes)
            if best is None or cost < best[0]:
                best = (cost, segments, doubles)
        _, self.segments, self.doubles = best

    @staticmethod
    def _weight(segments: int, doubles: int, size: int) -> float:
        k = size / segments
        filled, more = 1 - math.exp(-k), 1 - (1 + k) * math.exp(-k)
        return segments * filled + doubles * more

    @staticmethod
    def _cost(segments: int, doubles: int, size: int, needed: int, cost_single: float) -> float:
        k = size / segments
        filled, more = 1 - math.exp(-k), 1 - (1 + k) * math.exp(-k)
        single = k * math.exp(-k) / max(1e-9, filled)
        plain = (segments - doubles) * filled
        entries = min(needed, plain)
        if needed > plain:
            taken = min(doubles, (needed - plain) / max(1e-9, filled + more))
            entries += taken * (filled + k)
            if taken >= doubles:
                entries *= 1.5
        return entries * (1 + cost_single * single)

    def signatures(self, tokens: np.ndarray, mixed: np.ndarray, running: np.ndarray) -> np.ndarray:
        """64-bit keys of one set; ``running`` has the sums of ``mixed`` before each token."""
        n, needed = len(tokens), self.needed(len(tokens))
        place = ((tokens >> U(32)) * U(self.segments) >> U(32)).astype(np.int64)  # ascending, as tokens are
        starts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        ends = np.append(starts[1:], n)
        segment, count = place[starts], ends - starts
        double = segment >= self.segments - self.doubles
        reached = np.cumsum(1 + (double & (count > 1)))
        thin = reached[-1] < needed
        taken = len(segment) if thin else int(np.searchsorted(reached, needed)) + 1
        keys = [(running[ends[:taken]] - running[starts[:taken]], segment[:taken])]
        opened = np.flatnonzero(double[:taken] & ((count[:taken] > 1) | thin))
        if len(opened):
            inside = np.repeat(opened, count[opened])
            at = np.arange(len(inside)) - np.repeat(np.cumsum(count[opened]) - count[opened], count[opened]) + starts[inside]
            keys.append((running[ends[inside]] - running[starts[inside]] - mixed[at], segment[inside]))
        if thin:
            empty = np.setdiff1d(np.arange(self.segments), segment)
            keys.append((np.zeros(len(empty), U), empty))
        total = np.concatenate([k for k, _ in keys])
        where = np.concatenate([s for _, s in keys]).astype(U)
        return np.unique(_mix(total + _mix(where + U(self.number) * U(1 << 40) + _ODD)))


class Scheme:
    """The partitions in which a set of a given size takes part."""

    def __init__(self, threshold: Threshold):
        self.threshold = threshold
        self.of = lru_cache(maxsize=100_000)(self._of)
        self.partition = lru_cache(maxsize=1_000)(self._partition)

    def _partition(self, band: int, low: int, high: int, edge: bool) -> Partition:
        t = self.threshold
        if not edge:  # pairs inside the band [low, high]
            return Partition(2 * band, low, high, lambda size: t.apart(size, min(t.largest(size), high)) + 1)
        # Pairs across the lower edge of the band: ``low`` is that edge.
        least, most = t.smallest(low), t.largest(low - 1)
        return Partition(2 * band + 1, least, max(least, most), lambda size: t.apart(size, t.largest(size) if size < low else low - 1) + 1)

    def _of(self, size: int) -> tuple[Partition, ...]:
        t, found, band = self.threshold, [], 0
        edges = t.edges()
        low, high = next(edges), next(edges)
        while high <= size:
            low, high, band = high, next(edges), band + 1
        found.append(self.partition(band, low, high - 1, False))
        if low > 1 and t.smallest(size) < low:
            found.append(self.partition(band, low, high - 1, True))
        if t.largest(size) >= high:
            found.append(self.partition(band + 1, high, next(edges) - 1, True))
        return tuple(found)

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        mixed = _mix(tokens ^ _ODD)
        running = np.concatenate((np.zeros(1, U), np.cumsum(mixed, dtype=U)))
        return np.concatenate([p.signatures(tokens, mixed, running) for p in self.of(len(tokens))])


_MAPPED = "bucket int, signatures binary, ids binary, counts binary, doc_id long, n long, digest binary, bitmap binary"
_META = pa.schema([("bucket", pa.int32()), ("signatures", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bitmap", pa.binary())])


def _map_side(threshold: Threshold, width: int, buckets: int, most: int = 1_500_000):
    """Documents -> one row of facts each, and blobs of signatures per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen = Scheme(threshold), set()
        keys: list[np.ndarray] = []
        owners: list[int] = []
        held = 0

        def blobs() -> pa.RecordBatch:
            flat = np.concatenate(keys)
            owner = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
            bucket = (flat % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, short = bucket[order], owner[order], (flat[order] >> U(32)).astype(np.uint32)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mine = owner[a:b]
                heads = np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1))
                counts = np.diff(np.append(heads, len(mine))).astype(np.uint32)
                rows.append({"bucket": int(bucket[a]), "signatures": short[a:b].tobytes(), "ids": mine[heads].tobytes(), "counts": counts.tobytes()})
            keys.clear()
            owners.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_META)

        for batch in by_bytes(batches, "text"):
            facts = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = shingle_set(text, width)
                digest = set_digest(tokens)
                place = int.from_bytes(digest[:4], "little") if doc_id is None else doc_id
                facts.append({"bucket": place % buckets, "doc_id": doc_id, "n": len(tokens), "digest": digest, "bitmap": parity_bitmap(tokens).tobytes()})
                if len(tokens) and doc_id is not None and digest not in seen:
                    seen.add(digest)  # later copies in this task add nothing
                    keys.append(scheme.signatures(tokens))
                    owners.append(doc_id)
                    held += len(keys[-1])
            yield pa.RecordBatch.from_pylist(facts, schema=_META)
            if held >= most:
                yield blobs()
                held = 0
        if keys:
            yield blobs()

    return run


_GROUPED = "gid long, doc_id long, n long, digest binary, bitmap binary"


def _bucket_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs -> members of every group of equal signatures; facts pass through."""
    schema = pa.schema([("gid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bitmap", pa.binary())])
    by_bucket: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        is_fact = pa.compute.is_null(batch.column("signatures"))
        facts = batch.filter(is_fact)
        if facts.num_rows:
            columns = [pa.nulls(facts.num_rows, pa.int64()), *(facts.column(c) for c in ("doc_id", "n", "digest", "bitmap"))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        blobs = batch.filter(pa.compute.invert(is_fact))
        for bucket, signatures, ids, counts in zip(*(blobs.column(c).to_pylist() for c in ("bucket", "signatures", "ids", "counts")), strict=True):
            owner = np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32))
            by_bucket.setdefault(bucket, []).append((np.frombuffer(signatures, np.uint32), owner))
    known = np.zeros(0, U)
    for bucket in list(by_bucket):
        parts = by_bucket.pop(bucket)
        key, owner = np.concatenate([k for k, _ in parts]), np.concatenate([o for _, o in parts])
        del parts
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        twin = key[1:] == key[:-1]
        shared = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
        key, owner = key[shared], owner[shared]
        if not len(key):
            continue
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        key, owner = key[fresh], owner[fresh]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        size = np.diff(np.append(starts, len(key)))
        # Groups with the same members need not be looked at twice.
        gid = _mix(np.add.reduceat(_mix(owner.view(U) + _ODD), starts) + size.astype(U))
        _, first = np.unique(gid, return_index=True)
        use = np.zeros(len(starts), bool)
        use[first] = True
        use &= (size > 1) & ~np.isin(gid, known)
        known = np.union1d(known, gid[use]) if len(known) < 2_000_000 else known
        rows = np.repeat(use, size)
        out_gid, out_doc = np.repeat(gid, size)[rows].view(np.int64), owner[rows]
        for a in range(0, len(out_gid), 100_000):
            m = len(out_gid[a : a + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(out_gid[a : a + m]), pa.array(out_doc[a : a + m]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema=schema)


def _possible(threshold: Threshold):
    """Pairs (a, b) with sizes and bitmaps -> those that the bounds leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            keep = []
            for na, nb, ma, mb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb")), strict=True):
                if threshold.num * max(na, nb) > threshold.den * min(na, nb):
                    keep.append(False)
                    continue
                size = min(len(ma), len(mb))
                x = folded(np.frombuffer(ma, np.uint8), size) ^ folded(np.frombuffer(mb, np.uint8), size)
                keep.append(int(np.bitwise_count(x).sum()) <= threshold.apart(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = [threshold.linked(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = [shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "tokens"])

    return run


def _text_digests(width: int):
    """(doc_id, text) -> the same with the digest of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            digests = [set_digest(shingle_set(t, width)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(digests, pa.binary())], ["doc_id", "text", "digest"])

    return run


def _listed_tokens(threshold: Threshold, width: int):
    """(doc_id, token, prefix): every token of a set, and how many of its tokens a linked set cannot miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1_000_000):
            ids, sets = batch.column("doc_id").to_numpy(), [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            prefix = np.array([len(x) - threshold.smallest(len(x)) + 1 for x in sets], np.int64)
            flat, owner = np.concatenate(sets).view(np.int64), np.repeat(np.arange(len(sets)), sizes)
            for a in range(0, len(flat), 100_000):
                part = owner[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(flat[a : a + 100_000]), pa.array(prefix[part])], ["doc_id", "token", "prefix"])

    return run


def rare_groups(rows: DataFrame, threshold: Threshold, width: int) -> DataFrame:
    """(gid, rep): the sets that share one of their rarest tokens, one group per token.

    In any fixed order of tokens, sets that reach the threshold share one of their first
    ``size - smallest partner + 1`` tokens; ordering by the number of sets that hold a token
    keeps very common ones out of these prefixes. ``rows`` (doc_id, text): one per id.
    """
    tokens = rows.mapInArrow(lean("ngramjoin", _listed_tokens(threshold, width)), "doc_id long, token long, prefix long")
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    rarest = Window.partitionBy("doc_id").orderBy("held", "token")
    ranked = tokens.join(held, "token").withColumn("place", F.row_number().over(rarest))
    return ranked.where("place <= prefix and held > 1").select(F.col("token").alias("gid"), F.col("doc_id").alias("rep"))


def _cross_pairs(threshold: Threshold):
    """Sorted rows of (group, block i, block j) -> possible pairs of different components."""

    def pairs(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        doc, comp, n = (np.array(rows[c], np.int64) for c in ("doc_id", "comp", "n"))
        left = np.array([a == b for a, b in zip(rows["block"], rows["i"], strict=True)])
        right = np.array([a == b for a, b in zip(rows["block"], rows["j"], strict=True)])
        size = min(len(m) for m in rows["bitmap"])
        maps = np.stack([folded(np.frombuffer(m, np.uint8), size) for m in rows["bitmap"]]).view(U)
        a_out, b_out = [], []
        others = np.flatnonzero(right)
        for x in np.flatnonzero(left):
            y = others[(comp[others] != comp[x]) & (threshold.num * np.maximum(n[others], n[x]) <= threshold.den * np.minimum(n[others], n[x]))]
            if not len(y):
                continue
            away = np.bitwise_count(maps[y] ^ maps[x]).sum(axis=1)
            y = y[away <= threshold.apart(n[y], n[x])]
            a_out.append(np.minimum(doc[y], doc[x]))
            b_out.append(np.maximum(doc[y], doc[x]))
        if not a_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.unique(np.stack([np.concatenate(a_out), np.concatenate(b_out)]), axis=1)
        return found[0], found[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("gid", "i", "j", "block", "doc_id", "comp", "n", "bitmap")
        held: dict[str, list] = {c: [] for c in names}
        key, found, waiting = None, [], 0

        def taken() -> pa.RecordBatch:
            """Pairs found so far; many groups share a pair, which leaves a task but once."""
            both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in sliced(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:3] != key:
                    if key is not None:
                        found.append(np.stack(pairs(held)))
                        waiting += found[-1].shape[1]
                        if waiting > 1_000_000:
                            yield taken()
                            found, waiting = [], 0
                    key, held = row[:3], {c: [] for c in names}
                for c, value in zip(names, row, strict=True):
                    held[c].append(value)
        if key is not None:
            found.append(np.stack(pairs(held)))
        yield taken()

    return run


def _link_counts(threshold: Threshold):
    """Sorted rows of (component, block i, block j) -> links of each set, weighted by copies."""
    names = ("comp", "i", "j", "block", "doc_id", "copies", "tokens")

    def counted(rows: dict[str, list], i: int, j: int) -> pa.RecordBatch:
        doc, copies, block = (np.array(rows[c], np.int64) for c in ("doc_id", "copies", "block"))
        sets = [np.frombuffer(t, U) for t in rows["tokens"]]
        n = np.array([len(x) for x in sets], np.int64)
        place = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        own = np.split(place, np.cumsum(n)[:-1])
        right = np.flatnonzero(block == j)
        if not len(right):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.zeros(len(doc), np.int64))], ["doc_id", "links"])
        right = right[np.argsort(n[right], kind="stable")]
        sizes, flat = n[right], np.concatenate([own[y] for y in right])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        mark, links = np.zeros(len(place), np.int32), np.zeros(len(doc), np.int64)
        for x in np.flatnonzero(block == i):
            size = int(n[x])
            a, b = np.searchsorted(sizes, threshold.smallest(size)), np.searchsorted(sizes, threshold.largest(size), "right")
            if a == b:
                continue
            mark[own[x]] = 1
            common = np.add.reduceat(mark[flat[starts[a] : starts[b]]], starts[a:b] - starts[a], dtype=np.int64)
            mark[own[x]] = 0
            y = right[a:b][threshold.den * common >= threshold.num * (size + sizes[a:b] - common)]
            y = y[y != x]
            links[x] += copies[y].sum()
            if i != j:
                links[y] += copies[x]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(links)], ["doc_id", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {c: [] for c in names}
        for batch in sliced(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:3] != key:
                    if key is not None:
                        yield counted(held, *key[1:])
                    key, held = row[:3], {c: [] for c in names}
                for c, value in zip(names, row, strict=True):
                    held[c].append(value)
        if key is not None:
            yield counted(held, *key[1:])

    return run


def few_files(spark: SparkSession, frame: DataFrame, path: str, of: int = 8) -> DataFrame:
    """A work table in few files; those that hold sets or texts (``of`` 4) keep files that a task can read at once."""
    return saved(spark, merged(spark, frame, of), path)


def components(spark: SparkSession, links: DataFrame, folder: str) -> DataFrame:
    """(doc_id, comp): the smallest id reachable over ``links`` (a, b), for every end.

    Alternating large-star and small-star steps; each round is a work table.
    """
    edges = few_files(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{folder}/edges0")
    last, rounds = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        rounds += 1
        edges = few_files(spark, small, f"{folder}/edges{rounds}")
        dropped(spark, f"{folder}/edges{rounds - 1}")
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
        if state == last or state[0] == 0:
            break
        last = state
    roots = edges.select(F.col("v").alias("doc_id")).distinct().select("doc_id", F.col("doc_id").alias("comp"))
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")).unionByName(roots)


def similar_components(
    spark: SparkSession, docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, block: int = 1_024, salts: int = 16, count_links: bool = True, hot: int = 4_096
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every id of ``docs`` (doc_id, text).

    Without ``count_links`` links are not counted and n_links is left out.
    """
    threshold, folder = Threshold(num, den), work_folder(spark, "ngramjoin")
    buckets = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))

    def indexed(step: str) -> tuple[DataFrame, DataFrame]:
        """Signature groups beside the facts of each row, and the facts of each id."""
        mapped = rows.mapInArrow(lean("ngramjoin", _map_side(threshold, width, buckets)), _MAPPED).repartitionById(buckets, F.col("bucket"))
        grouped = few_files(spark, mapped.mapInArrow(lean("ngramjoin", _bucket_side), _GROUPED), f"{folder}/grouped{step}", 4)
        of_id = grouped.where(F.col("gid").isNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
        of_id = of_id.agg(F.min(F.struct("digest", "n")).alias("f"), F.max("digest").alias("last"), F.count(F.lit(1)).alias("rows"))
        return grouped, few_files(spark, of_id.select("doc_id", "f.*", "rows", (F.col("f.digest") != F.col("last")).alias("mixed")), f"{folder}/single{step}")

    grouped, single = indexed("1")
    repeated = single.agg(F.max(F.col("rows") > 1), F.max("mixed")).first()
    if repeated[0]:
        # One row per id from here on: the text whose set has the smallest digest.
        several = single.where("rows > 1").select("doc_id")
        counting = rows.join(several, "doc_id", "left_semi").mapInArrow(lean("ngramjoin", _text_digests(width)), "doc_id long, text string, digest binary")
        counting = counting.groupBy("doc_id").agg(F.min(F.struct("digest", "text")).alias("f")).select("doc_id", "f.text")
        rows = few_files(spark, rows.join(several, "doc_id", "left_anti").unionByName(counting), f"{folder}/rows", 4)
        if repeated[1]:  # signatures of texts that do not count must not stand in the index
            dropped(spark, f"{folder}/grouped1")
            grouped, single = indexed("2")

    facts = grouped.where(F.col("gid").isNull()).select("doc_id", "n", "digest", "bitmap")
    nameless = facts.where(F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("n_links"))
    facts = facts.where(F.col("doc_id").isNotNull())
    single = single.select("doc_id", "digest", "n")
    # Only sets that occur more than once need their first id; a set that very many documents
    # share meets it in ``salts`` places.
    first = single.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    single = single.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    named = single.join(first, ["digest", "salt"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    named = few_files(spark, named, f"{folder}/named")

    members = grouped.where(F.col("gid").isNotNull()).select("gid", "doc_id").join(named.select("doc_id", "rep"), "doc_id").select("gid", "rep").distinct()
    members = few_files(spark, members, f"{folder}/members")
    # Sizes and bitmaps only of the documents that share a group.
    maps = facts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    maps = maps.groupBy("doc_id").agg(F.min(F.struct("digest", "n", "bitmap")).alias("f")).select(F.col("doc_id").alias("rep"), "f.n", "f.bitmap")
    maps = few_files(spark, maps, f"{folder}/maps")
    hubs = members.groupBy("gid").agg(F.min("rep").alias("hub"))
    stars = members.join(hubs, "gid").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda x: maps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
    stars = stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean("ngramjoin", _possible(threshold)), "a long, b long")

    def verify(pairs: DataFrame, step: str) -> DataFrame:
        pairs = few_files(spark, pairs, f"{folder}/pairs{step}")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        found = rows.join(wanted, "doc_id", "left_semi").mapInArrow(lean("ngramjoin", _sets(width)), "doc_id long, tokens binary")
        found = few_files(spark, found, f"{folder}/sets{step}", 4)
        end = lambda x: found.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"s{x}"))
        links = few_files(spark, pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(lean("ngramjoin", _verified(threshold)), "a long, b long"), f"{folder}/links{step}")
        return links

    links = verify(stars, "1")
    comps = components(spark, links, f"{folder}/cc1")

    # Groups whose members still lie in several components: test their cross pairs.
    labels = comps.withColumnRenamed("doc_id", "rep")

    def spanning(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(gid, rep, comp), and the size of the groups that span several components."""
        labelled = groups.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        sizes = labelled.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
        return labelled, sizes.where("lo <> hi").select("gid", "size")

    labelled, sizes = spanning(members)
    sizes = few_files(spark, sizes.where("size > 2"), f"{folder}/sizes")
    opened = labelled.join(sizes.where(F.col("size") <= hot), "gid")
    if sizes.where(F.col("size") > hot).limit(1).count():
        crowd = members.join(sizes.where(F.col("size") > hot), "gid", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
        rare = few_files(spark, rare_groups(rows.join(crowd, "doc_id", "left_semi"), threshold, width), f"{folder}/rare")
        relabelled, sizes = spanning(rare)
        opened = opened.unionByName(relabelled.join(sizes, "gid").select(*opened.columns))
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    opened = opened.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    opened = opened.join(maps, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    opened = opened.select("gid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("rep").alias("doc_id"), "comp", "n", "bitmap")
    opened = opened.repartition(buckets, "gid", "i", "j").sortWithinPartitions("gid", "i", "j")
    cross = opened.mapInArrow(lean("ngramjoin", _cross_pairs(threshold)), "a long, b long").distinct()
    cross = few_files(spark, cross.join(spark.read.parquet(f"{folder}/pairs1"), ["a", "b"], "left_anti"), f"{folder}/cross")
    if cross.limit(1).count():
        links = links.unionByName(verify(cross, "2"))
        comps = components(spark, links, f"{folder}/cc2")
        steps = ("1", "2")
    else:
        steps = ("1",)
    if not count_links:
        dropped(spark, *(f"{folder}/sets{step}" for step in steps))
        result = named.join(comps.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
        return result.unionByName(nameless.drop("n_links"))

    # Every set of a component was verified against another one, so its tokens are at hand.
    sets = spark.read.schema("doc_id long, tokens binary").parquet(*(f"{folder}/sets{step}" for step in steps)).join(comps, "doc_id").dropDuplicates(["doc_id"])
    copies = few_files(spark, named.where("n > 0").groupBy(F.col("rep").alias("doc_id")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), f"{folder}/copies")
    sets = few_files(spark, sets.join(copies, "doc_id", "left").select("doc_id", "comp", F.coalesce("copies", F.lit(1)).alias("copies"), "tokens"), f"{folder}/sets", 4)
    dropped(spark, *(f"{folder}/sets{step}" for step in steps))
    shape = sets.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("tokens") / 8).alias("mass"))
    # Large components are cut finely enough that their cells spread over all tasks.
    spread = F.when(F.col("size") > F.lit(block // 4), F.least(F.col("size") / F.lit(block // 16 or 1), F.lit(math.ceil(math.sqrt(2 * buckets))))).otherwise(1)
    shape = shape.select("comp", F.ceil(F.greatest(F.col("size") / F.lit(block), F.col("mass") / F.lit(block * 1_000), spread)).cast("int").alias("blocks"))
    cells = sets.join(shape, "comp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "copies", "tokens")
    cells = cells.repartition(buckets, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    counts = cells.mapInArrow(lean("ngramjoin", _link_counts(threshold)), "doc_id long, links long").groupBy("doc_id").agg(F.sum("links").alias("links"))
    classes = comps.join(counts, "doc_id", "left").join(copies, "doc_id", "full").withColumnRenamed("doc_id", "rep")
    classes = few_files(spark, classes, f"{folder}/classes")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    result = named.join(classes, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"), n_links.alias("n_links"))
    return result.unionByName(nameless)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar texts: the one with the smallest id.

    Rows without a word (null or empty text) resemble nothing and all stay. Null ids and ids
    that several rows carry are legal: then every row is a document of its own, null ids
    come after all others, and of rows with one id in one group the first in the order of
    the stage's input stays. All columns, whatever their names, come back unchanged; an empty
    table gives no rows.
    """
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        groups = similar_components(spark, docs, count_links=False)
        other = fresh_name(docs, "other")
        others = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(other))
        return docs.join(others, docs["doc_id"] == others[other], "left_anti")
    place = fresh_name(docs, "place")
    # Written once, so that the places stay what they are.
    placed = saved(spark, docs.withColumn(place, F.monotonically_increasing_id()), f"{work_folder(spark, 'ngramstage')}/placed")
    groups = similar_components(spark, placed.select(F.col(place).alias("doc_id"), "text"), count_links=False)
    members = groups.select(F.col("doc_id").alias(place), "component_id").join(placed.select(place, F.col("doc_id").alias("id")), place)
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", F.col(place).alias("place"))).alias("f"))
    return placed.join(kept.select(F.col("f.place").alias(place)), place, "left_semi").select(*docs.columns)

"""Approximate nearest neighbours with one vantage-point tree per shard.

Rows are dealt to shards by a hash of their id; each shard's distinct vectors form a
vantage-point tree (equal vectors share one entry that lists its smallest ids, which
are the only ones a top-k with ties to the smaller id can need). There are as many shards
as shuffle partitions, fewer while they would hold under ``least_rows`` rows, and more once
they would hold over ``shard_bytes`` of vectors. Trees are work tables. Every query is sent
to every shard; a task reads its shard's tree once and then streams the queries past it,
many at a time, and each query's best per shard are merged.

A subtree is skipped if its distance band lies farther than the query's k-th best so
far, by the triangle inequality: factor * gap > kth. ``factor`` 1 is exact search;
larger factors skip more. Candidates are always ranked by their exact distance in
double precision.

Defined cases: null, empty or zero vectors and vectors with null or non-finite
components take no part; vectors meet only vectors of their own length; of several
rows with one id the one with the smallest vector counts; null ids take no part; a
query with fewer candidates than k gets them all; ties go to the smaller id; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, lean_worker, saved, shuffle_partitions, work_folder

_TREE_SCHEMA = "dims int, shard int, tree binary"


class VpTree:
    """A vantage-point tree over distinct vectors, as flat arrays."""

    FIELDS = ("vectors", "ids", "vantage", "inner_low", "inner_high", "outer_low", "outer_high", "children", "spans")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @staticmethod
    def build(vectors: np.ndarray, ids: np.ndarray, k: int, leaf: int = 64, seed: int = 5) -> VpTree:
        """``vectors`` (rows) and their ids; keeps the k + 1 smallest ids of equal vectors."""
        order = np.argsort(ids, kind="stable")
        vectors, ids = vectors[order], ids[order]
        distinct, group = np.unique(vectors, axis=0, return_inverse=True)
        group = group.reshape(-1)
        by = np.argsort(group, kind="stable")
        place = np.arange(len(by)) - np.searchsorted(group[by], group[by])
        kept = place <= k  # a query may have to leave out its own id
        listed = np.full((len(distinct), min(k + 1, int(place.max()) + 1 if len(place) else 1)), -1, np.int64)
        known = np.zeros(listed.shape, bool)
        listed[group[by][kept], place[kept]] = ids[by][kept]
        known[group[by][kept], place[kept]] = True
        rows = np.arange(len(distinct))
        generator = np.random.RandomState(seed)
        nodes: list[list] = []  # vantage row, four band edges, two children, span

        def grow(start: int, stop: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0.0, 0.0, 0.0, -1, -1, start, stop])
            if stop - start <= leaf:
                return me
            part = rows[start:stop]
            # The vantage point is the candidate whose distances spread most.
            tried = part[generator.randint(0, len(part), 8)]
            probe = distinct[part[generator.randint(0, len(part), 64)]]
            spread = [np.sqrt(((probe - distinct[t]) ** 2).sum(axis=1)).std() for t in tried]
            vantage = tried[int(np.argmax(spread))]
            away = np.sqrt(((distinct[part] - distinct[vantage]) ** 2).sum(axis=1))
            by_distance = np.argsort(away, kind="stable")
            rows[start:stop], away = part[by_distance], away[by_distance]
            half = (stop - start) // 2
            nodes[me][:5] = [vantage, away[0], away[half - 1], away[half], away[-1]]
            nodes[me][5] = grow(start, start + half)
            nodes[me][6] = grow(start + half, stop)
            return me

        if len(rows):
            grow(0, len(rows))
        table = np.array(nodes, float).reshape(-1, 9)
        return VpTree(
            vectors=distinct[rows],
            ids=np.stack([listed[rows], known[rows]]),
            vantage=distinct[table[:, 0].astype(int)] if len(table) else distinct,
            inner_low=table[:, 1], inner_high=table[:, 2], outer_low=table[:, 3], outer_high=table[:, 4],
            children=table[:, 5:7].astype(np.int64),
            spans=table[:, 7:9].astype(np.int64),
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> VpTree:
        with np.load(io.BytesIO(data), allow_pickle=False) as stored:
            return VpTree(**{name: stored[name] for name in VpTree.FIELDS})

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest to each query, nearest first, without its own id.

        Missing neighbours have the distance infinity. All queries go down together: at every
        node those that the band does not rule out turn first to the side that is nearer for
        most of them, so that a node is visited once.
        """
        best = np.full((len(queries), k), np.inf)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        if not len(self.spans) or not len(queries):
            return best, best_id
        waiting = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while waiting:
            node, who, gap = waiting.pop()
            # Ties at the k-th distance may still hold a smaller id, so only a larger gap skips.
            open_ = gap * factor <= best[who, -1]
            who, gap = who[open_], gap[open_]
            if not len(who):
                continue
            low, high = self.children[node]
            if low < 0:
                self._leaf(queries, own, k, best, best_id, who, *self.spans[node])
                continue
            away = np.sqrt(((self.vantage[node] - queries[who]) ** 2).sum(axis=1))
            slack = 1e-12 * (1.0 + away)
            inner = np.maximum(0.0, np.maximum(self.inner_low[node] - away, away - self.inner_high[node])) - slack
            outer = np.maximum(0.0, np.maximum(self.outer_low[node] - away, away - self.outer_high[node])) - slack
            nearer = (inner < outer) | ((inner == outer) & (away < (self.inner_high[node] + self.outer_low[node]) / 2))
            pair = [(high, who, np.maximum(gap, outer)), (low, who, np.maximum(gap, inner))]
            if 2 * np.count_nonzero(nearer) < len(who):
                pair.reverse()
            waiting += pair  # popped from the end
        return best, best_id

    def _leaf(self, queries, own, k, best, best_id, who, start, stop) -> None:
        # A product of matrices rules out most pairs, with room for its rounding; the rest is measured exactly.
        part, asked = self.vectors[start:stop], queries[who]
        sums, own_sums = (part**2).sum(axis=1)[None, :], (asked**2).sum(axis=1)[:, None]
        rough = sums + own_sums - 2.0 * (asked @ part.T)
        row, place = np.nonzero(~(rough > best[who, -1:] ** 2 + 1e-9 * (sums + own_sums)))
        distance = np.sqrt(((part[place] - asked[row]) ** 2).sum(axis=1))
        near = distance <= best[who[row], -1]
        row, place, distance = row[near], place[near], distance[near]
        if not len(row):
            return
        # Every id of the vectors that are near enough, as (query, distance, id).
        entry, listed = np.nonzero(self.ids[1, start:stop][place])
        ids, row, distance = self.ids[0, start:stop][place[entry], listed], who[row[entry]], distance[entry]
        others = ids != own[row]
        row, distance, ids = row[others], distance[others], ids[others]
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, k), row])
        distance, ids = np.concatenate([best[touched].ravel(), distance]), np.concatenate([best_id[touched].ravel(), ids])
        order = np.lexsort((ids, distance, row))
        first = np.searchsorted(row[order], touched)
        kept = order[(first[:, None] + np.arange(k)).ravel()]
        best[touched], best_id[touched] = distance[kept].reshape(-1, k), ids[kept].reshape(-1, k)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one finite, non-zero double vector per id."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column of equally long, non-null vectors."""
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), -1)


def build_index(spark: SparkSession, rows: DataFrame, folder: str, k: int, least_rows: int = 16_384, shard_bytes: int = 64 << 20) -> DataFrame:
    """One tree per shard (and vector length); every row is indexed."""
    facts = rows.agg(F.count(F.lit(1)), F.sum(8 * F.size("v"))).first()
    shards = max(1, min(shuffle_partitions(spark), -(-facts[0] // least_rows)), -(-(facts[1] or 0) // shard_bytes))
    dealt = rows.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))

    def grow(part: pa.Table) -> pa.Table:
        with lean_worker("vptree"):
            tree = VpTree.build(_matrix(part.column("v")), part.column("vec_id").to_numpy(), k).dump()
        return pa.table({"dims": part.column("dims")[:1], "shard": part.column("shard")[:1], "tree": pa.array([tree], pa.binary())})

    return saved(spark, dealt.groupBy("dims", "shard").applyInArrow(grow, _TREE_SCHEMA), f"{folder}/trees")


def search_index(spark: SparkSession, queries: DataFrame, trees: DataFrame, k: int, factor: float, floats_at_once: int = 1 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (vec_id, v) over all trees."""
    shards = int(trees.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.select(F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v", F.lit(None).cast("binary").alias("tree"))
    held = trees.select("dims", "shard", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), "tree")
    # Each shard's tree comes first, then its queries; shards are dealt evenly, one after another.
    spread = max(shards, shuffle_partitions(spark))
    rows = held.unionByName(asked).repartitionById(spread, F.col("shard")).sortWithinPartitions("dims", "shard", F.col("vec_id").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        for batch in batches:
            here = list(zip(batch.column("dims").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            heads = [i for i in range(batch.num_rows) if i == 0 or here[i] != here[i - 1]]
            for start, stop in zip(heads, [*heads[1:], batch.num_rows], strict=True):
                if here[start] != key:
                    key, tree = here[start], None
                if batch.column("tree")[start].is_valid:
                    tree = VpTree.load(batch.column("tree")[start].as_py())
                    start += 1
                if tree is None or start == stop:  # no row of this length lies in this shard
                    continue
                at_once = max(16, floats_at_once // max(1, 64 * key[0]))
                for a in range(start, stop, at_once):
                    part = batch.slice(a, min(at_once, stop - a))
                    own = part.column("vec_id").to_numpy()
                    away, ids = tree.search(_matrix(pa.chunked_array([part.column("v")])), own, k, factor)
                    some = np.isfinite(away)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, some.sum(axis=1))), pa.array(ids[some]), pa.array(away[some])], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(lean("vptree", search), "query_id long, vec_id long, score double")
    # At most k rows per query and shard meet here.
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(spark: SparkSession, vectors: DataFrame, k: int = 10, factor: float = 1.1, every: int = 100, least_rows: int = 16_384) -> DataFrame:
    """The k nearest others of every row whose id is divisible by ``every``."""
    folder = work_folder(spark, "vptree")
    rows = saved(spark, usable(vectors), f"{folder}/vectors")
    trees = build_index(spark, rows, folder, k, least_rows)
    return search_index(spark, rows.where(F.col("vec_id") % every == 0), trees, k, factor)


def op4_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

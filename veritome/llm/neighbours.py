"""Operator 3: approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long hash strings, one bit for each random hyperplane. A query
descends in every tree to its longest matching prefixes and then ascends in all trees at
once, a bit or more at a time, which widens the ranges of the arrays and so its candidates. It stops
when a neighbour as near as its k-th best so far would have been missed by all trees with
a probability of at most MISS; with no prefix left all rows have been compared. Rows are dealt into shards, each
with one forest through which all queries stream, and the best of all shards are merged. Vectors are
hashed after scaling by powers of two and compared in double precision, so their scale doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS = 128, 32
#: Prefix lengths at which candidates are looked at, longest first.
LEVELS = (32, 26, 20, 16, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0)
#: Prefixes up to this length are looked up in a table of the array's bounds, longer ones by bisection.
TABLE = 13
MISS = 0.05
#: Rows in a shard, about, and queries looked up at once; what a task holds is bounded by these, not by the table.
SHARD_ROWS, BLOCK_ROWS = 8192, 1024
SEED = 7


def _scaled(x: np.ndarray, axis: int | None) -> np.ndarray:
    """``x`` by a power of two, exactly, so that the largest component is from 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=axis, keepdims=True))[1])


class Forest:
    """The trees over one shard's different vectors, extended by one component so that the largest inner product is the smallest angle."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = SEED) -> None:
        norms = np.sqrt((vectors * vectors).sum(1))
        self.longest = float(norms.max())
        extended = np.hstack([vectors, np.sqrt(np.maximum(self.longest**2 - norms**2, 0))[:, None]])
        self.planes = np.random.default_rng(seed).standard_normal((extended.shape[1], trees * BITS)).astype(np.float32)
        keys = self._keys(extended)
        self.order = np.argsort(np.ascontiguousarray(keys.T), axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys.T, self.order, 1)
        bounds = np.stack([np.searchsorted(k, np.arange(1 << TABLE, dtype=np.uint32) << np.uint32(BITS - TABLE)) for k in self.keys] or [[]])
        self.bounds = np.hstack([bounds, np.full((len(bounds), 1), len(vectors))]).astype(np.int32)

    def _keys(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.planes.shape[1] // BITS), np.uint32)
        for at in range(0, len(x), 2048):
            bits = (x[at : at + 2048].astype(np.float32) @ self.planes) > 0
            out[at : at + 2048] = np.packbits(bits.reshape(len(bits), -1, BITS), axis=2).view(">u4")[:, :, 0]
        return out

    def ranges(self, queries: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each level its prefix length, and per query and tree the bounds of the array's range."""
        keys = self._keys(np.hstack([queries, np.zeros((len(queries), 1))])).astype(np.int64).T
        n, out = self.keys.shape[1], []
        for d in LEVELS:
            prefix = keys >> (BITS - d)
            if d <= TABLE:
                a = np.take_along_axis(self.bounds, prefix << (TABLE - d), 1)
                b = np.take_along_axis(self.bounds, (prefix + 1) << (TABLE - d), 1)
            else:
                low, high = prefix << (BITS - d), (prefix + 1) << (BITS - d)
                a = np.stack([np.searchsorted(k, x.astype(np.uint32)) for k, x in zip(self.keys, low, strict=True)])
                b = np.stack([np.where(x > 0xFFFFFFFF, n, np.searchsorted(k, np.minimum(x, 0xFFFFFFFF).astype(np.uint32))) for k, x in zip(self.keys, high, strict=True)])
            out.append((d, a.T, b.T))
        return out


class Shard:
    """Some rows with their forest. Rows with equal vectors are one point of the forest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, miss: float = MISS) -> None:
        self.trees, self.miss = trees, miss
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        rows = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, kind = np.unique(rows, return_index=True, return_inverse=True)
        self.ids = ids[np.argsort(kind, kind="stable")]  # point by point, ascending in each
        self.n_rows = np.bincount(kind, minlength=len(first))
        self.starts = np.cumsum(self.n_rows) - self.n_rows
        self.points = vectors[first]
        self.scaled = _scaled(self.points, None)
        self.forest = Forest(self.scaled, trees)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, row ids and scores: the ``k`` best that each query finds; ties to smaller ids, own id left out."""
        scaled = _scaled(queries, 1)
        levels = self.forest.ranges(scaled)
        total = np.stack([(b - a).sum(1) for _, a, b in levels], 1)
        found = [self._one(query_ids[q], queries[q], scaled[q], [(d, a[q], b[q]) for d, a, b in levels], total[q], k) for q in range(len(queries))]
        return np.repeat(query_ids, [len(i) for i, _ in found]), np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found])

    def _one(self, own: int, vector: np.ndarray, scaled: np.ndarray, levels: list, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, copies = len(self.points), np.minimum(self.n_rows, k + 1)
        reach = float(np.sqrt(scaled @ scaled)) * self.forest.longest
        score, seen = np.full(n, -np.inf), np.zeros(n, bool)
        at = int(np.argmax(total > k)) if total[-1] > k else len(levels) - 1  # down to where there are enough for a first look
        while True:
            d, a, b = levels[at]
            new = np.ones(n, bool) if d == 0 else np.zeros(n, bool)
            if d:
                new[np.concatenate([self.forest.order[t, lo:hi] for t, (lo, hi) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if hi > lo])] = True
            new = np.flatnonzero(new & ~seen)
            score[new] = self.scaled[new] @ scaled
            seen[new] = True
            if d == 0:
                break
            found = np.flatnonzero(seen)
            deepest = 0
            if copies[found].sum() > k:
                most = min(k, len(found) - 1)
                best = found[np.argpartition(-score[found], most)[: most + 1]]
                best = best[np.argsort(-score[best])]
                worst = score[best[min(np.searchsorted(np.cumsum(copies[best]), k + 1), len(best) - 1)]]
                near = 1 - np.arccos(np.clip(worst / reach, -1, 1)) / np.pi
                if (1 - near**d) ** self.trees <= self.miss:
                    break
                deepest = next(x for x in range(d, -1, -1) if (1 - near**x) ** self.trees <= self.miss)
            # up to where a neighbour like the k-th would be found, but no more than to a few times the candidates: nearer ones may turn up
            before = total[at]
            at += 1
            while levels[at][0] > deepest and total[at] < 3 * before:
                at += 1
        found = np.flatnonzero(seen)
        if len(found) > k + 1:  # all that could be among the best, ties and rounding included
            least = -np.partition(-score[found], k)[k]
            found = found[score[found] >= least - 1e-12 * reach]
        exact = (self.points[found] * vector).sum(1)  # sums each row in the same way, wherever it lies
        n_each = copies[found]
        ids = self.ids[np.repeat(self.starts[found] - np.cumsum(n_each) + n_each, n_each) + np.arange(n_each.sum())]
        scores = np.repeat(exact, n_each)
        other = ids != own
        ids, scores = ids[other], scores[other]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def usable(vector):
    """Column: the vector is not null, has no null or non-finite component, and isn't zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, miss: float = MISS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by inner product that the forests find for each row where ``is_query`` holds.

    Keys are integers. Null and zero vectors, those with null or non-finite components and rows with a null
    key take no part, as query or candidate; vectors of different lengths aren't
    compared. Ties go to the smaller key, and a query's own key is left out. Rows that repeat
    key and vector count once. Fewer candidates give fewer rows, an empty table none. Other columns are left out.
    Finite vectors of any scale take part, also of very different ones. A row goes to one shard and a query to all
    of them, and a task holds a shard and some queries.
    """
    kept = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).distinct()
    shards = max(1, -(-kept.count() // SHARD_ROWS))
    rows = kept.select("id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(shards).cast("long")).alias("shard"))
    queries = kept.where("asks").select("id", "v", "asks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    dealt = rows.unionByName(queries).withColumn("size", F.size("v").cast("long")).select("size", "shard", "asks", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, shard = None, [], None  # a shard's rows come before its queries
        for batch in batches:
            size, number, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.flatnonzero((np.diff(size) != 0) | (np.diff(number) != 0) | (asks[1:] != asks[:-1])) + 1
            cuts = [0, *edges.tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if (size[lo], number[lo]) != of:
                    of, held, shard = (size[lo], number[lo]), [], None
                x = batch.column(4).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, size[lo])
                if not asks[lo]:
                    held.append((ids[lo:hi], x))
                    continue
                if held:
                    shard, held = Shard(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), trees, miss), []
                for at in range(0, hi - lo if shard else 0, BLOCK_ROWS):
                    found = shard.search(ids[lo + at : min(hi, lo + at + BLOCK_ROWS)], x[at : at + BLOCK_ROWS], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    best = dealt.repartition("size", "shard").sortWithinPartitions("size", "shard", "asks").mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

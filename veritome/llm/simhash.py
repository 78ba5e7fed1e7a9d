"""Operator 5: SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their two
halves. Two fingerprints within the radius have counts that differ by no more, so a
tile meets only tiles that near; inside a pair of tiles, blocks sorted by the counts of
the four quarters are compared by exclusive-or and bit counts, and pairs of blocks
beyond the radius are skipped. A pair of tiles gives a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.graph import connected_components
from veritome.llm.tables import Scratch, own_name, written

RADIUS = 2
WORDS = 3
SEED = 42
#: Fingerprints in a tile, at most about; more are dealt into further tiles of the same counts.
TILE_ROWS = 50_000
#: Side of a compared block.
BLOCK = 256


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, 0 without words: bit set if in over half of the shingles' hashes."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hashed(joined, seed)
    ends = np.cumsum([len(x) + 1 for x in parts])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    votes, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 15):
        h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``key, h, fp``: a hash of the text and the fingerprint of each row, as signed 64-bit integers."""
    fixed = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["key", "h", "fp"])

    return fixed.mapInArrow(run, f"key {fixed.schema['key'].dataType.simpleString()}, h long, fp long")


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bitwise_count(fps >> np.uint64(32)).astype(np.int64), np.bitwise_count(fps & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _tile_pairs(batches: Iterator[pa.RecordBatch], tiles: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once for every pair of tiles that its tile belongs to: ``one, two, side, fp``."""
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    most = int(tiles.max(initial=1))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        hi, lo = _halves(fps)
        own_sub = (fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles[hi, lo]
        own = (hi * 33 + lo) * most + own_sub
        for i, j in near:
            inside = (hi + i >= 0) & (hi + i <= 32) & (lo + j >= 0) & (lo + j <= 32)
            other = np.where(inside, (hi + i) * 33 + lo + j, 0)
            n_sub = np.where(inside, tiles.reshape(-1)[other], 0)
            for sub in range(int(n_sub.max(initial=0))):
                rows = n_sub > sub
                a, b = own[rows], other[rows] * most + sub
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array((a > b).astype(np.int32)), pa.array(fps[rows].view(np.int64))], names=["one", "two", "side", "fp"])


def _blocks(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the quarters' population counts, and the least and most of these in each block."""
    quarters = np.stack([np.bitwise_count((fps >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.int16) for q in range(4)], 1)
    order = np.lexsort(quarters.T[::-1])
    quarters = quarters[order]
    at = np.arange(0, len(fps), BLOCK)
    return order, np.minimum.reduceat(quarters, at), np.maximum.reduceat(quarters, at)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (values of fingerprints) that connect whatever links within the radius connect; right None: left with itself."""
    nodes = left if right is None else np.concatenate([left, right])
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sides = []
    for fps, offset in ((left, 0), (left if right is None else right, 0 if right is None else len(left))):
        order, low, high = _blocks(fps)
        sides.append((fps[order], order + offset, low, high))
    (a, a_at, a_low, a_high), (b, b_at, b_low, b_high) = sides
    for i in range(len(a_low)):
        gap = np.maximum(0, np.maximum(b_low - a_high[i], a_low[i] - b_high)).sum(1)
        x, xs = a[i * BLOCK : (i + 1) * BLOCK], a_at[i * BLOCK : (i + 1) * BLOCK]
        for j in np.flatnonzero(gap <= radius):
            if right is None and j < i:
                continue
            y, ys = b[j * BLOCK : (j + 1) * BLOCK], b_at[j * BLOCK : (j + 1) * BLOCK]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            if right is None and j == i:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            # each row to its first partner, each column to its first: then what a row's partners share, until nothing changes
            rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            label = np.full(len(y), len(x) + len(y))
            label[columns] = columns
            while True:
                of_row = np.where(near, label[None, :], len(x) + len(y)).min(1)
                new = np.minimum(label, np.where(near, of_row[:, None], len(x) + len(y)).min(0))
                if (new == label).all():
                    break
                label = new
            for s, t in ((xs[rows], of_row[rows]), (ys[columns], label[columns])):
                for u, v in zip(s.tolist(), ys[t].tolist(), strict=True):
                    u, v = find(u), find(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
    return [(int(nodes[x]), int(nodes[root])) for x in range(len(nodes)) if (root := find(x)) != x]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row ``key, fingerprint, component_id`` for each row: linked if at most ``radius`` bits differ.

    Null and empty texts have fingerprint zero and link like any other. Equal texts
    and repeated rows have equal fingerprints, of which one is compared. A null key
    stays null and never names a component unless all its keys are null; keys may be of any type that has an order. Other columns of
    ``docs`` are left out, whatever their names, and an empty table gives an empty one. The copies of a text
    never meet in a task: minima are taken before the shuffle.
    """
    named = _named(docs, key, text, radius, words)
    return named.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(docs: DataFrame, key: str, text: str, radius: int, words: int) -> DataFrame:
    """``key, h, fp, component_id`` for each row."""
    made = written(fingerprints(docs, key, text, words), "fingerprints")
    distinct = written(made.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    counted = F.bit_count(F.shiftrightunsigned("fp", 32)) * 33 + F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    tiles = np.zeros(33 * 33, np.int64)
    for cell, n in distinct.groupBy(counted.alias("cell")).count().collect():  # 1,089 rows at most
        tiles[cell] = -(-n // TILE_ROWS)
    shared = tiles.reshape(33, 33)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tile_pairs(batches, shared, radius)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        alone = pdf["one"].iloc[0] == pdf["two"].iloc[0]
        left, right = fps[side == 0], None if alone else fps[side == 1]
        found = forest(left, right, radius) if len(left) and (alone or len(right)) else []
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    pairs = distinct.select("fp").mapInArrow(dealt, "one long, two long, side int, fp long")
    links = pairs.groupBy("one", "two").applyInPandas(compared, "a long, b long")
    joined = connected_components(links, "links")
    member = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return made.join(named, "fp").select("key", "h", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``docs`` with the row of the smallest key of each component; rows that repeat key and text stay once, rows without a key stay. All columns stay, whatever their names; an empty table stays empty."""
    key_name, hash_name, text_name = (own_name(docs, x) for x in ("key__", "h__", "text__"))
    named = _named(docs, key, text, radius, words).where("key = component_id")
    # of texts of one component under its key the one with the smallest hash
    kept = named.groupBy(F.col("key").alias(key_name), "component_id").agg(F.min("h").alias(hash_name)).select(key_name, hash_name)
    hashed = docs.where(F.col(key).isNotNull()).withColumn(text_name, F.xxhash64(text))
    stay = hashed.join(kept, (F.col(key) == F.col(key_name)) & (F.col(text_name) == F.col(hash_name)), "left_semi").dropDuplicates([key, text_name]).drop(text_name)
    return stay.unionByName(docs.where(F.col(key).isNull()))

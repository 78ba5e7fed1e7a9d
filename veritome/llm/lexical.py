"""Operator 13: ranked lexical search by best-first branch and bound in hierarchical max trees.

Each chunk of documents is a table row that holds what the chunk's documents have of the queries' terms. Its documents lie
in ranges of LEAF, FAN ranges in a wider one, and so on: for each term a tree of the greatest contribution in a range. The
sum over a query's terms bounds every score in a range. Ranges are opened by descending bound, until what is left lies
below the query's last place; ranges that equal it are opened, as a tie may go to a smaller key. A task carries the places
from chunk to chunk, so most later chunks are left at their root.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from veritome.llm import decontaminate
from veritome.llm.tables import Scratch, first_rows, written
from veritome.llm.words import byte_classes, chunks, lower_bytes, words

#: Rows for each query; documents in a leaf, nodes in a wider range; documents and bytes of text in a chunk at most, or one longer text.
ROWS, LEAF, FAN, CHUNK_ROWS, CHUNK = 10, 32, 8, 8192, 8 << 20
#: Terms of queries, each counted once a query, that a pass over the documents takes, and that a chunk's trees hold at once.
PASS_TERMS, TREE_TERMS = 1_000_000, 20_000
#: Fixed values of the contract: bytes that make no term.
APART = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def _array(x: np.ndarray) -> bytes:
    """Values behind a byte that tells their size."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + x.tobytes()


def _values(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], f"<u{x[0]}").astype(np.int64)


def _index(base: DataFrame, terms: list[str]) -> DataFrame:
    """A row for each chunk: ``keys, n, first, term, tf`` of documents that hold any of ``terms``, shortest first, and the chunk's counts ``docs, words, df``."""
    held = base.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    kind = base.schema["key"].dataType

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for chunk in chunks(batches, "text", CHUNK, CHUNK_ROWS):
            found = words(chunk.column("text"), byte_classes(APART), lower_bytes())
            known = np.array([number.get(t, -1) for t in found.dictionary.to_pylist()], np.int64)
            size = np.diff(found.starts)
            order = np.argsort(size, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            term = known[found.ids] if len(found.ids) else np.zeros(0, np.int64)
            pair, tf = np.unique((place[found.text] * len(number) + term)[term >= 0], return_counts=True)
            doc, term = pair // max(1, len(number)), pair % max(1, len(number))
            kept, first = np.unique(doc, return_index=True)
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), chunk.column("key").take(pa.array(order[kept]))),
                *(pa.array([_array(x)], pa.binary()) for x in (size[order[kept]], first, term, tf)),
                *(pa.array([int(x)], pa.int64()) for x in (np.count_nonzero(size), size.sum())),
                pa.array([_array(np.bincount(term, minlength=len(number)))], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["keys", "n", "first", "term", "tf", "docs", "words", "df"])

    packed = [StructField(c, BinaryType()) for c in ("n", "first", "term", "tf")]
    return base.mapInArrow(index, StructType([StructField("keys", ArrayType(kind)), *packed, StructField("docs", LongType()), StructField("words", LongType()), StructField("df", BinaryType())]))


def _document_counts(indexed: DataFrame, n: int) -> np.ndarray:
    """How many documents hold each of ``n`` terms."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += _values(x.as_py())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    total = np.zeros(n, np.int64)
    for row in indexed.select("df").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # PASS_TERMS rows at most
        total[row["term"]] = row["df"]
    return total


class Trees:
    """The max trees of a chunk for some terms, with its documents' contributions. Leaves come first in ``levels``."""

    def __init__(self, n: np.ndarray, first: np.ndarray, term: np.ndarray, worth: np.ndarray) -> None:
        docs = len(n)
        self.first, self.worth = np.append(first, len(term)), worth
        self.local, self.term = np.unique(term, return_inverse=True)
        leaves = -(-docs // LEAF)
        cell = self.term * leaves + np.repeat(np.arange(docs), np.diff(self.first)) // LEAF
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0)) if len(cell) else np.zeros(0, np.int64)
        level = np.zeros(len(self.local) * leaves, np.int64)
        if len(starts):
            level[cell[order][starts]] = np.maximum.reduceat(worth[order], starts)
        self.levels = [level.reshape(len(self.local), leaves)]
        while self.levels[-1].shape[1] > FAN:
            below = self.levels[-1]
            wide = np.zeros((len(below), -(-below.shape[1] // FAN) * FAN), np.int64)
            wide[:, : below.shape[1]] = below
            self.levels.append(wide.reshape(len(below), -1, FAN).max(axis=2))

    def search(self, terms: np.ndarray, keys: list, best: list, rows: int) -> None:
        """Puts into ``best``, sorted by descending score and then key, what belongs there of this chunk."""
        at = np.searchsorted(self.local, terms)
        at = at[(at < len(self.local))]
        at = at[np.isin(self.local[at], terms)]
        if not len(at):
            return
        asked = np.zeros(len(self.local), np.int64)
        asked[at] = 1
        top = len(self.levels) - 1
        heap = [(-int(b), top, i) for i, b in enumerate(self.levels[top][at].sum(axis=0)) if b > 0]
        heapq.heapify(heap)
        while heap:
            bound, level, node = heapq.heappop(heap)
            last = best[-1][0] if len(best) == rows else 0
            if bound > last:  # both are negative: nothing left can reach the last place, even by its key
                return
            if level:
                low = node * FAN
                for i, b in enumerate(self.levels[level - 1][at, low : low + FAN].sum(axis=0), low):
                    if 0 < b and -b <= last:
                        heapq.heappush(heap, (-int(b), level - 1, i))
                continue
            low, high = node * LEAF, min((node + 1) * LEAF, len(self.first) - 1)
            a, z = self.first[low], self.first[high]
            scores = np.add.reduceat(self.worth[a:z] * asked[self.term[a:z]], self.first[low:high] - a)
            for i in np.flatnonzero((scores > 0) & (-scores <= last)).tolist():
                key = keys[low + i]
                insort(best, (-int(scores[i]), key is None, 0 if key is None else key))
                if len(best) > rows:
                    best.pop()


def _groups(queries: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of queries with at most TREE_TERMS terms together, or one query."""
    start, held = 0, 0
    for i, q in enumerate(queries):
        if held and held + len(q) > TREE_TERMS:
            yield start, i, np.unique(np.concatenate(queries[start:i]))
            start, held = i, 0
        held += len(q)
    if queries:
        yield start, len(queries), np.unique(np.concatenate(queries[start:]))


def _searched(indexed: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_words: int, rows: int) -> DataFrame:
    """``query, key, score``: of each task the first ``rows`` documents for each query."""
    known = indexed.sparkSession.sparkContext.broadcast((queries, weights))
    kind = indexed.schema["keys"].dataType.elementType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = known.value
        groups, best, key_type = list(_groups(queries)), [[] for _ in queries], None
        for batch in batches:
            key_type = batch.column("keys").type.value_type
            for row in range(batch.num_rows):
                n, first, term, tf = (_values(batch.column(c)[row].as_py()) for c in ("n", "first", "term", "tf"))
                if not len(n):
                    continue
                keys = batch.column("keys")[row].as_py()
                m = np.repeat(10 + 90 * n * n_docs // n_words, np.diff(np.append(first, len(term))))
                worth = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                for start, end, terms in groups:
                    chosen = np.isin(term, terms)
                    before = np.append(0, np.cumsum(chosen))
                    starts = before[first]
                    full = np.diff(np.append(starts, before[-1])) > 0  # documents that hold any of these terms
                    trees = Trees(n[full], starts[full], term[chosen], worth[chosen])
                    held = [k for k, yes in zip(keys, full.tolist(), strict=True) if yes]
                    for q in range(start, end):
                        trees.search(queries[q], held, best[q], rows)
        found = [(q, None if none else key, -score) for q, places in enumerate(best) for score, none, key in places]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], key_type), pa.array([f[2] for f in found], pa.int64())], names=["query", "key", "score"])

    return indexed.select("keys", "n", "first", "term", "tf").mapInArrow(search, StructType([StructField("query", LongType()), StructField("key", kind), StructField("score", LongType())]))


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rows: int = ROWS, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``item_key, rank, key, score``: each item's ``rows`` documents of highest score above 0, equal scores by ascending key, null keys last.

    Null and empty texts have no terms. Item rows of one key are one item with the terms of all of them; a null key is a key. Each
    document row counts, also where keys or whole rows repeat. Other columns are left out. Empty tables give no rows. Items
    are taken by passes of about ``pass_terms`` terms, so what is broadcast is bounded and each pass covers all documents.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_key).alias("item"), F.explode(decontaminate.words(F.col(item_text))).alias("term")).distinct()
    passes = max(1, -(-asked.count() // pass_terms))
    found = []
    with Scratch() as scratch:
        asked = scratch.written(asked.withColumn("pass", F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(passes))), "queries")
        for i in range(passes):
            held: dict = {}
            for row in asked.where(F.col("pass") == i).select("item", "term").toLocalIterator():
                held.setdefault(row["item"], []).append(row["term"])
            number = {t: n for n, t in enumerate(sorted({t for q in held.values() for t in q}))}
            indexed = scratch.written(_index(base, list(number)), "chunks")
            n_docs, n_words = indexed.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in _document_counts(indexed, len(number)).tolist()], np.int64)
            queries = [np.array(sorted(number[t] for t in q), np.int64) for q in held.values()]
            names = spark.createDataFrame(list(enumerate(held)), StructType([StructField("query", LongType()), StructField("item", items.schema[item_key].dataType)]))
            places = _searched(indexed, queries, weights, n_docs, max(1, n_words), rows)
            best = first_rows(places, ["query"], [F.col("score").desc(), F.col("key").asc_nulls_last()], rows, "key")
            found.append(scratch.written(best.join(F.broadcast(names), "query").select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"), "places"))
        return written(reduce(DataFrame.unionByName, found), "ranked")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), totals AS (
  SELECT count(*) AS n_docs, cast(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY row, doc_id, n, term
), weights AS (
  SELECT term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, n_docs
), worth AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))) AS c FROM tf JOIN weights USING (term), totals
), scores AS (
  SELECT item_id, row, doc_id, cast(sum(c) AS BIGINT) AS score FROM q JOIN worth USING (term) GROUP BY item_id, row, doc_id HAVING sum(c) > 0
)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores QUALIFY rank <= 10"""

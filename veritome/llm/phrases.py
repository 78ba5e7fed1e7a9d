"""Operator 11: phrase collocation mining by merged count-min sketches and an exact second pass.

First pass: each chunk of text counts its phrases of one to five words in a count-min sketch, whose touched cells are
sent, packed, to the blocks of the sketch and summed there. A cell only ever counts too much, so the cells that reach the
threshold, as a bitmap, hold every frequent phrase. Second pass: phrases all of whose parts and cells pass are counted
exactly, in each chunk and then by key. What the sketch let through by mistake falls at the threshold there. Then
candidates are scored by their weakest cut, subsumed by longer ones, and ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.tables import Scratch, first_rows, written
from veritome.llm.words import Words, byte_classes, chunks, lower_bytes, mixed, words

#: Words in a phrase at most; the least frequency; rows for each language; percentage of a phrase's count at which a longer one subsumes it.
LONGEST, LEAST, ROWS, SUBSUME = 5, 100, 2_000, 100
#: Rows of the sketch; cells of a row at least and at most, so the bitmap has 8 to 64 MB; cells of a block.
DEPTH, LEAST_CELLS, MOST_CELLS, BLOCK = 2, 1 << 25, 1 << 28, 1 << 18
#: Counted phrases that a task holds before it sends them; bytes of text for which there is a bucket of phrases.
HELD, BUCKET_BYTES = 1_000_000, 16 << 20
#: Share of the threshold that a cell holds of rare phrases on average while the sketch may still grow, and phrases to a byte of text at most.
LOAD, DENSITY = 0.2, 0.65
#: Bytes of text whose phrases are counted together before they are sent; a longer text is a chunk of its own.
CHUNK = 3 << 20
UNKNOWN = "und"
#: Fixed values of the contract: bytes between words, and bytes that end a piece as well.
GAPS, BREAKS = (0x20, 0x09), (*b".,;:!?", *range(0x0A, 0x0E))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashed(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(values.to_pylist(), object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def _longer(found: Words, hashes: np.ndarray, at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases of k - 1 words at the places ``at``, those that go on by a word in their piece: which, their places, their hashes."""
    kept = np.flatnonzero(at + k - 1 < len(found.ids))
    kept = kept[found.piece[at[kept] + k - 1] == found.piece[at[kept]]]
    at = at[kept]
    return kept, at, mixed(h[kept] * _FACTOR + hashes[found.ids[at + k - 1]])


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    """A row of cells for each row of the sketch, numbered through all rows."""
    rows = [(mixed(h + np.uint64(d)) >> np.uint64(64 - bits)).astype(np.uint32) + np.uint32(d << bits) for d in range(DEPTH)]
    return np.stack(rows)


def _smallest(x: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds all values."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _packed(x: np.ndarray) -> bytes:
    x = _smallest(x)
    return bytes([x.itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), f"<u{x[0]}")


def _read(chunk: pa.RecordBatch) -> tuple[Words, np.ndarray, list[str], np.ndarray]:
    """Words, hashes of the dictionary, languages, and for each word the number of its language."""
    found = words(chunk.column("text"), byte_classes(GAPS, BREAKS), lower_bytes())
    langs = pc.fill_null(chunk.column("lang").cast(pa.string()), UNKNOWN).dictionary_encode()
    return found, _hashed(found.dictionary), langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64)[found.text]


def _start(hashes: np.ndarray, found: Words, langs: list[str], lang: np.ndarray) -> np.ndarray:
    return mixed(hashes[found.ids] ^ mixed(_hashed(pa.array(langs, pa.string())))[lang])


def sketch(docs: DataFrame, bits: int, longest: int, least: int) -> DataFrame:
    """``block, passed``: for each block of cells that anything fell into, a bitmap of those that reach ``least``."""
    block = min(BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            found, hashes, langs, lang = _read(chunk)
            at, h = np.arange(len(found.ids)), _start(hashes, found, langs, lang)
            touched = [_cells(h, bits).ravel()]
            for k in range(2, longest + 1):
                _, at, h = _longer(found, hashes, at, h, k)
                touched.append(_cells(h, bits).ravel())
            cells = np.concatenate(touched)
            touched.clear()
            cells.sort()
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])).astype(np.uint32) if len(cells) else np.zeros(0, np.uint32)
            n, cells = np.diff(first, append=np.uint32(len(cells))), cells[first]
            cuts = np.flatnonzero(np.diff(cells // np.uint32(block))) + 1
            parts = [(int(c[0]) // block, _packed(np.diff(c, prepend=np.uint32(int(c[0]) // block * block))), _packed(m)) for c, m in zip(np.split(cells, cuts), np.split(n, cuts), strict=True) if len(c)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["block", "cells", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(block, np.int64)

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "passed"])

        for batch in batches:
            for b, cells, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != now:
                    if now is not None:
                        yield passed()
                    now = b
                    total[:] = 0
                total[np.cumsum(_unpacked(cells), dtype=np.int64)] += _unpacked(n)
        if now is not None:
            yield passed()

    sent = docs.mapInArrow(count, "block int, cells binary, n binary")
    parts = max(1, min(DEPTH * (1 << bits) // block, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return sent.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(merge, "block int, passed binary")


def _bits(size: int, least: int, most: int) -> int:
    """Binary logarithm of the cells in a row, for so many bytes of text."""
    cells = min(most, max(LEAST_CELLS, size * DENSITY / (LOAD * least)))
    return int(np.ceil(np.log2(cells)))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, most_cells: int = MOST_CELLS) -> DataFrame:
    """``lang, phrase, m, a``: every phrase of up to ``longest`` words with its number of words and occurrences, at least ``least``; and, as the empty phrase of no words, the number of all words of the language.

    The sketch grows with the bytes of text, up to ``most_cells`` cells a row. Beyond, more phrases than needed are counted
    in the second pass; the result is the same with any sketch.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = _bits(size, least, most_cells)
    block = min(BLOCK, 1 << bits)
    whole = np.zeros((DEPTH << bits) // 8, np.uint8)
    for row in sketch(base, bits, longest, least).toLocalIterator():  # a bitmap of 64 MB at most
        whole[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["passed"], np.uint8)
    passed = spark.sparkContext.broadcast(whole)

    buckets = max(32, size // BUCKET_BYTES)

    def passes(h: np.ndarray) -> np.ndarray:
        good = np.ones(len(h), bool)
        for cells in _cells(h, bits):
            good &= (passed.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return good

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for chunk in chunks(batches, "text", CHUNK):
            held += _survivors(chunk, longest, passes)
            if sum(map(len, held)) > HELD:
                held = [_summed(held)]
                if len(held[0]) > HELD // 2:
                    yield _dealt(held.pop(), buckets)
        if held:
            yield _dealt(_summed(held), buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            whole = _summed(held)
            yield from whole.filter(pc.or_(pc.equal(whole.column("m"), 0), pc.greater_equal(whole.column("a"), least))).to_batches()

        for batch in batches:
            for i, b in enumerate(batch.column("bucket").to_pylist()):
                if b != now and held:
                    yield from done()
                    held = []
                now = b
                held.append(pa.table({c: batch.column(c)[i].values for c in COUNTED}))
                if sum(map(len, held)) > HELD:
                    held = [_summed(held)]
        if held:
            yield from done()

    sent = base.mapInArrow(count, "bucket int, lang array<string>, phrase array<string>, m array<int>, a array<long>")
    parts = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "lang string, phrase string, m int, a long")


def _survivors(chunk: pa.RecordBatch, longest: int, passes: Callable[[np.ndarray], np.ndarray]) -> list[pa.Table]:
    """Exact counts in a chunk of the phrases that the sketch lets pass, and of all words by language."""
    found, hashes, langs, lang = _read(chunk)
    if not len(found.ids):
        return []
    spoken = np.bincount(lang, minlength=len(langs))
    counted = [_counted(langs, np.flatnonzero(spoken), pa.array([""] * np.count_nonzero(spoken), pa.string()), 0, spoken[spoken > 0])]
    at, h = np.arange(len(found.ids)), _start(hashes, found, langs, lang)
    group, short = lang, None  # numbers of the phrases without their last word; where the phrases one shorter passed
    for k in range(1, longest + 1):
        if k > 1:
            kept, at, h = _longer(found, hashes, at, h, k)
            group = group[kept]
        good = passes(h)
        if short is not None:  # a phrase is no more frequent than its parts; its beginning has passed already
            good &= short[at + 1]
        at, h, group = at[good], h[good], group[good]
        if not len(at):
            break
        # numbered anew each time, by what they are and not by their hashes
        _, first, group, n = np.unique(group * len(found.dictionary) + found.ids[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
        place = at[first]
        said = [found.dictionary.take(pa.array(found.ids[place + i])) for i in range(k)]
        counted.append(_counted(langs, lang[place], pc.binary_join_element_wise(*said, pa.scalar(" ", pa.large_string())).cast(pa.string()), k, n))
        short = np.zeros(len(found.ids) + 1, bool)
        short[at] = True
    return counted


COUNTED = ("lang", "phrase", "m", "a")


def _counted(langs: list[str], lang: np.ndarray, phrase: pa.Array, m: int, n: np.ndarray) -> pa.Table:
    return pa.table([pa.array(langs, pa.string()).take(pa.array(lang)), phrase, pa.array(np.full(len(n), m), pa.int32()), pa.array(n, pa.int64())], names=COUNTED)


def _summed(held: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(held).group_by(list(COUNTED[:3]), use_threads=False).aggregate([("a", "sum")])
    return whole.rename_columns([*COUNTED[:3], "a"]).combine_chunks()


def _dealt(whole: pa.Table, buckets: int) -> pa.RecordBatch:
    """A row for each bucket, by the hash of the phrase, with all its phrases in order."""
    bucket = (_hashed(whole.column("phrase")) % np.uint64(buckets)).astype(np.int32)
    order = pc.sort_indices(whole.append_column("bucket", pa.array(bucket)), [("bucket", "ascending"), ("phrase", "ascending")])
    whole, bucket = whole.take(order).combine_chunks(), bucket[order.to_numpy()]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(bucket)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, whole.column(c).chunk(0) if whole.num_rows else pa.array([], whole.schema.field(c).type)) for c in COUNTED]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), *lists], names=["bucket", *COUNTED])


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, rows: int = ROWS, subsume: int = SUBSUME, most_cells: int = MOST_CELLS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``rows`` phrases by the contract's score.

    Null texts have no words, a null language is ``und``. Repeated rows count each; other columns are left out. Products
    are decimals of 38 digits, exact for up to 10^19 words of a language and 10^12 of a phrase. Tables without frequent phrases give no rows.
    """
    with Scratch() as scratch:
        counted = scratch.written(frequent(docs, text, lang, longest, least, most_cells), "phrases")
        known = counted.where("m > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("c"))
        totals = counted.where("m = 0").select("lang", F.col("a").alias("n"))
        candidates = counted.where("m > 1").withColumn("w", F.split("phrase", " "))
        cut = candidates.select("lang", "phrase", "m", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
        cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("before"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m")), " ").alias("after"))
        cut = cut.join(known.select("lang", F.col("part").alias("before"), F.col("c").alias("l")), ["lang", "before"])
        cut = cut.join(known.select("lang", F.col("part").alias("after"), F.col("c").alias("r")), ["lang", "after"]).join(totals, "lang")
        ratio = (_whole(F.col("a")) * _whole(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
        cut = cut.withColumn("x", ratio).withColumn("y", (_whole(F.col("l")) * _whole(F.col("r"))).cast("decimal(38,0)")).withColumn("score", F.expr("x div y"))
        weakest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda z: F.transform(F.sequence(F.lit(1), F.col("m") - z + 1), lambda i: F.array_join(F.slice("w", i, z), " "))))
        longer = candidates.where("m > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        left = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsume * F.col("a")))
        scored = left.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
        ranked = first_rows(scored, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], rows, "phrase")
        return written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")


def _oracle_sql(longest: int = LONGEST, least: int = LEAST, rows: int = ROWS) -> str:
    grams = " UNION ALL ".join(f"SELECT lang, list_slice(w, i, i + {m} - 1) AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {m} + 2)) AS i FROM p)" for m in range(1, longest + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, g, a, cast({k} AS BIGINT) AS k, list_slice(g, 1, {k}) AS b, list_slice(g, {k} + 1, len(g)) AS c FROM f WHERE len(g) > {k}" for k in range(1, longest))
    inner = " UNION ALL ".join(f"SELECT lang, list_slice(g, i, i + {m} - 1) AS g, a FROM (SELECT lang, g, a, unnest(range(1, len(g) - {m} + 2)) AS i FROM f WHERE len(g) > {m})" for m in range(2, longest))
    return rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t
), n AS (
  SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
), f AS MATERIALIZED (
  SELECT lang, g, count(*) AS a FROM ({grams}) GROUP BY lang, g HAVING count(*) >= {least}
), cuts AS ({cuts}
), scored AS (
  SELECT cuts.lang, cuts.g, cuts.a, k, l.a AS l, r.a AS r, n, (cast(1000 AS HUGEINT) * cuts.a * n) // (cast(l.a AS HUGEINT) * r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = b JOIN f r ON r.lang = cuts.lang AND r.g = c JOIN n ON n.lang = cuts.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
  SELECT lang, g, max(a) AS most FROM ({inner}) GROUP BY lang, g
), kept AS (
  SELECT w.lang, array_to_string(w.g, ' ') AS phrase, w.a, l, r, n, score FROM weakest w LEFT JOIN longer USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, cast(score AS BIGINT) AS score
FROM kept QUALIFY rank <= {rows}"""


ORACLE_SQL = _oracle_sql()

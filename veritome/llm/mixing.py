"""Operator 12: mixing sources to target weights in blocks of words.

The words of a source, document after document in an order by hash, are packed into blocks of a fixed length; the last may
be shorter. A source's target gives its number of slots. Output shards draw multinomial numbers of slots for each source,
in parallel and by a seed of their own; what a source is drawn beyond its slots goes to those drawn too little, so the
targets are met to the word. A slot's place in its source leads through a pseudorandom permutation of the block numbers,
another one for each time that all blocks are taken, to the block, which is joined by its number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritome.llm.tables import Scratch, written
from veritome.llm.words import mixed

#: Words in a block; slots in an output shard; documents of a bucket within which words are summed up in order.
BLOCK, SHARD, BUCKET = 1024, 4096, 20_000
#: Weights of the sources in order, repeating; how often a source is taken at most.
WEIGHTS, MOST = (1, 2, 3), 3
#: The table of sources is read by the driver and every task, so there may be so many; more are an error.
SOURCES = 1_000_000
SEED = 12
_APART = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _APART), "")


def targets(sizes: Sequence[int], weights: Sequence[float], most: int = MOST) -> list[float]:
    """Each source's share of the sum of all sizes by weight, but ``most`` times its size at most; what that leaves over is shared by weight again."""
    total, full = sum(sizes), set()
    while True:
        rest, weight = total - most * sum(sizes[i] for i in full), sum(w for i, w in enumerate(weights) if i not in full)
        share = [most * float(sizes[i]) if i in full else rest * w / weight for i, w in enumerate(weights)]
        above = {i for i, t in enumerate(share) if i not in full and t > most * sizes[i]}
        if not above:
            return share
        full |= above


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) under ``key`` takes ``x``: four Feistel rounds on the least even number of bits that holds n, repeated until the result is below n."""
    half = (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)
    half += (np.uint64(1) << (np.uint64(2) * half)) < n.astype(np.uint64)  # log2 is rounded
    mask, out = (np.uint64(1) << half) - np.uint64(1), x.astype(np.uint64)
    left = np.arange(len(x))
    while len(left):
        y, h, m, k = out[left], half[left], mask[left], key[left]
        a, b = y >> h, y & m
        for r in range(4):
            a, b = b, a ^ (mixed(b + mixed(k + np.uint64(r))) & m)
        out[left] = (a << h) | b
        left = left[out[left] >= n[left].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Plan:
    """Of each source by number: name, words, target, and how its slots lead to blocks."""

    names: list
    sizes: np.ndarray
    targets: list[float]
    block: int
    seed: int

    def __post_init__(self) -> None:
        #: Whole blocks, all blocks, words to take, times that all is taken, words of the last, partial time, and slots.
        self.whole, self.blocks = self.sizes // self.block, -(-self.sizes // self.block)
        self.quota = np.array([min(round(t), MOST * int(s)) for t, s in zip(self.targets, self.sizes, strict=True)], np.int64)
        self.times = self.quota // np.maximum(1, self.sizes)
        self.rest = self.quota - self.times * self.sizes
        self.slots = self.times * self.blocks + -(-self.rest // self.block)

    def draw(self, shard: int, size: int) -> np.ndarray:
        """Slots of each source in an output shard of ``size`` slots."""
        return np.random.default_rng([self.seed, shard]).multinomial(size, self.slots / self.slots.sum())

    def settled(self, drawn: np.ndarray, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source and place of slots when ``drawn`` are all that each source was drawn: those beyond a source's slots go, in order, to what others lack."""
        beyond, lack = np.maximum(0, drawn - self.slots), np.maximum(0, self.slots - drawn)
        before, ends = np.cumsum(beyond) - beyond, np.cumsum(lack)
        over = np.flatnonzero(place >= self.slots[source])
        nth = before[source[over]] + place[over] - self.slots[source[over]]
        to = np.searchsorted(ends, nth, side="right")
        source, place = source.copy(), place.copy()
        source[over], place[over] = to, drawn[to] + nth - (ends[to] - lack[to])
        return source, place

    def found(self, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Time, block and words of each slot."""
        time, at = place // self.blocks[source], place % self.blocks[source]
        block, full = at.copy(), at < self.whole[source]  # the short block, if any, is a time's last
        key = mixed(mixed(source[full].astype(np.uint64) + np.uint64(self.seed)) + time[full].astype(np.uint64))
        block[full] = permuted(at[full], self.whole[source[full]], key)
        words = np.minimum(self.block, self.sizes[source] - block * self.block)
        last = (self.rest[source] > 0) & (place == self.slots[source] - 1)
        words[last] = (self.rest[source] - at * self.block)[last]
        return time, block, words


def _packed(docs: DataFrame, scratch: Scratch, key: str, text: str, source: str, with_text: bool) -> DataFrame:
    """``key, source, size, start`` (and ``text``) of each row; starts are places in the source's words."""
    base = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    base = base.select("key", "source", F.size(word_list(F.col("text"))).cast("long").alias("size"), F.xxhash64("key", "text").alias("h"), *(["text"] if with_text else []))
    base = scratch.written(base, "sizes")
    buckets = max(1, -(-base.count() // BUCKET))
    base = base.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = sums.withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = base.withColumn("sum", F.sum("size").over(within))
    b = before.select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), "before")
    return ordered.join(b, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_"))).select("key", "source", "size", (F.col("before") + F.col("sum") - F.col("size")).alias("start"), *(["text"] if with_text else []))


def _planned(packed: DataFrame, block: int, seed: int) -> Plan:
    held = packed.groupBy("source").agg(F.sum("size").alias("words")).limit(SOURCES + 1).collect()
    if len(held) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    held = sorted(held, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in held]
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(held))]
    return Plan([r["source"] for r in held], np.array(sizes, np.int64), targets(sizes, weights) if held else [], block, seed)


def _slots(packed: DataFrame, plan: Plan, scratch: Scratch, shard: int) -> DataFrame:
    """``shard, number, time, block, words``: the mix slot by slot; ``number`` is the source's."""
    spark, total = packed.sparkSession, int(plan.slots.sum())
    shards = -(-total // shard)
    known = spark.sparkContext.broadcast(plan)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                n = known.value.draw(i, min(shard, total - i * shard))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i), pa.int64()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["shard", "number", "n"])

    drawn = scratch.written(spark.range(shards).mapInArrow(draw, "shard long, number long, n long"), "draws")
    sums = np.zeros(len(plan.names), np.int64)
    for row in drawn.groupBy("number").agg(F.sum("n").alias("n")).collect():  # a row for each source
        sums[row["number"]] = row["n"]
    known_sums = spark.sparkContext.broadcast(sums)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shard_, number, before, n = (batch.column(i).to_numpy() for i in range(4))
            for rows in np.array_split(np.arange(len(n)), max(1, int(n.sum()) // 1_000_000)):
                every = np.repeat(rows, n[rows])
                place = before[every] + np.arange(len(every)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
                source, place = known.value.settled(known_sums.value, number[every], place)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard_[every], source, *known.value.found(source, place))], names=["shard", "number", "time", "block", "words"])

    placed = drawn.withColumn("before", F.sum("n").over(Window.partitionBy("number").orderBy("shard")) - F.col("n"))
    return placed.select("shard", "number", "before", "n").mapInArrow(lead, "shard long, number long, time long, block long, words long")


def _sources(packed: DataFrame, plan: Plan) -> DataFrame:
    rows = [(n, i, int(s), float(t)) for i, (n, s, t) in enumerate(zip(plan.names, plan.sizes, plan.targets, strict=True))]
    return packed.sparkSession.createDataFrame(rows, "name string, number long, source_size long, target double")


def _numbered(packed: DataFrame, plan: Plan, block: int) -> DataFrame:
    """``packed`` with its source's row, and a row for each block that a document's words reach into; documents without words have none."""
    found = packed.join(F.broadcast(_sources(packed, plan)), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    return found.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``key, size, source_size, target, taken, source`` for each row of ``docs``.

    Null and empty texts have no words and nothing is taken of them; null sources are one source, the last; null and repeated
    keys are rows as any. The same rows in any order give the same result. Without words all targets are 0. Other columns
    are left out. A source's taken words are its target, rounded.
    """
    with Scratch() as scratch:
        packed = scratch.written(_packed(docs, scratch, key, text, source, False), "packed")
        plan = _planned(packed, block, seed)
        length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
        # by its length a slot takes the block whole, or, one slot of a source, its beginning
        slots = _slots(packed, plan, scratch, shard).groupBy("number", "block", "words").agg(F.count("*").alias("n")).groupBy("number", "block").agg(F.collect_list(F.struct("words", "n")).alias("lengths"))
        low = F.col("start") - F.col("block") * block
        inside = lambda to: F.greatest(F.lit(0), F.least(low + F.col("size"), to) - F.greatest(low, F.lit(0)))
        some = F.aggregate(F.coalesce("lengths", F.array().cast("array<struct<words:bigint,n:bigint>>")), F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * inside(F.least(x["words"], length)))
        found = _numbered(packed, plan, block).join(slots.hint("merge"), ["number", "block"], "left").withColumn("some", some)
        # a document with words is known by its place; rows without have no place of their own
        held = found.where("size > 0").groupBy("number", "start").agg(*(F.first(c).alias(c) for c in ("key", "size", "source_size", "target", "source")), F.sum("some").alias("taken"))
        none = found.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        columns = [F.col("key").alias(key), "size", "source_size", "target", "taken", F.col("source").alias("source")]
        return written(held.select(*columns).unionByName(none.select(*columns)), "taken")


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix itself: ``shard, place, source, time, block, n_words, text``, a row for each slot; ``place`` is its order in the output shard.

    Words are joined by one space. Odd rows are as in ``taken``; without words there are no rows.
    """
    with Scratch() as scratch:
        packed = scratch.written(_packed(docs, scratch, key, text, source, True), "packed")
        plan = _planned(packed, block, seed)
        low = F.col("start") - F.col("block") * block
        piece = F.array_join(F.slice(word_list(F.col("text")), F.greatest(F.lit(1), 1 - low).cast("int"), F.lit(block) - F.greatest(low, F.lit(0)).cast("int")), " ")
        pieces = _numbered(packed, plan, block).where("size > 0").select("number", "block", low.alias("low"), piece.alias("piece"))
        blocks = pieces.groupBy("number", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "piece"))), lambda x: x["piece"]), " ").alias("whole"))
        slots = _slots(packed, plan, scratch, shard).withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("shard", "number", "time", "block"), "number", "time", "block")))
        joined = slots.join(blocks, ["number", "block"]).join(F.broadcast(_sources(packed, plan)), "number")
        cut = F.array_join(F.slice(F.split("whole", " "), F.lit(1), F.col("words").cast("int")), " ")
        return written(joined.select("shard", "place", F.col("name").alias("source"), "time", "block", F.col("words").alias("n_words"), cut.alias("text")), "mixture")

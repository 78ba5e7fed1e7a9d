"""Operator 8: removal of long repeated substrings by suffix arrays.

Every window of LENGTH bytes is anchored at the least hash of the short strings in it, so
equal windows have equal anchors wherever they stand. Windows in a row with one anchor are a
segment. Segments that occur twice are repeated throughout; those that share only
their anchor with others go, once each, into shards by anchor, where a suffix array
(induced sorting) and the permuted common prefixes find the windows that occur again. An anchor with more
different segments than a shard should hold is split: its windows are cut into blocks by their distance to the anchor, and
all that share what a block's windows have in common go into one shard, by that instead of the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.suffix import permuted_lcp, suffix_array
from veritome.llm.tables import Scratch, own_name, written

#: Bytes of a repeated string, and of the strings whose hashes anchor it.
LENGTH, ANCHOR = 200, 32
#: Bytes in a shard, about; different segments at an anchor, or at a block's common string, from which these are split.
SHARD_BYTES, MANY = 500_000, 2_000
#: Bytes of text that a task hashes at once.
CHUNK = 1 << 20
#: Windows in a block.
BLOCK = 8

_table = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_odd = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _odd[1]
    return x ^ (x >> np.uint64(29))


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each position: sums of random numbers for bytes, times odd ones for places, doubled in width and mixed at the end."""
    out, width, at, done = None, 1, 0, _table[data]
    while True:
        if length & width:
            part = done[at:] if at else done
            out = done if out is None else out[: len(part)] * _odd[0] + part
            at += width
        if at == length:
            return _mixed(out)
        done = done[:-width] * (_odd[2] + np.uint64(2 * width)) + done[width:]
        width *= 2


def _segments(data: np.ndarray, bounds: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie end to end, each segment's text number, anchor hash, own hash, start in the text, and bytes."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(data) < length:
        return none
    grams = _grams(data, anchor)
    bits = max(24, int(len(grams)).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the leftmost
    need, width = length - anchor + 1, 1
    while 2 * width <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = need - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    owner = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(owner)]
    fits = np.ones(len(owner), bool)
    for end in bounds[1:].tolist():  # the last windows of a text would reach into the next
        fits[max(0, end - length + 1) : end] = False
    new = np.empty(len(owner), bool)
    new[0] = True
    new[1:] = (owner[1:] != owner[:-1]) | ~fits[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & fits)
    if not len(first):
        return none
    edge = np.flatnonzero(new | ~fits)  # a run ends before the next of these
    after = np.append(edge, len(owner))[np.searchsorted(edge, first, "right")]
    count = after - first - 1 + length
    # hash of first .. first + count: differences of a running sum, brought to the same power
    power = np.cumprod(np.full(len(data) + 1, _odd[0], np.uint64))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table[data] * power[:-1], out=running[1:])
    back = np.uint64(pow(int(_odd[0]), -1, 1 << 64))
    inverse = np.cumprod(np.full(len(data) + 1, back, np.uint64))
    value = _mixed((running[first + count] - running[first]) * inverse[first] + count.astype(np.uint64))
    d = doc[first]
    return d, grams[owner[first]], value, first - bounds[d], count


def _anchored(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts, rows, size = [], [], 0
            for i, x in enumerate(batch.column(1)):
                text = (x.as_py() or "").encode("utf-8", "replace")
                if len(text) >= length:
                    texts.append(text)
                    rows.append(i)
                    size += len(text)
                if texts and (size >= CHUNK or i + 1 == batch.num_rows):
                    yield made(texts, ids[rows])
                    texts, rows, size = [], [], 0
            if texts:
                yield made(texts, ids[rows])

    def made(texts: list[bytes], ids: np.ndarray) -> pa.RecordBatch:
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        d, a, value, start, count = _segments(np.frombuffer(b"".join(texts), np.uint8), bounds, length, anchor)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(value.view(np.int64)), pa.array(count.astype(np.int32)), pa.array(ids[d]), pa.array(start.astype(np.int32))], names=["a", "v", "n", "id", "at"])

    return run


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some different strings, which of its windows stand in one of them again (or twice in it)."""
    size = sum(len(p) + 1 for p in parts)
    s, room, at = np.zeros(size + 1, np.uint8), np.zeros(size + 1, np.int32), []
    i = 0
    for p in parts:  # no byte of UTF-8 is over 0xF4
        at.append(i)
        s[i : i + len(p)] = np.frombuffer(p, np.uint8) + np.uint8(2)
        s[i + len(p)] = 1
        room[i : i + len(p)] = np.arange(len(p), 0, -1)
        i += len(p) + 1
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa, room)
    same = lcp[sa] >= length
    again = np.zeros(size + 1, bool)
    again[sa[same]] = True
    again[sa[:-1][same[1:]]] = True
    return [again[i : i + len(p) - length + 1] for i, p in zip(at, parts, strict=True)]


def _runs(marks: np.ndarray, length: int) -> list[dict]:
    """Byte spans that the marked windows cover."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return [{"b": int(b), "e": int(e) - 1 + length} for b, e in zip(edges[::2], edges[1::2], strict=True)]


_SPANS = "array<struct<b:int,e:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text, want`` (a, v, n, at) to a, v, n and the segment's bytes."""
    for batch in batches:
        rows = []
        for x, want in zip(batch.column(0), batch.column(1), strict=True):
            text = x.as_py().encode("utf-8", "replace")
            rows += [(w["a"], w["v"], w["n"], text[w["at"] : w["at"] + w["n"]]) for w in want.as_py()]
        if rows:
            a, v, n, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int32()), pa.array(b, pa.binary())], names=["a", "v", "n", "bytes"])


def _blocked(length: int, anchor: int):
    """A segment's windows in blocks of BLOCK by their distance to the anchor: what these windows cover, and hashes of that (union) and of what all windows of such a block hold (core)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, v, n, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(b, np.uint8)
                count = len(data) - length + 1
                # the anchor's leftmost place is its own: one further left would own these windows
                place = int(np.flatnonzero(_grams(data, anchor)[: len(data) - anchor + 1].view(np.int64) == a)[0])
                for j in range(place // BLOCK + 1):
                    first, last = max(0, place - BLOCK * j - BLOCK + 1), min(count - 1, place - BLOCK * j)
                    if first > last:
                        continue
                    core = bytes([j]) + a.to_bytes(8, "little", signed=True) + b[place - BLOCK * j : place - BLOCK * j - BLOCK + 1 + length]
                    union = b[first : last + length]
                    rows.append((a, v, n, first, last - first + 1, hashlib.blake2b(core, digest_size=16).digest(), hashlib.blake2b(union, digest_size=16).digest(), union))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["a", "v", "n", "first", "m", "core", "union", "bytes"])

    return run


def _windows(length: int):
    """Two hashes of each window of a block's string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, v, n, first, c, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                data = np.frombuffer(b, np.uint8)
                count = len(data) - length + 1
                one, two = _grams(data, length)[:count].view(np.int64).tolist(), _grams(255 - data, length)[:count].view(np.int64).tolist()
                rows += [(a, v, n, c, first + i, one[i], two[i]) for i in range(count)]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["a", "v", "n", "c", "at", "one", "two"])

    return run


def _by_blocks(hot: DataFrame, length: int, anchor: int, scratch: Scratch) -> list[DataFrame]:
    """Spans of segments at anchors with very many of them.

    Equal windows lie in blocks with equal cores. A core that stands once is done, a
    block whose union stands twice is repeated throughout, and the different unions of a core are sorted in
    a shard with those of other cores. A core holds all but seven bytes of its windows; only where even it has more
    unions than a shard should hold are their windows, by hashes, counted.
    """
    blocks = scratch.written(hot.mapInArrow(_blocked(length, anchor), "a long, v long, n int, first int, m int, core binary, union binary, bytes binary"), "blocks")
    kinds = scratch.written(blocks.groupBy("core", "union").agg(F.count("*").alias("c"), F.min(F.struct("a", "v", "n", "first", "bytes")).alias("one")), "unions")
    settled = blocks.join(kinds.where("c > 1").select("union").distinct(), "union", "left_semi").select("a", "v", "n", F.struct(F.col("first").alias("b"), (F.col("first") + F.col("m") - 1 + length).alias("e")).alias("s"))
    by_block = settled.groupBy("a", "v", "n").agg(F.collect_set("s").alias("spans"))
    cores = kinds.groupBy("core").agg(F.count("*").alias("unions")).where("unions > 1")
    each = scratch.written(kinds.join(cores, "core").select("core", "unions", "c", "one.*"), "each")
    few = each.where(F.col("unions") <= MANY)
    size = few.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]

    def sorted_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = repeated_windows(pdf["bytes"].tolist(), length)
        hit = [bool(m.any()) and c == 1 for m, c in zip(marks, pdf["c"], strict=True)]
        out = pdf.loc[hit, ["a", "v", "n"]].copy()
        out["spans"] = [[{"b": x["b"] + f, "e": x["e"] + f} for x in _runs(m, length)] for m, f, h in zip(marks, pdf["first"].tolist(), hit, strict=True) if h]
        return out

    shard = F.pmod(F.xxhash64("core"), F.lit(max(1, -(-size // SHARD_BYTES))))
    by_sort = few.withColumn("shard", shard).groupBy("shard").applyInPandas(sorted_shard, f"a long, v long, n int, spans {_SPANS}")
    counted = scratch.written(each.where(F.col("unions") > MANY).select("a", "v", "n", "first", "c", "bytes").mapInArrow(_windows(length), "a long, v long, n int, c long, at int, one long, two long"), "windows")
    again = counted.groupBy("one", "two").agg(F.sum("c").alias("t")).where("t > 1").select("one", "two")
    by_window = counted.where("c = 1").join(again, ["one", "two"], "left_semi").groupBy("a", "v", "n").agg(F.collect_set(F.struct(F.col("at").alias("b"), (F.col("at") + length).alias("e"))).alias("spans"))
    return [by_block, by_sort, by_window]


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``id, spans``: byte spans of each text with repeated strings, some of which may overlap. ``docs`` has an ``id`` for each text."""
    base = docs.select("id", F.col(text).cast("string").alias("text"))
    with Scratch() as scratch:
        with Scratch() as first:
            places = scratch.written(_places(base, length, anchor, first), "places")
        kinds = places.groupBy("a", "v", "n").agg(F.count("*").alias("c"), F.min(F.struct("id", "at")).alias("one"))
        each = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("single"))
        kinds = scratch.written(kinds.join(each, "a"), "kinds")
        whole = kinds.where("c > 1").select("a", "v", "n", F.array(F.struct(F.lit(0).alias("b"), F.col("n").alias("e"))).alias("spans"))
        want = kinds.where("single > 0 and kinds > 1").select("one.id", F.struct("a", "v", "n", "one.at").alias("w"), "a", "kinds", "n")
        many = want.where(F.col("kinds") > MANY).select("a").distinct()
        size = want.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shards = max(1, -(-size // SHARD_BYTES))
        cut = base.join(want.groupBy("id").agg(F.collect_set("w").alias("want")), "id").select("text", "want").mapInArrow(_cut_segments, "a long, v long, n int, bytes binary")
        cut = scratch.written(cut, "cut")
        hot = _by_blocks(cut.join(many, "a", "left_semi").dropDuplicates(["a", "v", "n"]), length, anchor, scratch)

        def sorted_shard(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.drop_duplicates(["a", "v", "n"])
            marks = repeated_windows(pdf["bytes"].tolist(), length)
            hit = [m.any() for m in marks]
            out = pdf.loc[hit, ["a", "v", "n"]].copy()
            out["spans"] = [_runs(m, length) for m, h in zip(marks, hit, strict=True) if h]
            return out

        by_sort = cut.join(many, "a", "left_anti").withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInPandas(sorted_shard, f"a long, v long, n int, spans {_SPANS}")
        spans = whole.unionByName(by_sort)
        for part in hot:
            spans = spans.unionByName(part)
        spans = scratch.written(spans, "spans")
        hits = places.join(spans, ["a", "v", "n"]).select("id", F.explode("spans").alias("s"), "at").select("id", (F.col("s.b") + F.col("at")).alias("b"), (F.col("s.e") + F.col("at")).alias("e"))
        return written(hits.groupBy("id").agg(F.collect_set(F.struct("b", "e")).alias("spans")), "hits")


def _places(base: DataFrame, length: int, anchor: int, scratch: Scratch) -> DataFrame:
    """The segments at anchors that stand more than once."""
    found = scratch.written(base.mapInArrow(_anchored(length, anchor), "a long, v long, n int, id long, at int"), "segments")
    twice = scratch.written(found.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "anchors")
    return found.join(twice, "a")


def _merged(spans: list[dict] | None) -> list[list[int]]:
    merged: list[list[int]] = []
    for b, e in sorted((s["b"], s["e"]) for s in spans or ()):
        if merged and b <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([b, e])
    return merged


def _without(data: bytes, merged: list[list[int]]) -> bytes:
    at, rest = 0, []
    for b, e in merged:
        rest.append(data[at:b])
        at = e
    return b"".join([*rest, data[at:]])


def _identified(docs: DataFrame, key: str, text: str):
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\u0000")), F.col(text).cast("string"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for each row.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the
    same text or another; strings are judged on the input. Null counts as empty. Rows that
    repeat key and text lose all that is long enough, as each is elsewhere too; rows with
    equal keys and other texts are told apart by a 64-bit hash of both. Other columns are
    left out, empty tables give empty ones.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), _identified(docs, key, text).alias("id"))
    joined = base.join(repeats(base, "text", length, anchor), "id", "left").select("key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, left, count, sha = [], [], [], []
            for x, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, merged = (x.as_py() or "").encode("utf-8", "replace"), _merged(spans.as_py())
                rest = _without(data, merged)
                n.append(len(data))
                left.append(len(data) - len(rest))
                count.append(len(merged))
                sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(left, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = f"key {joined.schema['key'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with what ``dedup`` removes taken out of ``text``; a character of which a byte goes is left out whole. All rows stay, null texts too, and all columns, whatever their names; an empty table stays empty."""
    base = docs.select(F.col(text).cast("string").alias("text"), _identified(docs, key, text).alias("id"))
    of, found_id, spans_name = (own_name(docs, x) for x in ("of__", "found__", "spans__"))
    found = repeats(base, "text", length, anchor).select(F.col("id").alias(found_id), F.col("spans").alias(spans_name))
    joined = docs.withColumn(of, _identified(docs, key, text)).join(found, F.col(of) == F.col(found_id), "left").drop(of, found_id)
    at, names, kind = docs.columns.index(text), docs.columns, pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x, spans in zip(batch.column(at), batch.column(len(names)), strict=True):
                whole, merged = x.as_py(), _merged(spans.as_py())
                texts.append(_without(whole.encode("utf-8", "replace"), merged).decode("utf-8", "ignore") if merged else whole)
            columns = [pa.array(texts, kind) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)

"""Operator 7: token ids in Simple-8b files.

A 64-bit word holds a selector in its top four bits and as many ids as fit into the other
sixty at the width that the selector names; selector 15 stands for one id in a list of
those too wide. Ids are coded in blocks of BLOCK, and a payload lists the word at which each block
starts, so blocks are decoded alone or all at once. Payloads, each with whole documents,
are rows of a Parquet table whose files are in order of document id; Spark's committer
makes a lost task's rows appear once.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.tables import new_path

# Ids in a word and bits for each, by selector.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: Ids in a block, and in a payload at least (but for the last of a file).
BLOCK, PAYLOAD = 4096, 1 << 18
#: Bytes of text encoded at once, about.
TEXT_BYTES = 12 << 20
#: Bytes of stretches between spaces and their ids that a worker remembers, at most about; those of more than KEPT_LENGTH bytes never.
KEPT_BYTES, KEPT_LENGTH = 96 << 20, 64
MAGIC = b"S8B1"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes."""
    bits, rest = np.zeros(len(values), np.uint8), values
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        more = high > 0
        bits[more] += step
        rest = np.where(more, high, rest)
    return bits + (rest > 0)


_short = _widths(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> bytes:
    """A payload: magic, counts of ids, blocks, words and escaped ids; the blocks' first words; the words; the escaped ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK + 64, np.uint64)
    grid[:n] = ids
    wide = grid >> np.uint64(60) > 0
    bits = _short[grid] if int(grid.max()) < len(_short) else _widths(grid)
    # widest id among the next 1, 2, .. 60; ids beyond the block count as nothing, a word there is only filled in part
    selector = np.full(blocks * BLOCK, len(LAYOUT) - 1, np.uint8)
    field = bits[: blocks * BLOCK].reshape(blocks, BLOCK) if blocks else np.zeros((0, BLOCK), np.uint8)
    most, width = field, 1
    for k in range(len(LAYOUT) - 2, -1, -1):
        count, size = LAYOUT[k]
        while width < count:
            step = min(width, count - width)
            shifted = np.zeros_like(most)
            shifted[:, :-step] = most[:, step:]
            most = np.maximum(most, shifted)
            width += step
        fits = (most <= size).reshape(-1)
        selector[fits] = k
    selector[wide[: blocks * BLOCK]] = ESCAPE
    counts = np.array([c for c, _ in LAYOUT] + [0, 1])[selector].tolist()
    starts, first_words = [], []
    for b in range(blocks):
        first_words.append(len(starts))
        i, end = b * BLOCK, min(n, (b + 1) * BLOCK)
        while i < end:
            starts.append(i)
            i += counts[i]
    at = np.array(starts, np.int64)
    block_end = np.minimum((at // BLOCK + 1) * BLOCK, n)
    of = selector[at]
    words = of.astype(np.uint64) << np.uint64(60)
    for k, (count, size) in enumerate(LAYOUT):
        rows = np.flatnonzero(of == k)
        if len(rows):
            where = at[rows][:, None] + np.arange(count)
            values = np.where(where < block_end[rows][:, None], grid[np.minimum(where, len(grid) - 1)], np.uint64(0))
            words[rows] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(size)), axis=1)
    escaped = np.flatnonzero(of == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    head = MAGIC + struct.pack("<QIQI", n, blocks, len(words), len(escaped))
    return head + np.array(first_words, "<u8").tobytes() + words.astype("<u8").tobytes() + grid[at[escaped]].astype("<u8").tobytes()


def unpack(payload: bytes, block: int | None = None) -> np.ndarray:
    """The ids of a payload, or of one of its blocks, as unsigned 64-bit integers."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, blocks, n_words, n_escaped = struct.unpack_from("<QIQI", payload, 4)
    at = 4 + struct.calcsize("<QIQI")
    first = np.frombuffer(payload, "<u8", blocks, at).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, at + 8 * blocks)
    escaped = np.frombuffer(payload, "<u8", n_escaped, at + 8 * (blocks + n_words))
    lo, hi = (0, blocks) if block is None else (block, block + 1)
    w0, w1 = (first[lo], first[hi] if hi < blocks else n_words) if blocks else (0, 0)
    words = words[w0:w1]
    size = min(n, hi * BLOCK) - lo * BLOCK
    of = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in LAYOUT] + [0, 1])[of]
    # a block's last word may be filled in part: its place starts anew at each block
    total = np.cumsum(counts) - counts
    starts_at = first[lo:hi] - w0
    block_of = np.searchsorted(starts_at, np.arange(len(words)), "right") - 1
    place = total - total[starts_at][block_of] + block_of * BLOCK if len(words) else total
    out = np.zeros(size + 64, np.uint64)
    ends = np.minimum((block_of + 1) * BLOCK, size)
    for k, (count, bits) in enumerate(LAYOUT):
        rows = np.flatnonzero(of == k)
        if len(rows):
            values = (words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            where = place[rows][:, None] + np.arange(count)
            fits = where < ends[rows][:, None]
            out[where[fits]] = values[fits]
    rows = np.flatnonzero(of == ESCAPE)
    out[place[rows]] = escaped[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:size]


class WordTokenizer:
    """Encodes by the tokenizers library a stretch between spaces at a time, which it treats each by itself; those met before are remembered in Arrow and numpy arrays.

    Strings of special tokens in a text become those tokens wherever they stand, as the library
    cuts texts there first; its definition strips nothing around them and sees them before it lowers case.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.ending = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.sizes, self.ids = pa.array([""], pa.string()), np.zeros(1, np.int64), np.empty(0, "<u4")
        self.starts = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        for x in self.special:
            texts = pc.replace_substring(texts, x, f" {x} ")
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        chunks, which = coded.dictionary, coded.indices.to_numpy()
        if self.known.nbytes + self.ids.nbytes + 16 * len(self.known) > KEPT_BYTES:
            self._forget()
        place, kept = pc.index_in(chunks, value_set=self.known), None
        if place.null_count:  # what is learned follows what is known, long stretches last
            lacking = place.is_null().to_numpy(zero_copy_only=False)
            place = place.fill_null(0).to_numpy().copy()
            new = np.flatnonzero(lacking)
            long = pc.binary_length(chunks).to_numpy()[new] > KEPT_LENGTH
            new = new[np.argsort(long, kind="stable")]
            before = len(self.known)
            self._learn(chunks.take(pa.array(new)))
            place[new] = before + np.arange(len(new))
            if long.any():
                kept = before + len(new) - int(long.sum())
        else:
            place = place.to_numpy()
        place = place[which]
        n = self.sizes[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.starts[place] - ends[:-1], n) + np.arange(ends[-1])]
        if kept is not None:
            self.known, self.sizes, self.ids, self.starts = self.known.slice(0, kept), self.sizes[:kept], self.ids[: self.starts[kept]].copy(), self.starts[:kept]
        return ids, np.diff(ends[bounds])

    def _learn(self, chunks: pa.Array) -> None:
        """Letters and punctuation after them are separate pre-tokens, and ASCII letters count alike in both cases, so the library sees the letters once."""
        forms = []
        for x in chunks.to_pylist():
            stem = x.rstrip(punctuation)
            stem, mark = (stem, x[len(stem) :]) if stem.lower().isalpha() else (x, "")  # the lower case of a letter may end with a mark
            low = stem.lower() if stem.isascii() else stem
            forms.append((stem if any(t in low for t in self.special) else low, mark))  # a special token's string in capitals isn't one
        new = list({s for s, _ in forms})
        # plain words go as one text: each ends with a token that only ends words
        plain, of = [x for x in new if x.isalpha()], {"": b""}
        ids = np.array(self.library.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ending[ids]) + 1 if len(ids) else ids
        rest = new  # one of the plain ones may be more than one word to the library
        if len(ends) == len(plain):
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            of.update(zip(plain, [data[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)], strict=True))
            rest = [x for x in new if not x.isalpha()]
        rest += list({m for _, m in forms})
        for x, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            of[x] = array("I", e.ids).tobytes()
        values = [of[stem] + of[mark] for stem, mark in forms]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(values), "<u4")))
        self.known = pa.concat_arrays([self.known, chunks])


_ROW = "shard int, payload_no int, start long, n_ids long, doc_ids array<{}>, lengths array<long>, payload binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> None:
    """Writes the ids of all documents, each with ``end_id`` after it, in ascending order of the key (null first, ties by text).

    Null text counts as empty: the end id alone. Repeated rows are written each; other columns aren't, whatever their names. An empty
    table writes an empty one. Keys may be of any type that Spark sorts. Texts of any length are encoded whole.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast([f.read(), None])  # of the file's size; a worker keeps its tokenizer in place of None
    end = np.array([end_id], "<u4")
    ordered = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    row = _ROW.format(ordered.schema["key"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        coder = kept[1] = kept[1] or WordTokenizer(kept[0])
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        kind = pa.int64()
        parts: list[np.ndarray] = []
        counts: list[int] = []

        def payload() -> pa.RecordBatch:
            nonlocal number, start, keys, parts, counts
            ids = np.concatenate(parts)
            row = ([shard], [number], [start], [len(ids)], [keys], [counts], [pack(ids)])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary())
            number, start, keys, parts, counts = number + 1, start + len(ids), [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _ROW.split(", ")])

        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            heavy = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // TEXT_BYTES
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(heavy)) + 1, [batch.num_rows])).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                ids, lengths = coder.encode(batch.column(1).slice(lo, hi - lo))
                at = 0
                for k, n in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), lengths.tolist(), strict=True):
                    keys.append(k)
                    parts += [ids[at : at + n], end]
                    counts.append(n + 1)
                    at += n
                    size += n + 1
                    if size >= PAYLOAD:
                        yield payload()
                        size = 0
        if keys:
            yield payload()

    ordered.mapInArrow(run, row).write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32`` for each document, and its ``token_ids`` if asked for."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = sorted(tuple(r) for r in files.groupBy("shard").agg(F.sum("n_ids")).collect())  # a row for each file
    offsets, before = [], 0
    for shard, n in sizes:
        offsets.append((shard, before))
        before += n
    based = files.join(F.broadcast(spark.createDataFrame(offsets, "shard int, before long")), "shard").select((F.col("before") + F.col("start")).alias("start"), "doc_ids", "lengths", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, keys, lengths = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.array(batch.column(2)[i].as_py(), np.int64)
                ids = unpack(batch.column(3)[i].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                each = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(keys, batch.schema.field(1).type.value_type), pa.array(start + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return based.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Writes ``docs`` to a new table in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, key, text, end_id)
    return read_tokens(docs.sparkSession, path)

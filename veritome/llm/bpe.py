"""Operator 1: byte-level BPE encoding and decoding.

A pre-token's merges are picked from a rank queue: one bucket per merge rank
holds the positions of a linked list over the pre-token's parts, a two-level
bitmap over the ranks gives the lowest rank with entries by find-first-set, and
entries whose pair has changed meanwhile are skipped. A merge costs about the same
in a pre-token of ten bytes or of ten million.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, about, of the chunks and ids that a worker remembers, each with ENTRY more; when they get more, chunks longer than KEPT_LENGTH go, which seldom come again. Chunks over LONGEST are never remembered.
KEPT_BYTES, ENTRY, KEPT_LENGTH, LONGEST = 200 << 20, 190, 9, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class RankQueue:
    """Buckets of positions by rank, under a two-level bitmap: words of 256 ranks, and one word with a bit for each of them."""

    def __init__(self, n_ranks: int) -> None:
        self.words, self.top = [0] * (n_ranks // 256 + 1), 0
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]

    def drain(self, piece: bytes, get, after: list[int], before: list[int], now: list[int]) -> None:
        """Merges pairs, lowest rank first and leftmost first within it, until no pair has a rank.

        ``now`` holds the rank of the pair that starts at each part; the queue starts
        from it and is empty again at the end. Push and pop stand in line: calls would
        cost more than the work.
        """
        words, buckets, top, n = self.words, self.buckets, 0, len(piece)
        for i, rank in enumerate(now):
            if rank >= 0:
                if bucket := buckets[rank]:
                    heappush(bucket, i)
                else:
                    bucket.append(i)
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            a = (top & -top).bit_length() - 1  # find first set, twice
            word = words[a]
            low = word & -word
            rank = (a << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[a] = word = word ^ low
                if not word:
                    top ^= 1 << a
            if now[i] != rank:  # stale: the pair here has changed
                continue
            j = after[i]
            k = after[j]
            after[i], now[j], now[i] = k, -1, -1
            if k < n:
                before[k] = i
                rank = get(piece[i : after[k]], -1)
                if rank >= 0:
                    now[i] = rank
                    if bucket := buckets[rank]:
                        heappush(bucket, i)
                    else:
                        bucket.append(i)
                        words[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
            i = before[i]
            if i >= 0:
                now[i] = rank = get(piece[i:k], -1)
                if rank >= 0:
                    if bucket := buckets[rank]:
                        heappush(bucket, i)
                    else:
                        bucket.append(i)
                        words[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)


class Coder:
    """Encodes and decodes with one vocabulary; keeps no state between texts but a bounded memory of chunks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(len(self.tokens))
        self.known: dict[str, bytes] = {}
        self.held = 0
        # where two white-space characters meet, or one stands at an end, a space may belong to either side
        self.uneven = re.compile(r"\s\s|^\s|\s\Z").search
        self.cut = re.compile(r"(?<=\S)(?= \S)").split

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        now.append(-1)
        self.queue.drain(piece, get, after, before, now)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _keep(self, x: str, ids: bytes) -> bytes:
        if len(x) <= LONGEST:
            self.known[x] = ids
            self.held += ENTRY + 2 * len(x) + len(ids)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, pre-token by pre-token; those of a pre-token are remembered too, as a chunk of its own."""
        get, out = self.known.get, []
        for x in self.find(chunk):
            ids = get(x)
            out.append(self._keep(x, array("I", self.piece(x.encode("utf-8", "replace"))).tobytes()) if ids is None else ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        The text is first cut before single spaces between other characters, where
        no match of the pattern can reach across; repeated chunks are coded once.
        """
        if self.uneven(text):
            chunks = self.cut(text)
        else:
            chunks = text.split(" ")
            chunks[1:] = [" " + x for x in chunks[1:]]
        known = self.known
        try:
            return b"".join([known[x] for x in chunks])
        except KeyError:
            pass
        out = b"".join([known[x] if x in known else self._keep(x, self._chunk(x)) for x in chunks])
        if self.held > KEPT_BYTES:
            short = {x: ids for x, ids in known.items() if len(x) <= KEPT_LENGTH}
            size = sum(ENTRY + 2 * len(x) + len(ids) for x, ids in short.items())
            self.known, self.held = (short, size) if size < KEPT_BYTES // 2 else ({}, 0)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SCHEMA = {"ids": ("token_ids", "array<int>"), "decoded": ("decoded", "binary")}


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per input row: the key, ``n_tokens``, digests of ids and decoded bytes, and the outputs asked for.

    Null text counts as empty: no ids, no bytes. Rows with equal or null keys are
    coded each by itself, other columns of ``docs`` are left out, and an empty table
    gives an empty one. The text is never cut or dropped, however long. The
    vocabulary is read by the driver and broadcast (its size is that of the file).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([load_ranks(vocabulary), None])  # a worker keeps its coder in place of None, from task to task
    fixed = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    extra = [_SCHEMA[x] for x in outputs]
    schema = f"key {fixed.schema['key'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {n} {t}" for n, t in extra)
    types = {"token_ids": pa.list_(pa.int32()), "decoded": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        coder = kept[1] = kept[1] or Coder(kept[0], pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, sha, back, ids_out, bytes_out = [], [], [], [], []
                for x in part.column(1):
                    ids = coder.encode(x.as_py() or "")
                    plain = coder.decode(ids)
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(plain).hexdigest())
                    if "ids" in outputs:
                        ids_out.append(np.frombuffer(ids, "<i4"))
                    if "decoded" in outputs:
                        bytes_out.append(plain)
                made = {"token_ids": ids_out, "decoded": bytes_out}
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                columns += [pa.array(made[name], types[name]) for name, _ in extra]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", *(name for name, _ in extra)])

    return fixed.mapInArrow(run, schema).withColumnRenamed("key", key)

"""Operator 10: transcripts to canonical turns.

A hidden Markov model has two states for each role: the line that begins a turn and the
lines that go on with it. It sees speaker markers, empty lines before a line, and question
marks; Viterbi's path gives each line's role, and turns are rendered in one form. Paths are
found in pieces: a piece's best scores from any state to any state are a matrix, the
matrices of a transcript give the states at the pieces' borders, and each piece is then
traced by itself, so a transcript of any length never is in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritome.llm.tables import Scratch, written

ROLES = ("system", "user", "assistant")
#: Rows of a transcript in a piece, at most.
PIECE = 512
#: Characters of a text by which rows with one key and turn are dealt; few, as samples of them come to the driver.
DEALT_BY = 64
# Words that mark a speaker.
SPEAKERS = {
    "system": "system sys context instructions",
    "user": "user human q question prompter customer client instruction inst you me student",
    "assistant": "assistant ai bot a answer gpt chatbot model agent support response teacher",
}
_role_of = {w: r for r, words in SPEAKERS.items() for w in words.split()}
_marker = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?\s*([A-Za-z]{1,12})\s*(?:\*\*\s*:|\|?>|\]|:)\s*(?:\*\*)?\s*")


def _log(rows) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.array(rows, float))


# states: 2 * role for a turn's first line, 2 * role + 1 for the others
_SWITCH = {"system": (0.02, 0.93, 0.05), "user": (0.02, 0.05, 0.93), "assistant": (0.02, 0.93, 0.05)}
START = _log([0.25, 0, 0.6, 0, 0.15, 0])
MOVE = _log([[x for to, other in enumerate(ROLES) for x in (0.2 * _SWITCH[ROLES[s // 2]][to], 0.8 if other == ROLES[s // 2] else 0)] for s in range(6)])
# what marks a line: nothing, a system, user or assistant marker, another word before a colon
MARK = _log([x for r in range(3) for x in ([0.1, *(0.84 if r == k else 0.01 for k in range(3)), 0.04], [0.965, 0.003, 0.003, 0.003, 0.026])])
AFTER_EMPTY = _log([x for _ in range(3) for x in ([0.5, 0.5], [0.93, 0.07])])
ASKS = _log([x for p in (0.02, 0.3, 0.08) for x in ([1 - p, p], [1 - p, p])])


def observe(line: str, after_empty: bool) -> tuple[np.ndarray, int]:
    """Log probability of a line in each state, and the length of its marker."""
    m = _marker.match(line)
    word = m[1].lower() if m else None
    mark = 0 if word is None else 1 + ROLES.index(_role_of[word]) if word in _role_of else 4
    return MARK[:, mark] + AFTER_EMPTY[:, int(after_empty)] + ASKS[:, int(line.rstrip().endswith("?"))], m.end() if mark in (1, 2, 3) else 0


def _seen(text: str, empty_before: bool) -> tuple[list[str], np.ndarray, list[int], bool]:
    """Lines with text, their emissions and marker lengths; whether an empty line ends the text."""
    lines, emissions, cuts, empty = [], [], [], empty_before
    for line in text.split("\n"):
        if not line.strip():
            empty = True
            continue
        e, cut = observe(line, empty)
        lines.append(line)
        emissions.append(e)
        cuts.append(cut)
        empty = False
    return lines, np.array(emissions).reshape(-1, 6), cuts, empty


def _trace(emissions: np.ndarray, start: np.ndarray, last: int) -> list[int]:
    """The best path that ends in ``last``; ``start`` scores the states of the first line, before its emission."""
    score, back = start + emissions[0], []
    for e in emissions[1:]:
        step = score[:, None] + MOVE
        back.append(step.argmax(0))
        score = step.max(0) + e
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def viterbi(emissions: np.ndarray) -> list[int]:
    """The best path over a whole transcript."""
    if not len(emissions):
        return []
    score = START + emissions[0]
    for e in emissions[1:]:
        score = (score[:, None] + MOVE).max(0) + e
    return _trace(emissions, START, int(score.argmax()))


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list]]:
    """Rows in order, by their first columns; a group is held at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key and rows:
                yield key, rows
                rows = []
            key = row[:n_keys]
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def turns(transcripts: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``key, turn, role, text, rendered`` for each turn recovered, numbered from 0.

    A transcript's rows (``key``, ``order``, ``text``) are its stretches of lines, in order, ties by text. A single
    row may hold a whole transcript. Lines without text only separate; null texts have no
    lines, and transcripts without lines no turns. Rows with a null key or order are left out, as
    are other columns; repeated rows are lines that stand twice; an empty table gives an empty one.
    Pieces go by the place of rows in order, so rows that share a turn number are in as many pieces as
    their number asks for.
    """
    rows = transcripts.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("key is not null and at is not null")
    # ids of rows grow along the sorted partitions, whose first ids are multiples of 2**33; kept as a table, as they'd differ if computed again
    scratch = Scratch()
    in_order = rows.repartitionByRange("key", "at", F.substring("text", 1, DEALT_BY)).sortWithinPartitions("key", "at", "text")
    numbered_rows = scratch.written(in_order.withColumn("piece", F.floor(F.monotonically_increasing_id() / PIECE).cast("long")), "pieces")
    dealt = numbered_rows.select("key", "piece", "at", "text").repartition("key", "piece").sortWithinPartitions("key", "piece", "at", "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, piece), found in _groups(batches, 2):
            lines, emissions, _, ends = _seen("\n".join(t for _, t in found), False)
            both = [None, None]  # without and with an empty line before the piece; none where it has no lines
            if len(emissions):
                # the first line's step from before is left open: its emission, then the rest
                rest = np.where(np.eye(6, dtype=bool), 0.0, -np.inf)
                for e in emissions[1:]:
                    rest = (rest[:, :, None] + MOVE[None]).max(1) + e
                both = [(e[:, None] + rest).ravel().tolist() for e in (emissions[0], np.array(observe(lines[0], True)[0]))]
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([piece], pa.int64()), *(pa.array([m], pa.list_(pa.float64())) for m in both), pa.array([ends])], names=["key", "piece", "m", "m_empty", "ends"])

    matrices = dealt.mapInArrow(scored, "key string, piece long, m array<double>, m_empty array<double>, ends boolean")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k,), found in _groups(batches, 1):
            score, back, empty = START, [], False
            for piece, m, m_empty, ends in found:
                if m is not None:
                    step = (score[:, None] + MOVE).max(0) if back else score
                    from_state = (score[:, None] + MOVE).argmax(0) if back else None
                    inner = step[:, None] + np.array(m_empty if empty else m).reshape(6, 6)
                    back.append((piece, empty, from_state, inner.argmax(0)))
                    score = inner.max(0)
                empty = ends
            if not back:
                continue
            last, out = int(score.argmax()), []
            for piece, empty, from_state, first_of in reversed(back):
                first = int(first_of[last])
                out.append((piece, first, last, empty))
                last = last if from_state is None else int(from_state[first])
            out.reverse()
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(out)), *(pa.array(c) for c in zip(*out, strict=True))], names=["key", "piece", "first", "last", "empty"])

    # a row for each PIECE rows of a transcript
    borders = matrices.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(joined, "key string, piece long, first long, last long, empty boolean")
    guided = dealt.join(borders.select(F.col("key").alias("k2"), F.col("piece").alias("p2"), "first", "last", "empty"), (F.col("key") == F.col("k2")) & (F.col("piece") == F.col("p2"))).select("key", "piece", "at", "text", "first", "last", "empty").sortWithinPartitions("key", "piece", "at", "text")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, piece), found in _groups(batches, 2):
            lines, emissions, cuts, _ = _seen("\n".join(x[1] for x in found), found[0][4])
            start = np.full(6, -np.inf)
            start[found[0][2]] = 0.0
            out: list[list] = []
            for line, cut, s in zip(lines, cuts, _trace(emissions, start, found[0][3]), strict=True):
                part = line[cut:].strip()
                if s % 2 == 0 or not out:
                    out.append([s % 2 == 0, ROLES[s // 2], []])
                if part:
                    out[-1][2].append(part)
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n), pa.array([piece] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array(["\n".join(o[2]) for o in out], pa.string())], names=["key", "piece", "n", "begins", "role", "text"])

    with scratch:
        parts = written(guided.mapInArrow(told, "key string, piece long, n long, begins boolean, role string, text string"), "turns")
    # turns before each piece: a row for each piece of a transcript, in a window by transcript
    begun = parts.groupBy("key", "piece").agg(F.count_if("begins").alias("c"))
    before = begun.withColumn("before", F.sum("c").over(Window.partitionBy("key").orderBy("piece")) - F.col("c")).select("key", "piece", "before")
    inside = F.sum(F.col("begins").cast("long")).over(Window.partitionBy("key", "piece").orderBy("n"))
    numbered = parts.withColumn("i", inside).join(before, ["key", "piece"]).withColumn("turn", F.greatest(F.col("before") + F.col("i") - 1, F.lit(0)))
    whole = numbered.groupBy("key", "turn").agg(F.min_by("role", F.struct("piece", "n")).alias("role"), F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("piece", "n", "text"))), lambda x: x["text"]), lambda t: t != ""), "\n").alias("text"))
    kind = transcripts.schema[key].dataType.simpleString()
    return whole.select(F.col("key").cast(kind).alias(key), "turn", "role", "text", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")).alias("rendered"))

"""Operator 9: toxicity by a learned lexicon, misspellings included.

A lexicon of words and stems is learned from labelled texts and kept as a trie. A
Levenshtein automaton for a text's word is run along the trie, so one walk finds
all terms within the edit distance. Each hit is weighed by its term and by the window of
words around it: quotation marks and reporting words tell a report from abuse. A small
logistic model over sums of these weights gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so many labelled rows of either class are fitted on; any more are thinned by a hash of the key.
FIT_ROWS = 12_000
#: A term stands in at least this share of the toxic texts fitted on (and in two), and this share of the texts with it is toxic.
#: So there are at most 1 / SUPPORT terms for each unit that a toxic text holds on average, whatever the size of the tables.
SUPPORT, PRECISION = 0.01, 0.85
#: And its log-likelihood ratio, doubled, is at least this, or chance would fill the lexicon.
EVIDENCE = 15.0
STEM = range(3, 9)
#: Words on either side that are the context of a hit, and what a quoted hit counts.
WINDOW, QUOTED = 6, 0.3
#: Terms at least this long match with one edit.
FUZZY_LENGTH = 5
#: Chunks that a worker remembers, and their greatest length.
KEPT_WORDS, REMEMBERED = 500_000, 64
# Signs around a word, and what stands for a letter inside one.
AROUND = ".,;:!?\"'()[]{}<>«»“”„‘’…-–—*_~"
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
# Words that report speech.
REPORTING = frozenset("said says wrote writes quoted quotes quote called calls term word words slur insult reported according sagte schrieb nannte zitat dit écrit citation dijo escribió cita".split())
THRESHOLD = 0.7

_letters = re.compile(r"[^\W\d_]+")
_run = re.compile(r"(.)\1+")


def _path(node: dict, letters: str) -> dict:
    for c in letters:
        node = node.setdefault(c, {})
    return node


class Lexicon:
    """Terms with weights in a trie; a stem stands for every word that begins with it.

    One edit is a letter more, less, or another, or two neighbours that change places. Then a term's first half begins the word, or its
    second half ends it (of a stem: stands about its place), or the two letters between the halves have changed places. The automaton
    starts where these lead: in the trie, and in tries of words and of stems from their ends. A stem's last letter stands as it is.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        self._root: dict = {}
        self._back: dict = {}
        self._stems_back: dict = {}
        self._terms = [(term, stem) for term, stem, _ in terms]
        self._starts: dict[int, tuple] = {}
        self.longest = max((len(t) for t, _, _ in terms), default=0)
        for term, stem, weight in terms:
            _path(self._root, term)["stem" if stem else "word"] = weight
            if len(term) >= FUZZY_LENGTH:
                _path(self._stems_back if stem else self._back, term[::-1])["word"] = weight

    def _starting(self, size: int) -> tuple:
        """Where the automaton may start for a word of ``size`` letters, by what leads there: only terms that such a word can reach with an edit count."""
        heads: dict[int, dict[str, dict]] = {}
        crossed: dict[int, dict[str, dict]] = {}
        tails: dict[int, dict[str, dict]] = {}
        middles: dict[tuple[int, int], dict[str, dict]] = {}  # second halves of stems, by their place and length
        for term, stem in self._terms:
            n = len(term)
            if n > size + 1 or (n < size - 1 and not stem):
                continue
            if n < FUZZY_LENGTH:
                heads.setdefault(n, {})[term] = _path(self._root, term)
                continue
            half = n // 2
            heads.setdefault(half, {})[term[:half]] = _path(self._root, term[:half])
            crossed.setdefault(half + 1, {})[term[: half + 1]] = _path(self._root, term[: half + 1])
            ending = term[: half - 1 : -1]
            if stem:
                middles.setdefault((half, n - half), {})[term[half:]] = _path(self._stems_back, ending)
            else:
                tails.setdefault(n - half, {})[ending] = _path(self._back, ending)
        return tuple(heads.items()), tuple(crossed.items()), tuple(tails.items()), tuple(middles.items())

    def find(self, word: str) -> tuple[float, float]:
        """Largest weight of a term that ``word`` is, or else of one that it is but for one edit; 0 where there is none."""
        exact = near = 0.0
        size = min(len(word), self.longest + 2)  # longer words reach the same terms: stems
        found = self._starts.get(size)
        if found is None:
            found = self._starts[size] = self._starting(size)
        heads, crossed, tails, middles = found
        starts = []
        for n, nodes in heads:
            node = nodes.get(word[:n])
            if node is not None:
                starts.append((node, 1 << n, 3 << n, n))
        for n, nodes in crossed:
            node = nodes.get(word[: n - 2] + word[n - 1] + word[n - 2])
            if node is not None:
                starts.append((node, 0, 1 << n, n))
        if starts:
            exact, near = _matches(word, starts, self.longest)
        if tails:
            turned = word[::-1]
            starts = []
            for n, nodes in tails:
                node = nodes.get(turned[:n])
                if node is not None:
                    starts.append((node, 1 << n, 3 << n, n))
            if starts:
                a, b = _matches(turned, starts, self.longest)
                exact, near = max(exact, a), max(near, b)
        for (at, n), nodes in middles:
            for begin in (at - 1, at, at + 1):
                node = nodes.get(word[begin : begin + n])
                if node is not None:
                    near = max(near, *_matches(word[begin + n - 1 :: -1], [(node, 1 << n, 3 << n, n)], self.longest))
        return exact, 0.0 if exact else near


def _matches(word: str, starts: list[tuple[dict, int, int, int]], longest: int) -> tuple[float, float]:
    """``Lexicon.find`` below nodes that so many of the word's first characters lead to: with no edit, and with one at most.

    What lies beyond the longest term and an edit is never reached, so only as much of the word is looked at.
    """
    bits: dict[str, int] = {}
    reach = word[: longest + 2]
    for i, c in enumerate(reach):
        bits[c] = bits.get(c, 0) | 1 << i
    whole = (2 << len(reach)) - 1
    last = 1 << len(reach) if len(reach) == len(word) else 0
    exact = near = 0.0
    stack = []  # a node, the positions of the word reached with no edit, with one at most, those whose next two letters may be turned round, depth
    for node, none, one, depth in starts:
        one &= whole
        if none:
            exact = max(exact, node.get("stem", 0.0), node.get("word", 0.0) if none & last else 0.0)
        if one & last and depth >= FUZZY_LENGTH:
            near = max(near, node.get("word", 0.0))
        stack.append((node, none, one, 0, depth))
    while stack:
        node, none, one, turned, depth = stack.pop()
        depth += 1
        for c, child in node.items():
            if len(c) > 1:  # a weight
                continue
            at = bits.get(c, 0)
            none2 = (none & at) << 1
            stands = ((one & at) << 1 | (turned & at) << 2) & whole
            one2 = (stands | none | none << 1 | none2 | none2 << 1) & whole
            if not one2:
                continue
            if "word" in child:
                if none2 & last:
                    exact = max(exact, child["word"])
                elif one2 & last and depth >= FUZZY_LENGTH:
                    near = max(near, child["word"])
            if "stem" in child:
                if none2:
                    exact = max(exact, child["stem"])
                elif stands and depth >= FUZZY_LENGTH:
                    near = max(near, child["stem"])
            stack.append((child, none2, one2, none & at >> 1, depth))
    return exact, near


class Scanner(dict):
    """From a chunk between spaces to its hit weights; remembers a bounded number of chunks, none of them long."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, chunk: str) -> tuple[float, float] | None:
        """Words of letters; a drawn-out word by its letters once; digits and signs as the letters they stand for, or as one edit."""
        low = chunk.casefold()
        plain = low.strip(AROUND)
        if plain != chunk:  # signs around a word and capitals mean nothing
            found = self[plain] if plain else None
            if len(chunk) <= REMEMBERED:
                self[chunk] = found
            return found
        find = self.lexicon.find
        exact = near = 0.0
        for word in _letters.findall(plain):
            a, b = find(word)
            if not a and not b:
                short = _run.sub(r"\1", word)
                if short != word:
                    b = max(find(short))
            exact, near = max(exact, a), max(near, b)
        if not plain.isalpha() and _letters.search(plain):
            near = max(near, *find(plain))
            meant = plain.translate(LOOKALIKES)
            if meant != plain:
                for word in _letters.findall(meant):
                    near = max(near, *find(word))
        found = (exact, near) if exact or near else None
        if len(chunk) <= REMEMBERED:
            self[chunk] = found
        return found

    def features(self, text: str) -> list[float]:
        """Sums over the hits of a text: exact, with an edit, for each hundred words, quoted."""
        if len(self) > KEPT_WORDS:
            self.clear()
        words = text.split()
        exact = near = quoted = 0.0
        for i in [i for i, w in enumerate(words) if self[w]]:
            a, b = self[words[i]]
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            marks = sum(x.count('"') + x.count("“") + x.count("”") + x.count("«") + x.count("»") for x in around)
            if marks >= 2 or any(x.casefold().strip(".,:;!?\"'") in REPORTING for x in around):
                quoted += a or b
                a, b = a * QUOTED, b * QUOTED
            if a:
                exact += a
            else:
                near += b
        return [float(np.log1p(exact)), float(np.log1p(near)), float(np.log1p(100 * exact / max(1, len(words)))), float(np.log1p(quoted))]


def _units(text: str) -> set[tuple[str, str]]:
    """The words of a text, and each with its stems."""
    words = {w for w in _letters.findall(text.casefold()) if len(w) > 2}
    return {(w, w) for w in words} | {(w[:n], w) for w in words for n in STEM if len(w) > n}


def choose_terms(counts: list[tuple[str, bool, int, int, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """``(unit, is word, toxic texts, clean texts, distinct words, most texts of one word)`` to terms: shortest stems that many words share, and words of no such stem."""
    terms: dict[str, tuple[bool, float]] = {}
    for unit, is_word, toxic, clean, kinds, most in sorted(counts, key=lambda x: (len(x[0]), x[0], x[1])):
        if toxic / n_toxic < PRECISION * (toxic / n_toxic + clean / n_clean) or any(unit[:n] in terms and terms[unit[:n]][0] for n in range(2, len(unit) + 1)):
            continue
        share, rate = n_toxic / (n_toxic + n_clean), toxic / (toxic + clean)
        if 2 * (toxic * np.log(rate / share) + (clean * np.log((1 - rate) / (1 - share)) if clean else 0.0)) < EVIDENCE:
            continue
        if not is_word and (kinds < 4 or most > 0.6 * toxic):
            continue
        terms[unit] = (not is_word, float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))) * min(1.0, np.log1p(toxic)))
    return [(t, stem, weight) for t, (stem, weight) in sorted(terms.items())]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights, intercept first, by Newton steps; the classes count alike."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    beta, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + keep * len(y), x.T @ (w * (y - p)) - keep @ beta * len(y))
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    """A lexicon and the weights of the features; without labelled rows of both classes every score is 0."""

    def __init__(self, terms: list[tuple[str, bool, float]], beta: list[float]) -> None:
        self.terms, self.beta = terms, beta


def held_out(key: str = "doc_id"):
    """Column: the row is kept from learning, by the checksum of the key's text."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labelled rows that aren't held out, at most about FIT_ROWS of either class, thinned by a hash of the key.

    Rows with a null key, label or text and repeated rows are left out; of equal texts one counts.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where(F.col("key").isNotNull() & F.col("y").isNotNull() & ~held_out("key")).groupBy("key").agg(F.max("y").alias("y"))
    sizes = {bool(y): n for y, n in known.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    share = F.when(F.col("y") > 0, FIT_ROWS / max(1, sizes.get(True, 0))).otherwise(FIT_ROWS / max(1, sizes.get(False, 0)))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share * 1_000_000)
    # about 2 * FIT_ROWS rows of a key and a flag, whatever the size of the tables
    sample = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "key").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    totals = {bool(y): n for y, n in sample.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        return Model([], [-30.0, 0.0, 0.0, 0.0, 0.0])
    least = max(2, round(SUPPORT * n_toxic))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # the counts of few texts at a time are held
                part, tally = batch.slice(at, 256), Counter()
                for x, y in zip(part.column(0), part.column(1), strict=True):
                    toxic = y.as_py() > 0
                    tally.update((u, w, toxic) for u, w in _units(x.as_py()))
                n = list(tally.values())
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally]), pa.array([k[1] for k in tally]), pa.array([c if k[2] else 0 for k, c in zip(tally, n, strict=True)], pa.int64()), pa.array([0 if k[2] else c for k, c in zip(tally, n, strict=True)], pa.int64())], names=["unit", "word", "toxic", "clean"])

    words = sample.select("text", "y").mapInArrow(counted, "unit string, word string, toxic long, clean long").groupBy("unit", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    whole = words.where("unit = word")
    stems = words.where("unit <> word").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("kinds"), F.max("toxic").alias("most"))
    wanted = (F.col("toxic") >= least) & (F.col("toxic") * n_clean >= PRECISION * (F.col("toxic") * n_clean + F.col("clean") * n_toxic))
    both = whole.where(wanted).select("unit", F.lit(True).alias("is_word"), "toxic", "clean", F.lit(1).cast("long").alias("kinds"), F.col("toxic").alias("most")).unionByName(stems.where(wanted & (F.col("kinds") >= 4)).select("unit", F.lit(False).alias("is_word"), "toxic", "clean", "kinds", "most"))
    rows = [tuple(r) for r in both.collect()]  # bounded by SUPPORT
    terms = choose_terms(rows, n_toxic, n_clean)
    found = sample.select(F.col("h").alias("key"), "y", "text").mapInArrow(_featured(docs.sparkSession, terms), "key long, y int, f array<double>").select("y", "f").collect()  # a row for each of the texts fitted on
    beta = fit_logistic(np.array([r.f for r in found]), np.array([float(r.y > 0) for r in found]))
    return Model(terms, beta.tolist())


def _featured(spark: SparkSession, terms: list[tuple[str, bool, float]]):
    shared = spark.sparkContext.broadcast([terms, None])  # bounded by SUPPORT; a worker keeps its scanner in place of None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        scanner = kept[1] = kept[1] or Scanner(Lexicon(kept[0]))
        for batch in batches:
            made = [scanner.features(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], names=["key", "y", "f"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` for each row.

    Null and empty texts have no hits and get the score of a text without any. Repeated
    rows are each scored, a null key is not held out, other columns are left out, an
    empty table gives an empty one. Whole texts are read, however long.
    """
    fixed = docs.select(F.col(key).alias("key"), F.lit(0).alias("y"), F.col(text).cast("string").alias("text"))
    made = fixed.mapInArrow(_featured(docs.sparkSession, model.terms), f"key {fixed.schema['key'].dataType.simpleString()}, y int, f array<double>")
    line = sum((F.col("f")[i] * w for i, w in enumerate(model.beta[1:])), F.lit(model.beta[0]))
    scored = made.select("key", held_out("key").alias("held_out"), (1 / (1 + F.exp(-line))).alias("score"))
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, all columns as they are; null and empty texts score as texts without hits."""
    shared = docs.sparkSession.sparkContext.broadcast([model.terms, None])
    beta, at = np.array(model.beta), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        scanner = kept[1] = kept[1] or Scanner(Lexicon(kept[0]))
        for batch in batches:
            lines = [beta[0] + float(np.dot(beta[1:], scanner.features(x.as_py() or ""))) for x in batch.column(at)]
            yield batch.filter(pa.array([1 / (1 + np.exp(-np.clip(v, -700, 700))) < THRESHOLD for v in lines], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

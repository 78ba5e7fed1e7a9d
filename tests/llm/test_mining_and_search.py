"""Phrases, mixtures and ranked search on odd rows, and against brute force on small fixtures."""

import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("veritome.llm.phrases")

SCHEMA = "doc_id long, text string, lang string, source string, part string, rank int"
LONG = "the quick brown fox. And so on, " * 3000
ODD = [
    (None, None, None, None, "x", 1), (1, None, "en", "a", "x", 1), (2, "", "en", "a", "x", 1), (3, "one", None, "b", "x", 1), (3, "one", None, "b", "x", 1), (4, "A b  c\td\n\n é ü 123 a.b,c!", "de", "a", "x", 1),
    (5, LONG, "en", "a", "x", 1), (6, LONG, "en", "c", "x", 1), (6, "another text under the same key", "en", "c", "x", 1), (None, "text without a key", "und", None, "x", 1), (7, " \t\x0b. , ;", "en", "", "x", 1),
    (8, "=" * 5000, "en", "a", "x", 1), (9, "日本語 の テキスト 😀 " * 40, "ja", "\U0001f600", "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "é", "AB", "ab", "x-y"]
    made = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(vocabulary[: 1 + int(65 * rng.random() ** 3)]) if rng.random() > 0.1 else "new york city hall")
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!"]))
        made.append((i, "".join(parts), rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice("aaaaabbcdé") if i % 50 else None))
    return made


def rows(df):
    return [tuple(r) for r in df.collect()]


# 11: phrases


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def phrases_by_hand(texts, least, most):
    n, f = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    good = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    found = {}
    for (lang, w), a in good.items():
        inside = any(lang == other and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 100 * a for (other, v), b in good.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, l, r, n[lang], score))
    return sorted((lang, i, p.decode(), a, l, r, n, s) for lang, held in found.items() for i, (_, _, p, a, l, r, n, s) in enumerate(sorted(held)[:most], 1))


@pytest.mark.parametrize("cells", [1 << 12, 1 << 28])
def test_phrases_against_brute_force(spark, texts, cells, monkeypatch):
    from veritome.llm import phrases

    monkeypatch.setattr(phrases, "CHUNK", 3000)
    monkeypatch.setattr(phrases, "LEAST_CELLS", 1 << 12)
    monkeypatch.setattr(phrases, "HELD", 500)
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(5)
    got = sorted(rows(phrases.collocations(docs, least=12, rows=40, most_cells=cells)))
    assert got == phrases_by_hand([(t[1], t[2]) for t in texts], 12, 40)
    assert len(got) > 40


def test_phrases_odd_rows(spark, odd, empty):
    from veritome.llm.phrases import collocations

    assert sorted(rows(collocations(odd))) == phrases_by_hand([(r[1], r[2]) for r in ODD], 100, 2000)
    assert sorted(rows(collocations(odd, least=2))) == phrases_by_hand([(r[1], r[2]) for r in ODD], 2, 2000)
    assert rows(collocations(empty)) == []


def test_phrase_scores_beyond_64_bits(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veritome.llm import phrases

    a, l, r, n = 987_654_321_987, 1_234_567_890_123, 2_345_678_901_234, 8_888_888_888_888_888
    counts = [("en", "", 0, n), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)]
    monkeypatch.setattr(phrases, "frequent", lambda docs, *_: docs.sparkSession.createDataFrame(counts, "lang string, phrase string, m int, a long"))
    assert rows(phrases.collocations(spark.range(1).select(F.lit("").alias("text"))))[0][-1] == 1000 * a * n // (l * r)


# 13: ranked search


def ranked_by_hand(texts, items, most=10):
    terms = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", lower(t))
    docs = [(k, Counter(terms(t))) for k, t in texts]
    docs = [(k, c, sum(c.values())) for k, c in docs if c]
    big_n, big_l = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    found = []
    for item, q in asked.items():
        scores = []
        for k, c, n in docs:
            m = 10 + 90 * n * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            scores += [(-s, k is None, k or 0)] if s > 0 else []
        found += [(item, i, None if none else k, -s) for i, (s, none, k) in enumerate(sorted(scores)[:most], 1)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("tree_terms, pass_terms", [(20_000, 1_000_000), (5, 1_000_000), (20_000, 20)])
def test_ranked_against_brute_force(spark, texts, tree_terms, pass_terms, monkeypatch):
    from veritome.llm import lexical

    monkeypatch.setattr(lexical, "TREE_TERMS", tree_terms)
    monkeypatch.setattr(lexical, "CHUNK_ROWS", 60)
    monkeypatch.setattr(lexical, "LEAF", 3)
    monkeypatch.setattr(lexical, "FAN", 2)
    monkeypatch.setattr(lexical, "CHUNK", 2_000)
    held = [(t[0] if t[0] % 9 else t[0] // 2, t[1]) for t in texts] + [(k, "w1 w2 york") for k in range(900, 940)]  # ties over many leaves
    items = [(i, t[1]) for i, t in enumerate(texts[:12])] + [(0, "w7 w9"), (90, "w1 york"), (91, "zzz nothing"), (92, None), (None, "É é ab")]
    docs = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
    got = rows(lexical.ranked(docs, spark.createDataFrame(items, "item_id long, text string"), pass_terms=pass_terms))
    assert sorted(got, key=repr) == ranked_by_hand(held, items)


def test_ranked_odd_rows(spark, odd, empty):
    from veritome.llm.lexical import ranked

    items = spark.createDataFrame([(1, "one quick Fox"), (1, "one quick Fox"), (2, "テキスト"), (3, ""), (None, "and text")], "item_id long, text string")
    assert sorted(rows(ranked(odd, items)), key=repr) == ranked_by_hand([(r[0], r[1]) for r in ODD], [tuple(r) for r in items.collect()])
    assert rows(ranked(empty, items)) == []
    assert rows(ranked(odd, items.where("false"))) == []
    named = ranked(odd.withColumnRenamed("doc_id", "query"), items.withColumnRenamed("item_id", "key"), key="query", item_key="key")
    assert named.columns == ["key", "rank", "query", "score"] and named.count() > 0
    by_text = ranked(odd.withColumn("doc_id", odd.doc_id.cast("string")), items)
    assert dict(by_text.dtypes)["doc_id"] == "string" and by_text.count() == named.count()


# 12: mixing


def words_of(text):
    return re.findall("[^ \t-\r]+", text or "")


def targets_by_hand(sizes):
    """Shares by weight; the excess over three times a source's size is shared again among those below."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: total * weight[s] / sum(weight.values()) for s in names}
    while any(target[s] > 3 * sizes[s] + 1e-6 for s in names):
        excess = sum(max(0, target[s] - 3 * sizes[s]) for s in names)
        below = [s for s in names if target[s] < 3 * sizes[s] - 1e-6]
        target = {s: min(target[s], 3 * sizes[s]) + (excess * weight[s] / sum(weight[x] for x in below) if s in below else 0) for s in names}
    return target


def check_mix(given, got):
    sizes = Counter()
    for _, text, source in given:
        sizes[source] += len(words_of(text))
    want = targets_by_hand(sizes)
    assert sorted(((k, n, s) for k, n, _, _, _, s in got), key=repr) == sorted(((k, len(words_of(t)), s) for k, t, s in given), key=repr)
    held = Counter()
    for _, size, source_size, target, n, source in got:
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and 0 <= n <= 3 * size
        held[source] += n
    assert all(abs(held[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


@pytest.mark.parametrize("block, shard, bucket", [(1024, 4096, 20_000), (7, 16, 13), (1, 5, 3)])
def test_mixing_against_targets(spark, texts, block, shard, bucket, monkeypatch):
    from veritome.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET", bucket)
    given = [(k, t, s) for k, t, _, s in texts]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = rows(mixing.taken(docs.repartition(3), block=block, shard=shard))
    check_mix(given, got)
    again = rows(mixing.taken(docs.orderBy(docs.text).repartition(5), block=block, shard=shard))
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert len({n / s for _, s, _, _, n, x in got if s and x == "a"}) > 1 or block == 1024


def test_mixture_holds_what_is_taken(spark, texts):
    from veritome.llm import mixing

    given = [(k, " ".join(f"{k}:{i}" for i in range(len(words_of(t)))), s) for k, t, _, s in texts]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(4)
    got = rows(mixing.mixture(docs, block=9, shard=20))
    used = Counter(w.split(":")[0] for *_, text in got for w in text.split())
    assert used == Counter({str(k): n for k, _, _, _, n, _ in rows(mixing.taken(docs, block=9, shard=20)) if n})
    assert all(n == len(text.split()) and n <= 9 for *_, n, text in got)
    assert max(Counter((s, b) for _, _, s, _, b, _, _ in got).values()) <= 4 and {t for _, _, _, t, *_ in got} <= {0, 1, 2, 3}
    per_shard = Counter(s for s, *_ in got)
    assert set(per_shard[s] for s in range(max(per_shard))) == {20} and all(sorted(p for s, p, *_ in got if s == i) == list(range(1, n + 1)) for i, n in per_shard.items())


def test_permutations_are_whole():
    import numpy as np

    from veritome.llm.mixing import permuted

    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        x = permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(x.tolist()) == list(range(n))
        if n > 60:
            assert x.tolist() != permuted(np.arange(n), np.full(n, n), np.full(n, 78, np.uint64)).tolist()
            assert np.mean(np.abs(np.diff(x))) > n / 5


def test_mixing_odd_rows(spark, odd, empty):
    from veritome.llm.mixing import mixture, taken

    check_mix([(r[0], r[1], r[3]) for r in ODD], rows(taken(odd)))
    assert rows(taken(empty)) == [] and rows(mixture(empty)) == []
    bare = odd.where("doc_id <= 2")
    assert {r[4] for r in rows(taken(bare))} == {0} and rows(mixture(bare)) == []
    assert taken(odd.withColumnRenamed("doc_id", "number"), key="number").count() == len(ODD)
    assert mixture(odd).where("n_words <> size(split(text, ' '))").count() == 0

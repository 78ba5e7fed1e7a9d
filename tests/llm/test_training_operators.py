"""Each operator on odd rows, and against brute force on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

LONG = "The quick brown fox, and so on. " * 2000
ROWS = [
    (None, None, None, "x", 1.0), (1, None, "en", "x", 1.0), (2, "", "en", "x", 1.0), (3, "one", None, "x", 1.0), (3, "one", None, "x", 1.0), (4, "A b  c\td\n\n é ü 123 a.b,c!", "de", "x", 1.0),
    (5, LONG, "en", "x", 1.0), (6, LONG, "en", "x", 1.0), (6, "another text under the same key", "en", "x", 1.0), (None, "text without a key", "xx", "x", 1.0), (7, "idiot " * 30 + "and scum", "en", "x", 1.0),
    (8, "=" * 5000, "en", "x", 1.0), (9, "日本語のテキスト 😀 " * 40, "ja", "x", 1.0),
]
#: Further columns carry names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, key string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(1, 10)] + [(None, 1, 1), (7, 0, 1), (7, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus(spark):
    """Invented prose with copies, near copies and shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))
        if i % 5 == 0:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        if i % 7 == 3:
            text = texts[i - 3]
        if i % 11 == 6:
            cut = rng.randrange(max(1, len(texts[i - 4])))
            text = texts[i - 4][:cut] + "X" + texts[i - 4][cut + 1 :]
        texts.append(text)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1: byte-level BPE


def test_bpe_against_library(spark, docs, empty):
    import tiktoken

    from veritome.llm.bpe import encode_decode, load_ranks

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    got = sorted(map(repr, rows(encode_decode(docs, path, tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"))))
    want = []
    for k, t, *_ in ROWS:
        ids = library.encode_ordinary(t or "")
        want.append(repr((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids)))
    assert got == sorted(want)
    assert rows(encode_decode(empty, path, tokenizers.PATTERN)) == []


def test_bpe_random_text_and_long_pieces():
    import tiktoken

    from veritome.llm.bpe import Coder, load_ranks

    ranks = load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder, rng = Coder(ranks, tokenizers.PATTERN), random.Random(1)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    samples = ["".join(rng.choice(" \n\t\x1c\x85aabbé'st1,.😀") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["ab" * 20000, "a" * 30000]
    for text in samples:
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:60]
        assert coder.decode(ids) == text.encode()
    assert not coder.queue.words or not any(coder.queue.words)


# 2: quality


def kneser_ney(texts, order):
    """By the definition: the probability of a character after those before it, and of a text's perplexity."""
    padded = ["\0" * (order - 1) + t for t in texts]
    counts = {order: Counter(t[i : i + order] for t in padded for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        y = n1 / max(1, n1 + 2 * n2)
        raw = 1 - 2 * y * n2 / max(1, n1), 2 - 3 * y * n3 / max(1, n2), 3 - 4 * y * n4 / max(1, n3)
        discounts[k] = [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        after = [v for g, v in counts[k].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        d, n = discounts[k], counts[k][gram]
        return ((n - d[min(n, 3) - 1] if n else 0) + sum(d[min(v, 3) - 1] for v in after) * p(gram[1:])) / sum(after)

    def perplexity(text):
        t = "\0" * (order - 1) + text
        return math.exp(-sum(math.log(p(t[i : i + order])) for i in range(len(text))) / len(text))

    return p, perplexity


def test_quality_odd_rows(spark, docs, empty, labels):
    from veritome.llm.quality import classify

    got = rows(classify(docs, labels).select("doc_id", "perplexity", "keep"))
    assert len(got) == len(ROWS)
    assert all(not keep and p is None for k, p, keep in got if k in (1, 2))
    assert rows(classify(empty, labels)) == []
    assert {k for _, _, k in rows(classify(docs, labels.where("false")).where("perplexity is not null").select("doc_id", "lang", "keep"))} == {True}


def test_quality_held_out(spark):
    from veritome.llm.queries import op2_quality

    d = "/root/testdata/sf0.01"
    found = op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("quality", "keep").collect()
    assert sum(not r.keep for r in found if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in found)
    assert sum(r.keep for r in found if r.quality == 1) >= 0.9 * sum(r.quality == 1 for r in found)


def test_quality_tells_letters_of_any_script_apart(spark):
    from veritome.llm.quality import classify

    texts = [(i, "春眠暁を覚えず処処啼鳥を聞く夜来風雨の声。" * 3, "ja") for i in range(40)] + [(100, "花落知多少山水画図中月白烏鳴霜満天江楓漁火。" * 3, "ja"), (101, "春眠暁を覚えず", "ja")]
    got = {r.doc_id: r for r in classify(spark.createDataFrame(texts, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).collect()}
    assert got[100].perplexity > 10 * got[0].perplexity and not got[100].keep and got[0].keep


@pytest.mark.parametrize("block", [16_000_000, 30])
def test_kneser_ney_by_definition(spark, monkeypatch, block):
    from veritome.llm import quality

    monkeypatch.setattr(quality, "BLOCK", block)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdé日本 .", [30, 20, 10, 5, 3, 2, 2, 9, 1], k=60)) for _ in range(9)] + ["q", "never seen: 語", None, ""]
    df = spark.createDataFrame([(i, x, "xx" if i % 2 else None) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    model = quality.train(df.where("doc_id < 6"), order=3)
    p, ppl = kneser_ney(texts[:6], 3)
    letters = sorted({c for t in texts[:6] for c in t})
    assert math.isclose(sum(p("ab" + c) for c in [*letters, "never seen"[:1]]), 1, rel_tol=1e-9)
    got = {r.key: r.perplexity for r in quality.perplexity(df.selectExpr("doc_id", "text", "'yy' AS lang"), model, order=3).collect()}
    assert got.keys() == set(range(len(texts))) and got[11] is None and got[12] is None
    for i, t in enumerate(texts):
        if t:
            assert math.isclose(got[i], ppl(t), rel_tol=1e-6)
    own = kneser_ney(texts[1:6:2], 3)[1]
    assert all(math.isclose(r.perplexity, own(texts[r.key]), rel_tol=1e-6) for r in quality.perplexity(df.where("lang = 'xx' and text <> ''"), model, order=3).collect())


def test_thresholds_are_one_rule_for_all_lengths(spark):
    from veritome.llm.quality import thresholds

    rng = random.Random(3)
    sizes = [rng.choice((20, 50, 100, 400, 2000)) for _ in range(4000)]
    seen = [("en", n, math.exp(1 + 5 / n + rng.gauss(0, 0.02 + 2 / math.sqrt(n)))) for n in sizes] + [("one", 10, 3.0)]
    got = {r.lang: r for r in thresholds(spark.createDataFrame(seen, "lang string, n_chars long, perplexity double"), "lang").collect()}
    assert abs(got["en"].m0 - 1) < 0.05 and abs(got["en"].s1 - 2 * math.sqrt(2 / math.pi)) < 0.3 and 2.8 < got["en"].z < 3.8
    assert math.isclose(got["one"].m0, math.log(3)) and got["one"].z == 0


# 3: neighbours


def test_neighbours_recall_and_ties(spark):
    from pyspark.sql import functions as F

    from veritome.llm.neighbours import nearest

    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    x[100:200] = x[100]  # copies
    data = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(700, None, "c"), (701, [0.0] * 16, "c"), (702, [float("nan")] * 16, "c"), (703, [1.0, None] + [1.0] * 14, "c"), (704, [1.0, 2.0], "c"), (None, [1.0] * 16, "c"), (5, x[5].tolist(), "c")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    got = {}
    for q, rank, i, s in rows(nearest(df, F.col("vec_id") % 20 == 0, k=10)):
        got.setdefault(q, []).append((rank, i, s))
    hit = 0
    for q in range(0, 600, 20):
        order = sorted((-float((x[q] * v).sum()), i) for i, v in enumerate(x) if i != q)[:10]
        found = [i for _, i, _ in sorted(got[q])]
        hit += len(set(found) & {i for _, i in order})
        if q == 100:
            assert found == list(range(101, 111))
    assert set(got) == set(range(0, 600, 20))
    assert hit >= 0.9 * 300
    assert rows(nearest(df.where("false"), F.lit(True))) == []


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e25, "mixed"])
def test_neighbours_recall_at_any_scale(spark, scale):
    from pyspark.sql import functions as F

    from veritome.llm.neighbours import nearest

    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 32)) * (10.0 ** rng.integers(-30, 26, (1500, 1)) if scale == "mixed" else scale)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nearest(df, F.col("vec_id") % 20 == 0).collect()}
    want = {(q, int(i)) for q in range(0, 1500, 20) for i in np.argsort(np.where(np.arange(1500) == q, -np.inf, x @ x[q]))[::-1][:20]}
    assert len(got) == 75 * 20 and len(got & want) >= 0.95 * len(want)


def test_neighbours_ties_of_different_vectors_go_to_smaller_ids(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veritome.llm import neighbours

    monkeypatch.setattr(neighbours, "SHARD_ROWS", 50)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 2)
    data = [(i, [1.0, float(i)]) for i in range(200)] + [(300 + i, [1.0, 2.0, float(i)]) for i in range(3)]
    df = spark.createDataFrame([(i, [v[0], 0.0, *v[1:]] if i == 0 else [v[0], 0.0, v[1], 0.0] if i < 300 else v) for i, v in data], "vec_id long, embedding array<double>")
    ones = df.where("vec_id < 300 and vec_id > 0").unionByName(spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], df.schema)).unionByName(df.where("vec_id >= 300"))
    got = [r.vec_id for r in sorted(neighbours.nearest(ones, F.col("vec_id") == 0, k=7).collect(), key=lambda r: r["rank"])]
    assert got == [1, 2, 3, 4, 5, 6, 7]
    assert {(r.query_id, r.vec_id) for r in neighbours.nearest(ones, F.col("vec_id") == 301).collect()} == {(301, 300), (301, 302)}


# 4: decontamination


def words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination_against_brute_force(spark, docs, corpus, empty, monkeypatch):
    from veritome.llm import decontaminate
    from veritome.llm.decontaminate import contamination, decontaminated

    texts = dict(corpus.collect())
    items = [(1, " ".join(texts[5].split()[5:40])), (2, "abc"), (3, None), (4, "!!"), (None, texts[5]), (10, texts[8].upper()), (10, texts[8].upper()), (11, "ONE"), (12, "brown fox and so on the quick brown fox and so on the quick brown")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {(str(k), tuple(w[s : s + 13])) for k, t in items if k is not None and (w := words(t)) for s in range(max(1, len(w) - 12))}
    for table in (corpus, docs):
        got = Counter(rows(contamination(table, bench)))
        want = Counter()
        for r in table.collect():
            w, hit, found = words(r.text), set(), set()
            for k, g in windows:
                for s in range(len(w) - len(g) + 1):
                    if tuple(w[s : s + len(g)]) == g:
                        hit |= set(range(s, s + len(g)))
                        found.add(k)
            want[(r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
        assert got == want
    assert rows(contamination(empty, bench)) == []
    assert all(not r[-1] for r in rows(contamination(corpus, bench.where("false"))))
    clean = {r.doc_id for r in decontaminated(corpus, bench).collect()}
    told = Counter(rows(contamination(corpus, bench)))
    assert clean == {r[0] for r in told if not r[-1]}
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)  # both joins shuffle
    assert Counter(rows(contamination(corpus, bench))) == told


def test_decontamination_plan_is_native(spark, corpus):
    from veritome.llm.decontaminate import contamination

    plan = contamination(corpus, corpus.limit(3).withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 5: SimHash


def simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= radius:
                    label[i], changed = label[j], True
    return label


def test_simhash_against_brute_force(spark, corpus, docs, empty):
    from veritome.llm.simhash import keep_one, near_duplicates

    data = sorted(corpus.collect())
    fps = [simhash(t) for _, t in data]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(corpus).collect()}
    label = components(fps, 2)
    assert got == {k: (f"{f:016x}", data[c][0]) for (k, _), f, c in zip(data, fps, label)}
    assert {r.doc_id for r in keep_one(corpus).collect()} == {data[c][0] for c in label}
    odd = near_duplicates(docs).collect()
    assert len(odd) == len(ROWS)
    assert {r.component_id for r in odd if r.doc_id in (1, 2)} == {1}
    kept = sorted((r.doc_id or -1, r.text or "") for r in keep_one(docs).collect())
    assert (3, "one") in kept and kept.count((3, "one")) == 1 and (6, LONG) not in kept
    assert sum(k == -1 for k, _ in kept) == 2
    assert rows(near_duplicates(empty)) == []
    clashing = docs.selectExpr("*", *(f"'c' AS {x}" for x in ("key__", "h__", "text__", "h", "fp", "component_id")))
    assert keep_one(clashing).columns == clashing.columns and keep_one(clashing).count() == len(kept)
    named = near_duplicates(docs.selectExpr("concat('d', doc_id) AS doc_id", "text")).collect()
    assert {r.component_id for r in named if r.doc_id in ("d1", "d2")} == {"d1"}


def test_forest_connects_what_links_connect():
    from veritome.llm.simhash import forest

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) for _ in range(4)]))
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in forest(fps, None):
        parent[find(a)] = find(b)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    for i, j in zip(*np.nonzero(near)):
        assert find(int(fps[i])) == find(int(fps[j]))
    assert len({find(int(x)) for x in fps}) >= 300


def test_connected_components_of_chains_and_stars(spark):
    from veritome.llm.graph import connected_components

    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(300, 340)] + [(1, 1), (None, 2), (500, 499), (499, 500)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in [7, *range(300, 340)]}, 499: 499, 500: 499}


# 6: HTML


def test_html_main_text(spark):
    from veritome.llm.html_text import extract, main_text

    page = """<html><head><title>T</title></head><body><div id="header">Site <a href=/>home</a></div><div class="menu"><a href=1>One</a><a href=2>Two</a></div><div class="content"><h2>Heading</h2>
    <p>First paragraph of the story, long enough to count as real text &eacute;&nbsp;x.</p><p>Short.</p><p>Second paragraph with a <a href=x>link</a> in it, and more words.</p></div><div class="comments"><p>A comment that is rather long and is not the article at all.</p></div><form>Search</form><div class=footer>(c)</div>"""
    assert main_text(page) == "Heading\n\nFirst paragraph of the story, long enough to count as real text é x.\n\nShort.\n\nSecond paragraph with a link in it, and more words."
    assert main_text('<nav>a</nav><article><header>h<h1>own</h1></header><p>x &amp; y<br>z<script>"</p>"</script><aside>no</aside></article><footer>f') == "own\n\nx & y z"
    assert [main_text(x) for x in (None, "", "<", "plain", "<p>a", "<article></article>")] == ["", "", "<", "plain", "a", ""]
    df = spark.createDataFrame([(1, "u", None, "n"), (1, "u", None, "n"), (None, None, "<p>x</p>" * 20000, "n")], "page_id long, url string, html string, text string")
    got = sorted(rows(extract(df)), key=str)
    assert len(got) == 3 and got[0][2:] == ("", 0) and got[2][3] == 20000 * 3 - 2
    assert rows(extract(df.where("false"))) == []


STORY = "<p>First paragraph of the story, long enough to count as real text, with commas.</p><p>Short.</p><p>Second paragraph with more words in it, and still more of them to read.</p>"
MENU = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
PAGES = {
    "a sidebar beside": f'<div class="content has-sidebar"><h2>H</h2>{STORY}</div><div class=sidebar>About us and a long text that is no article at all, is it.</div>',
    "side by side": f'<div class="side-by-side"><h2>H</h2>{STORY}</div>',
    "one form around all": f'<body><form id="aspnetForm"><div class=menu>{MENU}</div><div id=main-content><h2>H</h2>{STORY}</div><div id=footer>(c)</div></form>',
    "nav without end": f"<body><nav>{MENU}<article><h2>H</h2>{STORY}</article>",
    "own header by name": f'<div class=post><div class="post-header"><h2>H</h2></div>{STORY}</div>',
    "own header": f"<header><h1>Site</h1></header><article><header><h2>H</h2><p>By N. N.</p></header>{STORY}<footer>Tags</footer></article>",
    "no containers": f"<body><div id=header>Site</div><div class=nav>{MENU}</div><h2>H</h2>{STORY}<div class=footer>(c) 2020 some site with a notice of rights, and an address</div></body>",
    "more comments than article": f"<div class=content><h2>H</h2>{STORY}</div><section id=comments>" + "<article class=comment><p>A comment that is rather long and isn't the article at all, at all.</p></article>" * 9 + "</section>",
    "comments in the main part": f"<main><article><h2>H</h2>{STORY}</article><div class='comment-list'><p>A comment that is rather long and isn't the article.</p></div></main>",
    "table": f"<table><tr><td class=nav>{MENU}</td><td><h2>H</h2>{STORY}</td></tr></table>",
    "notice and aside": f'<div class="cookie-notice"><p>We use cookies and similar things on this web site to make it better for you, the reader.</p></div><div><h2>H</h2>{STORY}</div><aside><p>Related news item about a thing that went on for a while.</p></aside>',
    "adverts inside": "<article><h2>H</h2>" + STORY.replace("<p>Short.", "<div class=ad>Buy</div><div class='ad-box'>More</div><div class=ad>x</div><p>Short.") + "</article>",
    "ends of nothing": "</div></span>" * 50 + f"<div><h2>H</h2>{STORY}</span></b></div></section>",
}


@pytest.mark.parametrize("name", PAGES)
def test_html_of_many_makes_gives_the_article(name):
    from veritome.llm.html_text import main_text

    assert main_text(PAGES[name]) == "H\n\nFirst paragraph of the story, long enough to count as real text, with commas.\n\nShort.\n\nSecond paragraph with more words in it, and still more of them to read."


def test_html_time_grows_with_the_page():
    import time

    from veritome.llm.html_text import main_text

    began = time.perf_counter()
    assert main_text("<div>" * 100_000 + "x" + "</span>" * 100_000) == "x"
    assert main_text("<b>" + '<div class="a b-c">t' * 50_000)
    line = "text of a line that is long enough to stand for an article "
    assert main_text("<article>" + f"<div>{line}" * 50_000).count("\n\n") == 49_999
    assert time.perf_counter() - began < 60


# 7: token files


def test_simple8b_round_trip():
    from veritome.llm.token_files import BLOCK, pack, unpack

    rng = np.random.default_rng(0)
    for n in (0, 1, 61, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7):
        for top in (0, 1, 300, 50_000, 1 << 33, (1 << 64) - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            payload = pack(ids)
            assert (unpack(payload) == ids).all()
            for b in range(-(-n // BLOCK)):
                assert (unpack(payload, b) == ids[b * BLOCK : (b + 1) * BLOCK]).all()


def test_token_files_against_library(spark, docs, empty):
    from tokenizers import Tokenizer

    from veritome.llm.token_files import round_trip

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [*ROWS, (4, "a <|endoftext|> b", "en", "x", 1.0), (10, "x<|startoftext|>y<|endoftext|><|ENDOFTEXT|>'s<|endoftext|", "en", "x", 1.0), (11, "after", "en", "x", 1.0)]
    got = sorted(rows(round_trip(spark.createDataFrame(odd, SCHEMA), path)), key=lambda r: r[1])
    want, start = [], 0
    for k, t, *_ in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert rows(round_trip(empty, path)) == []
    named = spark.createDataFrame([("b", "two"), ("a", "one"), (None, None)], "doc_id string, text string")
    assert [r[0] for r in sorted(rows(round_trip(named, path)), key=lambda r: r[1])] == [None, "a", "b"]


def test_long_stretches_are_encoded_but_never_remembered():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from veritome.llm.bpe import LONGEST, Coder, load_ranks
    from veritome.llm.token_files import WordTokenizer

    rng = random.Random(8)
    texts = ["".join(rng.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(4000)) for _ in range(30)] + ["a b a"]
    with open(tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = WordTokenizer(f.read())
    library = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        ids, lengths = coder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
        assert len(coder.known) == 3 and len(coder.ids) == 2 and coder.known.nbytes < 1000
    coder = Coder(load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), tokenizers.PATTERN)
    for t in texts:
        coder.encode(t)
    assert max(map(len, coder.known)) <= LONGEST and coder.held < 10_000


# 8: repeated substrings


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mark = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                mark[i : i + length] = 1
        kept = bytes(np.frombuffer(d, np.uint8)[mark[:-1] == 0])
        out.append((len(d), int(mark.sum()), int((np.diff(np.concatenate(([0], mark))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("many", "splits"), [(2000, None), (1, None), (1, 3)])
def test_substrings_against_brute_force(spark, corpus, docs, empty, monkeypatch, many, splits):
    from veritome.llm import substrings

    monkeypatch.setattr(substrings, "MANY", many)
    if splits:  # hot anchors are split and their parts sorted, however many
        by_blocks = substrings._by_blocks

        def sorted_blocks(*args):
            monkeypatch.setattr(substrings, "MANY", 1000)
            return by_blocks(*args)

        monkeypatch.setattr(substrings, "_by_blocks", sorted_blocks)
        monkeypatch.setattr(substrings, "SHARD_BYTES", 5000)
    for table in (corpus, docs.withColumn("text", docs["text"].substr(1, 3000))):
        data = table.select("doc_id", "text").collect()
        want = Counter((r.doc_id, *x) for r, x in zip(data, brute_repeats([r.text for r in data])))
        monkeypatch.setattr(substrings, "MANY", many)
        assert Counter(rows(substrings.dedup(table))) == want
    assert rows(substrings.dedup(empty)) == []


def test_without_repeats_keeps_rows_and_columns(spark, docs):
    from veritome.llm.substrings import without_repeats

    clashing = docs.selectExpr("*", *(f"'c' AS {x}" for x in ("id", "of__", "found__", "spans__", "SPANS", "a")))
    assert without_repeats(clashing).columns == clashing.columns
    assert without_repeats(clashing).where("spans__ = 'c' and of__ = 'c'").count() == len(ROWS)
    got = without_repeats(docs)
    assert got.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in got.collect())
    assert sum(texts.values()) == len(ROWS) and texts[(5, "")] == 1 and texts[(1, None)] == 1 and texts[(3, "one")] == 2


def test_suffix_array_and_common_prefixes():
    from veritome.llm.suffix import permuted_lcp, suffix_array

    rng = np.random.default_rng(1)
    deepest = 0
    for turn in range(200):
        s = np.concatenate([rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), [0]])
        if turn % 2:  # repeats of repeats need the names of names
            some = np.concatenate([np.tile(s[:-1][:7], 3), s[:-1]])
            s = np.concatenate([np.tile(some, 3), s])
        plain, levels = s.tolist(), []
        sa = suffix_array(s, levels)
        deepest = max(deepest, len(levels))
        assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        lcp = permuted_lcp(s.astype(np.uint8), sa, np.arange(len(s), 0, -1))
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = 0
            while n < min(len(plain) - a, len(plain) - b) and plain[a + n] == plain[b + n]:
                n += 1
            assert lcp[b] == n
    assert deepest >= 3


# 9: toxicity


def test_automaton_finds_words_stems_and_one_edit():
    from veritome.llm.toxicity import Lexicon

    lexicon = Lexicon([("moron", False, 2.0), ("scum", False, 1.0), ("lowei", True, 3.0)])
    edits = {"moron": (2.0, 0.0), "mroon": (0.0, 2.0), "morn": (0.0, 2.0), "moroon": (0.0, 2.0), "noron": (0.0, 2.0), "morox": (0.0, 2.0), "scun": (0.0, 0.0), "loweient": (3.0, 0.0), "lowe": (0.0, 0.0), "loweX": (0.0, 0.0), "loveient": (0.0, 3.0), "lwoei": (0.0, 3.0)}
    assert {w: lexicon.find(w) for w in edits} == edits


def test_automaton_against_a_table_of_distances():
    from veritome.llm.toxicity import FUZZY_LENGTH, Lexicon

    def distance(a, b):
        """Letters more, less, other, or two neighbours that change places."""
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
                if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    def begins(w, t):
        """Some beginning of ``w`` is the stem but for one edit, the stem's last letter standing, or changing places."""
        return any(w[j - 1] == t[-1] and distance(w[: j - 1], t[:-1]) <= 1 for j in range(1, len(w) + 1)) or w[: len(t)] == t[:-2] + t[-1] + t[-2]

    rng = random.Random(11)

    def word(least, most):
        return "".join(rng.choice("abcé") for _ in range(rng.randint(least, most)))

    for _ in range(60):
        terms = list({t: (t, stem, float(rng.randint(1, 9))) for t, stem in ((word(2, 8), rng.random() < 0.3) for _ in range(12))}.values())
        lexicon = Lexicon(terms)
        words = [word(1, 9) for _ in range(60)]
        for t, _, _ in terms:
            at, c = rng.randrange(len(t)), rng.choice("abcé")
            words += [t, t[:at] + t[at + 1 :], t[:at] + c + t[at:], t[:at] + c + t[at + 1 :], t + word(1, 3), t[:at] + t[at : at + 2][::-1] + t[at + 2 :], t[:at] + c + t[at + 1 :] + word(1, 3), t[:at] + t[at : at + 2][::-1] + t[at + 2 :] + word(1, 3)]
        for w in words:
            exact = max([x for t, stem, x in terms if (w.startswith(t) if stem else w == t)], default=0.0)
            near = max([x for t, stem, x in terms if len(t) >= FUZZY_LENGTH and (begins(w, t) if stem else distance(t, w) == 1)], default=0.0)
            assert lexicon.find(w) == (exact, 0.0 if exact else near), (w, terms)


def test_quotation_counts_less():
    from veritome.llm.toxicity import Lexicon, Scanner

    scan = Scanner(Lexicon([("idiot", False, 2.0)]))
    plain, quoted = scan.features("you are an idiot today"), scan.features('he wrote "idiot" in the report')
    assert plain[0] > quoted[0] and quoted[3] > plain[3]


def test_toxicity_reaches_edits_signs_and_drawn_out_words():
    from veritome.llm.toxicity import Lexicon, Scanner

    scan = Scanner(Lexicon([("moron", True, 2.0), ("idiot", False, 3.0), ("asshole", False, 2.5)]))
    for word in ("idoit", "iidot", "ideeot", "idiooot", "id1ot", "1d10t", "morrons", "m0ron", "m.oron,", "(morno)", "a$$hole"):
        assert scan[word] and not scan[word][0] and scan[word][1] > 0, word
    assert scan["idiot!"][0] == 3.0 and scan["morons"][0] == 2.0
    for word in ("patriot", "mormon's"[:3], "idol", "2020", "10", "-", ""):
        assert scan[word] is None, word
    assert scan["abmoron" * 100_000] is None and scan["moron" * 100_000][0] == 2.0  # long chunks are searched whole, and not remembered
    assert "moron" * 100_000 not in scan


def test_toxicity_odd_rows_and_held_out(spark, docs, empty, labels):
    from veritome.llm.toxicity import fit, held_out, keep_clean, score

    model = fit(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert rows(score(empty, model)) == [] and fit(empty, labels).terms == []
    assert keep_clean(docs, model).count() == sum(r.predicted == 0 for r in got)
    d = "/root/testdata/sf0.1"
    full, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = score(full, fit(full, known)).join(known, "doc_id").where(held_out("doc_id")).select("toxic", "predicted").collect()
    assert sum(r.predicted for r in found if r.toxic) >= 0.9 * sum(r.toxic for r in found)
    assert sum(r.predicted for r in found if not r.toxic) <= 0.01 * len(found)


# 10: chat


def test_chat_piece_sees_the_empty_line_that_ends_the_one_before(spark, monkeypatch):
    from veritome.llm import chat

    texts = ["User: how do I sort a list?", "Assistant: you can call sorted on it.", "", "", "and in reverse?", "does that copy it?"]
    lines, emissions, cuts, _ = chat._seen("\n".join(texts), False)
    want = []
    for line, cut, s in zip(lines, cuts, chat.viterbi(emissions), strict=True):
        if s % 2 == 0 or not want:
            want.append((chat.ROLES[s // 2], []))
        want[-1][1].append(line[cut:].strip())
    assert [role for role, _ in want] == ["user", "assistant", "user"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "conv_id long, turn long, text string")
    for piece in (1, 2, 3):
        monkeypatch.setattr(chat, "PIECE", piece)
        got = [(r.role, r.text) for r in sorted(chat.turns(df).collect(), key=lambda r: r.turn)]
        assert got == [(role, "\n".join(x)) for role, x in want]


def test_chat_pieces_agree_with_whole_transcripts(spark, monkeypatch):
    from veritome.llm import chat

    rng = random.Random(4)
    data = []
    for conv in range(12):
        for turn in range(rng.randint(1, 9)):
            role = ("User: ", "AI: ")[turn % 2] if rng.random() < 0.8 else "\n"
            data.append((conv, turn, role + "\n".join(f"words {rng.random()}" + "?" * (turn % 2 == 0) for _ in range(rng.randint(1, 3))), "x"))
    data += [(50, 0, None, "x"), (51, 0, "", "x"), (None, 0, "User: x", "x"), (52, None, "User: x", "x"), (53, 0, "User: a\nAssistant: b\n\nHuman: c", "x"), (53, 0, "User: a\nAssistant: b\n\nHuman: c", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, text string, role string")
    want = {}
    for conv in {r[0] for r in data if r[0] is not None and r[1] is not None}:
        text = "\n".join(r[2] or "" for r in sorted((r for r in data if r[0] == conv), key=lambda r: (r[1], r[2] or "")))
        lines, emissions, cuts, _ = chat._seen(text, False)
        path = chat.viterbi(emissions)
        if path:
            want[conv] = [chat.ROLES[s // 2] for i, s in enumerate(path) if s % 2 == 0 or i == 0]
    for piece in (512, 2):
        monkeypatch.setattr(chat, "PIECE", piece)
        got = {}
        for r in sorted(chat.turns(df).collect(), key=lambda r: (r.conv_id, r.turn)):
            got.setdefault(r.conv_id, []).append(r.role)
            assert r.rendered == chat.render(r.role, r.text)
        assert {k: v for k, v in got.items()} == want
    assert want[53][:3] == ["user", "assistant", "user"]
    # one turn number for all rows of a transcript: still in pieces, and in the order of the texts
    monkeypatch.setattr(chat, "PIECE", 4)
    tied = spark.createDataFrame([(1, 0, f"{' ' * (40 - i)}{('User', 'AI')[i % 2]}: {i:03d}") for i in range(40)], "conv_id long, turn long, text string")
    got = [(r.role, r.text) for r in sorted(chat.turns(tied).collect(), key=lambda r: r.turn)]
    assert got == [(("user", "assistant")[i % 2], f"{i:03d}") for i in range(40)]


def test_chat_recovers_roles(spark):
    from veritome.llm.queries import op10_chat

    d = "/root/testdata/sf0.01"
    told = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    got = op10_chat(spark, d).select("conv_id", "turn", "role")
    assert told.join(got, ["conv_id", "turn", "role"]).count() >= 0.95 * told.count()


# all together


def test_every_operator_has_a_query_and_the_pipeline_stages(spark):
    import corpus_pipeline
    from veritome.llm import queries

    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "suffix_dedup", "decontamination", "byte_bpe"]
    assert math.isclose(corpus_pipeline.run(spark, "/root/testdata/sf0.001").count(), 180, abs_tol=60)


def test_pipeline_stages_keep_columns_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, d)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert out.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), d)
    assert last.count() == 0


def test_word_tokenizer_on_random_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from veritome.llm.token_files import WordTokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        coder = WordTokenizer(f.read())
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t'’.,%#aAbBsSdé́İßΣ12<|>-中😀\x85\x1cre") for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["<|endoftext|> a", "b<|endoftext|>'s x<|ENDOFTEXT|>y", "<|startoftext|><|endoftext|>", None]
    ids, lengths = coder.encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_small_tiles_and_small_payloads_give_the_same(spark, corpus, monkeypatch):
    from veritome.llm import simhash, token_files

    path = tokenizers.path("word_bpe_49k.json")
    before = sorted(rows(simhash.near_duplicates(corpus))), sorted(rows(token_files.round_trip(corpus, path)))
    monkeypatch.setattr(simhash, "TILE_ROWS", 2)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(token_files, "PAYLOAD", 50)
    monkeypatch.setattr(token_files, "TEXT_BYTES", 100)
    monkeypatch.setattr(token_files, "KEPT_BYTES", 500)
    assert (sorted(rows(simhash.near_duplicates(corpus))), sorted(rows(token_files.round_trip(corpus, path)))) == before


def test_toxicity_and_bpe_forget_without_effect(spark, docs, labels, monkeypatch):
    from veritome.llm import bpe, toxicity

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = toxicity.fit(docs, labels)
    before = Counter(rows(toxicity.score(docs, model))), Counter(rows(bpe.encode_decode(docs, path, tokenizers.PATTERN, outputs=())))
    monkeypatch.setattr(bpe, "KEPT_BYTES", 800)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 3)
    assert (Counter(rows(toxicity.score(docs, model))), Counter(rows(bpe.encode_decode(docs, path, tokenizers.PATTERN, outputs=())))) == before

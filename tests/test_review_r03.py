"""Cases from the third review."""

import contextlib
import hashlib
import re
import unicodedata

import duckdb
import pandas as pd
import pytest

from veritome.functions import unicode
from veritome.operators import incremental, match_run, planning, postings, relational, snapshot
from veritome.plans import catalog
from veritome.sources import datasources, files
from veritome.streaming import scan_state


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_book_metadata_leaves_text_as_it_is(spark):
    """Equals signs, and what looks like a prefixed attribute, stand in a text as well as in a tag."""
    text = '<p xmlns:dc="x"><dc:title dc:id = "t">token = 1, a b:c=d</dc:title><creator>x =y</creator></p>'
    got = files.book_metadata(spark.createDataFrame([(1, text)], "k int, x string"), "k", "x")
    assert rows(got) == [(1, "creator", "x =y"), (1, "title", "token = 1, a b:c=d")]


def test_cases_where_a_join_turns_into_a_broadcast(spark, tmp_path):
    """Stars and pairs are spread by the same keys; a join that is changed while it runs must not meet another number of partitions in a union."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760"}
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold",)}
    keys = spark.range(0, 4000, 1, 8).selectExpr("if(id % 2 = 0, 'FILE_SHA256', 'EDITION_IDENTIFIER') block_type", "concat('k', id % 40) block_key", "concat('o', id) observation_id", "concat('f', id) file_id", "concat('e', id % 1000) entity_id")
    keys.write.parquet(f"{tmp_path}/keys")
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        # 20 stars of 100 files, 20 blocks of 25 editions in all pairs
        assert match_run.cases(spark.read.parquet(f"{tmp_path}/keys")).count() == 20 * 99 + 20 * 25 * 24 // 2
    finally:
        for c in confs:
            spark.conf.unset(c) if before.get(c) is None else spark.conf.set(c, before[c])


@pytest.mark.parametrize("adaptive", ["-1", "10485760"])
def test_match_run_twice_where_joins_are_planned_as_shuffles(spark, adaptive):
    """The whole query where no join is a broadcast when it is planned, and may or may not become one while it runs."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": adaptive}
    before = {c: spark.conf.get(c, None) for c in confs}
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        assert rows(catalog.queries()["match_run_twice"](spark, "/root/testdata/sf0.001")) == sorted(con.execute(catalog.oracle_sql()["match_run_twice"]).fetchall(), key=str)
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_keys_without_evidence_stand_once(spark):
    """Many titles of a work that say the same don't multiply what its observations are keyed by; cases stay as they are."""
    t = {
        "current": spark.range(20).selectExpr("concat('o', id) observation_id", "concat('f', id) file_id"),
        "fingerprints": spark.sql("SELECT 1 id, 'FILE_OBSERVATION' target_kind, 'o1' target_id, 'FILE_SHA256' kind, 'sha256' algorithm, 'v1' algorithm_version, 's' value WHERE false"),
        "resolution_candidates": spark.range(40).selectExpr("id", "'FILE' subject_kind", "concat('f', id % 20) subject_id", "'WORK' candidate_kind", "concat('w', id % 2) candidate_entity_id", "'AUTO_SAFE' disposition", "'x' evidence_digest"),
        "decisions": spark.sql("SELECT 0L candidate_id, 1 sequence_no, 'DEFER' decision, 'x' evidence_digest"),
        "identifiers": spark.sql("SELECT 1 id, 'EDITION' target_kind, 'e1' target_id, 'isbn' namespace, '9' value"),
        "contributions": spark.range(10).selectExpr("id", "'WORK' target_kind", "concat('w', id % 2) target_id", "'a' agent_id", "'author' role"),
        "assertions": spark.range(100).selectExpr("id", "'WORK' target_kind", "concat('w', id % 2) target_id", "'work.title.normalized' field_name", "'t' value"),
    }
    told, once = match_run.block_keys(t), match_run.block_keys(t, evidence=False)
    assert told.where("block_type = 'AGENT_TITLE'").count() == 20 * 50 and once.where("block_type = 'AGENT_TITLE'").count() == 20
    assert once.where("block_type = 'RESOLVED_WORK'").count() == 20 and once.columns == [c for c in told.columns if c != "evidence_id"]
    assert rows(match_run.cases(told)) == rows(match_run.cases(once)) and match_run.cases(once).count() == 1


def test_volume_sets_fold_names_once(spark):
    """What stands in the plan of the result reads tables of names, parts and sets; no name is folded again there."""
    names = spark.createDataFrame([("p", "a.part1.rar"), ("p", "a.part2.rar"), ("p", "b.zip"), ("p", "c.txt"), ("p", "C.TXT")], "parent string, name string")
    found = planning.volume_sets(names)
    assert rows(found) == sorted([("p", "a", "LISTED", "a.part1.rar", 2), ("p", "b.zip", "LISTED", "b.zip", 1), ("p", "c.txt", "NAME_COLLISION", None, 2)], key=str)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()


def test_listings_of_many_pieces_are_few_tasks(tmp_path):
    """Every piece is read, in a bounded number of tasks."""
    (tmp_path / "a.txt").write_bytes(b"Path = x\n" * 10_000)
    reader = datasources.ListingReader({"path": tmp_path.as_uri(), "bytes_per_partition": "100"})
    tasks = reader.partitions()
    pieces = [f[2:] for t in tasks for f in t.files]
    assert len(tasks) <= datasources.TASKS + 16 and len(pieces) == 900 and sum(b - a for a, b in pieces) == 90_000
    assert sum(1 for t in tasks for _ in reader.read(t)) == 10_000


@pytest.mark.parametrize("name", ["package_candidates", "provider_outcomes", "provider_projections", "consolidation_blockers", "match_scores"])
def test_small_files_that_grow_are_spread(spark, name):
    """What makes much of a small row deals the rows out by number first; a small file was one task."""
    assert "REPARTITION_BY_NUM" in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_provider_matches_tell_shared_brands_once(spark, tmp_path):
    """Parts and suppliers of several brands give a pair once, without an aggregate over all pairs."""
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT i % 40 AS p_partkey, cast(i % 3 AS INTEGER) AS p_size, 'Brand#' || (i % 5 + 1) || (i % 3 + 1) AS p_brand FROM range(400) t(i)")
    con.execute("CREATE TABLE supplier AS SELECT i % 60 AS s_suppkey, cast(i % 17 AS INTEGER) AS s_nationkey FROM range(300) t(i)")
    for t in ("part", "supplier"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    found = catalog.queries()["provider_matches"](spark, str(tmp_path))
    assert rows(found) == sorted(con.execute(catalog.oracle_sql()["provider_matches"]).fetchall(), key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_states_are_told_in_bounded_frames(monkeypatch):
    """A run's end tells its states piece by piece, and writes no run that it hasn't changed."""

    class Map(dict):
        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, key, value):
            written.append(key)
            self[key] = value

        containsKey, getValue = dict.__contains__, dict.__getitem__

    written, scans = [], scan_state.Scans()
    scans.files, scans.runs = Map(), Map({("old",): ("COMPLETED", None, None)})
    monkeypatch.setattr(scan_state, "TOLD", 10)
    none = {"size_bytes": 1, "modified_at": None, "resumed_from": None, "lease_expires_at": None, "status": None, "at": pd.Timestamp("2024-01-01")}
    marks = [("START", "a", None), *(("SEEN", "a", f"f{i}") for i in range(100)), ("FINISH", "a", None), ("START", "b", None), ("FINISH", "b", None)]
    told = pd.DataFrame([{"mark": m, "run_id": r, "relative_path": p, "sequence": i, **none} for i, (m, r, p) in enumerate(marks)])
    frames = list(scans.handleInputRows((0,), iter([told]), None))
    assert sum(len(f) for f in frames) == 200 and max(len(f) for f in frames[:10]) <= 10
    assert ("old",) not in written and all(f[2] == "MISSING" for f in scans.files.values())


def test_evidence_goes_through_joins_as_digests(spark):
    """Rows of evidence hold 32 bytes in place of the text that they are a digest of."""
    made = snapshot._rows(spark.sql("SELECT 1 id, 'x' value"), "ANALYSIS", "s", kind="FILE", subject="id")
    row = made.first()
    assert "material" not in made.columns and bytes(row["told"]).hex() == hashlib.sha256('s\x1f{"id":1,"value":"x"}'.encode()).hexdigest()


def test_text_that_nfkc_leaves_alone_stays_in_the_jvm(spark):
    """Letters with marks that are one character each need no Python; whatever could change goes there, with the same results."""
    stable = [c for c in map(chr, range(0x30000)) if re.match(f"[{unicode.STABLE}]", c)]
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    assert all(nfkc(c) == c and not unicodedata.combining(c) and (c.isascii() or not c.isspace()) for c in stable)
    assert nfkc("".join(stable)) == "".join(stable) and nfkc("".join(stable[::-1])) == "".join(stable[::-1])
    texts = ["Stra\u00dfe  \u00c9t\u00e9\t\u00f1", "".join(stable), "e\u0301 \ufb01", "\ufeffa\u00a0b", "\u1100\u1161 x", "\U0001d400\u3000y", "a\u0085b", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = frame.select("i", unicode.normal_text(frame.x).alias("n"), unicode.is_stable(frame.x).alias("s")).collect()
    assert [r.n for r in sorted(got)] == [None if t is None else unicode.text_rule(t) for t in texts]
    assert [r.s for r in sorted(got)] == [True, True, False, False, False, False, False, True, None]


@pytest.fixture
def deals(monkeypatch):
    """The rows that ``relational.dealt`` was told of, and what the session then said."""
    told, before = [], relational.dealt

    @contextlib.contextmanager
    def seen(spark, rows, per_task=relational.PER_TASK):
        with before(spark, rows, per_task):
            told.append((rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))
            yield

    for module in (incremental, postings, snapshot):
        monkeypatch.setattr(module, "dealt", seen)
    return told


def test_shuffles_follow_the_rows_while_they_are_dealt(spark):
    """More rows are more tasks; the session's settings come back, after an error too."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(c) for c in names]
    with relational.dealt(spark, 101, per_task=10):
        assert spark.conf.get(names[0]) == "11" and spark.range(9).selectExpr("id % 3 k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString().count(", 11)") > 0
    with relational.dealt(spark, 5):
        assert spark.conf.get(names[0]) == before[0]
    with pytest.raises(ValueError), relational.dealt(spark, 10**9):
        raise ValueError
    assert [spark.conf.get(c) for c in names] == before


@pytest.mark.parametrize("name, rows", [("run_lineage", 1500), ("indexed_page", 6000), ("indexed_search", 6000), ("snapshot_analysis", 6000)])
def test_what_is_sorted_is_dealt_by_rows(spark, deals, name, rows):
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert deals and max(n for n, _ in deals) >= rows

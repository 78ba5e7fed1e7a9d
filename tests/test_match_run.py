"""Matching runs: keys from consistent and accepted evidence, cases, carried decisions, the queue."""

import pytest

from veritome.operators import match_run


@pytest.fixture(scope="module")
def typed(spark):
    make = spark.createDataFrame
    return {
        "current": make([(f"o{i}", f"f{i}") for i in range(6)], "observation_id string, file_id string"),
        "fingerprints": make(
            [(1, "o0", "s"), (2, "o1", "s"), (3, "o2", "s"), (4, "o3", "s"), (5, "o3", "other"), (6, "gone", "s"), (7, "o4", None)], "id int, target_id string, value string"
        ).selectExpr("id", "'FILE_OBSERVATION' target_kind", "target_id", "'FILE_SHA256' kind", "'sha256' algorithm", "'v1' algorithm_version", "value"),
        "resolution_candidates": make(
            [(1, "FILE_OBSERVATION", "o0", "EDITION", "e1", "AUTO_SAFE"), (2, "FILE", "f1", "EDITION", "e2", "REVIEW"), (3, "FILE", "f2", "EDITION", "e3", "REVIEW"), (4, "FILE_OBSERVATION", "o3", "EDITION", "e4", "REVIEW"), (5, "FILE", "f0", "WORK", "w1", "AUTO_SAFE"), (6, "FILE", "f1", "WORK", "w2", "AUTO_SAFE"), (7, "FILE", "f2", "WORK", "w2", "AUTO_SAFE")],
            "id int, subject_kind string, subject_id string, candidate_kind string, candidate_entity_id string, disposition string",
        ).selectExpr("*", "'x' evidence_digest"),
        "decisions": make([(2, 1, "REJECT", "x"), (2, 2, "ACCEPT", "x"), (3, 1, "ACCEPT", "old"), (4, 1, "ACCEPT", "x"), (4, 2, "DEFER", "x")], "candidate_id int, sequence_no int, decision string, evidence_digest string"),
        "identifiers": make([(1, "EDITION", "e1", "isbn", "9"), (2, "EDITION", "e2", "isbn", "9"), (3, "EDITION", "e3", "isbn", "9"), (4, "EDITION", "e4", "isbn", "9"), (5, "EDITION", "e1", "asin", None)], "id int, target_kind string, target_id string, namespace string, value string"),
        "contributions": make([(1, "WORK", "w1", "a", "AUTHOR"), (2, "WORK", "w2", "a", "author"), (3, "WORK", "w2", "b", "editor")], "id int, target_kind string, target_id string, agent_id string, role string"),
        "assertions": make([(1, "WORK", "w1", "work.title.normalized", "t"), (2, "WORK", "w2", "work.title.normalized", "t"), (3, "WORK", "w2", "work.title", "u")], "id int, target_kind string, target_id string, field_name string, value string"),
    }


@pytest.fixture(scope="module")
def found(typed):
    return match_run.cases(match_run.block_keys(typed)).cache()


def test_keys(typed):
    got = {}
    for r in match_run.block_keys(typed).collect():
        got.setdefault(r["block_type"], set()).add((r["block_key"], r["observation_id"]))
    assert got["FILE_SHA256"] == {('["s"]', "o0"), ('["s"]', "o1"), ('["s"]', "o2")}  # o3's don't agree
    assert got["EDITION_IDENTIFIER"] == {('["isbn","9"]', "o0"), ('["isbn","9"]', "o1")}  # e3 was accepted on other evidence, e4 put off
    assert got["RESOLVED_WORK"] == {('["w1"]', "o0"), ('["w2"]', "o1"), ('["w2"]', "o2")} and got["AGENT_TITLE"] == {('["a","t"]', f"o{i}") for i in range(3)}
    assert set(got) == {"FILE_SHA256", "EDITION_IDENTIFIER", "AGENT_TITLE", "RESOLVED_EDITION", "RESOLVED_WORK"}


def test_cases(found):
    assert {(r["relation"], r["left_id"], r["right_id"], r["status"]) for r in found.collect()} == {("EXACT_DUPLICATE", "f0", "f1", "CONFIRMED"), ("EXACT_DUPLICATE", "f0", "f2", "CONFIRMED"), ("SAME_EDITION", "e1", "e2", "REVIEW_REQUIRED"), ("SAME_WORK", "w1", "w2", "REVIEW_REQUIRED")}


def test_large_blocks_are_stars(spark, typed):
    many = {**typed, "current": spark.range(300).selectExpr("concat('o', id) observation_id", "concat('f', id) file_id")}
    many["resolution_candidates"] = spark.range(300).selectExpr("cast(id as int) id", "'FILE' subject_kind", "concat('f', id) subject_id", "'EDITION' candidate_kind", "concat('e', id) candidate_entity_id", "'AUTO_SAFE' disposition", "'x' evidence_digest")
    many["identifiers"] = spark.range(300).selectExpr("id", "'EDITION' target_kind", "concat('e', id) target_id", "'isbn' namespace", "'1' value")
    keys = match_run.block_keys(many)
    assert match_run.cases(keys).where("relation = 'SAME_EDITION'").count() == 299
    assert match_run.cases(keys, pairwise=300).where("relation = 'SAME_EDITION'").count() == 300 * 299 // 2


def test_a_second_run_appends_nothing_and_decisions_stay(spark, typed, found):
    keys = list(match_run.IDENTITY)
    none = found.select(*keys).where("false")
    told = lambda df, decision: df.selectExpr(*keys, "timestamp'2024-01-01' decided_at", "1 sequence_no", "'d' decision_id", f"'{decision}' decision")
    new, reused, queue = match_run.run(found, none, told(none, "ACCEPT"), none.selectExpr("*", "0L ordinal"))
    assert (new.count(), reused.count(), sorted(r["ordinal"] for r in queue.collect())) == (4, 0, [0, 1])
    again, _, more = match_run.run(found, new, told(none, "ACCEPT"), queue.select(*keys, "ordinal"))
    assert (again.count(), more.count()) == (0, 0)
    work = found.where("relation = 'SAME_WORK'")
    _, reused, queue = match_run.run(found, none, told(work, "REJECT"), none.selectExpr("*", "7L ordinal"))
    assert [r["relation"] for r in reused.collect()] == ["SAME_WORK"] and [r["relation"] for r in queue.collect()] == ["SAME_EDITION"]
    assert match_run.run(found, none, told(work, "DEFER"), none.selectExpr("*", "0L ordinal"))[2].count() == 2
    # another member changes a block's set of cases, and so what its decisions hold for
    grown = match_run.cases(match_run.block_keys({**typed, "resolution_candidates": typed["resolution_candidates"].unionByName(spark.sql("SELECT 9 id, 'FILE' subject_kind, 'f4' subject_id, 'WORK' candidate_kind, 'w3' candidate_entity_id, 'AUTO_SAFE' disposition, 'x' evidence_digest")), "contributions": typed["contributions"].unionByName(spark.sql("SELECT 9 id, 'WORK' target_kind, 'w3' target_id, 'a' agent_id, 'author' role")), "assertions": typed["assertions"].unionByName(spark.sql("SELECT 9 id, 'WORK' target_kind, 'w3' target_id, 'work.title.normalized' field_name, 't' value"))}))
    changed, reused, _ = match_run.run(grown, new, told(work, "ACCEPT"), none.selectExpr("*", "0L ordinal"))
    assert {r["relation"] for r in changed.collect()} == {"SAME_WORK"} and changed.count() == 3 and reused.count() == 0


def test_empty(typed):
    assert match_run.cases(match_run.block_keys({n: t.where("false") for n, t in typed.items()})).count() == 0

"""Snapshots from typed evidence: scopes, digests that don't depend on order, profiles, odd tables."""

import pytest

from veritome.operators import snapshot
from veritome.plans import snapshot_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def typed(spark):
    return snapshot_queries.tables(spark, SF)


@pytest.fixture(scope="module")
def small(spark):
    """Two items; a review about one's observation, about an earlier one, about the file, and of a failed run."""
    make = spark.createDataFrame
    runs = make([("r1", "A", "COMPLETED", 1), ("r2", "A", "COMPLETED", 2), ("rf", "A", "FAILED", 1), ("x", "B", "COMPLETED", 1)], "id string, scan_root_id string, status string, completed_at int")
    observations = make([("a1", "a", "r1", "a.epub", 1), ("a2", "a", "r2", "d\\a.epub", 1), ("b2", "b", "r2", "b.tar.pdf", 2), ("c2", "c", "r2", "c", 3), ("af", "a", "rf", "a", 1), ("m", "m", "r2", "m.mp3", 9)], "id string, file_id string, scan_run_id string, relative_path string, size_bytes long")
    files = make([("a", "EBOOK"), ("b", "EBOOK"), ("c", "EBOOK"), ("m", "MUSIC")], "id string, media_type string")
    reviews = make([(1, "FILE_OBSERVATION", "a2"), (2, "FILE_OBSERVATION", "a1"), (3, "FILE", "a"), (4, "FILE_OBSERVATION", "af"), (5, "FILE", "b"), (6, None, None), (7, "FILE", "nobody")], "id long, subject_kind string, subject_id string")
    reviews = reviews.selectExpr("*", "'p' AS producer_name", "cast(null as string) AS producer_version", "' d ' AS decision_compatibility_version", "'PENDING' AS state")
    decisions = make([(1, 1, 1), (2, 1, 2)], "id long, review_item_id long, sequence_no int")
    nothing = make([], "file_id string, scan_run_id string"), make([], "id long, target_kind string, target_id string, tool_execution_id string")
    return {"runs": runs, "observations": observations, "files": files, "review_items": reviews, "review_decisions": decisions, "file_scan_events": nothing[0], "fingerprints": nothing[1]}


def states(wide):
    return {r["file_id"]: (r["REVIEW"]["state"], r["REVIEW"]["n"], r["REVIEW"]["digest"]) for r in wide.collect()}


def wide_of(t, run="r2"):
    return snapshot.item_evidence(snapshot.items_of(t["observations"], t["files"], run), snapshot.load(t, run, ["REVIEW"]))


def test_scopes(small):
    got = states(wide_of(small))
    # two decisions of one review, one earlier review, one about the file; the failed run's is out
    assert got["a"][:2] == ("CURRENT", 4) and got["b"][:2] == ("UNSCOPED", 1) and got["c"] == ("MISSING", 0, None) and set(got) == {"a", "b", "c"}
    assert states(wide_of(small, "r1"))["a"][:2] == ("CURRENT", 2)
    assert {r["format_name"] for r in snapshot.items_of(small["observations"], small["files"], "r2").collect()} == {"EPUB", "PDF", "OTHER"}


@pytest.mark.parametrize("run", ["rf", "none"])
def test_only_a_completed_run_has_a_snapshot(small, run):
    with pytest.raises(ValueError):
        snapshot.timeline(small["runs"], run)


def test_digests_know_content_and_not_order(small):
    before = states(wide_of(small))
    assert states(wide_of(small | {"review_items": small["review_items"].repartition(7, "id"), "review_decisions": small["review_decisions"].repartition(3)})) == before
    changed = states(wide_of(small | {"review_items": small["review_items"].selectExpr("id", "subject_kind", "subject_id", "producer_name", "producer_version", "decision_compatibility_version", "CASE WHEN id = 2 THEN 'DECIDED' ELSE state END AS state")}))
    assert changed["a"][2] != before["a"][2] and changed["b"] == before["b"]


def test_two_observations_of_a_file_raise(spark, small):
    twice = small["observations"].unionByName(spark.createDataFrame([("a3", "a", "r2", "x", 1)], small["observations"].schema))
    with pytest.raises(Exception, match="two observations"):
        snapshot.items_of(twice, small["files"], "r2").collect()


def test_profiles_are_different_trimmed_and_bounded(small):
    found, items = snapshot.load(small, "r2", ["REVIEW"]), snapshot.items_of(small["observations"], small["files"], "r2")
    assert [tuple(r) for r in snapshot.profiles(found, items).collect()] == [("REVIEW", ["decision: d"], "NONE")]
    (row,) = snapshot.profiles(found, items, most=0).collect()
    assert row["profiles"] == [] and row["truncation"] == "PROFILE_VERSIONS"


def test_empty_tables(spark, typed):
    none = {n: (t if n in ("runs", "files", "observations") else t.where("false")) for n, t in typed.items()}
    built = snapshot.build(none, "r2")
    assert {(r["coverage"], r["freshness"], r["missing"]) for r in built.components.collect()} == {("NONE", "UNKNOWN", built.items.count())}
    built = snapshot.build(none | {"observations": typed["observations"].where("false")}, "r2")
    assert {(r["coverage"], r["freshness"]) for r in built.components.collect()} == {("COMPLETE", "CURRENT")} and built.items.count() == 0


def test_whole_snapshot_is_sealed(typed):
    one, other = (snapshot.build(typed | {"plans": typed["plans"].where(w)}, "r2") for w in ("true", "id % 90 <> 0"))
    assert one.seal.first() == snapshot.build(typed | {"plans": typed["plans"].repartition(5)}, "r2").seal.first() != other.seal.first()
    listed = {r["component"]: r["profiles"] for r in one.components.collect()}
    assert listed["CALIBRE"] == ["adapter:a2", "library/v1", "parser:p3", "tool:calibre@7"] and "tool:opf@1" in listed["ANALYSIS"]


def test_raw_evidence_is_shuffled_after_it_is_combined(typed):
    plan = snapshot.item_evidence(snapshot.items_of(typed["observations"], typed["files"], "r2"), snapshot.load(typed, "r2"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert "hashpartitioning(file_id" in plan and "partial_sum(lane0" in plan

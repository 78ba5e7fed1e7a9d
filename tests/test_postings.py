"""The stored inverted index: caps, odd values, plans that read little, pages, buckets written anew."""

import json

import pytest

from veritome.operators import postings, search
from veritome.operators.state import COMPONENTS
from veritome.sources.shared import new_path

STATES = ", ".join(f"'CURRENT' AS {c.lower()}_state" for c in COMPONENTS)


@pytest.fixture(scope="module")
def projected(spark):
    items = spark.sql(f"SELECT lpad(cast(id AS string), 4, '0') AS file_id, concat('o', id) AS observation_id, CASE id % 2 WHEN 0 THEN 'EPUB' ELSE 'PDF' END AS format_name, {STATES} FROM range(100)")
    metadata = spark.createDataFrame(
        [("0001", "title", "Crème brûlée"), ("0001", "title", "Crème brûlée"), ("0001", "contributor.1.name", "Crème brûlée"), ("0001", "title", ""), ("0001", "title", None), ("0001", "title", "x" * 4097), ("0001", "title", " 　 "), ("0001", "creator", "nobody"), ("0002", "title", "Brulee of creme"), ("0003", "title", "Creme"), ("0003", "title", "BRÛLÉE"), ("9999", "title", "no item")]
        + [("0005", "title", f"t{i:03}") for i in range(300)] + [(f"{i:04}", "language", "de") for i in range(0, 100, 3)],
        "file_id string, key string, value string",
    )
    findings = spark.createDataFrame([("0001", "a_b"), ("0001", "A_B"), ("0001", ""), ("0001", None), ("0001", "Ärger"), ("0001", "A" * 129)] + [("0006", f"C{i:03}") for i in range(200)], "file_id string, code string")
    return postings.project(items, metadata, findings)


@pytest.fixture(scope="module")
def path(spark, projected):
    at = new_path(spark, "index")
    for name in ("a", "b"):
        postings.store(*projected, at, name, bucket=30)
    return at


def asked(where, **more):
    return search.parse(json.dumps({"version": search.VERSION, "where": where, **more}))


def one(field, operator, value):
    return {"field": field, "operator": operator, "value": value}


def test_caps_and_counters(projected):
    got = {r["file_id"]: (r["metadata_count"], r["finding_count"], r["truncated_count"], r["value_count"]) for r in projected[1].collect()}
    assert got["0001"] == (2, 1, 8, 15) and got["0005"] == (256, 0, 44, 268) and got["0006"] == (1, 128, 72, 141) and got["0007"] == (0, 0, 0, 12) and len(got) == 100
    assert tuple(postings.summary(projected[1]).first())[4:] == (124, "PARTIAL", "VALUE_LIMIT")


@pytest.mark.parametrize(
    "where, files",
    [
        (one("TITLE", "MATCH", "BRULEE creme"), {"0001", "0002"}),  # 0003 has the words in two values
        (one("TITLE", "EQ", "crème BRÛLÉE"), {"0001"}),
        (one("TITLE", "PREFIX", "CRÈME"), {"0001"}),
        (one("TITLE", "MATCH", "t299"), set()),  # beyond the cap
        (one("FINDING_CODE", "EQ", "A_b"), {"0001"}),
        ({"operator": "AND", "children": [one("LANGUAGE", "EQ", "DE"), one("TITLE", "PREFIX", "t25")]}, set()),
        ({"operator": "AND", "children": [one("LANGUAGE", "EQ", "DE"), one("FORMAT", "EQ", "PDF"), {"operator": "OR", "children": [one("TITLE", "MATCH", "creme brulee"), one("FILE_ID", "EQ", "0009"), one("TITLE", "MATCH", "creme")]}]}, {"0003", "0009"}),
    ],
)
def test_conditions(spark, path, where, files):
    assert {r[0] for r in postings.matching(postings.stored(spark, path, "a"), asked(where).where).collect()} == files


def test_same_as_search_over_values(spark, projected, path):
    indexed = search.index(projected[0].select("file_id", "field", "value"))
    for where in (one("LANGUAGE", "EQ", "de"), one("TITLE", "MATCH", "creme brulee"), {"operator": "OR", "children": [one("FORMAT", "EQ", "EPUB"), one("TITLE", "PREFIX", "b")]}):
        q = asked(where)
        assert sorted(search.matching_files(indexed, q.where).collect()) == sorted(postings.matching(postings.stored(spark, path, "a"), q.where).collect())


def test_lookups_are_pushed_to_the_sorted_files(spark, path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    found = postings.matching(postings.stored(spark, path, "a"), asked(one("TITLE", "PREFIX", "b")).where)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,b)" in plan and "EqualTo(field,TITLE)" in plan and "Python" not in plan and "Window" not in plan


def test_pages_end_early_and_go_on(spark, path):
    q = one("LANGUAGE", "EQ", "de")
    first = postings.page(spark, path, "a", asked(q, limit=5))
    assert first == postings.Page([f"{i:04}" for i in range(0, 15, 3)], "0012", 1)
    files, after, turns = [], None, 0
    while True:
        page = postings.page(spark, path, "a", asked(q, limit=9, **({"after_file_id": after} if after else {})))
        files, after, turns = files + page.files, page.after, turns + 1
        if after is None:
            break
    assert files == [f"{i:04}" for i in range(0, 100, 3)] and turns == 4
    assert postings.page(spark, path, "a", asked(one("TITLE", "EQ", "none"))) == postings.Page([], None, 4)
    assert postings.page(spark, path, "a", asked(q, after_file_id="9999")) == postings.Page([], None, 0)


def files_below(spark, path):
    from pyspark.sql import functions as F

    return {r["f"] for r in spark.read.parquet(f"{path}/snapshot=a/postings").select(F.input_file_name().alias("f")).distinct().collect()}


def test_a_bucket_is_written_anew_alone(spark, projected, path):
    values, documents = projected
    before = files_below(spark, path)
    changed = values.selectExpr("file_id", "field", "kind", "CASE WHEN field = 'TITLE' THEN 'Neu' ELSE value END AS value", "CASE WHEN field = 'TITLE' THEN 'neu' ELSE normalized END AS normalized")
    postings.refresh(changed, documents, path, "a", 0)
    spark.catalog.refreshByPath(path)
    after = files_below(spark, path)
    assert {f for f in before if "bucket=0/" not in f} == {f for f in after if "bucket=0/" not in f} and not {f for f in before & after if "bucket=0/" in f}
    assert {r[0] for r in postings.matching(postings.stored(spark, path, "a"), asked(one("TITLE", "EQ", "neu")).where).collect()} == {"0001", "0002", "0003", "0005"}
    assert postings.matching(postings.stored(spark, path, "b"), asked(one("TITLE", "EQ", "neu")).where).count() == 0
    with pytest.raises(ValueError):
        postings.refresh(changed, documents, path, "a", 9)
    with pytest.raises(ValueError):
        postings.refresh(changed, documents.where("file_id <> '0004'"), path, "b", 0)


def test_empty_index(spark, projected):
    at = new_path(spark, "index")
    postings.store(projected[0].where("false"), projected[1].where("false"), at, "none")
    assert postings.page(spark, at, "none", asked(one("TITLE", "EQ", "x"))) == postings.Page([], None, 0)

"""Provider records within bounds, plans' blockers without evidence, and archives as data sources."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from veritome.operators import blockers
from veritome.plans import blocker_queries
from veritome.sources import datasources, files, knowledge

RECORDS = "record_id string, endpoint string, body string, target_id string, kind string"
BINDINGS = "key string, target_ref string"
BOUND = [("openlibrary.work:OL1W", "w-1"), ("openlibrary.edition:OL1M", "e-1"), ("openlibrary.author:OL1A", "a-1"), ("openlibrary.edition:OL2M", "a/path"), ("openlibrary.edition:OL3M", None)]


def outcome(spark, *records, bindings=BOUND):
    df = spark.createDataFrame([(f"r{i}", endpoint, body if body is None or isinstance(body, str) else json.dumps(body), target, "x") for i, (endpoint, body, target) in enumerate(records)], RECORDS)
    found = {r.record_id: r for r in knowledge.mapped(df, spark.createDataFrame(bindings, BINDINGS)).collect()}
    return [found[f"r{i}"] for i in range(len(records))]


def test_records_of_each_kind(spark):
    work, edition, author, only_isbn = outcome(
        spark,
        ("WORK", {"key": "/works/OL1W", "first_publish_date": 1999, "subjects": ["b", "a", "b", ""], "authors": [{"author": {"key": "/authors/OL1A"}}]}, None),
        ("EDITION", {"key": "OL1M", "isbn_13": ["9780306406157", "9780306406158"], "oclc_numbers": ["12", "x"], "works": [{"key": "/works/OL1W"}, 5]}, None),
        ("AUTHOR", {"key": "/authors/OL1A", "name": "é", "alternate_names": None}, None),
        ("IDENTIFIER", {"isbn_10": ["0306406152"]}, "mine"),
    )
    told = lambda r: [(p.projection, p.target_ref, p.name, p.value) for p in r.projections]
    assert told(work) == [("AGENT_CANDIDATE", "a-1", "openlibrary.author", "OL1A"), ("IDENTIFIER", "w-1", "openlibrary.work", "OL1W"), ("VALUE", "w-1", "first_publish_year", "1999"), ("VALUE", "w-1", "subjects", "a"), ("VALUE", "w-1", "subjects", "b")]
    assert edition.truncated and [x[2:] for x in told(edition)] == [("isbn13", "9780306406157"), ("oclc", "12"), ("openlibrary.edition", "OL1M"), ("openlibrary.work", "OL1W")]
    assert ("VALUE", "a-1", "name", "é") in told(author) and ("AGENT_CANDIDATE", "a-1", "openlibrary.author", "OL1A") in told(author)
    assert told(only_isbn) == [("IDENTIFIER", "mine", "isbn10", "0306406152")]


def test_records_that_are_refused(spark):
    cases = {
        "INVALID_RESPONSE": [("EDITION", {"key": "/books/OL1M", "title": 5}, None), ("EDITION", {"key": "/books/OL1M", "publishers": "p"}, None), ("EDITION", {"key": "/works/OL1W"}, None), ("WORK", None, None), ("WORK", "", None), ("WORK", "{", None), ("WORK", "[]", None), (None, "{}", None), ("SEARCH", {"author_name": ["n"]}, None)],
        "NOT_BOUND": [("EDITION", {"key": "OL9M"}, None), ("EDITION", {"key": "OL3M"}, None), ("EDITION", {"key": "OL1M", "works": ["OL9W"]}, None), ("SEARCH", {"key": "OL1W", "editions": {"docs": [{"isbn_10": ["0306406152"]}]}}, "mine")],
        "NOT_CANONICAL": [("EDITION", {"key": "OL1M", "title": " t"}, None), ("EDITION", {"key": "OL1M", "title": "a\nb"}, None), ("EDITION", {"key": "OL2M"}, None), ("EDITION", {"key": "OL9M"}, "file:x")],
    }
    for status, records in cases.items():
        found = outcome(spark, *records)
        assert [r.status for r in found] == [status] * len(records)
        assert not any(r.projections for r in found)


def test_searches_merge_their_children(spark):
    docs = [{"key": "OL1M", "title": "B"}, {"key": "OL1M", "title": "A"}, {"title": "none"}]
    body = {"key": "OL1W", "title": "W", "author_name": ["Y", "X", "Y", "", 5], "subjects": [5], "author_key": ["OL1A"], "editions": {"docs": docs}}
    r, many = outcome(spark, ("SEARCH", body, None), ("SEARCH", {"key": "OL1W", "editions": {"docs": [{"key": "OL1M"}] * 33}}, None))
    assert (r.status, r.truncated, r.findings) == ("MAPPED", True, ["MALFORMED_SEARCH_EDITION"])
    refs = ["openlibrary.work:OL1W", "openlibrary.edition:OL1M"]
    assert [(p.source_refs, p.value) for p in r.projections if p.projection == "AGENT_CANDIDATE"] == [([], "OL1A"), (refs, "X"), (refs, "Y")]
    assert [(p.target_ref, p.value) for p in r.projections if p.projection == "VALUE"] == [("e-1", "A"), ("w-1", "W")]
    assert many.status == "MAPPED" and many.findings == ["SEARCH_EDITIONS_TRUNCATED"] and many.truncated


def test_bounds_cut_and_tell(spark):
    long, many, exact = outcome(spark, ("WORK", {"key": "OL1W", "title": "t" * 513}, None), ("WORK", {"key": "OL1W", "subjects": [f"s{i:02}" for i in range(33)]}, None), ("WORK", {"key": "OL1W", "title": "t" * 512, "subjects": [f"s{i:02}" for i in range(32)]}, None))
    assert [(r.status, r.truncated, len(r.projections)) for r in (long, many, exact)] == [("MAPPED", True, 1), ("MAPPED", True, 33), ("MAPPED", False, 34)]


def test_no_records(spark):
    assert knowledge.mapped(spark.createDataFrame([], RECORDS), spark.createDataFrame([], BINDINGS)).collect() == []


def test_merge_keeps_each_entry_once(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (1, ["c", "a"]), (None, []), (2, None)], "g int, parts array<string>")
    assert {r.g: r.parts for r in knowledge.merged(df, "g", "parts").collect()} == {1: ["a", "b", "c"], None: [], 2: []}


def test_plans_without_evidence_are_blocked(spark):
    parts = blocker_queries._parts(spark, "/root/testdata/sf0.001")
    plans = parts[0].where("plan_id = 1").withColumn("n", F.lit(1)).withColumn("whole", F.lit(True))
    bare = blockers.consolidation_blockers(plans, *(p.limit(0) for p in parts[1:]), blocker_queries._VERSIONS).collect()
    unknown = ["ARCHIVE_RELATIONSHIP_UNKNOWN", "CALIBRE_RELATIONSHIP_UNKNOWN", "CONSOLIDATION_REVIEW_MISSING", "IDENTITY_NOT_ACTIONABLE", "KEEP_PREFERENCE_REVIEW_MISSING", "PRECONDITION_INCOMPLETE", "QUALITY_EVIDENCE_INCOMPLETE", "SIDECAR_RELATIONSHIP_UNKNOWN"]
    assert [(r.blockers, r.status) for r in bare] == [(unknown, "BLOCKED")]
    # a doubled condition, another fingerprint than expected, a doubled review
    one = [p.where("plan_id = 1") for p in parts[1:]]
    clean = lambda *x: blockers.consolidation_blockers(plans, *x, blocker_queries._VERSIONS).first()
    assert clean(*one).blockers == [] and clean(*one).status == "APPROVED_NON_EXECUTABLE"
    assert clean(one[0].unionByName(one[0].where("code = 'SIZE_MATCHES' and role = 'KEEPER'")), *one[1:]).blockers == ["PRECONDITION_INCOMPLETE"]
    assert clean(one[0], one[1], one[2].withColumn("fingerprint", F.lit("g")), one[3]).blockers == ["PRECONDITION_INCOMPLETE"]
    assert clean(*one[:3], one[3].unionByName(one[3].where("review_type = 'KEEP_PREFERENCE'"))).blockers == ["KEEP_PREFERENCE_REVIEW_MISSING", "PRECONDITION_INCOMPLETE"]
    waiting = one[3].withColumn("state", F.lit("DEFERRED"))
    assert clean(*one[:3], waiting).blockers == ["PRECONDITION_INCOMPLETE"]
    assert blockers.consolidation_blockers(plans.limit(0), *one, blocker_queries._VERSIONS).collect() == []


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_listings_in_pieces_of_any_size(spark, tmp_path, size):
    """However a listing is cut, each block is read once and whole."""
    blocks = [(f"d/é{i}.txt", i, i % 3 == 0) for i in range(9)]
    text = "Listing archive: x\n\n" + "".join(f"----------\nPath = {p}\nSize = {n}\n" + ("CRC = AB\n" if c else "") + "junk\n" for p, n, c in blocks)
    (tmp_path / "a.lst").write_text(text)
    (tmp_path / "b.lst").write_text("Path = last\r\nSize = 5")
    (tmp_path / "_c.lst").write_text("Path = hidden\n")
    (tmp_path / "empty.lst").write_text("")
    datasources.register(spark)
    df = spark.read.format("archive_listing").option("bytes_per_partition", size).load(str(tmp_path))
    got = [(r.path, r.size, r.crc) for r in df.orderBy("file", "place").collect()]
    assert got == [(p, str(n), "AB" if c else None) for p, n, c in blocks] + [("last", "5", None)]
    assert [r.path for r in df.where("file = 'b.lst'").collect()] == ["last"] and df.count() == 10
    picked = spark.read.format("archive_listing").option("bytes_per_partition", size).option("prefix", "b").load(str(tmp_path))
    assert [r.path for r in picked.collect()] == ["last"]


def test_tar_files_are_walked_where_they_lie(spark, tmp_path):
    for name, n in (("x/a.tar", 3), ("b.tar", 2)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with tarfile.open(tmp_path / name, "w", format=tarfile.USTAR_FORMAT) as tar:
            for i in range(n):
                info = tarfile.TarInfo(f"m{i}")
                info.size = 700 * i
                tar.addfile(info, io.BytesIO(b"x" * info.size))
    whole = (tmp_path / "b.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[:1300])
    datasources.register(spark)
    df = spark.read.format("tar_members").option("suffix", ".tar").load(f"file://{tmp_path}")
    got = sorted((r.file, r.ordinal, r.path, r.size, r.finding) for r in df.collect())
    bytes_ = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    held = files.tar_members(bytes_.withColumn("name", F.substring_index("path", f"{tmp_path}/", -1)), "name", "content")
    assert got == sorted((r.key, r.ordinal, r.path, r.size, r.finding) for r in held.collect())
    assert {r[0] for r in got} == {"x/a.tar", "b.tar", "cut.tar"} and any(r[4] == "TRUNCATED" for r in got)
    assert df.where(F.col("file").startswith("x/")).count() == 3
    with pytest.raises(Exception, match="FileNotFound|nothing"):
        spark.read.format("tar_members").load(str(tmp_path / "nothing")).collect()

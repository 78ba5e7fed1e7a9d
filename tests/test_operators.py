"""Semantics that the driver's tables hold no cases of."""

import json

import pytest
from pyspark.sql import functions as F

from veritome.functions import scalars, unicode
from veritome.operators import evidence, incremental, inventory, matching, planning, relational, search, state
from veritome.sources import files, sinks
from veritome.streaming.incremental import reconcile_stream, windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(("value", "good"), [("0306406152", True), ("0306406153", False), ("080442957X", True), ("x", False), ("", False)])
def test_isbn10(spark, value, good):
    assert one(spark, scalars.isbn10_valid, value) is good


@pytest.mark.parametrize(("value", "good"), [("9780306406157", True), ("9780306406158", False), ("978030640615", False)])
def test_isbn13(spark, value, good):
    assert one(spark, scalars.isbn13_valid, value) is good


@pytest.mark.parametrize(("a", "b", "n"), [("0" * 16, "f" * 16, 64), ("00000000000000ff", "0" * 16, 8), ("8000000000000000", "0000000000000001", 2), ("zz", "0" * 16, None), (None, "0" * 16, None)])
def test_hamming(spark, a, b, n):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(scalars.hamming64(F.col("a"), F.col("b"))).first()[0] == n


def test_unicode_rules():
    assert unicode.query_value_rule("  ＡＢ Straße ") == "ab strasse"
    assert unicode.agent_key_rule("Brontë, Charlotte") == "charlotte bronte"
    assert unicode.agent_key_rule("A, B, C") == "a b c"
    assert unicode.agent_name_rule("O'Neil, Zoë") == "o'neil zoe"
    assert unicode.title_rule(" The  Ünïque/Book: a_b ") == "the unique book a b"
    assert unicode.identifier_rule("urn:ISBN 978-0_1") == "urnisbn97801"
    assert unicode.identifier_key_rule(" ISBN (978-0)_1 ") == "isbn97801"
    assert unicode.text_rule("﻿a\n b") == "a b"


def test_quick_fingerprint_covers_both_edges(spark):
    body = bytes(range(256)) * 2
    def of(content):
        return spark.createDataFrame([(bytearray(content),)], "c binary").select(scalars.quick_fingerprint(F.col("c"), F.octet_length("c"), edge=8)).first()[0]

    assert of(body) == of(body[:8] + b"x" * (len(body) - 16) + body[-8:])
    assert of(body) != of(body[:-1] + b"x") and of(b"short") != of(b"other")


def test_signature(spark):
    df = spark.createDataFrame([(bytearray(b"PK\x03\x04rest"), "a/b.EPUB"), (bytearray(b"Rar!\x1a\x07\x01\x00"), "x.zip"), (bytearray(b"none"), "x.rar")], "c binary, p string")
    assert [tuple(r[0]) for r in df.select(scalars.archive_signature(F.col("c"), F.col("p"))).collect()] == [("ZIP", ".epub", "MATCHED"), ("RAR5", ".zip", "SIGNATURE_SUFFIX_MISMATCH"), (None, ".rar", "UNKNOWN_SIGNATURE")]


def test_conflicting_values_are_left_out(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    assert rows(relational.consistent_value(df, ["k"], "v")) == [(1, "a")]


def test_unknown_vocabulary_raises(spark):
    df = spark.createDataFrame([("a",), ("z",)], "v string")
    with pytest.raises(Exception, match="outside its vocabulary"):
        relational.vocabulary_counts(df, "v", ("a", "b")).collect()


def test_page_tells_whether_more_follow(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "k int")
    page, more, after = relational.page(df, ["k"], (1,), 2)
    assert (rows(page), more, after) == ([(2,), (3,)], True, (3,))
    assert relational.page(df, ["k"], (2,), 2)[1:] == (False, None)
    with pytest.raises(ValueError):
        relational.at_most(df, 4, "rows")


def test_digest_doesnt_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(200)], "k int, v string")
    a, b = (relational.ordered_digest(df.repartition(n), ["k"]).first()[0] for n in (1, 7))
    assert a == b != relational.ordered_digest(df.where("k < 199"), ["k"]).first()[0]


def test_create_or_get_refuses_other_material(spark):
    old = spark.createDataFrame([(1, "a")], "k int, digest string")
    assert rows(relational.create_or_get(old, spark.createDataFrame([(1, "a"), (2, "b")], old.schema), ["k"])) == [(2, "b")]
    with pytest.raises(Exception, match="conflicting material"):
        relational.create_or_get(old, spark.createDataFrame([(1, "x")], old.schema), ["k"]).collect()


def test_incomplete_scan_marks_nothing_missing(spark):
    records = spark.createDataFrame([("a", 1, 0, "PRESENT", None, 0)], "relative_path string, size_bytes int, modified_at int, presence_state string, missing_since_at timestamp, misses int")
    found = records.where("false").select("relative_path", "size_bytes", "modified_at")
    now = F.lit("2024-01-01").cast("timestamp")
    told = {c: incremental.reconcile(records, found, now, completed=c).select("presence_state", "misses", "change_state").first() for c in (True, False)}
    assert tuple(told[True]) == ("MISSING", 1, "MISSING") and tuple(told[False]) == ("PRESENT", 0, None)


def test_ambiguous_relocation_is_dropped(spark):
    missing = spark.createDataFrame([(1, "a/x"), (2, "a/y")], "file_id int, relative_path string")
    new = spark.createDataFrame([(11, "b/x"), (12, "b/z")], "file_id int, relative_path string")
    prints = spark.createDataFrame([(1, "QUICK_FILE", "q"), (2, "QUICK_FILE", "q"), (11, "QUICK_FILE", "q"), (1, "FILE_SHA256", "f"), (11, "FILE_SHA256", "f")], "file_id int, kind string, value string")
    assert rows(incremental.relocations(missing, new, prints)) == [(1, 11, "FILE_SHA256", "f", "MOVED")]


def test_exact_block_of_a_thousand_is_a_star(spark):
    made = matching.blocks(spark.range(1000).select(F.lit("FILE_SHA256").alias("block_type"), F.lit("k").alias("block_key"), F.col("id").alias("member_id")), members=1000)
    assert tuple(made.select("member_count", "status", "representative").first()) == (1000, "EXACT_GROUP", 0)
    assert matching.pairs(made).count() == 999


def test_match_pairs_links_every_copy_of_a_large_group(spark, tmp_path):
    from veritome.plans.matching_queries import match_pairs

    copies = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), "id").alias("source"), F.lit(8).alias("n_chars"))
    copies.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in match_pairs(spark, str(tmp_path)).collect()) == [(0, i, "FILE_SHA256,TEXT_FINGERPRINT") for i in range(1, 300)]


def test_score_without_features_present_is_zero(spark):
    df = spark.createDataFrame([(1, 2, "SAME_WORK", "TITLE_COMPATIBLE", False)], "left_id int, right_id int, relation string, feature string, present boolean")
    assert tuple(matching.score(df).select("confidence", "status").first()) == (0.0, "REVIEW_REQUIRED")


def test_metadata_state(spark):
    df = spark.createDataFrame([({"t": ["a"]}, {"t": ["a"], "x": ["b"]}), ({"t": ["a"]}, {"t": ["b"]}), ({"t": ["a"]}, {"u": ["a"]}), (None, {"t": ["a"]})], "l map<string,array<string>>, r map<string,array<string>>")
    assert [r[0] for r in df.select(evidence.metadata_state(F.col("l"), F.col("r"))).collect()] == ["SAME", "DIFFERENT", "INDETERMINATE", "INDETERMINATE"]


def test_size_breaks_ties_only_by_policy(spark):
    df = spark.createDataFrame([("g", 1, 0, 0, 0, "EPUB", 10, False), ("g", 2, 0, 0, 0, "EPUB", 5, False)], "group_id string, file_id int, incomplete int, action_required int, review int, format string, size_bytes int, blocked boolean")
    assert rows(evidence.keep_preference(df)) == [("g", "TIED", "TIED", None)]
    assert rows(evidence.keep_preference(df, "PREFER_SMALLER")) == [("g", "PREFERRED", "SIZE_TIE_BREAKER", 2)]
    mixed = df.withColumn("format", F.when(F.col("file_id") == 1, "PDF").otherwise("MOBI"))
    assert rows(evidence.keep_preference(mixed)) == [("g", "TIED", "TIED", None)]  # no format is preferred unless one is named
    assert rows(evidence.keep_preference(mixed, formats=("PDF",))) == [("g", "PREFERRED", "PREFERRED_FORMAT", 1)]
    assert rows(evidence.keep_preference(mixed, formats=("MOBI", "PDF"))) == [("g", "PREFERRED", "PREFERRED_FORMAT", 2)]
    assert rows(evidence.keep_preference(mixed, formats=("EPUB",))) == [("g", "TIED", "TIED", None)]


def test_snapshot_digest_changes_with_a_state(spark):
    items = spark.createDataFrame([(1,), (2,)], "file_id int")
    none = spark.createDataFrame([], "file_id int, component string, scope string, conflict boolean")
    some = spark.createDataFrame([(1, "REVIEW", "STALE", True)], none.schema)
    a, b = (state.seal(state.item_states(items, e)).first()[0] for e in (none, some))
    assert a != b and rows(state.item_states(items, some).where("state <> 'MISSING'")) == [(1, "REVIEW", "STALE_CONFLICT")]


GOOD = {"version": search.VERSION, "where": {"field": "TITLE", "operator": "MATCH", "value": "a b"}}


@pytest.mark.parametrize("change", [
    {"extra": 1}, {"version": "x"}, {"limit": 0}, {"limit": 101}, {"limit": True}, {"where": None}, {"where": {"field": "NONE", "operator": "EQ", "value": "x"}}, {"where": {"field": "FILE_ID", "operator": "PREFIX", "value": "x"}},
    {"where": {"field": "TITLE", "operator": "EQ", "value": "x" * 257}}, {"where": {"operator": "AND", "children": []}}, {"where": {"operator": "OR", "children": [{"field": "TITLE", "operator": "EQ", "value": "x"}] * 17}},
    {"where": {"operator": "AND", "children": [{"operator": "AND", "children": [{"operator": "AND", "children": [{"operator": "AND", "children": [GOOD["where"]]}]}]}]}}, {"where": {"field": "TITLE", "operator": "MATCH", "value": "--"}}, {"sort": "OTHER"}, {"after_file_id": 5},
])
def test_bad_queries_raise(change):
    with pytest.raises(search.QueryError):
        search.parse(json.dumps(GOOD | change))


def test_good_query_and_strict_json():
    assert search.parse(json.dumps(GOOD)).limit == 25
    for text in ('{"version": 1, "version": 2}', '{"limit": NaN}', "{"):
        with pytest.raises(search.QueryError):
            search.parse(text)


def test_match_needs_all_words_in_one_value(spark):
    values = spark.createDataFrame([("1", "TITLE", "Crème Brûlée"), ("2", "TITLE", "creme"), ("2", "TITLE", "brulee"), ("3", "TITLE", "brulee-CREME 2")], "file_id string, field string, value string")
    q = search.parse(json.dumps(GOOD | {"where": {"field": "TITLE", "operator": "MATCH", "value": "creme brulee"}}))
    indexed = search.index(values)
    page = search.search(indexed, q)
    assert [r.file_id for r in page.collect()] == ["1", "3"]
    assert rows(search.disclosed(page, indexed, q))[0] == ("1", "TITLE", ["crème brûlée"])
    capped = search.index(values.select(F.lit("9").alias("file_id"), "field", "value"), cap=2)
    assert capped.count() == 2 and {r.left_out for r in capped.collect()} == {2}


def test_sources(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.EPUB").write_text("xx")
    (tmp_path / "in/sub/b.pdf").write_text("y")
    (tmp_path / "in/c.doc").write_text("z")
    assert rows(files.discover(spark, str(tmp_path / "in"), (".epub", ".pdf")).select("relative_path", "size_bytes")) == [("a.EPUB", 2), ("sub/b.pdf", 1)]
    with pytest.raises(Exception):
        files.discover(spark, str(tmp_path / "none"), (".epub",)).collect()
    (tmp_path / "page.json").write_text('[{"id": 1, "title": "t", "authors": ["a"], "formats": ["f"], "identifiers": {"isbn": "1"}, "uuid": "u", "last_modified": "2024-01-01T00:00:00"}]')
    assert files.library_page(spark, str(tmp_path / "page.json")).first().identifiers == {"isbn": "1"}
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        files.library_page(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "c.csv").write_text("category,name,count\ntags,x,3\n")
    assert rows(files.categories(spark, str(tmp_path / "c.csv"))) == [("tags", "x", 3)]
    (tmp_path / "ids").write_text("1\n\n 22 \n")
    assert rows(files.id_list(spark, str(tmp_path / "ids"))) == [(1,), (22,)]
    xml = spark.createDataFrame([(1, '<package xmlns="x"><dc:title id="t">A Title</dc:title><dc:creator>B</dc:creator><dc:creator>C</dc:creator></package>'), (2, "<!DOCTYPE x><title>no</title>")], "k int, x string")
    assert rows(files.book_metadata(xml, "k", "x")) == [(1, "creator", "B"), (1, "creator", "C"), (1, "title", "A Title")]
    web = spark.createDataFrame([('{"key": "/b/1", "title": "T", "isbn_13": ["978"], "works": [{"key": "/w/1"}]}',), ("junk",)], "t string")
    assert {(r.key, r.kind) for r in files.knowledge_editions(web, "t").collect()} == {("/b/1", "title"), ("/b/1", "isbn13"), ("/b/1", "work"), (None, "MALFORMED_RECORD")}


def test_sinks(spark, tmp_path):
    text, digest = sinks.report_json({"b": 1, "a": "é"})
    assert text.endswith("}\n") and text.index('"a"') < text.index('"b"') and len(digest) == 64
    with pytest.raises(ValueError):
        sinks.report_json({"x": float("nan")})
    df = spark.createDataFrame([("=1+1", 2), ("fine", 3)], "c string, n int")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert "'=1+1" in next((tmp_path / "csv").glob("*.csv")).read_text()
    sinks.write_once(df, str(tmp_path / "sealed"), "d1")
    with pytest.raises(Exception):
        sinks.write_once(df, str(tmp_path / "sealed"), "d1")
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a").write_text("x")
    manifest = sinks.checksums(spark, str(tmp_path / "f")).collect()
    kept = spark.createDataFrame(manifest, "name string, sha256 string")
    (tmp_path / "f/a").write_text("y")
    assert rows(sinks.checksum_failures(spark, str(tmp_path / "f"), kept)) == [("a",)]
    log = spark.createDataFrame([(1, 100, 1, "DEFER")], "item_id int, decision_id int, sequence_no long, decision string")
    good = spark.createDataFrame([(1, 101, 100, "ACCEPT"), (2, 102, None, "REJECT")], "item_id int, decision_id int, expected_latest int, decision string")
    assert rows(sinks.append_decision(log, good)) == [(1, 101, 2, "ACCEPT"), (2, 102, 1, "REJECT")]
    with pytest.raises(Exception, match="another decision"):
        sinks.append_decision(log, good.where("item_id = 1").withColumn("expected_latest", F.lit(99))).collect()


def test_stream_ends_as_batches_do(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "relative_path string, size_bytes int, modified_at int")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], "relative_path string, size_bytes int, modified_at int, presence_state string, missing_since_at timestamp, misses int")
    now, held = F.lit("2024-01-01").cast("timestamp"), {}
    stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    reconcile_stream(stream, lambda: empty, lambda df, n: held.update({n: rows(df)}), str(tmp_path / "ck"), now).awaitTermination()
    assert held == {0: rows(incremental.reconcile(empty, first, now))}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_planning_rules(spark):
    checks = spark.createDataFrame([("COMPLETE",), ("PENDING",), ("INVALID",)], "state string")
    assert rows(planning.verification(checks)) == [("INVALID", 2)]
    assert rows(planning.verification(checks.where("false"))) == [("COMPLETE", 0)]
    groups = spark.createDataFrame([("a", 5, 3), ("b", 5, 3), ("c", 9, 2)], "group_id string, member_count int, redundant_bytes int")
    assert {r.group_id for r in inventory.largest_groups(groups, 1).collect()} == {"b"} and {r.group_id for r in inventory.most_members(groups, 2).collect()} == {"c", "a"}


def test_reconciliation_tells_authority_and_sidecars(spark):
    contributors = spark.createDataFrame([(1, "Ada"), (1, "Bo"), (2, "Cy"), (3, None)], "record_id int, name string")
    candidates = spark.createDataFrame([(1, 10, "AGENT", "Bo", "REVIEW_REQUIRED"), (1, 11, "AGENT", "Di", "REVIEW_REQUIRED"), (2, 12, "AGENT", "Di", "ACCEPTED"), (2, 13, "WORK", "Di", "REVIEW_REQUIRED"), (2, 14, "AGENT", "Di", "REVIEW_REQUIRED"), (3, 15, "AGENT", "Di", "REVIEW_REQUIRED")], "record_id int, candidate_id int, kind string, name string, disposition string")
    reviews = spark.createDataFrame([(i, "CONFIRMED" if i == 14 else "PENDING") for i in range(10, 16)], "candidate_id int, state string")
    authority = planning.authority_conflicts(contributors, candidates, reviews)
    assert rows(authority) == [(1, 11)]
    formats = spark.createDataFrame([(1, "a/b.epub"), (1, "a/b.pdf"), (2, "c/d.epub"), (2, "e/d.pdf"), (3, "top.epub"), (3, "metadata.opf")], "record_id int, path string")
    beside = spark.createDataFrame([(1, "a/cover.jpg", "COVER"), (1, "ab/x", "OTHER"), (1, "a/data", "EXTRA_DATA"), (1, "a/data/x", "EXTRA_DATA"), (2, "c/cover.jpg", "COVER"), (3, "metadata.opf", "METADATA_OPF"), (3, "cover.jpg", "COVER"), (4, "z/cover.jpg", "COVER")], "record_id int, path string, kind string")
    files = spark.createDataFrame([("a/cover.jpg", "x"), ("a/b.epub", "y")], "path string, sha256 string")
    sidecar = planning.sidecar_dependencies(formats, beside, files)
    assert {tuple(r) for r in sidecar.collect()} == {(1, "a/cover.jpg", "COVER", True), (1, "a/data/x", "EXTRA_DATA", False), (3, "cover.jpg", "COVER", False)}
    found = planning.library_findings(files, spark.createDataFrame([(1,), (2,), (3,)], "record_id int"), formats, authority=authority, sidecar=sidecar)
    assert {tuple(r) for r in found.where("code like '%AUTH%' or code like '%SIDE%'").collect()} == {("AUTHORITY_CONFLICT", "1"), ("SIDECAR_DEPENDENCY", "1"), ("SIDECAR_DEPENDENCY", "3")}


def test_tar_frames(spark):
    import io
    import tarfile

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, body in (("a.txt", b"x" * 700), ("d/b.bin", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
    data = raw.getvalue()
    bad = bytearray(data)
    bad[0] ^= 1
    df = spark.createDataFrame([("good", bytearray(data)), ("bad", bad), ("cut", bytearray(data[:900])), ("none", None)], "k string, c binary")
    got = {}
    for r in files.tar_members(df, "k", "c").orderBy("key", "ordinal").collect():
        got.setdefault(r.key, []).append((r.path, r.size, r.kind, r.finding))
    assert got["good"] == [("a.txt", 700, "REGULAR_FILE", None), ("d/b.bin", 0, "REGULAR_FILE", None), ("d/", 0, "DIRECTORY", None)]
    assert got["bad"][0][3] == "CHECKSUM_MISMATCH" and got["cut"][0][3] == "TRUNCATED" and "none" not in got


def test_null_keys_stay_in_bounded_lists(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 5), (None, 4)], "k string, m int")
    assert rows(relational.bounded_members(df, ["k"], "m", 2)) == [("a", 2, [1, 2], False), (None, 3, [3, 4], True)]


def test_archives_that_look_harmless_are_rejected(spark):
    from veritome.operators import planning

    listed = [
        ("bomb", 1, "a", 1000, 0, "REGULAR_FILE"), ("blind", 1, "a", 10, None, "REGULAR_FILE"), ("parent", 1, "A", 1, 1, "REGULAR_FILE"), ("parent", 2, "a/b", 1, 1, "REGULAR_FILE"), ("child", 1, "a/b", 1, 1, "DIRECTORY"), ("child", 2, "a", 1, 1, "REGULAR_FILE"),
        ("folder", 1, "a", 0, 0, "DIRECTORY"), ("folder", 2, "a/b", 5, 5, "REGULAR_FILE"), ("device", 1, "x/nul.txt", 1, 1, "REGULAR_FILE"), ("first", 1, "x", -1, 1, "REGULAR_FILE"), ("first", 2, "..", 1, 1, "REGULAR_FILE"),
    ] + [("many", i, str(i), 1, 1, "REGULAR_FILE") for i in range(10_001)]
    got = {r.archive_id: r.violation for r in planning.archive_safety(spark.createDataFrame(listed, "archive_id string, ordinal long, path string, size long, packed long, kind string")).collect()}
    assert got == {"bomb": "COMPRESSION_RATIO_LIMIT", "blind": "UNKNOWN_SIZE", "parent": "PARENT_CHILD_CONFLICT", "child": "PARENT_CHILD_CONFLICT", "folder": None, "device": "PATH_INVALID", "first": "NEGATIVE_SIZE", "many": "MEMBER_COUNT_LIMIT"}


def test_snapshot_sides_from_item_states(spark):
    """Blocked by a conflict in consolidation or quarantine; evidence counts if current."""
    old = spark.createDataFrame([(1, "ANALYSIS", "STALE"), (1, "QUARANTINE", "CURRENT"), (2, "REVIEW", "MISSING")], "file_id int, component string, state string")
    new = spark.createDataFrame([(1, "ANALYSIS", "CURRENT_CONFLICT"), (1, "QUARANTINE", "STALE_CONFLICT"), (2, "REVIEW", "CURRENT")], "file_id int, component string, state string")
    sides = [state.diffable(x, spark.createDataFrame([(1, 1, "EPUB", 1, "t"), (2, 2, "EPUB", 1, "t")], "file_id int, observation_id int, format_name string, size_bytes int, technical string")) for x in (old, new)]
    assert {r["file_id"]: sorted(r["categories"]) for r in state.diff(*sides).collect()} == {1: ["NEWLY_ANALYZED", "NEWLY_BLOCKED"], 2: ["NEWLY_REVIEWED"]}


def test_item_without_any_evidence(spark):
    facts = spark.createDataFrame([(1, None, None, None, None, None, None)], "file_id int, fixity_values int, metadata_fields array<string>, review_states array<string>, metadata_truncated boolean, quality_found boolean, sidecar boolean")
    found = state.item_findings(spark.createDataFrame([], "file_id int, component string, state string"), facts).first()
    assert found["covered"] == ["OPEN_REVIEWS", "BLOCKED_OPERATIONS"]
    assert found["codes"] == ["FULL_FIXITY_MISSING", "ANALYSIS_MISSING", *(f"{w}_METADATA_MISSING" for w in ("TITLE", "CONTRIBUTOR", "IDENTIFIER", "LANGUAGE", "PUBLISHER")), "AUTHORITY_RESOLUTION_COVERAGE_GAP", "CLASSIFICATION_COVERAGE_GAP", "MATCHING_COVERAGE_GAP", "DEPENDENCY_COVERAGE_GAP"]


def test_large_identity_block_is_a_star_of_all_members(spark):
    told = spark.range(300).select(F.lit("AGENT_TITLE").alias("block_type"), F.lit("k").alias("block_key"), F.col("id").alias("member_id"))
    made = matching.blocks(told)
    assert made.first()["status"] == "SECONDARY_REQUIRED"
    assert sorted(tuple(r)[:2] for r in matching.pairs(made, told).collect()) == [(0, i) for i in range(1, 300)]


@pytest.mark.parametrize(
    "names, told",
    [
        (["B.part1.rar", "B.part2.rar"], {("b", "LISTED", "B.part1.rar", 2)}),
        (["B.part1.rar", "b.part2.rar"], {("b", "AMBIGUOUS_VOLUME", None, 2)}),
        (["b.part01.rar", "b.part2.rar"], {("b", "AMBIGUOUS_VOLUME", None, 2)}),
        (["b.part1.rar", "b.part3.rar"], {("b", "MISSING_VOLUME", None, 2)}),
        (["b.part2.rar"], {("b", "MISSING_VOLUME", None, 1)}),
        (["b.part1.rar", "b.rar"], {("b", "AMBIGUOUS_VOLUME", None, 1)}),
        (["b.part1.rar", "b.7z.001"], {("b", "AMBIGUOUS_VOLUME", None, 2)}),
        (["c.rar", "c.r00", "c.r01"], {("c", "LISTED", "c.rar", 3)}),
        (["C.rar", "c.r00"], {("c", "AMBIGUOUS_VOLUME", None, 2)}),
        (["c.r00", "c.r01"], {("c", "ORPHAN_VOLUME", None, 2)}),
        (["c.rar", "c.r01"], {("c", "MISSING_VOLUME", None, 2)}),
        (["d.7z.001", "d.7z.002"], {("d", "LISTED", "d.7z.001", 2)}),
        (["e.z01", "e.zip", "e.z02"], {("e", "UNSUPPORTED_FORMAT", "e.zip", 3)}),
        (["e.z01"], {("e", "ORPHAN_VOLUME", None, 1)}),
        (["e.zip.001"], set()),
        (["f.epub", "F.EPUB", "g.tar.gz", "h.txt"], {("f.epub", "NAME_COLLISION", None, 2), ("g.tar.gz", "LISTED", "g.tar.gz", 1)}),
        ([f"l.part{i:03}.rar" for i in range(1, 258)], {("l", "UNSUPPORTED_VOLUME", None, 257)}),
        (["straße.part1.rar", "STRASSE.part1.rar"], {("strasse.part1.rar", "NAME_COLLISION", None, 2)}),
    ],
)
def test_volume_sets(spark, names, told):
    found = planning.volume_sets(spark.createDataFrame([("p", n) for n in names] + [("other", "x.r00")], "parent string, name string"))
    assert {tuple(r) for r in found.where("parent = 'p'").drop("parent").collect()} == told


def test_name_based_uuids_and_gradients(spark):
    import uuid

    from veritome.functions import scalars

    df = spark.createDataFrame([("",), ("a",), ("größe",)], "x string")
    assert [r[0] for r in df.select(scalars.name_based_uuid(F.col("x"), str(uuid.NAMESPACE_URL))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("", "a", "größe")]
    grid = [[(7 * y + 5 * x * x) % 11 for x in range(9)] for y in range(8)]
    want = "".join("01"[grid[y][x] > grid[y][x + 1]] for y in range(8) for x in range(8))
    assert spark.createDataFrame([([c for row in grid for c in row],)], "c array<int>").select(scalars.gradient_hash(F.col("c"))).first()[0] == want


def test_archive_paths_composed_otherwise_collide(spark):
    listed = [("a", 1, "Ä/x", 1, 1, "REGULAR_FILE"), ("a", 2, "a\u0308/X", 1, 1, "REGULAR_FILE"), ("b", 1, "ß", 1, 1, "REGULAR_FILE"), ("b", 2, "SS/x", 1, 1, "REGULAR_FILE")]
    got = {r.archive_id: r.violation for r in planning.archive_safety(spark.createDataFrame(listed, "archive_id string, ordinal long, path string, size long, packed long, kind string")).collect()}
    assert got == {"a": "PATH_COLLISION", "b": "PARENT_CHILD_CONFLICT"}


def test_technical_change(spark):
    names = "file_id int, observation_id int, format_name string, size_bytes int, technical string, analysis boolean, resolution boolean, review boolean, quarantine boolean"
    side = lambda *rows: spark.createDataFrame([(*r, False, False, False, False) for r in rows], names)
    before = side((1, 1, "EPUB", 5, "t"), (2, 1, "EPUB", 5, "t"), (3, 1, "EPUB", 5, "t"), (4, 1, "EPUB", 5, "t"))
    after = side((1, 1, "EPUB", 5, "u"), (2, 2, "EPUB", 5, "u"), (3, 2, "PDF", 5, "t"), (4, 2, "EPUB", 6, "t"))
    assert {r["file_id"] for r in state.diff(before, after).collect()} == {1, 3, 4}  # another observation's digest tells nothing


def test_sidecars_beyond_the_limit(spark):
    files = spark.createDataFrame([(f"d/{i}.nfo",) for i in range(4)] + [("e/1.nfo",), ("e/x.epub",)], "path string")
    archives = spark.createDataFrame([("d/a.rar",), ("d/b.rar",), ("e/c.rar",), ("f/d.rar",)], "path string")
    got = sorted(rows(planning.sidecar_inventory(archives, files, 3)))
    assert got == [("d/a.rar", "LIMIT_EXCEEDED", None, None, 4), ("d/b.rar", "LIMIT_EXCEEDED", None, None, 4), ("e/c.rar", "LISTED", "1.nfo", "NFO", 1)]


def test_archives_meet_their_workspace(spark):
    """A rule about the archive comes before its members', the room that they need after; nulls violate their rule."""
    gib = 1 << 30
    archives = [
        ("fits", 1, 8 * gib, 3 * gib, False), ("exactly", 1, 2 * gib - 1, 3 * gib - 1, False), ("tight", 1, 8 * gib, 3 * gib - 2, False), ("small", 1, 2 * gib - 2, 9 * gib, False), ("none", 1, 0, gib, False), ("parts", 257, 0, 0, True), ("no parts", None, 0, 0, True),
        ("wide", 1, 8 * gib + 1, 9 * gib, False), ("debt", 1, 0, -1, True), ("over", 1, 0, 0, True), ("unsure", 1, 0, 9 * gib, None), ("link", 1, 0, 0, False), ("many", 0, -1, -1, True), (None, 1, 0, 0, False), ("fits", 1, 0, 3 * gib, False),
    ]
    one = [(a, 1, "a", 2 * gib - 1, gib, "REGULAR_FILE") for a in ("fits", "exactly", "tight", "small", "parts", "wide", "stranger", None)]
    members = [*one, ("link", 1, "a", 5 * gib, 1, "SYMLINK"), *(("many", i, str(i), 1 << 62, 1, "REGULAR_FILE") for i in range(10_001))]
    got = planning.archive_admission(
        spark.createDataFrame(archives, "archive_id string, volumes int, capacity long, free long, overlaps boolean"),
        spark.createDataFrame(members, "archive_id string, ordinal long, path string, size long, packed long, kind string"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("fits", "ACCEPTED", None, 1), ("fits", "LIMIT_EXCEEDED", "WORKSPACE_LIMIT", 1), ("exactly", "ACCEPTED", None, 1), ("tight", "LIMIT_EXCEEDED", "WORKSPACE_RESERVE", 1), ("small", "LIMIT_EXCEEDED", "WORKSPACE_LIMIT", 1), ("none", "ACCEPTED", None, 0),
        ("parts", "LIMIT_EXCEEDED", "VOLUME_COUNT_LIMIT", 0), ("no parts", "LIMIT_EXCEEDED", "VOLUME_COUNT_LIMIT", 0), ("wide", "LIMIT_EXCEEDED", "WORKSPACE_LIMIT", 0), ("debt", "LIMIT_EXCEEDED", "WORKSPACE_RESERVE", 0), ("over", "POLICY_REJECTED", "WORKSPACE_OVERLAP", 0),
        ("unsure", "POLICY_REJECTED", "WORKSPACE_OVERLAP", 0), ("link", "POLICY_REJECTED", "MEMBER_KIND_REJECTED", 1), ("many", "LIMIT_EXCEEDED", "MEMBER_COUNT_LIMIT", 0),
    ], key=str)

"""Package metadata: creators, refinements, identifiers, series, and documents that are refused."""

import pytest

from veritome.sources import packages

HEAD = '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:opf="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="3.0"><metadata>'
TAIL = "</metadata><manifest><item id='i' href='x'/></manifest></package>"


def of(spark, *texts):
    rows = [(i, bytearray(t if isinstance(t, bytes) else (HEAD + t + TAIL).encode())) if t is not None else (i, None) for i, t in enumerate(texts)]
    return {r["k"]: (r["status"], [tuple(x) for x in r["observations"]], {x["field_path"]: (x["value"], x["source_location"]) for x in r["candidates"]}) for r in packages.projected(spark.createDataFrame(rows, "k int, c binary"), "k", "c").collect()}


def test_people_titles_and_refinements(spark):
    text = """<dc:title id="t">A &amp;
      B &#x442;</dc:title><meta refines="#t" property="file-as">B, A</meta>
      <dc:creator opf:role="aut" opf:file-as="Doe, J">J  Doe</dc:creator><dc:creator id="c">M<b>ax</b> Muster</dc:creator><dc:contributor id="d">T</dc:contributor>
      <meta refines="#c" property="role" scheme="marc:relators">edt</meta><meta refines="#c" property="role" scheme="own">aut</meta><meta refines="#c" property="role" scheme="marc:relators">edt</meta>
      <meta refines="#d" property="ROLE" content="trl"/><meta refines="d" property="file-as">no</meta><meta refines="#d" property="other">no</meta><dc:language> </dc:language>"""
    status, told, found = of(spark, text)[0]
    assert status == "OK"
    assert told == [("title", "A & B т"), ("title_sort", "B, A"), ("creator:aut", "J Doe"), ("creator_file_as:aut", "Doe, J"), ("creator:edt", "Max Muster"), ("contributor:trl", "T")]
    assert found == {
        "title": ("A & B т", "opf.title[1].text"), "title_sort": ("B, A", "opf.title[1].file-as"),
        "contributor.1.name": ("J Doe", "opf.creator[1].text"), "contributor.1.source_element": ("creator", "opf.creator[1]"), "contributor.1.source_role": ("aut", "opf.creator[1].role"), "contributor.1.role": ("author", "opf.creator[1].role"), "contributor.1.sort_name": ("Doe, J", "opf.creator[1].file-as"),
        "contributor.2.name": ("Max Muster", "opf.creator[2].text"), "contributor.2.source_element": ("creator", "opf.creator[2]"), "contributor.2.source_role.1": ("edt", "opf.creator[2].role"), "contributor.2.source_role_scheme.1": ("marc:relators", "opf.creator[2].role.scheme"), "contributor.2.role.1": ("editor", "opf.creator[2].role"),
        "contributor.2.source_role.2": ("aut", "opf.creator[2].role"), "contributor.2.source_role_scheme.2": ("own", "opf.creator[2].role.scheme"),
        "contributor.3.name": ("T", "opf.contributor[1].text"), "contributor.3.source_element": ("contributor", "opf.contributor[1]"), "contributor.3.source_role": ("trl", "opf.contributor[1].role"), "contributor.3.role": ("translator", "opf.contributor[1].role"),
    }


def test_identifiers(spark):
    text = """<dc:identifier opf:scheme="ISBN-13">978</dc:identifier><dc:identifier opf:scheme="My Store">7</dc:identifier><dc:identifier id="i">urn:x</dc:identifier><meta refines="#i" property="identifier-type" scheme="onix:codelist5">15</meta>
      <dc:identifier>URN:ISBN:5</dc:identifier><dc:identifier>urn:uuid:6</dc:identifier><dc:identifier>plain</dc:identifier>"""
    _, told, found = of(spark, text)[0]
    assert [k for k, _ in told] == ["identifier:isbn-13", "identifier:my-store", "identifier:15", "identifier", "identifier", "identifier"]
    assert {k: v[0] for k, v in found.items() if k.endswith(".namespace")} == {"identifier.1.namespace": "isbn", "identifier.2.namespace": "my-store", "identifier.3.namespace": "isbn", "identifier.4.namespace": "isbn", "identifier.5.namespace": "uuid"}
    assert found["identifier.3.source_namespace_scheme"] == ("onix:codelist5", "opf.identifier[3].identifier-type.scheme") and found["identifier.4.namespace"][1] == "opf.identifier[4].text-prefix"


def test_series_of_both_kinds(spark):
    text = """<meta name="calibre:series" content="Old"/><meta name="calibre:series_index" content="2.0"/><meta name="calibre:rating" content="8"/><meta name="calibre:series" content=" "/>
      <meta property="belongs-to-collection" id="s">Set</meta><meta refines="#s" property="collection-type">set</meta><meta property="belongs-to-collection" id="n">New</meta><meta refines="#n" property="collection-type"> Series </meta><meta refines="#n" property="group-position">3</meta>"""
    _, told, found = of(spark, text)[0]
    assert told == [("rating", "8"), ("series", "Old"), ("series_index", "2.0"), ("series", "New"), ("series_index", "3")]
    assert found == {"rating": ("8", "opf.meta[calibre:rating][1]"), "series.1.name": ("Old", "opf.meta[calibre:series][1]"), "series.1.position": ("2.0", "opf.meta[calibre:series_index][1]"), "series.2.name": ("New", "opf.collection[2].text"), "series.2.position": ("3", "opf.collection[2].group-position")}


def test_second_version_and_character_data(spark):
    text = "<dc-metadata><dc:title>In</dc:title></dc-metadata><dc:description><![CDATA[<p>x</p> &amp; y]]></dc:description>"
    _, told, _ = of(spark, text, b"\xef\xbb\xbf<package><metadata><title>Bare</title></metadata></package>")[0]
    assert sorted(told) == [("description", "<p>x</p> &amp; y"), ("title", "In")]
    assert of(spark, b"\xef\xbb\xbf<package><metadata><title>Bare</title></metadata></package>")[0][1] == [("title", "Bare")]


@pytest.mark.parametrize(
    "text, status",
    [
        (None, "NO_DOCUMENT"), (b"", "MALFORMED"), (b"x", "MALFORMED"), (b"<package><metadata>", "MALFORMED"), (b"<book><metadata/></book>", "NO_PACKAGE"), (b"<package/>", "NO_METADATA"), (b"<package><metadata/></package>", "OK"),
        (b"<!doctype x><package><metadata/></package>", "FORBIDDEN_DECLARATION"), (b"<package><metadata>\xff</metadata></package>", "NOT_UTF8"), (b"<package>" + b" " * (4 << 20) + b"<metadata/></package>", "TOO_LARGE"),
        (f"<dc:title>{'x' * 4097}</dc:title>", "OVERSIZED_VALUE"), ("<dc:subject>s</dc:subject>" * 257, "TOO_MANY_VALUES"), ("<dc:subject>s</dc:subject>" * 256, "OK"),
    ],
)
def test_refused(spark, text, status):
    found = of(spark, text)[0]
    assert found[0] == status and (status == "OK" or found[1:] == ([], {}))

"""What a provider says of works and editions, and archives read as data sources, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritome.plans.registry import query, spread, table
from veritome.sources import datasources, knowledge
from veritome.sources.shared import new_path

_EDITIONS = """e AS (SELECT p_partkey AS k, 'ed' || p_partkey AS record_id, p_name AS n, p_type AS m, p_brand AS b, p_size AS s, '978' || lpad(cast(p_partkey AS VARCHAR), 9, '0') AS stem FROM part),
c AS (SELECT *, stem || ((10 - list_sum(list_transform(range(1, 13), lambda i: cast(stem[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10) AS isbn,
 CASE WHEN k % 10 = 3 THEN 'INVALID_RESPONSE' WHEN s = 7 THEN 'NOT_BOUND' WHEN k % 10 = 5 THEN 'NOT_CANONICAL' ELSE 'MAPPED' END AS status FROM e)"""


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _editions(spark, d):
    """Editions made of parts: every tenth title a number, every tenth with a space at its end; works of one size aren't bound; a wrong ISBN and a doubled publisher in each."""
    k, size = F.col("p_partkey"), F.col("p_size")
    stem = _text("978", F.lpad(k.cast("string"), 9, "0"))
    digits = sum(F.substring(stem, i + 1, 1).cast("int") * (3 if i % 2 else 1) for i in range(12))
    isbn = _text(stem, (10 - digits % 10) % 10)
    title = F.when(k % 10 == 3, k.cast("string")).otherwise(_text('"', F.col("p_name"), F.when(k % 10 == 5, " ").otherwise(""), '"'))
    body = _text('{"key":"/books/OL', k, 'M","title":', title, ',"publishers":["', F.col("p_type"), '","', F.col("p_brand"), '","', F.col("p_type"), '"],"languages":[{"key":"/languages/ger"}],"isbn_13":["', isbn, '","9780306406158"],"works":[{"key":"/works/OL', size, 'W"}],"authors":[{"author":{"key":"/authors/OL', size, 'A"}}]}')
    parts = table(spark, d, "part")
    records = spread(parts.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey").select(_text("ed", k).alias("record_id"), F.lit("EDITION").alias("endpoint"), body.alias("body"), F.lit(None).cast("string").alias("target_id"))
    sizes = parts.where("p_size <> 7").select("p_size").distinct()
    own = parts.select(_text("openlibrary.edition:OL", k, "M").alias("key"), _text("e-", k).alias("target_ref"))
    bindings = own.unionByName(sizes.select(_text("openlibrary.work:OL", size, "W").alias("key"), _text("w-", size).alias("target_ref"))).unionByName(parts.select("p_size").distinct().select(_text("openlibrary.author:OL", size, "A").alias("key"), _text("a-", size).alias("target_ref")))
    return knowledge.mapped(records, bindings)


@query(f"""WITH {_EDITIONS}, p AS (
 SELECT record_id, 'AGENT_CANDIDATE' AS projection, 'AGENT' AS target_kind, 'a-' || s AS target_ref, 'openlibrary.author' AS name, 'OL' || s || 'A' AS value FROM c WHERE status = 'MAPPED'
 UNION ALL SELECT record_id, 'IDENTIFIER', 'EDITION', 'e-' || k, unnest(['isbn13', 'openlibrary.edition']), unnest([isbn, 'OL' || k || 'M']) FROM c WHERE status = 'MAPPED'
 UNION ALL SELECT record_id, 'VALUE', 'EDITION', 'e-' || k, unnest(['languages', 'publishers', 'publishers', 'title']), unnest(['/languages/ger', m, b, n]) FROM c WHERE status = 'MAPPED'
 UNION ALL SELECT record_id, 'WORK_CANDIDATE', 'WORK', 'w-' || s, 'openlibrary.work', 'OL' || s || 'W' FROM c WHERE status = 'MAPPED')
SELECT *, cast(row_number() OVER (PARTITION BY record_id ORDER BY projection, target_kind, target_ref, name, value) - 1 AS INTEGER) AS ordinal FROM p""")
def provider_projections(spark, d):
    """Identifiers, values and candidates of editions, in one order, each once."""
    return knowledge.projections(_editions(spark, d)).drop("source_refs")


@query(f"WITH {_EDITIONS} SELECT record_id, status, true AS truncated, '' AS findings FROM c")
def provider_outcomes(spark, d):
    """What became of each edition's record."""
    return _editions(spark, d).select("record_id", "status", "truncated", F.array_join("findings", ",").alias("findings"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_name AS n, s_nationkey AS a FROM supplier), p AS (
 SELECT k, 'AGENT_CANDIDATE' AS projection, 'openlibrary.work:OL' || k || 'W,openlibrary.edition:OL' || k || 'M' AS refs, NULL AS target_ref, 'author_name' AS name, unnest([n, 'é ' || k]) AS value FROM s
 UNION ALL SELECT k, 'AGENT_CANDIDATE', '', 'a-' || a, 'openlibrary.author', 'OL' || a || 'A' FROM s
 UNION ALL SELECT k, 'IDENTIFIER', '', unnest(['e-' || k, 'w-' || k]), unnest(['openlibrary.edition', 'openlibrary.work']), unnest(['OL' || k || 'M', 'OL' || k || 'W']) FROM s
 UNION ALL SELECT k, 'VALUE', '', unnest(['e-' || k, 'w-' || k, 'w-' || k]), unnest(['title', 'title', 'first_publish_year']), unnest(['A', n, cast(1900 + a AS VARCHAR)]) FROM s)
SELECT k AS record_id, projection, refs, target_ref, name, value, 'MALFORMED_SEARCH_EDITION' AS findings FROM p""")
def provider_searches(spark, d):
    """Searches: a work, two editions of one key of which the smaller stays, one without a key, contributors by name in composed form."""
    k, a, n = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_name")
    body = _text('{"key":"/works/OL', k, 'W","title":"', n, '","first_publish_year":', a + 1900, ',"author_key":["OL', a, 'A"],"author_name":["', n, '","é ', k, '","', n, '",""],"editions":{"docs":[{"key":"OL', k, 'M","title":"B"},{"key":"/books/ol', k, 'm","title":"A"},{"title":"none"}]}}')
    s = table(spark, d, "supplier")
    records = s.select(k.alias("record_id"), F.lit("SEARCH").alias("endpoint"), body.alias("body"), F.lit(None).cast("string").alias("target_id"))
    bindings = s.select(F.explode(F.array(F.struct(_text("openlibrary.work:OL", k, "W").alias("key"), _text("w-", k).alias("target_ref")), F.struct(_text("openlibrary.edition:OL", k, "M").alias("key"), _text("e-", k).alias("target_ref")))).alias("b")).select("b.*")
    bindings = bindings.unionByName(s.select("s_nationkey").distinct().select(_text("openlibrary.author:OL", a, "A").alias("key"), _text("a-", a).alias("target_ref")))
    found = knowledge.mapped(records, bindings)
    told = found.select("record_id", F.array_join("findings", ",").alias("findings"), F.explode("projections").alias("p"))
    return told.select("record_id", "findings", "p.projection", F.array_join("p.source_refs", ",").alias("refs"), "p.target_ref", "p.name", "p.value")


@query("SELECT 'f' || l_orderkey || '/' || l_linenumber || '.txt' AS path, cast(l_partkey AS VARCHAR) AS size, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS crc FROM lineitem")
def listing_source(spark, d):
    """Listings in seven folders, written as text and read by ``format("archive_listing")`` in pieces of 64 KB."""
    path = new_path(spark, "listings")
    k = F.col("l_orderkey")
    block = _text("----------\nPath = f", k, "/", F.col("l_linenumber"), ".txt\nSize = ", F.col("l_partkey"), "\n", F.when(F.col("l_linenumber") % 2 == 0, _text("CRC = ", F.col("l_returnflag"), "\n")).otherwise(""))
    table(spark, d, "lineitem").select((k % 7).alias("folder"), block.alias("value")).write.partitionBy("folder").text(path)
    datasources.register(spark)
    found = spark.read.format("archive_listing").option("bytes_per_partition", 1 << 16).option("suffix", ".txt").option("prefix", "folder=").load(path)
    return found.select("path", "size", "crc")


@query("SELECT 'o' || o_orderkey || '.txt' AS path, octet_length(encode(o_orderpriority)) AS size, 'REGULAR_FILE' AS kind, NULL AS finding FROM orders")
def tar_source(spark, d):
    """TAR files whose headers Spark writes as text, read by ``format("tar_members")``."""
    path = new_path(spark, "tars")
    body = F.col("o_orderpriority")
    nul = F.lit("\0")
    before = F.concat(F.rpad(_text("o", F.col("o_orderkey"), ".txt"), 100, "\0"), F.lit("0000644\0" + "0000000\0" * 2), F.lpad(F.conv(F.octet_length(body).cast("string"), 10, 8), 11, "0"), nul, F.lit("0" * 11 + "\0"))
    after = F.rpad(F.lit("0"), 356, "\0")
    summed = F.aggregate(F.split(F.concat(before, F.lit(" " * 8), after), ""), F.lit(0), lambda n, c: n + F.ascii(c))
    # the line's end is the last byte of the padding
    frame = F.rpad(F.concat(before, F.lpad(F.conv(summed.cast("string"), 10, 8), 6, "0"), nul, F.lit(" "), after, body), 1023, "\0")
    table(spark, d, "orders").select(frame.alias("value")).write.option("lineSep", "\0").text(path)
    datasources.register(spark)
    return spark.read.format("tar_members").load(path).select("path", F.col("size").cast("int").alias("size"), "kind", "finding")

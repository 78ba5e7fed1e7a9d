"""Sources and sinks over the driver's tables: package documents, folders, archives, versions, checked tables, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.operators import search
from veritome.plans.registry import OBS, observations, query, spread, table
from veritome.sources import files, packages, sinks, versions
from veritome.sources.shared import new_path

_PART = """WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_size AS s FROM part)"""


@query(_PART + """ SELECT k, unnest(['title', 'contributor.1.name', 'contributor.1.source_element', 'contributor.1.source_role', 'contributor.1.role', 'contributor.1.sort_name', 'contributor.2.name', 'contributor.2.source_element', 'identifier.1.value', 'identifier.1.source_namespace', 'identifier.1.namespace', 'identifier.2.value', 'identifier.2.namespace', 'series.1.name', 'series.1.position']) AS field_path,
unnest([n || ' & <' || b || '> é', b || ' ' || k, 'creator', 'aut', 'author', k || ', ' || b, 'Zweite', 'contributor', '97' || k, 'ISBN', 'isbn', 'urn:uuid:' || k, 'uuid', 'Reihe ' || s, cast(s AS VARCHAR)]) AS value FROM p WHERE k % 10 <> 3
UNION ALL SELECT k, unnest(['contributor.2.source_role', 'contributor.2.source_role_scheme', 'contributor.2.role']), unnest(['edt', 'marc:relators', 'editor']) FROM p WHERE k % 10 <> 3 AND s % 2 = 0""")
def package_candidates(spark, d):
    """Package documents made of parts: entities, attributes, refinements, both kinds of series; every tenth has a type declaration and is refused."""
    k, n, b, s = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    doc = text(
        F.when(F.col("p_partkey") % 10 == 3, "<!DOCTYPE package>").otherwise(""), '<package xmlns="http://www.idpf.org/2007/opf" xmlns:opf="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>',
        "<dc:title>", n, " &amp;\n &lt;", b, "&gt; &#233;</dc:title>", '<dc:creator opf:role="aut" opf:file-as="', k, ", ", b, '">', b, "  ", k, "</dc:creator>", '<dc:contributor id="c">Zweite</dc:contributor>',
        F.when(F.col("p_size") % 2 == 0, '<meta refines="#c" property="role" scheme="marc:relators">edt</meta>').otherwise(""), '<dc:identifier opf:scheme="ISBN">97', k, "</dc:identifier><dc:identifier>urn:uuid:", k, "</dc:identifier>",
        '<meta property="belongs-to-collection" id="s">Reihe ', s, '</meta><meta refines="#s" property="collection-type">series</meta><meta refines="#s" property="group-position">', s, "</meta></metadata></package>",
    )
    parts = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    return packages.candidates(parts.select(F.col("p_partkey").alias("k"), doc.alias("x")), "k", "x").select("k", "field_path", "value")


@query("SELECT 'n' || cast(n_nationkey AS VARCHAR) || '.epub' AS name, sha256(n_name) AS sha256 FROM nation")
def file_checksums(spark, d):
    """Each nation's name as a file of its own in the shared folder, discovered by suffix, with its checksum."""
    path = new_path(spark, "files")
    table(spark, d, "nation").repartition(25, "n_nationkey").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").option("lineSep", "|").text(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    told = found.select(F.concat(F.lit("n"), F.regexp_extract("path", "n_nationkey=([0-9]+)", 1), F.lit(".epub")).alias("name"), F.rtrim(F.col("content").cast("string"), F.lit("|")).alias("text"))
    return told.select("name", F.sha2("text", 256).alias("sha256"))


@query("SELECT nullif(o_orderkey % 50, 49) AS item_id, concat('d', max(o_orderkey)) AS decision_id, cast(2 AS INTEGER) AS sequence_no FROM orders WHERE o_orderkey % 50 <> 49 GROUP BY 1 UNION ALL SELECT 49, 'first', 1")
def decision_log(spark, d):
    """Decisions appended to each item's latest one, and one to an item without any."""
    o = table(spark, d, "orders").where("o_orderkey % 50 <> 49")
    log = o.groupBy((F.col("o_orderkey") % 50).alias("item_id")).agg(F.concat(F.lit("d"), F.max("o_orderkey").cast("string")).alias("decision_id")).withColumn("sequence_no", F.lit(1))
    new = log.select("item_id", F.col("decision_id").alias("expected_latest"), "decision_id", F.lit("ACCEPT").alias("decision"))
    first = spark.createDataFrame([(49, None, "first", "ACCEPT")], "item_id long, expected_latest string, decision_id string, decision string")
    return sinks.append_decision(log, new.unionByName(first)).select("item_id", "decision_id", F.col("sequence_no").cast("int").alias("sequence_no"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS generation, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS payload FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 1) UNION ALL SELECT -1, 1, 'new'")
def versioned_cache(spark, d):
    """A cache committed in two versions: candidates for every third entry, late ones, a new key, expired entries."""
    path, k = new_path(spark, "cache"), F.col("c_custkey")
    at = F.when(k % 5 == 0, F.lit("2024-01-01")).otherwise(F.lit("2026-01-01")).cast("timestamp")
    entries = table(spark, d, "customer").select(k.alias("key"), F.lit(1).cast("long").alias("generation"), F.lit("old").alias("payload"), at.alias("expires_at"))
    rules = {"generation": versions.counter("generation"), "payload": versions.one_of("payload", ("old", "new"))}
    first = versions.commit(entries, path, 0, rules)
    later = F.lit("2027-01-01").cast("timestamp")
    wanted = table(spark, d, "customer").where((k % 3 == 0) | (k % 7 == 1)).select(k.alias("key"), F.when(k % 3 == 0, 1).otherwise(9).cast("long").alias("expected_generation"), F.lit("new").alias("payload"), later.alias("expires_at"))
    wanted = wanted.unionByName(spark.createDataFrame([(-1, 0, "new")], "key long, expected_generation long, payload string").withColumn("expires_at", later))
    after, _ = versions.replaced(versions.read(spark, path), wanted, F.lit("2025-01-01").cast("timestamp"), 1 << 40, 1 << 50)
    versions.commit(after, path, first, rules)
    return versions.read(spark, path).select("key", F.col("generation").cast("int").alias("generation"), "payload")


@query(f"WITH {OBS} SELECT file_id, sha AS content_digest FROM obs")
def sealed_rows(spark, d):
    """A checked table, written once in one pass with its counts, and read back."""
    path = new_path(spark, "sealed")
    rows = observations(spark, d).select("file_id", F.col("sha").alias("content_digest"), "size_bytes")
    versions.write_checked(rows, path, {"digest": versions.digest("content_digest"), "size": versions.counter("size_bytes")})
    return spark.read.parquet(path).select("file_id", "content_digest")


@query("SELECT file_id, field, string_agg(v, ',' ORDER BY v) AS shown FROM (SELECT DISTINCT lpad(cast(p_partkey AS VARCHAR), 9, '0') AS file_id, 'PUBLISHER' AS field, lower(p_brand) AS v FROM part WHERE lower(p_brand) LIKE 'brand#2%' ORDER BY 1 LIMIT 30) GROUP BY ALL")
def disclosed_values(spark, d):
    """Of a page's files the values of the fields that the query itself names."""
    import json

    p = table(spark, d, "part")
    key = F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("file_id")
    values = p.select(key, F.lit("PUBLISHER").alias("field"), F.col("p_brand").alias("value")).unionByName(p.select(key, F.lit("TITLE").alias("field"), F.col("p_name").alias("value")))
    indexed = search.index(values)
    asked = search.parse(json.dumps({"version": search.VERSION, "where": {"field": "PUBLISHER", "operator": "PREFIX", "value": "Brand#2"}, "limit": 29}))
    return search.disclosed(search.search(indexed, asked), indexed, asked).select("file_id", "field", F.array_join("values", ",").alias("shown"))

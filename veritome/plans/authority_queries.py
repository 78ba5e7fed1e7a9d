"""Authorities, caches, dependencies and corrections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.functions.scalars import marc_role
from veritome.operators import authority, planning
from veritome.operators.relational import ordered_digest
from veritome.plans.registry import OBS, observations, query, table


@query("""WITH n AS (SELECT c_custkey, c_name AS plain, 'x' || c_mktsegment AS inner_part FROM customer)
SELECT c_custkey, plain AS value, 'CANONICAL' AS kind FROM n UNION ALL SELECT c_custkey, inner_part, 'ALIAS' FROM n WHERE inner_part <> plain""")
def name_candidates(spark, d):
    named = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" (x"), "c_mktsegment", F.lit(")")).alias("n"))
    return authority.name_candidates(named, "c_custkey", "n").select("c_custkey", "value", "kind")


@query("""WITH t AS (SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'A ' ELSE '' END) || p_name AS t FROM part)
SELECT p_partkey, 'CANONICAL' AS kind, t AS value FROM t UNION ALL SELECT p_partkey, 'ALIAS', regexp_replace(t, '^(The|A) ', '') FROM t WHERE p_partkey % 3 <> 2""")
def title_candidates(spark, d):
    lead = F.when(F.col("p_partkey") % 3 == 0, "The ").when(F.col("p_partkey") % 3 == 1, "A ").otherwise("")
    return authority.title_candidates(table(spark, d, "part").select("p_partkey", F.concat(lead, "p_name", F.lit(" [note]")).alias("t")), "p_partkey", "t").select("p_partkey", "kind", "value")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'author-title-year' WHEN 1 THEN 'series-number-title' WHEN 2 THEN 'author-title' ELSE 'none' END AS profile, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'Title ' || cast(p_partkey AS VARCHAR) END AS title FROM part""")
def file_name_profiles(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("An Author - Title "), n, F.lit(" (1999).epub"))).when(k == 1, F.concat(F.lit("Some Series 12 - Title "), n, F.lit(".pdf"))).when(k == 2, F.concat(F.lit("An Author - Title "), n, F.lit(".epub"))).otherwise(F.concat(F.lit("plain"), n))
    parsed = table(spark, d, "part").select("p_partkey", authority.parsed_name(F.concat(F.lit("a/b/"), name)).alias("m"))
    return parsed.select("p_partkey", F.coalesce("m.profile", F.lit("none")).alias("profile"), F.coalesce("m.title", F.lit("")).alias("title"))


@query(f"""WITH {OBS} SELECT file_id, 'FILE_NAME' AS source, 'book' || cast(file_id AS VARCHAR) AS value, cast(200 AS INTEGER) AS permille FROM obs UNION ALL SELECT file_id, 'FOLDER_NAME', lang, 100 FROM obs""")
def path_evidence(spark, d):
    return authority.path_evidence(observations(spark, d), "file_id", "relative_path").select("file_id", "source", "value", F.round(F.col("confidence") * 1000).cast("int").alias("permille"))


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'author' WHEN 1 THEN 'editor' WHEN 2 THEN 'translator' WHEN 3 THEN 'book_producer' WHEN 4 THEN 'other' END AS role FROM supplier")
def contributor_roles(spark, d):
    code = F.element_at(F.array(*(F.lit(x) for x in ("AUT", "edt", "trl ", "bkp", "oth", "zzz"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", marc_role(code).alias("role"))


@query("SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY cast(l_suppkey AS VARCHAR) || '}') AS r FROM lineitem) WHERE r = 1 GROUP BY 1")
def smallest_payloads(spark, d):
    return authority.smallest_payload(table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey")


@query("""WITH e AS (SELECT o_orderkey, o_orderdate + INTERVAL 300 DAY AS f, o_orderdate + INTERVAL 900 DAY AS x, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1998-06-01' END AS r FROM orders)
SELECT o_orderkey, CASE WHEN TIMESTAMP '1998-01-01' < f THEN 'USE' WHEN TIMESTAMP '1998-01-01' < x AND r IS NOT NULL THEN 'SERVE_STALE' WHEN r IS NOT NULL THEN 'WAIT' WHEN TIMESTAMP '1998-01-01' < x THEN 'REFRESH' ELSE 'FETCH' END AS decision FROM e""")
def cache_decisions(spark, d):
    at = F.col("o_orderdate")
    entries = table(spark, d, "orders").select("o_orderkey", (at + F.expr("INTERVAL 300 DAYS")).alias("fresh_until"), (at + F.expr("INTERVAL 900 DAYS")).alias("expires_at"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("1998-06-01").cast("timestamp_ntz")).alias("retry_after"))
    return authority.cache_decision(entries, F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "decision")


@query("SELECT o_orderkey FROM orders WHERE TIMESTAMP '1998-01-01' < o_orderdate + INTERVAL 900 DAY")
def pruned_cache(spark, d):
    entries = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("expires_at"), F.lit(10).cast("long").alias("payload_bytes"))
    return authority.pruned_cache(entries, F.lit("1998-01-01").cast("timestamp_ntz"), 1 << 40).select("o_orderkey")


@query("""WITH f AS (SELECT p_partkey, p_partkey % 50 AS folder, CASE p_partkey % 6 WHEN 0 THEN 'NFO' WHEN 1 THEN 'SFV' END AS kind, (CASE p_partkey % 6 WHEN 0 THEN 'a' || cast(p_partkey AS VARCHAR) || '.nfo' ELSE 'b' || cast(p_partkey AS VARCHAR) || '.sfv' END) AS name FROM part WHERE p_partkey % 6 < 2 AND p_partkey % 5 <> 0)
SELECT DISTINCT 'd' || cast(s_suppkey % 60 AS VARCHAR) || '/s' || cast(s_suppkey AS VARCHAR) || '.rar' AS archive_path, CASE WHEN n_sidecars > 8 THEN 'LIMIT_EXCEEDED' ELSE 'LISTED' END AS status, CASE WHEN n_sidecars <= 8 THEN name END AS name, CASE WHEN n_sidecars <= 8 THEN kind END AS kind, n_sidecars FROM (SELECT s_suppkey, name, kind, count(*) OVER (PARTITION BY s_suppkey) AS n_sidecars FROM supplier JOIN f ON s_suppkey % 60 = folder)""")
def sidecar_inventory(spark, d):
    n = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("a"), n, F.lit(".nfo"))).when(F.col("p_partkey") % 6 == 1, F.concat(F.lit("b"), n, F.lit(".sfv"))).otherwise(F.concat(F.lit("c"), n, F.lit(".epub")))
    deep = F.when(F.col("p_partkey") % 5 == 0, "deeper/").otherwise("")
    files = table(spark, d, "part").select(F.concat(F.lit("d"), (F.col("p_partkey") % 50).cast("string"), F.lit("/"), deep, name).alias("path"))
    archives = table(spark, d, "supplier").select(F.concat(F.lit("d"), (F.col("s_suppkey") % 60).cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".rar")).alias("path"))
    return planning.sidecar_inventory(archives, files, 8)


@query(f"""WITH {OBS}, m AS (SELECT root AS parent, CASE WHEN file_id % 50 = 3 THEN NULL ELSE sha END AS sha FROM obs WHERE file_id % 10 = 3)
SELECT file_id, CASE WHEN file_id % 7 = 0 OR sha IN (SELECT sha FROM m WHERE sha IS NOT NULL) THEN 'KNOWN_PRESENT' WHEN root IN (SELECT parent FROM m WHERE sha IS NULL) THEN 'UNKNOWN' ELSE 'KNOWN_NONE' END AS state FROM obs""")
def archive_dependencies(spark, d):
    o = observations(spark, d)
    members = o.where("file_id % 10 = 3").select(F.col("root").alias("parent"), F.when(F.col("file_id") % 50 != 3, F.col("sha")).alias("sha256"))
    return planning.archive_dependencies(o.select("file_id", F.col("root").alias("parent"), F.col("sha").alias("sha256")), o.where("file_id % 7 = 0").select("file_id"), members)


@query("""WITH b AS (SELECT o_orderkey AS plan_id, o_orderstatus AS s, list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'LINEAGE_MISMATCH' END, CASE WHEN o_orderkey % 7 = 0 THEN 'FIELD_SELECTION_INVALID' END, CASE WHEN o_orderkey % 9 = 0 THEN 'DEPENDENCY_EVIDENCE_INCOMPLETE' END, CASE WHEN o_orderstatus = 'P' THEN 'REVIEW_REJECTED' END], lambda v: v IS NOT NULL) AS x FROM orders)
SELECT plan_id, array_to_string(x, ',') AS blockers, CASE WHEN len(x) > 0 THEN 'BLOCKED' WHEN s = 'F' THEN 'APPROVED_NON_EXECUTABLE' ELSE 'REVIEW_REQUIRED' END AS status FROM b""")
def correction_status(spark, d):
    i = F.col("o_orderkey")
    review = F.when(F.col("o_orderstatus") == "P", "REJECTED").when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("PENDING")
    plans = table(spark, d, "orders").select(i.alias("plan_id"), (i % 5 != 0).alias("same_lineage"), F.lit(True).alias("evidence_complete"), F.lit("a").alias("old_value"), F.when(i % 7 == 0, "a").otherwise("b").alias("new_value"), F.when(i % 9 == 0, "UNKNOWN").otherwise("KNOWN_NONE").alias("dependency"), review.alias("review"))
    return planning.correction_status(plans).select("plan_id", F.array_join("blockers", ",").alias("blockers"), "status")


@query("""WITH b AS (SELECT o_orderkey AS plan_id, list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'PLAN_NOT_APPROVED' END, CASE WHEN o_orderkey % 3 = 0 THEN 'IDENTITY_NOT_EXACT_DUPLICATE' END, CASE WHEN TIMESTAMP '1996-01-01' < o_orderdate OR TIMESTAMP '1996-01-01' >= o_orderdate + INTERVAL 400 DAY THEN 'AUTHORIZATION_WINDOW_INVALID' END], lambda v: v IS NOT NULL) AS x FROM orders)
SELECT plan_id, CASE WHEN len(x) > 0 THEN 'BLOCKED' ELSE 'ELIGIBLE' END AS status, array_to_string(x, ',') AS blockers FROM b""")
def quarantine_eligibility(spark, d):
    at = F.col("o_orderdate")
    plans = table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), F.when(F.col("o_orderstatus") == "F", "APPROVED_NON_EXECUTABLE").otherwise("BLOCKED").alias("plan_status"), F.when(F.col("o_orderkey") % 3 == 0, "SAME_WORK").otherwise("EXACT_DUPLICATE").alias("relation"), F.lit("KNOWN_NONE").alias("dependency"), at.alias("valid_from"), (at + F.expr("INTERVAL 400 DAYS")).alias("valid_until"))
    return planning.quarantine_eligibility(plans, F.lit("1996-01-01").cast("timestamp_ntz")).select("plan_id", "status", F.array_join("blockers", ",").alias("blockers"))


@query("SELECT true AS stable, false AS changed_is_stable")
def double_read(spark, d):
    """Two reads of a library give one digest, whatever their partitions; a changed one another."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    first, second = (ordered_digest(x, ["p_partkey"]).withColumnRenamed("digest", n) for x, n in ((p, "a"), (p.repartition(7), "b")))
    third = ordered_digest(p.where("p_partkey > 1"), ["p_partkey"]).withColumnRenamed("digest", "c")
    return first.crossJoin(second).crossJoin(third).select((F.col("a") == F.col("b")).alias("stable"), (F.col("a") == F.col("c")).alias("changed_is_stable"))  # one row each

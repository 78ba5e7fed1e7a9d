"""Inventory, reports and relational building blocks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.functions.scalars import book_format, is_book, quick_fingerprint
from veritome.functions.unicode import normal_text
from veritome.operators import inventory, relational
from veritome.plans.registry import OBS, QUICK, observations, query, table

_GROUPS = f"""WITH {OBS}, g AS (
  SELECT sha, count(*) AS member_count, cast(sum(size_bytes) AS BIGINT) AS total_bytes, greatest(0, cast(sum(size_bytes) - max(size_bytes) AS BIGINT)) AS redundant_bytes,
         sha256(concat_ws(chr(0), 'duplicate-group/v1', sha)) AS group_id FROM obs GROUP BY sha HAVING count(*) > 1)
"""


@query(_GROUPS + "SELECT sha, group_id, member_count, total_bytes, redundant_bytes FROM g")
def duplicate_inventory(spark, d):
    return inventory.duplicate_groups(observations(spark, d), "sha", "file_id", "size_bytes")


@query(_GROUPS + "SELECT sha, group_id, member_count, total_bytes, redundant_bytes FROM g ORDER BY redundant_bytes DESC, member_count DESC, group_id DESC LIMIT 20")
def largest_duplicate_groups(spark, d):
    return inventory.largest_groups(duplicate_inventory(spark, d), 20)


@query(_GROUPS + "SELECT sha, group_id, member_count, total_bytes, redundant_bytes FROM g ORDER BY member_count DESC, group_id LIMIT 20")
def most_member_groups(spark, d):
    return inventory.most_members(duplicate_inventory(spark, d), 20)


@query(f"WITH {OBS} SELECT file_id, sha, group_size FROM (SELECT file_id, sha, count(*) OVER (PARTITION BY sha) AS group_size FROM obs) WHERE group_size > 1")
def duplicate_members(spark, d):
    return inventory.group_members(observations(spark, d).select("file_id", "sha"), "sha").select("file_id", "sha", "group_size")


@query(f"""WITH {OBS}, n AS (SELECT *, regexp_replace(trim(text, E' \\n\\t\\r'), '\\s+', ' ', 'g') AS t FROM obs), v AS (SELECT file_id, t, sha FROM n UNION ALL SELECT -file_id - 1, t, sha256(sha) FROM n WHERE file_id % 10 = 0)
SELECT sha256(t) AS text_sha, count(*) AS member_count, count(DISTINCT sha) AS file_versions FROM v WHERE t <> '' GROUP BY t HAVING count(DISTINCT sha) > 1""")
def content_variants(spark, d):
    base = observations(spark, d).select("file_id", normal_text(F.col("text")).alias("t"), "sha").where("t <> ''").select("file_id", F.sha2("t", 256).alias("text_sha"), "sha")
    other = base.where("file_id % 10 = 0").select((-F.col("file_id") - 1).alias("file_id"), "text_sha", F.sha2("sha", 256).alias("sha"))
    return inventory.content_variants(base.unionByName(other), "text_sha", "sha")


_FORMATS = ("EPUB", "MOBI", "AZW", "AZW3", "PDF", "OTHER", "UNKNOWN", "CBZ")


@query(f"""WITH {OBS}, f AS (SELECT CASE WHEN lower(relative_path) LIKE '%.epub' THEN 'EPUB' WHEN lower(relative_path) LIKE '%.mobi' THEN 'MOBI' WHEN lower(relative_path) LIKE '%.azw' THEN 'AZW' WHEN lower(relative_path) LIKE '%.azw3' THEN 'AZW3' WHEN lower(relative_path) LIKE '%.pdf' THEN 'PDF' WHEN relative_path LIKE '%.txt' THEN 'OTHER' ELSE 'UNKNOWN' END AS format FROM obs),
v(ordinal, format) AS (VALUES (0,'EPUB'),(1,'MOBI'),(2,'AZW'),(3,'AZW3'),(4,'PDF'),(5,'OTHER'),(6,'UNKNOWN'),(7,'CBZ'))
SELECT cast(ordinal AS INTEGER) AS ordinal, v.format AS format, count(f.format) AS n FROM v LEFT JOIN f USING (format) GROUP BY ALL""")
def format_counts(spark, d):
    return relational.vocabulary_counts(observations(spark, d).select(book_format(F.col("relative_path")).alias("format")), "format", _FORMATS)


@query("""SELECT coalesce(CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END, 'UNAVAILABLE') AS language, count(*) AS n FROM documents GROUP BY 1""")
def language_counts(spark, d):
    return table(spark, d, "documents").select(F.when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("l")).groupBy(F.coalesce("l", F.lit("UNAVAILABLE")).alias("language")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, cast(sum(round(o_totalprice * 100)) AS BIGINT) AS cents, cast(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, count(DISTINCT o_custkey) AS customers,
count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_custkey END) AS large_customers FROM orders GROUP BY 1""")
def status_rollup(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))).alias("large_customers"))


@query("SELECT count(*) AS files, cast(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes, cast(coalesce(sum(CASE WHEN n_chars < 0 THEN n_chars END), 0) AS BIGINT) AS negative FROM documents")
def inventory_totals(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("n_chars") < 0, F.col("n_chars"))), F.lit(0)).alias("negative"))


_QUICK = f"""WITH {OBS}, q AS (SELECT file_id AS target_id, {QUICK} AS value FROM obs UNION ALL SELECT file_id, sha256('other' || sha) FROM obs WHERE file_id % 17 = 0),
a AS (SELECT target_id, min(value) AS value FROM q GROUP BY 1 HAVING count(DISTINCT value) = 1)
"""


def _quick(spark, d):
    o = observations(spark, d)
    content = F.encode("text", "UTF-8")
    one = o.select(F.col("file_id").alias("target_id"), quick_fingerprint(content, F.octet_length(content)).alias("value"))
    return one.unionByName(o.where("file_id % 17 = 0").select(F.col("file_id").alias("target_id"), F.sha2(F.concat(F.lit("other"), "sha"), 256).alias("value")))


@query(_QUICK + "SELECT target_id, value FROM a")
def consistent_fingerprints(spark, d):
    return relational.consistent_value(_quick(spark, d), ["target_id"], "value")


@query(_QUICK + """SELECT a.target_id, a.value, g.group_size FROM a JOIN (SELECT value, count(*) AS group_size FROM a GROUP BY 1 HAVING count(*) > 1) g USING (value)
WHERE NOT EXISTS (SELECT 1 FROM obs WHERE obs.file_id = a.target_id AND obs.file_id % 5 = 0)""")
def hash_candidates(spark, d):
    full = observations(spark, d).where("file_id % 5 = 0").select(F.col("file_id").alias("target_id"), F.col("sha").alias("value"))
    return inventory.hash_candidates(_quick(spark, d), full)


@query("SELECT conv_id AS item_id, arg_max(role, turn) AS decision, max(turn) AS sequence_no FROM conversations GROUP BY 1")
def latest_decision(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("sequence_no"), F.col("role").alias("decision"))
    return relational.latest(c, ["item_id"], ["sequence_no"]).select("item_id", "decision", "sequence_no")


@query("""WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
c AS (SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, c.o_orderkey AS latest_complete, CASE WHEN l.o_orderstatus = 'F' THEN l.o_orderkey ELSE -1 END AS latest_if_complete FROM c JOIN l USING (o_custkey)""")
def latest_run_variants(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    any_status = relational.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(-1).alias("latest_if_complete"))
    complete = relational.latest(o.where("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("latest_complete"))
    return complete.join(any_status, "o_custkey")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def previous_observation(spark, d):
    return relational.latest_by_rank(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey AS item_id, status, cast(priority AS INTEGER) AS priority FROM (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'REVIEW' ELSE 'SUCCEEDED' END AS status FROM orders),
(VALUES ('ERROR', 0), ('FAILED', 1), ('REVIEW', 6)) v(s, priority) WHERE s = status ORDER BY priority, item_id LIMIT 2500""")
def review_list(spark, d):
    word = F.when(F.col("o_orderkey") % 9 == 0, "ERROR").when(F.col("o_orderkey") % 9 == 1, "FAILED").when(F.col("o_orderkey") % 9 == 2, "REVIEW").otherwise("SUCCEEDED")
    return inventory.review_list(table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), word.alias("status")), 2500).select("item_id", "status", "priority")


@query(f"WITH {OBS} SELECT root, file_id, relative_path, place FROM (SELECT root, file_id, relative_path, cast(row_number() OVER (PARTITION BY root ORDER BY relative_path, file_id) AS INTEGER) AS place FROM obs) WHERE place <= 5")
def plan_per_root(spark, d):
    return relational.top_per_group(observations(spark, d).select("root", "file_id", "relative_path"), ["root"], [F.col("relative_path"), F.col("file_id")], 5)


@query("""WITH c AS (SELECT l_orderkey, count(*) AS counted FROM lineitem GROUP BY 1) SELECT o_orderkey, cast(o_orderkey % 7 AS BIGINT) AS stored, coalesce(counted, 0) AS counted FROM orders LEFT JOIN c ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> coalesce(counted, 0)""")
def counter_mismatches(spark, d):
    stored = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("stored"))
    return inventory.counter_mismatches(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), stored, ["o_orderkey"], "stored")


@query("SELECT 'l_returnflag' AS name, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', cast(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2")
def literal_counts(spark, d):
    return inventory.literal_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("SELECT source, count(*) AS member_count, array_to_string(list_sort(list(doc_id))[1:10], ',') AS members, count(*) > 10 AS truncated FROM documents GROUP BY 1")
def bounded_members(spark, d):
    return relational.bounded_members(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 10).select("source", "member_count", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "truncated")


@query(f"""WITH {OBS} SELECT file_id, relative_path FROM obs WHERE file_id % 4 <> 1 AND file_id % 6 <> 0 AND (lower(relative_path) LIKE '%.epub' OR lower(relative_path) LIKE '%.mobi' OR lower(relative_path) LIKE '%.azw' OR lower(relative_path) LIKE '%.azw3' OR lower(relative_path) LIKE '%.pdf')""")
def current_observations(spark, d):
    o = observations(spark, d).withColumn("modified_at", F.col("file_id"))
    seen = o.select("file_id", "relative_path", "size_bytes", "modified_at", F.lit("run-2").alias("scan_run_id")).unionByName(o.select("file_id", "relative_path", "size_bytes", "modified_at", F.lit("run-1").alias("scan_run_id")))
    records = o.select("file_id", "relative_path", (F.col("size_bytes") + F.when(F.col("file_id") % 4 == 1, 1).otherwise(0)).alias("size_bytes"), "modified_at", F.when(F.col("file_id") % 6 == 0, "MISSING").otherwise("PRESENT").alias("presence_state"), F.lit("EBOOK").alias("media_type"))
    return relational.current_observations(seen, records, "run-2").where(is_book(F.col("relative_path"))).select("file_id", "relative_path")


@query("""SELECT doc_id AS observation_id, quality FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 1""")
def evidence_on_either_subject(spark, d):
    current = table(spark, d, "documents").select(F.col("doc_id").alias("observation_id"), (F.col("doc_id") + 1_000_000_000).alias("file_id"))
    evidence = table(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "FILE_OBSERVATION").otherwise("FILE").alias("target_kind"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1_000_000_000).alias("target_id"), "quality")
    return relational.stacked_subjects(current).join(evidence, ["target_kind", "target_id"]).select("observation_id", "quality")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def without_evidence(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def with_open_runs(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey, n_name, r_name, count(o_orderkey) AS runs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def agents_with_runs(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    agents = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return agents.join(runs, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("runs"))


@query("SELECT doc_id, cast(row_number() OVER (ORDER BY lang, doc_id) - 1 AS BIGINT) AS ordinal FROM documents")
def dense_ordinals(spark, d):
    return relational.dense_ordinals(table(spark, d, "documents").select("lang", "doc_id"), ["lang", "doc_id"]).select("doc_id", "ordinal")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 3) ORDER BY 1, 2 LIMIT 50")
def keyset_page(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.page(rows, ["l_orderkey", "l_linenumber"], (100, 3), 50)[0]


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part UNION ALL SELECT p_partkey + 100000000, p_size FROM part WHERE p_partkey % 50 = 0")
def upserted_parts(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    changes = p.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") + 1).alias("p_size")).unionByName(p.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 100_000_000).alias("p_partkey"), "p_size"))
    return relational.upsert(p, changes, "p_partkey")


@query("SELECT s_suppkey, sha256(s_name) AS digest FROM supplier WHERE s_suppkey % 4 <> 0")
def newly_created(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("digest"))
    return relational.create_or_get(s.where("s_suppkey % 4 = 0"), s, ["s_suppkey"])


@query("""WITH e AS (SELECT event_type AS provider, user_id % 5 AS capability, user_id AS input_id, 'v' || cast(event_id % 2 AS VARCHAR) AS tool_version, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'c' END AS config, CASE WHEN value > 50 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM events)
SELECT DISTINCT w.provider, w.input_id, w.tool_version FROM e w WHERE EXISTS (SELECT 1 FROM e x WHERE x.status = 'SUCCEEDED' AND x.provider = w.provider AND x.capability = w.capability AND x.input_id = w.input_id AND x.tool_version = w.tool_version AND x.config = w.config)""")
def reusable_steps(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 5).alias("capability"), F.col("user_id").alias("input_id"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("tool_version"), F.lit("a").alias("adapter_version"), F.when(F.col("event_id") % 7 != 0, "c").alias("config"), F.when(F.col("value") > 50, "SUCCEEDED").otherwise("FAILED").alias("status"))
    return relational.reusable(e.drop("status"), e).select("provider", "input_id", "tool_version").distinct()


@query("""WITH x AS (SELECT event_type, user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REJECT' ELSE 'DEFER' END AS decision, ts FROM events)
SELECT event_type, user_id, decision, event_id AS decision_id FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE decision <> 'DEFER'""")
def reusable_decisions(spark, d):
    e = table(spark, d, "events")
    log = e.select("event_type", "user_id", F.col("event_id").alias("decision_id"), F.col("event_id").alias("sequence_no"), F.col("ts").alias("decided_at"), F.element_at(F.array(F.lit("ACCEPT"), F.lit("REJECT"), F.lit("DEFER")), (F.col("event_id") % 3 + 1).cast("int")).alias("decision"))
    return relational.reusable_decision(log, e.select("event_type", "user_id").distinct(), ["event_type", "user_id"])

"""Matching runs over the driver's tables: customers in the role of observations, orders in that of resolutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.operators import match_run
from veritome.plans.registry import query, table
from veritome.sources.shared import written

_BASE = ("customer", "orders", "lineitem", "supplier")
TABLES = {
    "current": "SELECT concat('o', c_custkey) AS observation_id, concat('f', c_custkey) AS file_id FROM {customer} WHERE c_custkey % 11 <> 0",
    "fingerprints": "SELECT o_orderkey AS id, 'FILE_OBSERVATION' AS target_kind, concat('o', o_custkey) AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'FILE_SHA256' ELSE 'EBOOK_NORMALIZED_TEXT' END AS kind, 'sha256' AS algorithm, CASE WHEN o_orderkey % 3 = 0 THEN 'v2' ELSE 'v1' END AS algorithm_version, concat('d', CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey ELSE o_custkey % 40 END) AS value FROM {orders}",
    "resolution_candidates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'FILE' ELSE 'FILE_OBSERVATION' END AS subject_kind, concat(CASE WHEN o_orderkey % 4 = 0 THEN 'f' ELSE 'o' END, o_custkey) AS subject_id, CASE o_orderkey % 3 WHEN 0 THEN 'EDITION' WHEN 1 THEN 'WORK' ELSE 'SERIES' END AS candidate_kind, concat('e', o_orderkey % 500) AS candidate_entity_id, CASE WHEN o_orderkey % 5 < 3 THEN 'AUTO_SAFE' ELSE 'REVIEW' END AS disposition, concat('x', o_orderkey % 2) AS evidence_digest FROM {orders}",
    "decisions": "SELECT l_orderkey AS candidate_id, l_linenumber AS sequence_no, CASE WHEN l_partkey % 3 = 0 THEN 'ACCEPT' WHEN l_partkey % 3 = 1 THEN 'REJECT' ELSE 'DEFER' END AS decision, concat('x', l_suppkey % 2) AS evidence_digest FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) q",
    "identifiers": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'WORK' ELSE 'EDITION' END AS target_kind, concat('e', s_suppkey * 3) AS target_id, 'isbn' AS namespace, concat('n', s_suppkey % 7) AS value FROM {supplier}",
    "contributions": "SELECT s_suppkey AS id, 'WORK' AS target_kind, concat('e', s_suppkey % 60) AS target_id, concat('a', s_suppkey % 4) AS agent_id, CASE WHEN s_suppkey % 5 = 0 THEN 'editor' ELSE 'Author' END AS role FROM {supplier}",
    "assertions": "SELECT s_suppkey AS id, 'WORK' AS target_kind, concat('e', s_suppkey % 60) AS target_id, CASE WHEN s_suppkey % 10 = 0 THEN 'work.title' ELSE 'work.title.normalized' END AS field_name, concat('t', s_suppkey % 5) AS value FROM {supplier}",
}


def tables(spark, d) -> dict:
    known = {n: table(spark, d, n) for n in _BASE}
    return {name: spark.sql(sql, **{n: x for n, x in known.items() if f"{{{n}}}" in sql}) for name, sql in TABLES.items()}


_WITH = "WITH " + ", ".join(f"{n} AS ({s.replace('{', '').replace('}', '')})" for n, s in TABLES.items()) + """,
agreed AS (SELECT target_id AS o, kind, algorithm_version AS v, min(value) AS value FROM fingerprints GROUP BY ALL HAVING count(DISTINCT value) = 1),
latest AS (SELECT candidate_id, arg_max(decision, sequence_no) AS decision, arg_max(evidence_digest, sequence_no) AS digest FROM decisions GROUP BY 1),
res AS (SELECT DISTINCT c.observation_id AS o, c.file_id AS f, r.candidate_kind AS kind, r.candidate_entity_id AS e FROM resolution_candidates r JOIN current c ON (r.subject_kind = 'FILE_OBSERVATION' AND r.subject_id = c.observation_id) OR (r.subject_kind = 'FILE' AND r.subject_id = c.file_id) LEFT JOIN latest l ON l.candidate_id = r.id WHERE disposition = 'AUTO_SAFE' OR (l.decision = 'ACCEPT' AND l.digest = r.evidence_digest)),
keys AS (SELECT 'FILE_SHA256' AS t, value AS k, c.observation_id AS o, c.file_id AS f, NULL AS e FROM agreed a JOIN current c ON c.observation_id = a.o WHERE kind = 'FILE_SHA256' AND v = 'v1'
 UNION SELECT 'TEXT_FINGERPRINT', v || value, c.observation_id, c.file_id, NULL FROM agreed a JOIN current c ON c.observation_id = a.o WHERE kind = 'EBOOK_NORMALIZED_TEXT'
 UNION SELECT CASE kind WHEN 'SERIES' THEN 'SERIES_CONTEXT' ELSE 'RESOLVED_' || kind END, e, o, f, e FROM res
 UNION SELECT 'EDITION_IDENTIFIER', namespace || value, o, f, e FROM res JOIN identifiers i ON kind = 'EDITION' AND i.target_kind = 'EDITION' AND i.target_id = e
 UNION SELECT 'AGENT_TITLE', agent_id || value, o, f, e FROM res JOIN contributions b ON kind = 'WORK' AND b.target_id = e AND lower(role) = 'author' JOIN assertions a ON a.target_id = e AND a.field_name = 'work.title.normalized'),
full_blocks AS (SELECT t, k FROM keys GROUP BY ALL HAVING count(DISTINCT o) > 1),
ends AS (SELECT DISTINCT t, k, CASE WHEN t = 'FILE_SHA256' THEN f ELSE e END AS x FROM keys JOIN full_blocks USING (t, k) WHERE t IN ('FILE_SHA256', 'EDITION_IDENTIFIER', 'AGENT_TITLE')),
sizes AS (SELECT t, k, count(*) AS n, min(x) AS least FROM ends GROUP BY ALL),
cases AS (SELECT t, k, l.x AS left_id, r.x AS right_id FROM ends l JOIN ends r USING (t, k) JOIN sizes USING (t, k) WHERE l.x < r.x AND (l.x = least OR (t <> 'FILE_SHA256' AND n <= 64)))
"""


@query(_WITH + "SELECT t AS block_type, count(DISTINCT k) AS keys, count(DISTINCT o) AS observations, count(*) AS n FROM (SELECT DISTINCT t, k, o FROM keys) GROUP BY 1")
def block_keys(spark, d):
    """Keys of all seven types."""
    found = match_run.block_keys(tables(spark, d), evidence=False).select("block_type", "block_key", "observation_id").distinct()
    keys = found.groupBy("block_type", "block_key").agg(F.count("*").alias("n")).groupBy("block_type").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))
    return keys.join(found.select("block_type", "observation_id").distinct().groupBy("block_type").agg(F.count("*").alias("observations")), "block_type")


@query(_WITH + "SELECT CASE t WHEN 'FILE_SHA256' THEN 'EXACT_DUPLICATE' WHEN 'AGENT_TITLE' THEN 'SAME_WORK' ELSE 'SAME_EDITION' END AS relation, left_id, right_id, CASE WHEN t = 'FILE_SHA256' THEN 'CONFIRMED' ELSE 'REVIEW_REQUIRED' END AS status, count(*) AS n FROM cases GROUP BY ALL")
def match_cases(spark, d):
    return match_run.cases(written(match_run.block_keys(tables(spark, d), evidence=False), "keys")).groupBy("relation", "left_id", "right_id", "status").agg(F.count("*").alias("n"))


@query(_WITH + "SELECT 'append' AS what, count(*) AS n FROM cases UNION ALL SELECT 'queue', count(*) FILTER (t <> 'FILE_SHA256') FROM cases UNION ALL SELECT 'last ordinal', count(*) FILTER (t <> 'FILE_SHA256') - 1 FROM cases UNION ALL SELECT 'append again', 0 UNION ALL SELECT 'queue again', 0")
def match_run_twice(spark, d):
    """A run over nothing stored, and one over what the first has appended."""
    found = written(match_run.cases(written(match_run.block_keys(tables(spark, d), evidence=False), "keys")), "cases")
    keys = list(match_run.IDENTITY)
    none = found.select(*keys).where("false")
    decisions = none.selectExpr("*", "cast(null as timestamp) decided_at", "0 sequence_no", "'' decision_id", "'' decision")
    new, _, queue = match_run.run(found, none, decisions, none.selectExpr("*", "cast(0 as long) ordinal"))
    new, queue = written(new, "candidates"), written(queue, "queue")
    again, _, more = match_run.run(found, new, decisions, queue.select(*keys, "ordinal"))
    told = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    last = queue.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("n")).select(F.lit("last ordinal").alias("what"), "n")
    return told("append", new).unionByName(told("queue", queue)).unionByName(last).unionByName(told("append again", again)).unionByName(told("queue again", more))

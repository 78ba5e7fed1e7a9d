"""Incremental scans, candidate blocks, pairs, scores, comparison and quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.functions.scalars import book_format, quick_fingerprint
from veritome.functions.unicode import text_fingerprint
from veritome.operators import evidence, incremental, matching
from veritome.plans.registry import OBS, QUICK, observations, query, spread, table
from veritome.sources.shared import written

_SCAN = f"""WITH {OBS}, old AS (SELECT relative_path AS p, size_bytes + CASE WHEN file_id % 9 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN file_id % 8 = 0 THEN 'MISSING' ELSE 'PRESENT' END AS presence, CASE WHEN file_id % 8 = 0 THEN 2 ELSE 0 END AS misses, CASE WHEN file_id % 16 = 0 THEN TIMESTAMP '2024-01-01' WHEN file_id % 8 = 0 THEN TIMESTAMP '2024-01-09 12:00:00' END AS since FROM obs WHERE file_id % 10 <> 0),
new AS (SELECT relative_path AS p, size_bytes AS size FROM obs WHERE file_id % 11 <> 0 AND file_id % 24 <> 8 AND file_id % 16 <> 0)
"""


def _records(spark, d):
    o = observations(spark, d).where("file_id % 10 <> 0")
    gone = F.col("file_id") % 8 == 0
    since = F.when(F.col("file_id") % 16 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).when(gone, F.lit("2024-01-09 12:00:00").cast("timestamp"))
    return o.select("relative_path", (F.col("size_bytes") + F.when(F.col("file_id") % 9 == 0, 1).otherwise(0)).alias("size_bytes"), F.lit(0).alias("modified_at"), F.when(gone, "MISSING").otherwise("PRESENT").alias("presence_state"), since.alias("missing_since_at"), F.when(gone, 2).otherwise(0).alias("misses"))


def _found(spark, d):
    return observations(spark, d).where("file_id % 11 <> 0 AND file_id % 24 <> 8 AND file_id % 16 <> 0").select("relative_path", "size_bytes", F.lit(0).alias("modified_at"))


@query(_SCAN + """SELECT coalesce(old.p, new.p) AS relative_path, CASE WHEN new.p IS NOT NULL THEN 'PRESENT' WHEN old.misses + 1 >= 3 AND TIMESTAMP '2024-01-10' >= old.since + INTERVAL 24 HOUR THEN 'DELETED' ELSE 'MISSING' END AS presence_state,
cast(CASE WHEN new.p IS NOT NULL THEN 0 ELSE old.misses + 1 END AS INTEGER) AS misses,
coalesce(CASE WHEN new.p IS NOT NULL THEN CASE WHEN old.p IS NULL THEN 'NEW' WHEN old.presence <> 'PRESENT' THEN 'REAPPEARED' WHEN old.size = new.size THEN 'UNCHANGED' ELSE 'MODIFIED' END
WHEN old.misses + 1 >= 3 AND TIMESTAMP '2024-01-10' >= old.since + INTERVAL 24 HOUR THEN 'DELETED' WHEN old.presence = 'PRESENT' THEN 'MISSING' END, 'NONE') AS change_state FROM old FULL JOIN new ON old.p = new.p""")
def incremental_scan(spark, d):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return incremental.reconcile(_records(spark, d), _found(spark, d), now).select("relative_path", "presence_state", F.col("misses").cast("int").alias("misses"), F.coalesce("change_state", F.lit("NONE")).alias("change_state"))


@query(f"""WITH {OBS}, f AS (SELECT file_id, 'FILE_SHA256' AS kind, 2 AS rank, sha AS value FROM obs WHERE file_id % 3 <> 0 UNION ALL SELECT file_id, 'QUICK_FILE', 1, {QUICK} FROM obs),
s AS (SELECT f.* FROM f WHERE file_id % 2 = 0), t AS (SELECT f.* FROM f WHERE file_id % 2 = 1),
one AS (SELECT kind, value FROM s GROUP BY ALL HAVING count(DISTINCT file_id) = 1), two AS (SELECT kind, value FROM t GROUP BY ALL HAVING count(DISTINCT file_id) = 1)
SELECT s.file_id AS source_id, t.file_id AS target_id, s.kind AS evidence, s.value FROM s JOIN t ON s.kind = t.kind AND s.value = t.value JOIN one ON s.kind = one.kind AND s.value = one.value JOIN two ON s.kind = two.kind AND s.value = two.value QUALIFY row_number() OVER (PARTITION BY s.file_id, t.file_id ORDER BY s.rank DESC, s.value DESC) = 1""")
def relocations(spark, d):
    o = observations(spark, d)
    prints = o.where("file_id % 3 <> 0").select("file_id", F.lit("FILE_SHA256").alias("kind"), F.col("sha").alias("value")).unionByName(o.select("file_id", F.lit("QUICK_FILE").alias("kind"), quick_fingerprint(F.encode("text", "UTF-8"), F.octet_length(F.encode("text", "UTF-8"))).alias("value")))
    files = o.select("file_id", "relative_path")
    return incremental.relocations(files.where("file_id % 2 = 0"), files.where("file_id % 2 = 1"), prints).select("source_id", "target_id", "evidence", "value")


_BLOCKS = f"""WITH {OBS}, e AS (SELECT 'FILE_SHA256' AS block_type, sha AS block_key, file_id AS m FROM obs UNION ALL SELECT 'AGENT_TITLE', root || '|' || lang || '|' || cast(file_id % 5 AS VARCHAR), file_id FROM obs UNION ALL SELECT 'SERIES_CONTEXT', lang, file_id FROM obs UNION ALL SELECT 'TEXT_FINGERPRINT', sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), file_id FROM obs),
b AS (SELECT block_type, block_key, count(DISTINCT m) AS n, list_sort(list(DISTINCT m)) AS ms FROM e GROUP BY ALL HAVING count(DISTINCT m) > 1)
"""


def _evidence(spark, d):
    """A table of every file's keys: texts are read, hashed and normalised once, however often blocks and pairs go over their keys."""
    keys = {"FILE_SHA256": F.col("sha"), "AGENT_TITLE": F.concat_ws("|", "root", "lang", (F.col("file_id") % 5).cast("string")), "SERIES_CONTEXT": F.col("lang"), "TEXT_FINGERPRINT": text_fingerprint(F.col("text"))}
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("block_type"), key.alias("block_key")) for kind, key in keys.items()))).alias("k")
    return written(observations(spark, d).select(F.col("file_id").alias("member_id"), each).select("k.*", "member_id"), "evidence")


@query(_BLOCKS + """SELECT block_type, block_key, n AS member_count, cast(least(n, 256) AS INTEGER) AS listed, n > 256 AS truncated, CASE WHEN block_type = 'FILE_SHA256' THEN 'EXACT_GROUP' WHEN n > 64 THEN 'SECONDARY_REQUIRED' ELSE 'READY' END AS status,
CASE WHEN block_type = 'SERIES_CONTEXT' THEN 'SUPPORTING_ONLY' ELSE 'IDENTITY_CAPABLE' END AS strength, CASE WHEN block_type = 'FILE_SHA256' THEN ms[1] ELSE -1 END AS representative FROM b""")
def candidate_blocks(spark, d):
    return matching.blocks(_evidence(spark, d)).select("block_type", "block_key", "member_count", F.size("members").alias("listed"), "truncated", "status", "strength", F.coalesce("representative", F.lit(-1)).alias("representative"))


@query(_BLOCKS + """, p AS (SELECT block_type, ms[1] AS l, unnest(ms[2:]) AS r FROM b WHERE block_type = 'FILE_SHA256' OR (block_type <> 'SERIES_CONTEXT' AND n > 64) UNION ALL
SELECT block_type, x, y FROM (SELECT block_type, ms, unnest(ms) AS x FROM b WHERE block_type IN ('AGENT_TITLE', 'TEXT_FINGERPRINT') AND n <= 64) s, unnest(s.ms) u(y) WHERE x < y)
SELECT l AS left_id, r AS right_id, string_agg(DISTINCT block_type, ',' ORDER BY block_type) AS block_types FROM p GROUP BY ALL""")
def match_pairs(spark, d):
    told = _evidence(spark, d).where("block_type <> 'SERIES_CONTEXT'")  # which only supports, so it gives no pairs
    return matching.pairs(matching.blocks(told), told).select("left_id", "right_id", F.array_join("block_types", ",").alias("block_types"))


_PAIRS = """WITH pr AS (SELECT l_orderkey AS left_id, l_linenumber + 1000000 AS right_id, any_value(l_partkey) AS k FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1) GROUP BY ALL)
"""


@query(_PAIRS + """, f AS (SELECT *, k % 2 = 0 AS same, k % 3 = 0 AS title, k % 11 = 0 AS edition_differs FROM pr)
SELECT left_id, right_id, 'EXACT_DUPLICATE' AS relation, cast(CASE WHEN same THEN 100 ELSE 0 END AS BIGINT) AS supporting, cast(100 AS BIGINT) AS assessed, CASE WHEN same THEN 'CONFIRMED' ELSE 'REJECTED' END AS status, cast(CASE WHEN same THEN 1000 ELSE 0 END AS BIGINT) AS permille FROM f
UNION ALL SELECT left_id, right_id, 'SAME_EDITION', CASE WHEN title THEN 10 ELSE 0 END, CASE WHEN title THEN 10 ELSE 30 END + CASE WHEN edition_differs THEN 100 ELSE 0 END, CASE WHEN edition_differs THEN 'REJECTED' ELSE 'REVIEW_REQUIRED' END, cast(round(1000.0 * CASE WHEN title THEN 10 ELSE 0 END / (CASE WHEN title THEN 10 ELSE 30 END + CASE WHEN edition_differs THEN 100 ELSE 0 END)) AS BIGINT) FROM f""")
def match_scores(spark, d):
    first = F.min(F.struct("l_partkey", "l_suppkey"))
    # dealt out by pair once, to tasks of a bounded number of rows: neither the pairs nor their features are summed up before, or shuffled again
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("left_id"), (F.col("l_linenumber") + 1000000).alias("right_id"), "l_partkey", "l_suppkey")
    p = spread(lines, "left_id", "right_id").groupBy("left_id", "right_id").agg(first["l_partkey"].alias("k"))
    told = F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(x).alias("feature"), c.alias("present")) for r, x, c in (
        ("EXACT_DUPLICATE", "FILE_SHA256_EQUAL", F.col("k") % 2 == 0), ("EXACT_DUPLICATE", "FILE_SHA256_DIFFERENT", F.col("k") % 2 != 0), ("SAME_EDITION", "TITLE_COMPATIBLE", F.col("k") % 3 == 0),
        ("SAME_EDITION", "TITLE_CONTRADICTORY", F.col("k") % 3 != 0), ("SAME_EDITION", "RESOLVED_EDITION_DIFFERENT", F.col("k") % 11 == 0))))
    scored = matching.score(p.select("left_id", "right_id", F.explode(told).alias("f")).select("left_id", "right_id", "f.*"))
    return scored.select("left_id", "right_id", "relation", F.col("supporting").cast("bigint").alias("supporting"), F.col("assessed").cast("bigint").alias("assessed"), "status", F.round(F.col("confidence") * 1000).cast("bigint").alias("permille"))


@query("""WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY 1), c AS (SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 4 = 0 THEN 'AUTO_SAFE' ELSE 'REVIEW_REQUIRED' END AS disposition, o_orderkey % 3 AS digest FROM orders)
SELECT candidate_id, disposition FROM c LEFT JOIN l ON candidate_id = conv_id WHERE disposition = 'AUTO_SAFE' OR (role = 'assistant' AND turn % 3 = digest)""")
def accepted_resolutions(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 4 == 0, "AUTO_SAFE").otherwise("REVIEW_REQUIRED").alias("disposition"), (F.col("o_orderkey") % 3).alias("evidence_digest"))
    log = table(spark, d, "conversations").select(F.col("conv_id").alias("candidate_id"), F.col("turn").alias("sequence_no"), F.when(F.col("role") == "assistant", "ACCEPT").otherwise("REJECT").alias("decision"), (F.col("turn") % 3).alias("evidence_digest"))
    return matching.accepted_resolutions(c, log).select("candidate_id", "disposition")


@query(f"""WITH {OBS}, f AS (SELECT file_id, CASE WHEN file_id % 6 = 0 THEN NULL ELSE sha END AS a, CASE WHEN file_id % 4 = 0 THEN NULL ELSE lang END AS b FROM obs),
s AS (SELECT l.file_id AS left_id, r.file_id AS right_id, CASE WHEN l.a IS NULL OR r.a IS NULL THEN 'INDETERMINATE' WHEN l.a = r.a THEN 'SAME' ELSE 'DIFFERENT' END AS file_bytes, CASE WHEN l.b IS NULL OR r.b IS NULL THEN 'INDETERMINATE' WHEN l.b = r.b THEN 'SAME' ELSE 'DIFFERENT' END AS metadata FROM f l JOIN f r ON r.file_id = l.file_id + 1)
SELECT *, CASE WHEN file_bytes <> 'INDETERMINATE' AND metadata <> 'INDETERMINATE' THEN 'COMPLETE' WHEN file_bytes <> 'INDETERMINATE' OR metadata <> 'INDETERMINATE' THEN 'PARTIAL' ELSE 'NONE' END AS coverage FROM s""")
def pair_comparison(spark, d):
    facts = observations(spark, d).select("file_id", F.when(F.col("file_id") % 6 != 0, F.col("sha")).alias("sha"), F.when(F.col("file_id") % 4 != 0, F.col("lang")).alias("lang"))
    ids = facts.select("file_id")
    pairs = ids.select(F.col("file_id").alias("left_id"), (F.col("file_id") + 1).alias("right_id")).join(ids.withColumnRenamed("file_id", "right_id"), "right_id", "left_semi")
    return evidence.compare(pairs, facts, "file_id", {"FILE_BYTES": "sha", "METADATA": "lang"})


_FACTS = """WITH f AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 't' END AS title, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS chars, doc_id % 3 <> 0 AS cover, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 8 % 2 END AS fatal FROM documents),
q AS (SELECT item_id, 'METADATA' AS dimension, 'METADATA_TITLE_MISSING' AS code, 'WARNING' AS severity FROM f WHERE title IS NULL UNION ALL SELECT item_id, 'TEXT', 'TEXT_EVIDENCE_INCOMPLETE', 'WARNING' FROM f WHERE chars IS NULL UNION ALL SELECT item_id, 'TEXT', 'TEXT_NOT_AVAILABLE', 'ERROR' FROM f WHERE chars = 0
UNION ALL SELECT item_id, 'TEXT', 'TEXT_VERY_SHORT', 'WARNING' FROM f WHERE chars > 0 AND chars < 2000 UNION ALL SELECT item_id, 'COVER', 'COVER_MISSING', 'WARNING' FROM f WHERE NOT cover UNION ALL SELECT item_id, 'STRUCTURE', 'EPUB_FATAL_ERRORS', 'ERROR' FROM f WHERE fatal > 0 UNION ALL SELECT item_id, 'STRUCTURE', 'STRUCTURAL_VALIDATION_UNAVAILABLE', 'INFO' FROM f WHERE fatal IS NULL)
"""


def _facts(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("item_id"), F.when(i % 5 != 0, "t").alias("title"), F.lit("a").alias("author"), F.lit("l").alias("language"), F.lit("i").alias("identifier"), F.when(i % 7 != 0, F.col("n_chars")).alias("text_chars"), (i % 3 != 0).alias("has_cover"), F.when(i % 4 != 0, i % 8 % 2).alias("fatal"), F.lit(0).alias("errors"))


@query(_FACTS + "SELECT item_id, dimension, code, severity FROM q")
def quality_findings(spark, d):
    return evidence.quality_findings(_facts(spark, d))


@query(_FACTS + """SELECT item_id, CASE coalesce(max(CASE WHEN severity = 'ERROR' THEN 3 WHEN code LIKE '%INCOMPLETE%' OR code LIKE '%UNAVAILABLE%' THEN 2 WHEN severity = 'WARNING' THEN 1 ELSE 0 END), 0) WHEN 3 THEN 'ACTION_REQUIRED' WHEN 2 THEN 'INCOMPLETE' WHEN 1 THEN 'REVIEW' ELSE 'OK' END AS status FROM f LEFT JOIN q USING (item_id) GROUP BY 1""")
def quality_status(spark, d):
    facts = _facts(spark, d)
    return evidence.quality_status(evidence.quality_findings(facts), facts.select("item_id"))


@query(f"""WITH {OBS}, c AS (SELECT sha AS group_id, file_id, file_id % 2 AS a, file_id % 3 AS b, cast(0 AS BIGINT) AS c, CASE file_id % 7 WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 4 ELSE 9 END AS d, size_bytes AS e, file_id % 40 = 0 AS blocked FROM obs WHERE sha IN (SELECT sha FROM obs GROUP BY 1 HAVING count(*) > 1)),
r AS (SELECT *, rank() OVER (PARTITION BY group_id ORDER BY a, b, c, d) AS k, dense_rank() OVER (PARTITION BY group_id ORDER BY a, b, c, d) AS dk FROM c),
g AS (SELECT group_id, bool_or(blocked) AS blocked, count(*) FILTER (k = 1) AS nb, min(file_id) FILTER (k = 1) AS f, any_value(a) FILTER (dk = 1) AS a1, any_value(b) FILTER (dk = 1) AS b1, any_value(a) FILTER (dk = 2) AS a2, any_value(b) FILTER (dk = 2) AS b2, max(dk) AS mdk FROM r GROUP BY 1),
s AS (SELECT *, CASE WHEN blocked THEN 'BLOCKED' WHEN nb > 1 OR mdk = 1 THEN 'TIED' ELSE 'PREFERRED' END AS status FROM g)
SELECT group_id, status, CASE status WHEN 'BLOCKED' THEN 'HARD_CONSTRAINT' WHEN 'TIED' THEN 'TIED' ELSE CASE WHEN a1 <> a2 THEN 'FEWER_INCOMPLETE_DIMENSIONS' WHEN b1 <> b2 THEN 'FEWER_ACTION_REQUIRED_DIMENSIONS' ELSE 'PREFERRED_FORMAT' END END AS reason, CASE WHEN status = 'PREFERRED' THEN f ELSE -1 END AS file_id FROM s""")
def keep_preferences(spark, d):
    o = observations(spark, d)
    copies = o.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha")
    c = o.join(copies, "sha").select(F.col("sha").alias("group_id"), "file_id", (F.col("file_id") % 2).alias("incomplete"), (F.col("file_id") % 3).alias("action_required"), F.lit(0).alias("review"), book_format(F.col("relative_path")).alias("format"), "size_bytes", (F.col("file_id") % 40 == 0).alias("blocked"))
    return evidence.keep_preference(c, formats=("EPUB", "AZW3", "MOBI", "AZW", "PDF")).select("group_id", "status", "reason", F.coalesce("file_id", F.lit(-1)).alias("file_id"))


@query("""WITH a AS (SELECT l_partkey AS subject_id, CASE WHEN l_linenumber % 2 = 0 THEN 'DOMAIN' ELSE 'GENRE' END AS dimension, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_returnflag || cast(l_suppkey % 6 AS VARCHAR) END AS value, CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS tier FROM lineitem),
t AS (SELECT * FROM a QUALIFY tier = max(tier) OVER (PARTITION BY subject_id, dimension)), g AS (SELECT subject_id, dimension, list_sort(list(DISTINCT value)) AS v FROM t GROUP BY ALL)
SELECT subject_id, dimension, CASE WHEN len(v) > CASE dimension WHEN 'DOMAIN' THEN 1 ELSE 8 END THEN 'CONFLICT' ELSE 'PROJECTED' END AS status, CASE WHEN len(v) > CASE dimension WHEN 'DOMAIN' THEN 1 ELSE 8 END THEN '' ELSE array_to_string(v, ',') END AS vals FROM g""")
def classification_projection(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject_id"), F.when(even, "DOMAIN").otherwise("GENRE").alias("dimension"), F.when(even, F.col("l_returnflag")).otherwise(F.concat("l_returnflag", (F.col("l_suppkey") % 6).cast("string"))).alias("value"), F.when(F.col("l_quantity") > 45, "USER_CONFIRMED").otherwise("AUTOMATED").alias("tier"))
    return evidence.project_classification(a).select("subject_id", "dimension", "status", F.array_join("values", ",").alias("vals"))


@query("""SELECT l_orderkey AS item_id, 'contributor' AS kind, cast(l_linenumber AS INTEGER) AS place, string_agg(DISTINCT l_shipdate_s, '|' ORDER BY l_shipdate_s) AS names FROM (SELECT l_orderkey, l_linenumber, 'n' || cast(l_partkey AS VARCHAR) AS l_shipdate_s FROM lineitem) GROUP BY ALL""")
def grouped_contributors(spark, d):
    l = table(spark, d, "lineitem")
    name = l.select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("contributor."), F.col("l_linenumber").cast("string"), F.lit(".name")).alias("key"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("value"))
    other = l.select(F.col("l_orderkey").alias("item_id"), F.lit("malformed").alias("key"), F.lit("x").alias("value"))
    return evidence.grouped_metadata(name.unionByName(other)).select("item_id", "kind", "place", F.array_join(F.element_at("parts", "name"), "|").alias("names"))


@query("""WITH k(i, relation, kind, effect, need) AS (VALUES (0, 'EXACT_DUPLICATE', 'FILE', 'CONFIRMS_IDENTITY', ['FILE_SHA256']), (1, 'CONTENT_DUPLICATE', 'FILE', 'NONE', ['CONTENT_FINGERPRINT']), (2, 'FORMAT_VARIANT', 'FILE', 'NONE', ['FORMAT_EVIDENCE']), (3, 'QUALITY_VARIANT', 'FILE', 'NONE', ['QUALITY_EVIDENCE']),
(4, 'SAME_EDITION', 'EDITION', 'CONFIRMS_IDENTITY', ['EDITION_IDENTIFIER']), (5, 'DIFFERENT_EDITION', 'EDITION', 'CONTRADICTS_IDENTITY', ['WORK_RESOLUTION', 'EDITION_IDENTIFIER']), (6, 'SAME_WORK', 'WORK', 'CONFIRMS_IDENTITY', ['WORK_RESOLUTION'])),
r AS (SELECT o_orderkey, coalesce((SELECT min(relation) FROM k WHERE i = o_orderkey % 8), 'TRANSLATION') AS relation, ['FILE', 'EDITION', 'WORK'][cast(o_custkey % 3 AS INTEGER) + 1] AS l, ['FILE', 'EDITION', 'WORK'][cast(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey % 3 END AS INTEGER) + 1] AS r,
CASE o_orderkey % 3 WHEN 0 THEN ['FILE_SHA256', 'EDITION_IDENTIFIER'] WHEN 1 THEN ['WORK_RESOLUTION', 'EDITION_IDENTIFIER', 'FORMAT_EVIDENCE'] ELSE ['CONTENT_FINGERPRINT', 'QUALITY_EVIDENCE', 'WORK_RESOLUTION'] END AS e FROM orders)
SELECT o_orderkey, relation, coalesce(effect, '-') AS effect, CASE WHEN kind IS NULL THEN 'NO_CONTRACT' WHEN l <> kind OR r <> kind THEN 'ENDPOINT_KIND' WHEN NOT list_has_all(e, need) THEN 'EVIDENCE_MISSING' ELSE '-' END AS violation FROM r LEFT JOIN k USING (relation)""")
def relation_checks(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names, kinds = F.array(*(F.lit(x) for x in (*(r for r, *_ in matching.RELATIONS), "TRANSLATION"))), F.array(*(F.lit(x) for x in ("FILE", "EDITION", "WORK")))

    def of(*words):
        return F.array(*(F.lit(w) for w in words))

    told = F.when(k % 3 == 0, of("FILE_SHA256", "EDITION_IDENTIFIER")).when(k % 3 == 1, of("WORK_RESOLUTION", "EDITION_IDENTIFIER", "FORMAT_EVIDENCE")).otherwise(of("CONTENT_FINGERPRINT", "QUALITY_EVIDENCE", "WORK_RESOLUTION"))
    one = (c % 3 + 1).cast("int")
    r = table(spark, d, "orders").select("o_orderkey", F.element_at(names, (k % 8 + 1).cast("int")).alias("relation"), F.element_at(kinds, one).alias("left_kind"), F.element_at(kinds, F.when(c % 5 == 0, 1).otherwise(one)).alias("right_kind"), told.alias("evidence"))
    return matching.relation_checks(r).select("o_orderkey", "relation", F.coalesce("effect", F.lit("-")).alias("effect"), F.coalesce("violation", F.lit("-")).alias("violation"))

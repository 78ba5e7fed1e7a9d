"""Snapshots, search, library reconciliation, archives and plans over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritome.operators import planning, search, state
from veritome.plans.registry import OBS, observations, query, table

_EVIDENCE = """WITH e AS (SELECT user_id AS file_id, CASE event_type WHEN 'view' THEN 'ANALYSIS' WHEN 'click' THEN 'MATCHING' WHEN 'purchase' THEN 'REVIEW' WHEN 'signup' THEN 'RESOLUTION' ELSE 'QUARANTINE' END AS component, CASE event_id % 4 WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'STALE' WHEN 2 THEN 'UNSCOPED' END AS scope, value > 95 AS conflict FROM events WHERE event_id % 4 <> 3),
best AS (SELECT file_id, component, max(CASE scope WHEN 'CURRENT' THEN 3 WHEN 'STALE' THEN 2 ELSE 1 END) AS r, bool_or(conflict) AS c FROM e GROUP BY ALL),
i AS (SELECT DISTINCT user_id AS file_id FROM events), comp(component) AS (VALUES ('ANALYSIS'),('RESOLUTION'),('CLASSIFICATION'),('MATCHING'),('REVIEW'),('CALIBRE'),('ARCHIVE'),('CONSOLIDATION'),('QUARANTINE')),
st AS (SELECT i.file_id, comp.component, CASE coalesce(r, 0) WHEN 3 THEN 'CURRENT' WHEN 2 THEN 'STALE' WHEN 1 THEN 'UNSCOPED' ELSE 'MISSING' END || CASE WHEN c THEN '_CONFLICT' ELSE '' END AS state FROM i CROSS JOIN comp LEFT JOIN best USING (file_id, component))
"""


def _states(spark, d):
    e = table(spark, d, "events")
    runs = spark.createDataFrame([("r2", "COMPLETED", 2), ("r1", "COMPLETED", 1), ("rx", "FAILED", 1)], "run_id string, status string, completed_at int")
    names = {"view": "ANALYSIS", "click": "MATCHING", "purchase": "REVIEW", "signup": "RESOLUTION"}
    component = F.lit("QUARANTINE")
    for k, v in names.items():
        component = F.when(F.col("event_type") == k, v).otherwise(component)
    run = F.when(F.col("event_id") % 4 == 0, "r2").when(F.col("event_id") % 4 == 1, "r1").when(F.col("event_id") % 4 == 3, "rx")
    rows = e.select(F.col("user_id").alias("file_id"), component.alias("component"), run.alias("run_id"), (F.col("value") > 95).alias("conflict"))
    return state.item_states(e.select(F.col("user_id").alias("file_id")).distinct(), state.scoped(rows, "r2", 2, runs))


@query(_EVIDENCE + "SELECT file_id, component, state FROM st")
def item_states(spark, d):
    return _states(spark, d)


@query(_EVIDENCE + """, k AS (SELECT component, count(*) AS items, count(*) FILTER (state <> 'MISSING') AS covered, count(*) FILTER (state LIKE 'CURRENT%') AS cur, count(*) FILTER (state LIKE 'STALE%' OR state LIKE 'UNSCOPED%') AS oth, bool_or(state LIKE '%_CONFLICT') AS c FROM st GROUP BY 1)
SELECT component, items, covered, CASE WHEN covered = items THEN 'COMPLETE' WHEN covered > 0 THEN 'PARTIAL' ELSE 'NONE' END AS coverage, CASE WHEN covered = 0 THEN 'UNKNOWN' WHEN oth = 0 THEN 'CURRENT' WHEN cur = 0 THEN 'STALE' ELSE 'MIXED' END AS freshness, CASE WHEN c THEN 'PRESENT' ELSE 'NONE' END AS conflict FROM k""")
def component_summary(spark, d):
    return state.component_summary(_states(spark, d))


_DIFF = f"""WITH {OBS}, a AS (SELECT file_id, file_id AS o, size_bytes AS z, sha AS t, file_id % 3 = 0 AS x, file_id % 5 = 0 AS y FROM obs WHERE file_id % 7 <> 0), b AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN file_id ELSE -file_id END AS o, CASE WHEN file_id % 25 = 0 THEN size_bytes + 1 ELSE size_bytes END AS z, CASE WHEN file_id % 9 = 0 THEN 'new' ELSE sha END AS t, file_id % 2 = 0 AS x, true AS y FROM obs WHERE file_id % 8 <> 0),
j AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, list_filter([CASE WHEN a.file_id IS NULL THEN 'ADDED' END, CASE WHEN b.file_id IS NULL THEN 'DISAPPEARED' END, CASE WHEN a.z <> b.z OR (a.o = b.o AND a.t <> b.t) THEN 'TECHNICALLY_CHANGED' END, CASE WHEN b.x AND NOT a.x THEN 'NEWLY_ANALYZED' END, CASE WHEN b.y AND NOT a.y THEN 'NEWLY_REVIEWED' END], lambda v: v IS NOT NULL) AS cats FROM a FULL JOIN b ON a.file_id = b.file_id)
"""


def _changes(spark, d):
    o, i = observations(spark, d), F.col("file_id")
    no = F.lit(False)
    before = o.where("file_id % 7 <> 0").select("file_id", i.alias("observation_id"), F.lit("EPUB").alias("format_name"), "size_bytes", F.col("sha").alias("technical"), (i % 3 == 0).alias("analysis"), no.alias("resolution"), (i % 5 == 0).alias("review"), no.alias("quarantine"))
    after = o.where("file_id % 8 <> 0").select("file_id", F.when(i % 2 == 0, i).otherwise(-i).alias("observation_id"), F.lit("EPUB").alias("format_name"), F.when(i % 25 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(i % 9 == 0, "new").otherwise(F.col("sha")).alias("technical"), (i % 2 == 0).alias("analysis"), no.alias("resolution"), F.lit(True).alias("review"), no.alias("quarantine"))
    return state.diff(before, after)


@query(_DIFF + "SELECT file_id, array_to_string(cats, ',') AS categories FROM j WHERE len(cats) > 0")
def snapshot_diff(spark, d):
    return _changes(spark, d).select("file_id", F.array_join("categories", ",").alias("categories"))


@query(_DIFF + "SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM j) GROUP BY 1")
def diff_counts(spark, d):
    return state.diff_counts(_changes(spark, d))


_HEALTH = """WITH f AS (SELECT doc_id AS file_id, CASE WHEN n_chars < 300 THEN 'FULL_FIXITY_MISSING' WHEN lang <> 'en' THEN 'LANGUAGE_METADATA_MISSING' WHEN source = 'src1' THEN 'QUARANTINE_BLOCKED' WHEN source = 'src2' THEN 'TITLE_METADATA_MISSING' END AS code FROM documents UNION ALL SELECT doc_id, 'PENDING_REVIEW' FROM labels),
r(code, dimension, severity, rank) AS (VALUES ('FULL_FIXITY_MISSING','SCAN_FIXITY','INCOMPLETE',3),('PENDING_REVIEW','OPEN_REVIEWS','ATTENTION',2),('TITLE_METADATA_MISSING','METADATA_AUTHORITY_CLASSIFICATION','ATTENTION',2),('LANGUAGE_METADATA_MISSING','METADATA_AUTHORITY_CLASSIFICATION','INFO',1),('QUARANTINE_BLOCKED','BLOCKED_OPERATIONS','BLOCKED',4))
"""


def _found(spark, d):
    code = F.when(F.col("n_chars") < 300, "FULL_FIXITY_MISSING").when(F.col("lang") != "en", "LANGUAGE_METADATA_MISSING").when(F.col("source") == "src1", "QUARANTINE_BLOCKED").when(F.col("source") == "src2", "TITLE_METADATA_MISSING")
    one = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), code.alias("code"))  # null for a healthy one
    return one.unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), F.lit("PENDING_REVIEW").alias("code")))


@query(_HEALTH + "SELECT f.code, dimension, severity, count(DISTINCT file_id) AS n, array_to_string(list_sort(list(DISTINCT file_id))[1:64], ',') AS samples FROM f JOIN r USING (code) GROUP BY ALL")
def health_findings(spark, d):
    return state.health_findings(_found(spark, d)).select("code", "dimension", "severity", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query(_HEALTH + """, dims(dimension) AS (VALUES ('SCAN_FIXITY'),('ANALYSIS_TOOL_COVERAGE'),('METADATA_AUTHORITY_CLASSIFICATION'),('OPEN_REVIEWS'),('DUPLICATE_VARIANT_EVIDENCE'),('DEPENDENCIES'),('BLOCKED_OPERATIONS'))
SELECT dims.dimension, count(DISTINCT file_id) AS affected, (SELECT count(*) FROM documents) AS items, CASE coalesce(max(rank), 0) WHEN 0 THEN 'CLEAR' WHEN 1 THEN 'OBSERVED' WHEN 2 THEN 'ATTENTION' WHEN 3 THEN 'INCOMPLETE' ELSE 'BLOCKED' END AS status FROM dims LEFT JOIN (f JOIN r USING (code)) USING (dimension) GROUP BY 1""")
def health_dimensions(spark, d):
    return state.health_dimensions(_found(spark, d), table(spark, d, "documents").count())


@query(_HEALTH + ", a AS (SELECT code, count(DISTINCT file_id) AS n FROM f WHERE code <> 'TITLE_METADATA_MISSING' GROUP BY 1), b AS (SELECT code, count(DISTINCT file_id) AS n FROM f WHERE code <> 'QUARANTINE_BLOCKED' GROUP BY 1) SELECT coalesce(a.code, b.code) AS code, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.code = b.code")
def health_delta(spark, d):
    f = _found(spark, d)
    return state.health_delta(state.health_findings(f.where("code <> 'TITLE_METADATA_MISSING'")), state.health_findings(f.where("code <> 'QUARANTINE_BLOCKED'")))


_STATE_NAMES = ("MISSING", "CURRENT", "STALE", "UNSCOPED", "CURRENT_CONFLICT", "STALE_CONFLICT", "UNSCOPED_CONFLICT")
_ITEMS = "WITH s AS (SELECT o_orderkey AS id, o_custkey AS c, " + ", ".join(f"{list(_STATE_NAMES)}[cast((o_orderkey * {i + 3} + o_custkey * {i} + {i}) % 7 AS INTEGER) + 1] AS {name}" for i, name in enumerate(state.COMPONENTS)) + ", o_orderkey % 3 AS fix, CASE o_orderkey % 4 WHEN 0 THEN ['PENDING'] WHEN 1 THEN ['DEFERRED'] WHEN 2 THEN ['DEFERRED', 'PENDING'] ELSE [] END AS rev FROM orders)\n"
_CUR, _CON = "IN ('CURRENT', 'CURRENT_CONFLICT')", "IN ('CURRENT_CONFLICT', 'STALE_CONFLICT', 'UNSCOPED_CONFLICT')"


def _item_findings(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    words = F.array(*(F.lit(x) for x in _STATE_NAMES))
    told = F.explode(F.array(*(F.struct(F.lit(name).alias("component"), F.element_at(words, ((k * (i + 3) + c * i + i) % 7 + 1).cast("int")).alias("state")) for i, name in enumerate(state.COMPONENTS))))
    fields = F.filter(F.array(*(F.when(F.floor(c / (1 << i)) % 2 == 1, w) for i, w in enumerate(("title", "contributor", "identifier", "language", "publisher")))), lambda x: x.isNotNull())
    reviews = F.when(k % 4 == 0, F.array(F.lit("PENDING"))).when(k % 4 == 1, F.array(F.lit("DEFERRED"))).when(k % 4 == 2, F.array(F.lit("DEFERRED"), F.lit("PENDING")))
    facts = o.select(k.alias("file_id"), (k % 3).alias("fixity_values"), fields.alias("metadata_fields"), reviews.alias("review_states"), (c % 13 == 0).alias("metadata_truncated"), (c % 11 == 0).alias("quality_found"), (c % 4 == 0).alias("sidecar"))
    return state.item_findings(o.select(k.alias("file_id"), told.alias("s")).select("file_id", "s.component", "s.state"), facts)


@query(_ITEMS + f"""SELECT id AS file_id, array_to_string(list_filter([CASE WHEN fix = 0 THEN 'FULL_FIXITY_MISSING' WHEN fix > 1 THEN 'FULL_FIXITY_CONFLICT' END,
CASE WHEN ANALYSIS = 'MISSING' THEN 'ANALYSIS_MISSING' WHEN ANALYSIS NOT {_CUR} THEN 'ANALYSIS_STALE_OR_UNSCOPED' END, CASE WHEN ANALYSIS {_CON} THEN 'ANALYSIS_CONFLICT' END, CASE WHEN c % 11 = 0 THEN 'ANALYSIS_QUALITY_FINDING_PRESENT' END,
CASE WHEN c & 1 = 0 THEN 'TITLE_METADATA_MISSING' END, CASE WHEN c & 2 = 0 THEN 'CONTRIBUTOR_METADATA_MISSING' END, CASE WHEN c & 4 = 0 THEN 'IDENTIFIER_METADATA_MISSING' END, CASE WHEN c & 8 = 0 THEN 'LANGUAGE_METADATA_MISSING' END, CASE WHEN c & 16 = 0 THEN 'PUBLISHER_METADATA_MISSING' END, CASE WHEN c % 13 = 0 THEN 'METADATA_INDEX_TRUNCATED' END,
CASE WHEN RESOLUTION NOT {_CUR} THEN 'AUTHORITY_RESOLUTION_COVERAGE_GAP' END, CASE WHEN RESOLUTION {_CON} THEN 'AUTHORITY_RESOLUTION_CONFLICT' END, CASE WHEN CLASSIFICATION NOT {_CUR} THEN 'CLASSIFICATION_COVERAGE_GAP' END, CASE WHEN CLASSIFICATION {_CON} THEN 'CLASSIFICATION_CONFLICT' END,
CASE WHEN list_contains(rev, 'PENDING') THEN 'PENDING_REVIEW' END, CASE WHEN list_contains(rev, 'DEFERRED') THEN 'DEFERRED_REVIEW' END, CASE WHEN MATCHING {_CUR} THEN 'DUPLICATE_OR_VARIANT_EVIDENCE_PRESENT' ELSE 'MATCHING_COVERAGE_GAP' END, CASE WHEN MATCHING {_CON} THEN 'MATCHING_CONFLICT' END,
CASE WHEN CALIBRE {_CUR} THEN 'CALIBRE_DEPENDENCY_PRESENT' END, CASE WHEN c % 4 = 0 THEN 'SIDECAR_DEPENDENCY_PRESENT' END, CASE WHEN ARCHIVE {_CUR} THEN 'ARCHIVE_DEPENDENCY_PRESENT' END, CASE WHEN CALIBRE NOT {_CUR} AND ARCHIVE NOT {_CUR} AND c % 4 <> 0 THEN 'DEPENDENCY_COVERAGE_GAP' END,
CASE WHEN CALIBRE {_CON} THEN 'CALIBRE_CONFLICT' END, CASE WHEN ARCHIVE {_CON} THEN 'ARCHIVE_CONFLICT' END, CASE WHEN CONSOLIDATION {_CON} THEN 'CONSOLIDATION_BLOCKED' END, CASE WHEN QUARANTINE {_CON} THEN 'QUARANTINE_BLOCKED' END], lambda x: x IS NOT NULL), ',') AS codes,
array_to_string(list_filter([CASE WHEN fix = 1 THEN 'SCAN_FIXITY' END, CASE WHEN ANALYSIS {_CUR} THEN 'ANALYSIS_TOOL_COVERAGE' END, CASE WHEN c & 3 = 3 AND c % 13 <> 0 AND RESOLUTION {_CUR} AND CLASSIFICATION {_CUR} THEN 'METADATA_AUTHORITY_CLASSIFICATION' END, 'OPEN_REVIEWS',
CASE WHEN MATCHING {_CUR} THEN 'DUPLICATE_VARIANT_EVIDENCE' END, CASE WHEN CALIBRE {_CUR} OR ARCHIVE {_CUR} OR c % 4 = 0 THEN 'DEPENDENCIES' END, 'BLOCKED_OPERATIONS'], lambda x: x IS NOT NULL), ',') AS covered FROM s""")
def item_findings(spark, d):
    return _item_findings(spark, d).select("file_id", F.array_join("codes", ",").alias("codes"), F.array_join("covered", ",").alias("covered"))


def _index(spark, d):
    p = table(spark, d, "part")
    key = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    return search.index(p.select(key.alias("file_id"), F.lit("TITLE").alias("field"), F.col("p_name").alias("value")).unionByName(p.select(key.alias("file_id"), F.lit("PUBLISHER").alias("field"), F.col("p_brand").alias("value"))).unionByName(p.select(key.alias("file_id"), F.lit("FORMAT").alias("field"), F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("value"))))


def _text(where, **more) -> str:
    return json.dumps({"version": search.VERSION, "where": where, **more})


@query("SELECT lpad(cast(p_partkey AS VARCHAR), 9, '0') AS file_id FROM part WHERE lower(p_brand) LIKE 'brand#1%' AND ('s' || cast(p_size AS VARCHAR) = 's7' OR 's' || cast(p_size AS VARCHAR) = 's9')")
def search_files(spark, d):
    where = {"operator": "AND", "children": [{"field": "PUBLISHER", "operator": "PREFIX", "value": "BRAND#1"}, {"operator": "OR", "children": [{"field": "FORMAT", "operator": "EQ", "value": "S7"}, {"field": "FORMAT", "operator": "EQ", "value": "s9"}]}]}
    return search.matching_files(_index(spark, d), search.parse(_text(where)).where)


@query("SELECT file_id, cast(row_number() OVER (ORDER BY file_id) AS INTEGER) AS place FROM (SELECT lpad(cast(p_partkey AS VARCHAR), 9, '0') AS file_id FROM part WHERE list_contains(string_split_regex(lower(p_brand), '[^a-z0-9]+'), 'brand') AND list_contains(string_split_regex(lower(p_brand), '[^a-z0-9]+'), '23') AND lpad(cast(p_partkey AS VARCHAR), 9, '0') > '000000100' ORDER BY 1 LIMIT 11)")
def search_page(spark, d):
    q = search.parse(_text({"field": "PUBLISHER", "operator": "MATCH", "value": "23 Bránd"}, limit=10, after_file_id="000000100"))
    return search.search(_index(spark, d), q)


_LIBRARY = f"""WITH {OBS}, files AS (SELECT relative_path AS path, sha FROM obs WHERE file_id % 6 <> 0), fmts AS (SELECT file_id // 2 AS record_id, relative_path AS path FROM obs WHERE file_id % 5 <> 0), recs AS (SELECT DISTINCT file_id // 2 AS record_id FROM obs),
h AS (SELECT record_id, path, sha FROM fmts JOIN files USING (path))
"""


@query(_LIBRARY + """SELECT 'FILESYSTEM_ONLY' AS code, path AS subject_id FROM files WHERE path NOT IN (SELECT path FROM fmts) UNION ALL SELECT 'RECORD_WITHOUT_FILE', cast(record_id AS VARCHAR) FROM recs WHERE record_id NOT IN (SELECT record_id FROM h)
UNION ALL SELECT DISTINCT 'DUPLICATE_RECORD_CANDIDATE', cast(record_id AS VARCHAR) FROM h WHERE sha IN (SELECT sha FROM h GROUP BY 1 HAVING count(DISTINCT record_id) > 1) UNION ALL SELECT 'MULTI_FORMAT_RECORD', cast(record_id AS VARCHAR) FROM h GROUP BY record_id HAVING count(DISTINCT path) > 1""")
def library_findings(spark, d):
    o = observations(spark, d)
    record = F.floor(F.col("file_id") / 2).alias("record_id")
    return planning.library_findings(o.where("file_id % 6 <> 0").select(F.col("relative_path").alias("path"), F.col("sha").alias("sha256")), o.select(record).distinct(), o.where("file_id % 5 <> 0").select(record, F.col("relative_path").alias("path")))


@query("SELECT DISTINCT p_partkey AS record_id, 'brand' AS field FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_brand <> 'Brand#1' || cast(l_suppkey % 5 + 1 AS VARCHAR)")
def metadata_conflicts(spark, d):
    records = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit("brand").alias("field"), F.col("p_brand").alias("value"))
    seen = table(spark, d, "lineitem").select(F.col("l_partkey").alias("record_id"), F.lit("brand").alias("field"), F.concat(F.lit("Brand#1"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("value"))
    return planning.metadata_conflicts(records, seen)


@query("""WITH c AS (SELECT o_orderkey AS candidate_id, o_custkey AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN c_name ELSE 'Agent ' || cast(o_orderkey % 5 AS VARCHAR) END AS name, o_orderstatus, o_orderkey % 4 AS r FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT record_id, candidate_id FROM c JOIN customer ON record_id = c_custkey WHERE o_orderstatus <> 'F' AND r IN (0, 1) AND name <> c_name""")
def authority_conflicts(spark, d):
    customers, key = table(spark, d, "customer"), F.col("o_orderkey")
    orders = table(spark, d, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    name = F.when(key % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Agent "), (key % 5).cast("string")))
    candidates = orders.select(F.col("o_custkey").alias("record_id"), key.alias("candidate_id"), F.lit("AGENT").alias("kind"), name.alias("name"), F.when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("REVIEW_REQUIRED").alias("disposition"))
    state = F.element_at(F.array(*(F.lit(x) for x in ("PENDING", "DEFERRED", "CONFIRMED", "REJECTED"))), (key % 4 + 1).cast("int"))
    return planning.authority_conflicts(customers.select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name")), candidates, orders.select(key.alias("candidate_id"), state.alias("state")))


@query("""WITH f AS (SELECT l_orderkey AS record_id, 'r' || cast(l_orderkey AS VARCHAR) || CASE WHEN l_orderkey % 7 = 0 THEN '/v' || cast(l_linenumber % 2 AS VARCHAR) ELSE '' END AS home FROM lineitem),
h AS (SELECT record_id, min(home) AS home FROM f GROUP BY 1 HAVING count(DISTINCT home) = 1), s AS (SELECT o_orderkey AS record_id, 'r' || cast(o_orderkey AS VARCHAR) AS root, o_orderkey % 4 AS k, o_orderkey % 5 AS e FROM orders),
p AS (SELECT record_id, root || CASE WHEN e = 0 THEN '/other/x' WHEN k = 0 THEN '/metadata.opf' WHEN k = 1 THEN '/cover.jpg' WHEN k = 2 THEN '/data/a/b' ELSE '/notes.txt' END AS path, CASE k WHEN 0 THEN 'METADATA_OPF' WHEN 1 THEN 'COVER' WHEN 2 THEN 'EXTRA_DATA' ELSE 'OTHER' END AS kind FROM s)
SELECT record_id, path, kind, record_id % 3 = 0 AS observed FROM p JOIN h USING (record_id) WHERE (kind = 'METADATA_OPF' AND path = home || '/metadata.opf') OR (kind = 'COVER' AND path = home || '/cover.jpg') OR (kind = 'EXTRA_DATA' AND starts_with(path, home || '/data/')) OR (kind = 'OTHER' AND starts_with(path, home || '/'))""")
def sidecar_dependencies(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    folder = F.when(k % 7 == 0, F.concat(F.lit("/v"), (n % 2).cast("string"))).otherwise(F.lit(""))
    formats = table(spark, d, "lineitem").select(k.alias("record_id"), F.concat(F.lit("r"), k.cast("string"), folder, F.lit("/book"), n.cast("string")).alias("path"))
    o = F.col("o_orderkey")
    name, kind = F.lit("/notes.txt"), F.lit("OTHER")
    for i, (x, y) in enumerate((("/metadata.opf", "METADATA_OPF"), ("/cover.jpg", "COVER"), ("/data/a/b", "EXTRA_DATA"))):
        name, kind = F.when(o % 4 == i, x).otherwise(name), F.when(o % 4 == i, y).otherwise(kind)
    found = table(spark, d, "orders").select(o.alias("record_id"), F.concat(F.lit("r"), o.cast("string"), F.when(o % 5 == 0, "/other/x").otherwise(name)).alias("path"), kind.alias("kind"))
    return planning.sidecar_dependencies(formats, found, found.where("record_id % 3 = 0").select("path"))


_VOLUME = "CASE l_orderkey % 9 WHEN 0 THEN concat('Größe.part', l_linenumber, '.rar') WHEN 1 THEN concat('Größe.7z.', lpad(concat('', l_linenumber), 3, '0')) WHEN 2 THEN CASE WHEN l_linenumber = 1 THEN 'Größe.rar' ELSE concat('Größe.r0', l_linenumber - 2) END WHEN 3 THEN CASE WHEN l_linenumber = 2 THEN 'b.zip' ELSE concat('b.z0', CASE WHEN l_linenumber > 2 THEN l_linenumber - 1 ELSE l_linenumber END) END WHEN 4 THEN concat('x.part', l_linenumber, CASE WHEN l_linenumber = 3 THEN '.RAR' ELSE '.rar' END) WHEN 5 THEN CASE WHEN l_linenumber = 1 THEN 'c.rar' WHEN l_linenumber = 2 THEN 'C.RAR' ELSE concat('c.part', l_linenumber - 2, '.rar') END WHEN 6 THEN CASE WHEN l_linenumber = 4 THEN 'd.rar' ELSE concat('d.part', l_linenumber, '.rar') END WHEN 7 THEN concat('n', l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '.epub' ELSE '.txt' END) ELSE concat('e.z0', l_linenumber) END"
_PARTS = f"SELECT DISTINCT concat('', l_orderkey) AS parent, {_VOLUME} AS name FROM {{lineitem}}"


@query(f"""WITH n AS ({_PARTS.replace("{", "").replace("}", "")}), f AS (SELECT *, replace(lower(name), 'ß', 'ss') AS fold FROM n), c AS (SELECT parent, fold, count(*) AS n FROM f GROUP BY ALL), u AS (SELECT f.* FROM f JOIN c USING (parent, fold) WHERE c.n = 1),
v AS (SELECT parent, name, fold, regexp_extract(fold, '^(.+)[.](part[0-9]+[.]rar|7z[.][0-9]+|r[0-9][0-9]|z[0-9][0-9])$', 1) AS logical, CASE WHEN regexp_matches(fold, '[.]part[0-9]+[.]rar$') THEN 'NEW' WHEN regexp_matches(fold, '[.]7z[.][0-9]+$') THEN 'SEVEN' WHEN regexp_matches(fold, '[.]r[0-9][0-9]$') THEN 'OLD' WHEN regexp_matches(fold, '[.]z[0-9][0-9]$') THEN 'SPLIT' END AS family, cast(regexp_extract(fold, '([0-9]+)([.]rar)?$', 1) AS INTEGER) AS number FROM u),
s AS (SELECT parent, logical, family, count(*) AS n, min(number) AS low, max(number) AS high, arg_min(name, number) AS first FROM v WHERE family IS NOT NULL GROUP BY ALL),
h AS (SELECT s.*, u.name AS head, u.fold AS used FROM s LEFT JOIN u ON u.parent = s.parent AND u.fold = s.logical || CASE family WHEN 'SEVEN' THEN '.7z' WHEN 'SPLIT' THEN '.zip' ELSE '.rar' END),
j AS (SELECT parent, logical, n + CASE WHEN family IN ('OLD', 'SPLIT') AND head IS NOT NULL THEN 1 ELSE 0 END AS members, CASE WHEN family IN ('NEW', 'SEVEN') AND head IS NOT NULL THEN 'AMBIGUOUS_VOLUME' WHEN family IN ('OLD', 'SPLIT') AND head IS NULL THEN 'ORPHAN_VOLUME' WHEN low <> CASE family WHEN 'OLD' THEN 0 ELSE 1 END OR high - low + 1 <> n THEN 'MISSING_VOLUME' WHEN family = 'SPLIT' THEN 'UNSUPPORTED_FORMAT' ELSE 'LISTED' END AS status, CASE WHEN family IN ('OLD', 'SPLIT') THEN head ELSE first END AS entry FROM h)
SELECT parent, logical, status, CASE WHEN status IN ('LISTED', 'UNSUPPORTED_FORMAT') THEN entry END AS entry, members FROM j UNION ALL SELECT parent, fold, 'NAME_COLLISION', NULL, n FROM c WHERE n > 1
UNION ALL SELECT parent, fold, 'LISTED', name, 1 FROM v WHERE family IS NULL AND regexp_matches(fold, '[.](epub|zip|rar)$') AND NOT EXISTS (SELECT 1 FROM h WHERE h.parent = v.parent AND h.used = v.fold)""")
def volume_sets(spark, d):
    """Parts of all kinds, whole and with gaps, heads, rivals, orphans and names that differ in case, one folder an order."""
    return planning.volume_sets(spark.sql(_PARTS, lineitem=table(spark, d, "lineitem")))


@query("""WITH m AS (SELECT l_orderkey AS archive_id, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS ordinal, CASE WHEN l_partkey % 50 = 0 THEN '../x' WHEN l_partkey % 31 = 0 THEN 'f1/Sub' WHEN l_partkey % 29 = 0 THEN 'F' || cast(l_linenumber % 2 AS VARCHAR) WHEN l_partkey % 61 = 0 THEN 'a/nul.txt' WHEN l_partkey % 67 = 0 THEN 'a./b' ELSE 'F' || cast(l_linenumber AS VARCHAR) END AS path,
CASE WHEN l_partkey % 80 = 1 THEN NULL WHEN l_partkey % 83 = 2 THEN -1 WHEN l_partkey % 89 = 3 THEN 3000000000 ELSE (l_suppkey % 40) * 100 END AS size, CASE WHEN l_partkey % 97 = 5 THEN NULL WHEN l_partkey % 89 = 3 THEN 3000000000 ELSE l_suppkey % 40 * (CASE WHEN l_suppkey % 23 = 0 THEN 0 ELSE 1 END) END AS packed, CASE WHEN l_suppkey % 30 = 0 THEN 'SYMLINK' WHEN l_suppkey % 9 = 0 THEN 'DIRECTORY' ELSE 'REGULAR_FILE' END AS kind FROM lineitem),
r AS (SELECT *, sum(size) OVER w AS total, sum(packed) OVER w AS all_packed, row_number() OVER (PARTITION BY archive_id, lower(path) ORDER BY ordinal) > 1 AS again FROM m WINDOW w AS (PARTITION BY archive_id ORDER BY ordinal)),
v AS (SELECT archive_id, ordinal, CASE WHEN kind = 'SYMLINK' THEN 'MEMBER_KIND_REJECTED' WHEN path IN ('../x', 'a/nul.txt', 'a./b') THEN 'PATH_INVALID' WHEN size IS NULL OR packed IS NULL THEN 'UNKNOWN_SIZE' WHEN size < 0 OR packed < 0 THEN 'NEGATIVE_SIZE' WHEN size > 2147483648 THEN 'MEMBER_SIZE_LIMIT'
WHEN size > 0 AND packed = 0 THEN 'COMPRESSION_RATIO_LIMIT' WHEN packed > 0 AND size > 1000 * packed THEN 'COMPRESSION_RATIO_LIMIT' WHEN total > 8589934592 THEN 'TOTAL_UNCOMPRESSED_LIMIT' WHEN total > 0 AND all_packed = 0 THEN 'COMPRESSION_RATIO_LIMIT' WHEN all_packed > 0 AND total > 1000 * all_packed THEN 'COMPRESSION_RATIO_LIMIT' WHEN again THEN 'PATH_COLLISION'
WHEN EXISTS (SELECT 1 FROM m o WHERE o.archive_id = r.archive_id AND o.ordinal < r.ordinal AND ((o.kind = 'REGULAR_FILE' AND starts_with(lower(r.path), lower(o.path) || '/')) OR (r.kind = 'REGULAR_FILE' AND starts_with(lower(o.path), lower(r.path) || '/')))) THEN 'PARENT_CHILD_CONFLICT' END AS violation FROM r)
SELECT archive_id, coalesce(arg_min(violation, ordinal) FILTER (violation IS NOT NULL), 'ACCEPTED') AS violation FROM v GROUP BY 1""")
def archive_safety(spark, d):
    i, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    path = F.when(i % 50 == 0, "../x").when(i % 31 == 0, "f1/Sub").when(i % 29 == 0, F.concat(F.lit("F"), (n % 2).cast("string"))).when(i % 61 == 0, "a/nul.txt").when(i % 67 == 0, "a./b").otherwise(F.concat(F.lit("F"), n.cast("string")))
    size = F.when(i % 80 == 1, F.lit(None)).when(i % 83 == 2, -1).when(i % 89 == 3, 3_000_000_000).otherwise((s % 40) * 100)
    packed = F.when(i % 97 == 5, F.lit(None)).when(i % 89 == 3, 3_000_000_000).otherwise(F.when(s % 23 == 0, 0).otherwise(s % 40))
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive_id"), (n.cast("long") * 1_000_000_000 + i * 10_000 + s).alias("ordinal"), path.alias("path"), size.cast("long").alias("size"), packed.cast("long").alias("packed"), F.when(s % 30 == 0, "SYMLINK").when(s % 9 == 0, "DIRECTORY").otherwise("REGULAR_FILE").alias("kind"))
    return planning.archive_safety(m).select("archive_id", F.coalesce("violation", F.lit("ACCEPTED")).alias("violation"))


@query("""WITH m AS (SELECT l_orderkey AS archive_id, count(*) AS n, cast(sum(cast(l_quantity AS BIGINT) * 20000000) AS BIGINT) AS bytes, bool_or(l_suppkey % 97 = 0) AS links FROM lineitem GROUP BY 1),
a AS (SELECT o_orderkey AS archive_id, CASE WHEN o_custkey % 61 = 0 THEN NULL WHEN o_custkey % 59 = 0 THEN 257 ELSE o_custkey % 5 + 1 END AS volumes, CASE WHEN o_custkey % 53 = 0 THEN 9000000000 ELSE o_custkey % 9 * 900000000 END AS capacity, CASE WHEN o_custkey % 47 = 0 THEN -1 ELSE o_custkey % 13 * 500000000 END AS free, CASE WHEN o_custkey % 43 = 0 THEN NULL ELSE o_custkey % 41 = 0 END AS meets FROM orders),
f AS (SELECT *, CASE WHEN volumes IS NULL OR volumes > 256 THEN 'VOLUME_COUNT_LIMIT' WHEN capacity > 8589934592 THEN 'WORKSPACE_LIMIT' WHEN free < 0 THEN 'WORKSPACE_RESERVE' WHEN coalesce(meets, true) THEN 'WORKSPACE_OVERLAP' END AS itself FROM a LEFT JOIN m USING (archive_id)),
v AS (SELECT *, CASE WHEN itself IS NOT NULL THEN itself WHEN links THEN 'MEMBER_KIND_REJECTED' WHEN coalesce(bytes, 0) > capacity THEN 'WORKSPACE_LIMIT' WHEN free < coalesce(bytes, 0) + 1073741824 THEN 'WORKSPACE_RESERVE' END AS violation FROM f)
SELECT archive_id, CASE WHEN violation IS NULL THEN 'ACCEPTED' WHEN violation IN ('WORKSPACE_OVERLAP', 'MEMBER_KIND_REJECTED') THEN 'POLICY_REJECTED' ELSE 'LIMIT_EXCEEDED' END AS status, coalesce(violation, '-') AS violation, CASE WHEN itself IS NULL THEN coalesce(n, 0) ELSE 0 END AS member_count FROM v""")
def archive_admission(spark, d):
    """Orders in the role of archives, each with a workspace, their lines in the role of members."""
    c = F.col("o_custkey")
    volumes = F.when(c % 61 == 0, F.lit(None)).when(c % 59 == 0, 257).otherwise(c % 5 + 1)
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("archive_id"), volumes.cast("int").alias("volumes"), F.when(c % 53 == 0, F.lit(9_000_000_000)).otherwise(c % 9 * F.lit(900_000_000).cast("long")).alias("capacity"), F.when(c % 47 == 0, F.lit(-1).cast("long")).otherwise(c % 13 * F.lit(500_000_000).cast("long")).alias("free"), F.when(c % 43 != 0, c % 41 == 0).alias("overlaps"))
    size = F.col("l_quantity").cast("long") * 20_000_000
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("ordinal"), size.alias("size"), F.when(F.col("l_suppkey") % 97 == 0, "HARDLINK").otherwise("REGULAR_FILE").alias("kind"))
    m = m.select("archive_id", "ordinal", F.concat(F.lit("part"), F.col("ordinal").cast("string")).alias("path"), "size", F.col("size").alias("packed"), "kind")
    return planning.archive_admission(a, m).select("archive_id", "status", F.coalesce("violation", F.lit("-")).alias("violation"), F.col("member_count").cast("long").alias("member_count"))


_NAMES = (("ReadMe", "README"), ("READ.ME", "README"), ("Passwort", "PASSWORD"), ("pw", "PASSWORD"), ("Readme.TXT", "TEXT"), ("a.NFO", "NFO"), ("i.htm", "HTML"), ("x.sfv", "SFV"), ("d.diz", "DIZ"), ("lost-passwords-book.epub", None), ("a:b.txt", None), ("txt", None), ("pass", "PASSWORD"))


@query("SELECT p_partkey, kind FROM part JOIN (VALUES " + ", ".join(f"({i}, '{kind}')" for i, (_, kind) in enumerate(_NAMES) if kind) + f") AS k (i, kind) ON p_partkey % {len(_NAMES)} = i")
def sidecar_kinds(spark, d):
    name = F.element_at(F.array(*(F.lit(x) for x, _ in _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return planning.sidecars(table(spark, d, "part").select("p_partkey", F.lit("p").alias("parent"), name.alias("name"))).select("p_partkey", "kind")


@query("""WITH w AS (SELECT DISTINCT l_orderkey AS wanted_id, l_returnflag || l_linestatus AS m FROM lineitem), s AS (SELECT DISTINCT l_suppkey AS stored_id, l_returnflag || l_linestatus AS m FROM lineitem),
a AS (SELECT wanted_id, list_sort(list(m)) AS ms FROM w GROUP BY 1), b AS (SELECT stored_id, list_sort(list(m)) AS ms FROM s GROUP BY 1) SELECT wanted_id, min(stored_id) AS stored_id FROM a JOIN b USING (ms) GROUP BY 1""")
def equal_source_sets(spark, d):
    l = table(spark, d, "lineitem").withColumn("member", F.concat("l_returnflag", "l_linestatus"))
    return planning.equal_source_sets(l.select(F.col("l_orderkey").alias("wanted_id"), "member"), l.select(F.col("l_suppkey").alias("stored_id"), "member"))


@query("""WITH b AS (SELECT o_orderkey AS plan_id, list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'IDENTITY_NOT_CONFIRMED' END, CASE WHEN o_orderkey % 7 = 0 THEN 'PRECONDITION_INCOMPLETE' END, CASE WHEN o_orderkey % 11 = 0 THEN 'PROTECTED_SOURCE_ROOT' END, CASE WHEN o_orderkey % 13 = 0 THEN 'KEEP_PREFERENCE_UNRESOLVED' END], lambda v: v IS NOT NULL) AS x, o_orderstatus AS s FROM orders)
SELECT plan_id, array_to_string(x, ',') AS blockers, CASE WHEN len(x) > 0 THEN 'BLOCKED' WHEN s = 'F' THEN 'APPROVED_NON_EXECUTABLE' ELSE 'REVIEW_REQUIRED' END AS status FROM b""")
def plan_status(spark, d):
    i = F.col("o_orderkey")
    p = table(spark, d, "orders").select(i.alias("plan_id"), F.when(i % 5 == 0, "REVIEW_REQUIRED").otherwise("CONFIRMED").alias("identity_status"), (i % 7 != 0).alias("preconditions_complete"), (i % 11 == 0).alias("root_protected"), F.lit(True).alias("quality_complete"), F.when(i % 13 == 0, "TIED").otherwise("PREFERRED").alias("preference"), F.when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("PENDING").alias("review"))
    return planning.plan_status(p).select("plan_id", F.array_join("blockers", ",").alias("blockers"), "status")


@query("SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, max(event_id) AS sequence_no FROM events GROUP BY 1")
def latest_events(spark, d):
    return planning.latest_events(table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence_no"), F.col("event_type").alias("status")))


@query("SELECT CASE WHEN count(*) FILTER (n_chars < 0) > 0 THEN 'INVALID' WHEN (SELECT count(*) FROM labels) < (SELECT count(*) FROM documents) THEN 'PENDING' ELSE 'COMPLETE' END AS state, cast(CASE WHEN count(*) FILTER (n_chars < 0) > 0 THEN 2 WHEN (SELECT count(*) FROM labels) < (SELECT count(*) FROM documents) THEN 3 ELSE 0 END AS INTEGER) AS exit_code FROM documents")
def postscan_verification(spark, d):
    sizes = table(spark, d, "documents").agg(F.when(F.count_if(F.col("n_chars") < 0) > 0, "INVALID").otherwise("COMPLETE").alias("state"))
    lacking = table(spark, d, "documents").agg(F.count("*").alias("n")).crossJoin(F.broadcast(table(spark, d, "labels").agg(F.count("*").alias("m"))))
    return planning.verification(sizes.unionByName(lacking.select(F.when(F.col("m") < F.col("n"), "PENDING").otherwise("COMPLETE").alias("state"))))


@query(f"WITH {OBS} SELECT root AS parent, relative_path AS name, cast(o AS INTEGER) AS ordinal FROM (SELECT root, relative_path, row_number() OVER (PARTITION BY root ORDER BY relative_path) - 1 AS o FROM obs) WHERE o < 8")
def archive_plan(spark, d):
    return planning.archive_plan(observations(spark, d).select(F.col("root").alias("parent"), F.col("relative_path").alias("name")), 8)

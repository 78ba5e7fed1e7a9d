"""Snapshots from typed evidence over the driver's tables: customers in the role of files, orders and their lines in that of evidence."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.operators import snapshot, state
from veritome.plans.registry import query, table

_BASE = ("customer", "orders", "lineitem", "supplier")
#: Orders with the run and the observation that they are evidence of; every eleventh is about another run's observation.
_O = """(SELECT o_orderkey, o_custkey, run, concat(run, '-', o_custkey) AS obs, CASE WHEN o_orderkey % 11 = 0 THEN concat('r0-', o_custkey) ELSE concat(run, '-', o_custkey) END AS bound FROM
 (SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'r2' WHEN 1 THEN 'r2' WHEN 2 THEN 'r0' WHEN 3 THEN 'r1' ELSE 'r3' END AS run FROM {orders}) q)"""
_OL = f"(SELECT o.*, l_linenumber, l_partkey, l_suppkey FROM {_O} o JOIN {{lineitem}} ON o_orderkey = l_orderkey)"
_SUBJECT = "CASE WHEN o_orderkey % 4 = 0 THEN 'FILE' ELSE 'FILE_OBSERVATION' END AS subject_kind, CASE WHEN o_orderkey % 4 = 0 THEN concat('', o_custkey) ELSE obs END AS subject_id"

#: The typed tables, in SQL that both engines read.
TABLES = {
    "runs": "SELECT * FROM (VALUES ('r0', 'A', 'COMPLETED', '2024-01-01'), ('r1', 'A', 'FAILED', '2024-02-01'), ('r2', 'A', 'COMPLETED', '2024-03-01'), ('r3', 'A', 'COMPLETED', '2024-04-01'), ('x0', 'B', 'COMPLETED', '2024-01-05')) AS t(id, scan_root_id, status, completed_at)",
    "files": "SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN 'MUSIC' ELSE 'EBOOK' END AS media_type FROM {customer}",
    "observations": " UNION ALL ".join(f"SELECT concat('{r}-', c_custkey) AS id, c_custkey AS file_id, '{r}' AS scan_run_id, concat('shelf/b', c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.epub' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '' END) AS relative_path, c_custkey * 7 AS size_bytes FROM {{customer}} WHERE {w}" for r, w in (("r0", "c_custkey % 3 <> 0"), ("r1", "c_custkey % 4 = 0"), ("r2", "c_custkey % 10 <> 3"), ("r3", "c_custkey % 5 = 0"))),
    "file_scan_events": "SELECT c_custkey AS file_id, 'r2' AS scan_run_id, 'MODIFIED' AS kind FROM {customer} WHERE c_custkey % 6 = 0",
    "collection_runs": "SELECT concat('cr-', id) AS id, id AS source_scan_run_id, 'collection/v1' AS profile, concat('analysis/', id) AS analysis_profile, status FROM {runs}",
    "collection_items": f"SELECT o_orderkey AS id, concat('cr-', run) AS run_id, bound AS observation_id, 'COMPLETED' AS status FROM {_O} o WHERE o_orderkey % 3 = 0",
    "collection_findings": "SELECT l_orderkey AS item_id, l_linenumber AS ordinal, 'WARNING' AS severity FROM {lineitem} WHERE l_linenumber < 3",
    "collection_executions": "SELECT l_orderkey AS item_id, l_linenumber AS ordinal, 'TEXT' AS step FROM {lineitem} WHERE l_linenumber = 4",
    "tool_executions": "SELECT s_suppkey AS id, 'opf' AS provider_id, s_suppkey % 3 AS tool_version, 'a1' AS adapter_version, 'METADATA' AS capability, 'SUCCEEDED' AS status FROM {supplier}",
    "tool_results": f"SELECT o_orderkey * 10 + l_linenumber AS id, l_suppkey AS execution_id, CASE WHEN l_linenumber = 7 THEN 'FILE' ELSE 'FILE_OBSERVATION' END AS target_kind, CASE WHEN l_linenumber = 7 THEN concat('', o_custkey) ELSE obs END AS target_id, CASE WHEN l_linenumber < 3 THEN 'ebook_metadata_candidate' ELSE 'text_sample' END AS result_type, concat('k', l_linenumber, '-', l_suppkey % 20) AS key, concat('v', l_partkey % 2) AS value FROM {_OL} x WHERE o_orderkey % 2 = 0",
    "fingerprints": f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'FILE' ELSE 'FILE_OBSERVATION' END AS target_kind, CASE WHEN o_orderkey % 7 = 0 THEN concat('', o_custkey) ELSE obs END AS target_id, 'TEXT' AS kind, 'sha256' AS algorithm, 'v1' AS algorithm_version, concat('f', o_orderkey % 4) AS value, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 END AS tool_execution_id FROM {_O} o WHERE o_orderkey % 9 < 4",
    "resolution_candidates": f"SELECT o_orderkey AS id, {_SUBJECT}, CASE o_orderkey % 3 WHEN 0 THEN 'WORK' WHEN 1 THEN 'EDITION' ELSE 'AGENT' END AS candidate_kind, concat('e', CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_custkey END) AS candidate_entity_id, 'exact' AS resolver_name, 'v2' AS resolver_version, 'd1' AS decision_compatibility_version FROM {_O} o",
    "resolution_evidence": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS resolution_candidate_id, l_linenumber AS ordinal, CASE WHEN l_partkey % 37 = 0 THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS evidence_role FROM {lineitem} WHERE l_linenumber = 2",
    "projections": "SELECT concat('w', c_custkey) AS id, 'WORK' AS target_kind, concat('e', c_custkey) AS target_id, 'as1' AS assertion_profile_version, 'pr1' AS projection_profile_version, CASE WHEN c_custkey % 19 = 0 THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status FROM {customer} WHERE c_custkey % 5 <> 1",
    "projection_values": "SELECT concat('w', c_custkey) AS projection_id, 'GENRE' AS dimension, 0 AS ordinal, CASE WHEN c_custkey % 23 = 0 THEN 'SEVERAL' END AS conflict_code FROM {customer} WHERE c_custkey % 4 <> 2",
    "relation_candidates": f"SELECT o_orderkey AS id, run AS source_scan_run_id, 'FILE' AS left_kind, concat('', o_custkey) AS left_id, CASE WHEN o_orderkey % 6 = 0 THEN 'EDITION' ELSE 'FILE' END AS right_kind, concat('', o_custkey % 100 + 1) AS right_id, 'ebook' AS matcher_name, 'v3' AS matcher_version, 'd1' AS decision_compatibility_version FROM {_O} o WHERE o_orderkey % 4 = 1",
    "relation_evidence": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS relation_candidate_id, l_linenumber AS ordinal, CASE WHEN l_partkey % 29 = 0 THEN 'TITLE_CONTRADICTORY' ELSE 'TITLE_EQUAL' END AS feature_code, CASE WHEN l_suppkey % 2 = 0 THEN 'PRESENT' ELSE 'ABSENT' END AS feature_state FROM {lineitem} WHERE l_linenumber < 3",
    "review_items": f"SELECT o_orderkey AS id, {_SUBJECT}, 'PENDING' AS state, 'matcher' AS producer_name, 'v1' AS producer_version, 'd1' AS decision_compatibility_version FROM {_O} o WHERE o_orderkey % 8 < 3",
    "review_decisions": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS review_item_id, l_linenumber AS sequence_no, 'DEFER' AS decision FROM {lineitem} WHERE l_linenumber > 5",
    "calibre_snapshots": "SELECT concat('s-', id) AS id, id AS source_scan_run_id, 'library/v1' AS profile, 'a2' AS adapter_version, '7' AS tool_version, 'p3' AS parser_version, status FROM {runs}",
    "calibre_records": f"SELECT o_orderkey AS id, concat('s-', run) AS snapshot_id FROM {_O} o WHERE o_orderkey % 7 = 1",
    "calibre_formats": f"SELECT o_orderkey AS id, o_orderkey AS record_snapshot_id, 'EPUB' AS format_label, CASE WHEN o_orderkey % 2 = 0 THEN bound END AS observation_id FROM {_O} o WHERE o_orderkey % 7 = 1",
    "calibre_sidecars": f"SELECT o_orderkey AS id, o_orderkey AS record_snapshot_id, 'OPF' AS kind, bound AS observation_id FROM {_O} o WHERE o_orderkey % 21 = 1",
    "calibre_findings": f"SELECT o_orderkey AS id, concat('s-', run) AS snapshot_id, CASE WHEN o_custkey % 3 = 0 THEN 'METADATA_CONFLICT' ELSE 'SIZE_CHANGED' END AS code FROM {_O} o WHERE o_orderkey % 10 = 2",
    "calibre_finding_refs": f"SELECT o_orderkey AS id, o_orderkey AS finding_id, 0 AS ordinal, CASE WHEN o_custkey % 5 = 0 THEN 'RECORD' ELSE 'FILE_OBSERVATION' END AS ref_kind, bound AS ref_id FROM {_O} o WHERE o_orderkey % 10 = 2",
    "archive_observations": f"SELECT o_orderkey AS id, run AS source_scan_run_id, 'archive/v1' AS profile, 'sig/v1' AS signature_profile, CASE o_custkey % 9 WHEN 0 THEN 'CORRUPT' WHEN 1 THEN 'FAILED' ELSE 'PASSED' END AS integrity_status, CASE o_custkey % 14 WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'UNSUPPORTED' ELSE 'RECOGNIZED' END AS recognition_status FROM {_O} o WHERE o_orderkey % 6 = 4",
    "archive_sources": f"SELECT o_orderkey AS archive_observation_id, 0 AS source_ordinal, bound AS file_observation_id FROM {_O} o WHERE o_orderkey % 6 = 4",
    "sidecar_inventories": f"SELECT o_orderkey AS id, run AS source_scan_run_id, 'side/v1' AS profile FROM {_O} o WHERE o_orderkey % 12 = 5",
    "sidecar_items": f"SELECT o_orderkey AS inventory_id, 0 AS sidecar_ordinal, bound AS sidecar_file_observation_id FROM {_O} o WHERE o_orderkey % 12 = 5",
    "archive_runs": "SELECT concat('ar-', id) AS id, id AS source_scan_run_id, 'collect/v1' AS profile, 'plan/v1' AS plan_profile, status, 0 AS missing_volume_count, 0 AS unsupported_volume_count, CASE WHEN id = 'r0' THEN 2 ELSE 0 END AS ambiguous_volume_count, 0 AS name_collision_count, 0 AS orphan_volume_count FROM {runs}",
    "archive_run_sources": f"SELECT concat('ar-', run) AS run_id, o_orderkey AS item_id, 0 AS source_ordinal, bound AS file_observation_id FROM {_O} o WHERE o_orderkey % 15 = 7",
    "plans": f"SELECT o_orderkey AS id, run AS source_scan_run_id, o_custkey AS keeper_file_id, o_custkey % 50 + 1 AS candidate_file_id, 'plan/v1' AS profile, 'v1' AS plan_version, 's1' AS serializer_version FROM {_O} o WHERE o_orderkey % 9 = 0",
    "plan_blockers": "SELECT l_orderkey AS plan_id, l_linenumber AS ordinal, 'PATH_REFERENCED' AS code FROM {lineitem} WHERE l_partkey % 5 = 0",
    "quality_evidence": f"SELECT o_orderkey AS id, run AS source_scan_run_id, bound AS observation_id, CASE o_custkey % 8 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'ACTION_REQUIRED' ELSE 'OK' END AS aggregate_quality_status, 'q/v1' AS profile, 'c/v1' AS collection_profile, 'a/v1' AS analysis_profile, 'k/v1' AS quality_profile FROM {_O} o WHERE o_orderkey % 16 = 3",
    "authorizations": f"SELECT o_orderkey AS id, o_orderkey AS plan_id, 'auth/v1' AS profile, 'h' AS content_hash, 't0' AS authorized_at, 't1' AS expires_at FROM {_O} o WHERE o_orderkey % 18 = 0",
    "quarantine_runs": f"SELECT concat('q', o_orderkey) AS id, o_orderkey AS authorization_id, 'exec/v1' AS profile, 't0' AS created_at FROM {_O} o WHERE o_orderkey % 36 = 0",
    "quarantine_events": "SELECT concat('q', l_orderkey) AS run_id, l_linenumber AS sequence_no, CASE l_partkey % 6 WHEN 0 THEN 'PREPARED' WHEN 1 THEN 'MOVED' WHEN 2 THEN 'VERIFIED' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'FAILED' ELSE 'ROLLED_BACK' END AS status, 't0' AS occurred_at, 'none' AS finding_code FROM {lineitem}",
}
SOURCE = "r2"


def tables(spark, d) -> dict[str, DataFrame]:
    known = {n: table(spark, d, n) for n in _BASE}
    found: dict[str, DataFrame] = {}
    for name, sql in TABLES.items():
        used = {n: x for n, x in (known | found).items() if f"{{{n}}}" in sql}
        found[name] = spark.sql(sql, **used)
    return found


#: The rules as SQL: evidence of a component as file_id, scope, conflict. Bound evidence of the current run about another observation is stale.
_BOUND = "JOIN tl ON tl.run = x.source_scan_run_id JOIN observations b ON b.id = x.obs_id JOIN it ON it.file_id = b.file_id"
_SEEN = "JOIN observations b ON x.subject_kind = 'FILE_OBSERVATION' AND b.id = x.subject_id JOIN tl ON tl.run = b.scan_run_id"


def _bound(rows: str, conflict: str = "false") -> str:
    return f"SELECT b.file_id, CASE WHEN tl.scope = 'CURRENT' AND b.id <> it.obs THEN 'STALE' ELSE tl.scope END AS scope, coalesce({conflict}, false) AS conflict FROM ({rows}) x {_BOUND}"


def _either(rows: str, conflict: str = "false") -> str:
    """About an observation by its run, or about a file without one."""
    return f"SELECT b.file_id, tl.scope, coalesce({conflict}, false) AS conflict FROM ({rows}) x {_SEEN} UNION ALL SELECT cast(x.subject_id AS BIGINT), 'UNSCOPED', coalesce({conflict}, false) FROM ({rows}) x WHERE x.subject_kind = 'FILE'"


def _ends(rows: str, conflict: str) -> str:
    return f"SELECT cast(e AS BIGINT) AS file_id, tl.scope, coalesce({conflict}, false) AS conflict FROM (SELECT *, unnest(list_distinct(list_filter(ends, lambda v: v IS NOT NULL))) AS e FROM ({rows}) y) x JOIN tl ON tl.run = x.source_scan_run_id"


_ITEMS = "SELECT i.*, r.source_scan_run_id, i.observation_id AS obs_id FROM collection_items i JOIN collection_runs r ON r.id = i.run_id"
_RESOLVED = "SELECT c.*, e.evidence_role FROM resolution_candidates c LEFT JOIN resolution_evidence e ON e.resolution_candidate_id = c.id"
RULES = {
    "ANALYSIS": " UNION ALL ".join([
        _bound(_ITEMS), _bound(f"SELECT i.* FROM collection_findings f JOIN ({_ITEMS}) i ON i.id = f.item_id"), _bound(f"SELECT i.* FROM collection_executions f JOIN ({_ITEMS}) i ON i.id = f.item_id"),
        "SELECT file_id, scope, scope = 'CURRENT' AND result_type = 'ebook_metadata_candidate' AND count(DISTINCT value) OVER (PARTITION BY file_id, scope, result_type, key) > 1 FROM (SELECT b.file_id, tl.scope, t.result_type, t.key, t.value FROM tool_results t JOIN tool_executions e ON e.id = t.execution_id JOIN observations b ON t.target_kind = 'FILE_OBSERVATION' AND b.id = t.target_id JOIN tl ON tl.run = b.scan_run_id) x",
        "SELECT cast(target_id AS BIGINT), 'UNSCOPED', false FROM tool_results JOIN tool_executions e ON e.id = execution_id WHERE target_kind = 'FILE'",
        "SELECT b.file_id, tl.scope, false FROM fingerprints f JOIN observations b ON f.target_kind = 'FILE_OBSERVATION' AND b.id = f.target_id JOIN tl ON tl.run = b.scan_run_id WHERE tool_execution_id IS NOT NULL",
    ]),
    "RESOLUTION": "SELECT file_id, scope, contradicts OR count(DISTINCT entity) OVER (PARTITION BY file_id, scope, kind) > 1 AS conflict FROM (SELECT b.file_id, tl.scope, candidate_kind AS kind, candidate_entity_id AS entity, coalesce(evidence_role = 'CONTRADICTS', false) AS contradicts FROM (" + _RESOLVED + ") x " + _SEEN + " UNION ALL SELECT cast(subject_id AS BIGINT), 'UNSCOPED', candidate_kind, candidate_entity_id, coalesce(evidence_role = 'CONTRADICTS', false) FROM (" + _RESOLVED + ") x WHERE subject_kind = 'FILE') y",
    "CLASSIFICATION": _either("SELECT c.subject_kind, c.subject_id, p.status, v.conflict_code FROM resolution_candidates c JOIN projections p ON p.target_kind = c.candidate_kind AND p.target_id = c.candidate_entity_id LEFT JOIN projection_values v ON v.projection_id = p.id", "x.status = 'REVIEW_REQUIRED' OR x.conflict_code IS NOT NULL"),
    "MATCHING": _ends("SELECT c.source_scan_run_id, e.feature_code, e.feature_state, [CASE WHEN left_kind = 'FILE' THEN left_id END, CASE WHEN right_kind = 'FILE' THEN right_id END] AS ends FROM relation_candidates c LEFT JOIN relation_evidence e ON e.relation_candidate_id = c.id", "feature_code LIKE '%CONTRADICTORY' AND feature_state = 'PRESENT'"),
    "REVIEW": _either("SELECT r.subject_kind, r.subject_id FROM review_items r LEFT JOIN review_decisions d ON d.review_item_id = r.id"),
    "CALIBRE": " UNION ALL ".join([
        *(_bound(f"SELECT s.source_scan_run_id, f.observation_id AS obs_id FROM {child} f JOIN calibre_records r ON r.id = f.record_snapshot_id JOIN calibre_snapshots s ON s.id = r.snapshot_id") for child in ("calibre_formats", "calibre_sidecars")),
        _bound("SELECT s.source_scan_run_id, r.ref_id AS obs_id, f.code FROM calibre_finding_refs r JOIN calibre_findings f ON f.id = r.finding_id JOIN calibre_snapshots s ON s.id = f.snapshot_id WHERE r.ref_kind = 'FILE_OBSERVATION'", "x.code LIKE '%CONFLICT%'"),
    ]),
    "ARCHIVE": " UNION ALL ".join([
        _bound("SELECT a.*, s.file_observation_id AS obs_id FROM archive_sources s JOIN archive_observations a ON a.id = s.archive_observation_id", "x.integrity_status IN ('FAILED', 'CORRUPT') OR x.recognition_status IN ('UNSUPPORTED', 'AMBIGUOUS')"),
        _bound("SELECT i.source_scan_run_id, s.sidecar_file_observation_id AS obs_id FROM sidecar_items s JOIN sidecar_inventories i ON i.id = s.inventory_id"),
        _bound("SELECT r.*, s.file_observation_id AS obs_id FROM archive_run_sources s JOIN archive_runs r ON r.id = s.run_id", "x.missing_volume_count + x.unsupported_volume_count + x.ambiguous_volume_count + x.name_collision_count + x.orphan_volume_count > 0"),
    ]),
    "CONSOLIDATION": " UNION ALL ".join([
        _ends("SELECT p.source_scan_run_id, b.code, [keeper_file_id, candidate_file_id] AS ends FROM plans p LEFT JOIN plan_blockers b ON b.plan_id = p.id", "code IS NOT NULL"),
        _bound("SELECT *, observation_id AS obs_id FROM quality_evidence", "x.aggregate_quality_status IN ('REVIEW', 'ACTION_REQUIRED')"),
    ]),
    "QUARANTINE": _ends("SELECT p.source_scan_run_id, e.status, [keeper_file_id, candidate_file_id] AS ends FROM authorizations a JOIN plans p ON p.id = a.plan_id LEFT JOIN quarantine_runs r ON r.authorization_id = a.id LEFT JOIN quarantine_events e ON e.run_id = r.id", "status NOT IN ('PREPARED', 'MOVED', 'VERIFIED', 'COMPLETED')"),
}


def _with(components) -> str:
    plain = lambda sql: sql.replace("{", "").replace("}", "")
    made = ", ".join(f"{name} AS ({plain(sql)})" for name, sql in TABLES.items())
    rules = " UNION ALL ".join(f"SELECT '{c}' AS component, file_id, scope, conflict FROM ({RULES[c]}) r" for c in components)
    names = ", ".join(f"({state.COMPONENTS.index(c)}, '{c}')" for c in components)
    return f"""WITH {made},
tl AS (SELECT id AS run, CASE WHEN id = '{SOURCE}' THEN 'CURRENT' ELSE 'STALE' END AS scope FROM runs WHERE scan_root_id = 'A' AND (id = '{SOURCE}' OR (status = 'COMPLETED' AND completed_at < '2024-03-01'))),
it AS (SELECT o.file_id, o.id AS obs, size_bytes, relative_path FROM observations o JOIN files f ON f.id = o.file_id WHERE scan_run_id = '{SOURCE}' AND media_type = 'EBOOK'),
ev AS ({rules}), comp(ordinal, component) AS (VALUES {names}),
st AS (SELECT it.file_id, comp.ordinal, comp.component, count(ev.scope) AS n, CASE WHEN count(*) FILTER (ev.scope = 'CURRENT') > 0 THEN 'CURRENT' WHEN count(*) FILTER (ev.scope = 'STALE') > 0 THEN 'STALE' WHEN count(*) FILTER (ev.scope = 'UNSCOPED') > 0 THEN 'UNSCOPED' ELSE 'MISSING' END || CASE WHEN bool_or(ev.conflict) THEN '_CONFLICT' ELSE '' END AS state
 FROM it CROSS JOIN comp LEFT JOIN ev ON ev.file_id = it.file_id AND ev.component = comp.component GROUP BY ALL)
"""


def _component(name: str):
    def run(spark, d):
        t = tables(spark, d)
        wide = snapshot.items_written(snapshot.items_of(t["observations"], t["files"], SOURCE), snapshot.load(t, SOURCE, [name]), table(spark, d, "lineitem").count())
        return snapshot.item_rows(wide).where(F.col("component") == name).select("file_id", "state", "n")

    run.__name__ = f"snapshot_{name.lower()}"
    return query(_with([name]) + "SELECT file_id, state, n FROM st")(run)


for _name in state.COMPONENTS:
    _component(_name)

_SUMS = """, s AS (SELECT ordinal, component, count(*) AS items, sum(n) AS evidence, count(*) FILTER (state LIKE 'CURRENT%') AS cur, count(*) FILTER (state LIKE 'STALE%') AS stale, count(*) FILTER (state LIKE 'UNSCOPED%') AS unscoped, count(*) FILTER (state = 'MISSING') AS missing, count(*) FILTER (state LIKE '%_CONFLICT') AS conflicts FROM st GROUP BY ALL)
"""


@cache
def _all() -> str:
    return _with(state.COMPONENTS) + _SUMS


def _snapshot(spark, d) -> snapshot.Snapshot:
    return snapshot.build(tables(spark, d), SOURCE)


@query(_all() + """SELECT ordinal, component, items, cast(evidence AS BIGINT) AS evidence, cur AS current, stale, unscoped, missing, conflicts, CASE WHEN cur = items THEN 'COMPLETE' WHEN cur + unscoped > 0 THEN 'PARTIAL' ELSE 'NONE' END AS coverage,
CASE WHEN stale > 0 AND cur + unscoped > 0 THEN 'MIXED' WHEN stale > 0 THEN 'STALE' WHEN unscoped > 0 THEN 'UNKNOWN' WHEN cur > 0 THEN 'CURRENT' ELSE 'UNKNOWN' END AS freshness, CASE WHEN conflicts > 0 THEN 'PRESENT' ELSE 'NONE' END AS conflict FROM s""")
def snapshot_components(spark, d):
    return _snapshot(spark, d).components.drop("profiles", "truncation")


@query(_all() + """SELECT 'physical.item_count' AS count_key, count(*) AS count_value FROM it UNION ALL SELECT 'physical.byte_count', cast(sum(size_bytes) AS BIGINT) FROM it
UNION ALL SELECT 'physical.format.' || f, count(*) FILTER (CASE file_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' ELSE 'other' END = f) FROM it, (VALUES ('azw'), ('azw3'), ('epub'), ('mobi'), ('other'), ('pdf')) v(f) GROUP BY f
UNION ALL SELECT lower(component) || '.' || k, cast(v AS BIGINT) FROM (SELECT component, unnest(['conflict_items', 'current_items', 'evidence_links', 'missing_items', 'stale_items', 'unscoped_items']) AS k, unnest([conflicts, cur, evidence, missing, stale, unscoped]) AS v FROM s)""")
def snapshot_counts(spark, d):
    return _snapshot(spark, d).counts

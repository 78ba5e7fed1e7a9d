"""Plans and what stands in their way, made of orders, each rule broken for some of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.operators import blockers, planning
from veritome.plans.registry import query, spread, table

_VERSIONS = {"KEEP_PREFERENCE": "keep/1", "CONSOLIDATION_CANDIDATE": "candidate/1"}


def _parts(spark, d):
    """Five tables in which orders break one rule or another, by the remainder of their key."""
    # by plan from the start: what is made of an order stays in its task, and only keys are shuffled
    o = spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    k = F.col("o_orderkey")
    plans = o.select(
        k.alias("plan_id"), F.when(k % 101 != 0, F.when(k % 5 == 0, "SAME_WORK").otherwise("EXACT_DUPLICATE")).alias("relation"), F.lit("FILE").alias("left_kind"), F.lit("FILE").alias("right_kind"),
        (2 * k).alias("left_file_id"), (2 * k + 1).alias("right_file_id"), F.when(k % 7 == 0, "PROPOSED").otherwise("CONFIRMED").alias("match_status"), F.lit("root").alias("scan_root_id"), F.lit("run").alias("scan_run_id"),
        (k % 11 != 0).alias("run_completed"), F.lit(True).alias("sha_equal"), F.when(k % 13 != 0, True).alias("lineage_matches"), (k % 17 == 0).alias("root_protected"), F.when(k % 19 == 0, "TIED").otherwise("PREFERRED").alias("preference"),
    )
    roles = F.explode(F.array(F.struct(F.lit("KEEPER").alias("role"), F.lit(0).alias("at")), F.struct(F.lit("CANDIDATE").alias("role"), F.lit(1).alias("at")))).alias("r")
    each = o.select(k.alias("plan_id"), roles).select("plan_id", "r.*")
    p, keeper = F.col("plan_id"), F.col("role") == "KEEPER"
    kinds = F.explode(F.array(*(F.lit(x) for x in blockers.DEPENDENCY_CODES))).alias("kind")
    state = F.when((F.col("kind") == "SIDECAR") & (p % 23 == 0), "UNKNOWN").when((F.col("kind") == "ARCHIVE") & (p % 29 == 0), "KNOWN_PRESENT").when(F.col("kind") == "CALIBRE", "NOT_APPLICABLE").otherwise("KNOWN_NONE")
    snapshot = F.when((F.col("kind") != "CALIBRE") | (p % 31 != 0), F.lit("s"))
    dependencies = each.select("plan_id", "role", kinds).select("plan_id", "role", "kind", state.alias("state"), F.lit("f").alias("fingerprint"), F.lit("LIBRARY").alias("snapshot_kind"), snapshot.alias("snapshot_id"))
    reviewed = F.when(keeper & (p % 37 == 0), "REJECTED").when(~keeper & (p % 41 == 0), "STALE").when(p % 43 == 0, "PENDING").otherwise("ACCEPTED")
    kind = F.when(keeper, "KEEP_PREFERENCE").otherwise("CONSOLIDATION_CANDIDATE")
    decision = [F.concat(F.lit("r"), p.cast("string")).alias("review_item_id"), F.lit("d").alias("decision_id"), F.lit(1).alias("sequence_no"), F.when(keeper, "keep/1").otherwise("candidate/1").alias("version"), F.lit("e").alias("evidence"), F.lit("c").alias("candidates")]
    reviews = each.where((p % 47 != 0) | keeper).select("plan_id", kind.alias("review_type"), reviewed.alias("state"), F.when(keeper, "ebook-keep-preference").otherwise("ebook-consolidation-candidate").alias("producer"), *decision)
    quality = each.where((p % 53 != 0) | keeper).select("plan_id", "role", F.lit("root").alias("scan_root_id"), F.lit("run").alias("scan_run_id"), F.when((p % 59 == 0) & keeper, "old").otherwise(F.concat(F.lit("o"), (2 * p + F.col("at")).cast("string"))).alias("observation_id"))
    codes = F.explode(F.concat(F.array(*(F.lit(x) for x in (*blockers.FILE_CONDITIONS, *blockers.RELATION_CONDITIONS.values(), blockers.REVIEW_CONDITION))), F.when(keeper, F.array(F.lit(blockers.KEEPER_CONDITION))).otherwise(F.array().cast("array<string>")))).alias("code")
    file = [(2 * p + F.col("at")).alias("file_id"), F.concat(F.lit("o"), (2 * p + F.col("at")).cast("string")).alias("observation_id"), F.lit("root").alias("scan_root_id"), F.lit("run").alias("scan_run_id"), F.lit("PRESENT").alias("presence"), F.when((p % 61 == 0) & keeper, "other").otherwise("sha").alias("sha256"), F.lit(1).alias("size_bytes"), F.lit("m").alias("modified_at"), F.lit("n").alias("observed_at")]
    conditions = each.select("plan_id", "role", "at", codes).where((p % 67 != 0) | (F.col("code") != "SIZE_MATCHES"))
    relation = F.coalesce(*(F.when(F.col("code") == c, F.lit(x)) for x, c in blockers.RELATION_CONDITIONS.items()))
    expected = conditions.select("plan_id", "role", "code", *file, relation.alias("dependency_kind"), *decision).withColumn("kind", F.col("dependency_kind"))
    expected = expected.select("*", F.when(F.col("kind").isNotNull(), state).alias("dependency_state"), F.when(F.col("kind").isNotNull(), F.lit("f")).alias("dependency_fingerprint"), F.when(F.col("kind").isNotNull(), F.lit("LIBRARY")).alias("dependency_snapshot_kind"), F.when(F.col("kind").isNotNull(), snapshot).alias("dependency_snapshot_id")).drop("kind")
    return plans, expected, quality, dependencies, reviews


@query("""WITH k AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT k, k % 47 = 0 OR k % 41 = 0 AS gone, k % 37 = 0 AS refused, k % 37 <> 0 AND k % 43 = 0 AS keeper_waits, k % 43 = 0 AS waits FROM k),
b AS (SELECT k, list_sort(list_filter([
 CASE WHEN k % 101 = 0 OR k % 5 = 0 OR k % 61 = 0 THEN 'IDENTITY_NOT_ACTIONABLE' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'IDENTITY_NOT_CONFIRMED' END,
 CASE WHEN k % 13 = 0 THEN 'LINEAGE_MISMATCH' END, CASE WHEN k % 17 = 0 THEN 'PROTECTED_SOURCE_ROOT' END, CASE WHEN k % 19 = 0 THEN 'KEEP_PREFERENCE_UNRESOLVED' END,
 CASE WHEN k % 101 = 0 OR k % 53 = 0 OR k % 59 = 0 THEN 'QUALITY_EVIDENCE_INCOMPLETE' END,
 CASE WHEN k % 101 = 0 OR k % 67 = 0 OR gone OR refused OR waits THEN 'PRECONDITION_INCOMPLETE' END,
 CASE WHEN k % 23 = 0 THEN 'SIDECAR_RELATIONSHIP_UNKNOWN' END, CASE WHEN k % 29 = 0 THEN 'ARCHIVE_MEMBERSHIP_PRESENT' END, CASE WHEN k % 31 = 0 THEN 'CALIBRE_RELATIONSHIP_UNKNOWN' END,
 CASE WHEN refused THEN 'KEEP_PREFERENCE_REVIEW_REJECTED' END, CASE WHEN gone THEN 'CONSOLIDATION_REVIEW_MISSING' END], lambda x: x IS NOT NULL)) AS x FROM r)
SELECT k AS plan_id, array_to_string(x, ',') AS blockers, CASE WHEN len(x) > 0 THEN 'BLOCKED' ELSE 'APPROVED_NON_EXECUTABLE' END AS status FROM b""")
def consolidation_blockers(spark, d):
    """All codes of plans whose evidence stands in five tables."""
    found = blockers.consolidation_blockers(*_parts(spark, d), _VERSIONS)
    return found.select("plan_id", F.array_join("blockers", ",").alias("blockers"), "status")


@query("""WITH b AS (SELECT o_orderkey AS k, list_filter([CASE WHEN k % 3 = 0 THEN 'DEPENDENCY_EVIDENCE_INCOMPLETE' END, CASE WHEN k % 5 = 0 THEN 'FIELD_SELECTION_INVALID' END, CASE WHEN k % 7 = 0 THEN 'LINEAGE_MISMATCH' END, CASE WHEN k % 11 = 0 THEN 'PRECONDITION_INCOMPLETE' END,
 CASE WHEN k % 13 = 0 THEN 'REVIEW_MISSING' END, CASE WHEN k % 13 <> 0 AND k % 17 <> 0 AND k % 19 = 0 THEN 'REVIEW_REJECTED' END, CASE WHEN k % 13 <> 0 AND k % 17 = 0 THEN 'REVIEW_STALE' END,
 CASE WHEN k % 23 = 0 THEN 'SOURCE_EVIDENCE_INCOMPLETE' END, CASE WHEN k % 29 = 0 THEN 'TARGET_CARRIER_INVALID' END, CASE WHEN k % 31 = 0 THEN 'VERIFICATION_CONTRACT_INCOMPLETE' END, CASE WHEN k % 37 = 0 THEN 'WRITER_REQUIREMENT_INVALID' END], lambda v: v IS NOT NULL) AS x FROM orders)
SELECT k AS plan_id, array_to_string(x, ',') AS blockers, CASE WHEN len(x) > 0 THEN 'BLOCKED' ELSE 'APPROVED_NON_EXECUTABLE' END AS status FROM b""")
def correction_blockers(spark, d):
    """All eleven codes of metadata corrections."""
    k = F.col("o_orderkey")
    review = F.when(k % 13 != 0, F.when(k % 19 == 0, "REJECTED").otherwise("ACCEPTED"))
    plans = table(spark, d, "orders").select(
        k.alias("plan_id"), (k % 7 != 0).alias("same_lineage"), (k % 23 != 0).alias("evidence_complete"), F.lit("a").alias("old_value"), F.when(k % 5 == 0, "a").otherwise("b").alias("new_value"), F.when(k % 3 == 0, "UNKNOWN").otherwise("KNOWN_NONE").alias("dependency"), review.alias("review"),
        F.when(k % 29 != 0, True).alias("carrier_valid"), (k % 37 != 0).alias("writer_valid"), (k % 11 != 0).alias("preconditions_complete"), (k % 31 != 0).alias("verification_complete"), (k % 17 != 0).alias("review_compatible"),
    )
    return planning.correction_blockers(plans).select("plan_id", F.array_join("blockers", ",").alias("blockers"), "status")

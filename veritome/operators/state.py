"""Sealed collection snapshots: item states, component summaries, differences, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritome.operators.relational import ordered_digest

# Components of a snapshot; findings with their dimension and severity.
COMPONENTS = ("ANALYSIS", "RESOLUTION", "CLASSIFICATION", "MATCHING", "REVIEW", "CALIBRE", "ARCHIVE", "CONSOLIDATION", "QUARANTINE")
SEVERITIES = ("INFO", "ATTENTION", "INCOMPLETE", "BLOCKED")
FINDINGS = (
    ("FULL_FIXITY_MISSING", "SCAN_FIXITY", "INCOMPLETE"),
    ("FULL_FIXITY_CONFLICT", "SCAN_FIXITY", "BLOCKED"),
    ("ANALYSIS_MISSING", "ANALYSIS_TOOL_COVERAGE", "INCOMPLETE"),
    ("ANALYSIS_STALE_OR_UNSCOPED", "ANALYSIS_TOOL_COVERAGE", "INCOMPLETE"),
    ("ANALYSIS_CONFLICT", "ANALYSIS_TOOL_COVERAGE", "BLOCKED"),
    ("ANALYSIS_QUALITY_FINDING_PRESENT", "ANALYSIS_TOOL_COVERAGE", "ATTENTION"),
    ("TITLE_METADATA_MISSING", "METADATA_AUTHORITY_CLASSIFICATION", "ATTENTION"),
    ("CONTRIBUTOR_METADATA_MISSING", "METADATA_AUTHORITY_CLASSIFICATION", "ATTENTION"),
    ("IDENTIFIER_METADATA_MISSING", "METADATA_AUTHORITY_CLASSIFICATION", "INFO"),
    ("LANGUAGE_METADATA_MISSING", "METADATA_AUTHORITY_CLASSIFICATION", "INFO"),
    ("PUBLISHER_METADATA_MISSING", "METADATA_AUTHORITY_CLASSIFICATION", "INFO"),
    ("METADATA_INDEX_TRUNCATED", "METADATA_AUTHORITY_CLASSIFICATION", "INCOMPLETE"),
    ("AUTHORITY_RESOLUTION_COVERAGE_GAP", "METADATA_AUTHORITY_CLASSIFICATION", "INCOMPLETE"),
    ("AUTHORITY_RESOLUTION_CONFLICT", "METADATA_AUTHORITY_CLASSIFICATION", "ATTENTION"),
    ("CLASSIFICATION_COVERAGE_GAP", "METADATA_AUTHORITY_CLASSIFICATION", "INCOMPLETE"),
    ("CLASSIFICATION_CONFLICT", "METADATA_AUTHORITY_CLASSIFICATION", "ATTENTION"),
    ("PENDING_REVIEW", "OPEN_REVIEWS", "ATTENTION"),
    ("DEFERRED_REVIEW", "OPEN_REVIEWS", "ATTENTION"),
    ("DUPLICATE_OR_VARIANT_EVIDENCE_PRESENT", "DUPLICATE_VARIANT_EVIDENCE", "INFO"),
    ("MATCHING_COVERAGE_GAP", "DUPLICATE_VARIANT_EVIDENCE", "INCOMPLETE"),
    ("MATCHING_CONFLICT", "DUPLICATE_VARIANT_EVIDENCE", "ATTENTION"),
    ("CALIBRE_DEPENDENCY_PRESENT", "DEPENDENCIES", "INFO"),
    ("SIDECAR_DEPENDENCY_PRESENT", "DEPENDENCIES", "INFO"),
    ("ARCHIVE_DEPENDENCY_PRESENT", "DEPENDENCIES", "INFO"),
    ("DEPENDENCY_COVERAGE_GAP", "DEPENDENCIES", "INCOMPLETE"),
    ("CALIBRE_CONFLICT", "DEPENDENCIES", "ATTENTION"),
    ("ARCHIVE_CONFLICT", "DEPENDENCIES", "ATTENTION"),
    ("CONSOLIDATION_BLOCKED", "BLOCKED_OPERATIONS", "BLOCKED"),
    ("QUARANTINE_BLOCKED", "BLOCKED_OPERATIONS", "BLOCKED"),
)
SAMPLES = 64


def scoped(evidence: DataFrame, source_run: str, source_completed_at, runs: DataFrame) -> DataFrame:
    """Adds ``scope``: CURRENT for the source run, STALE for an earlier complete one, UNSCOPED without a run; other runs' rows go."""
    known = runs.select(F.col("run_id").alias("run__"), "status", "completed_at")
    joined = evidence.join(known, F.col("run_id") == F.col("run__"), "left")
    scope = F.when(F.col("run_id").isNull(), F.lit("UNSCOPED")).when(F.col("run_id") == source_run, F.lit("CURRENT")).when((F.col("status") == "COMPLETED") & (F.col("completed_at") < F.lit(source_completed_at)), F.lit("STALE"))
    return joined.withColumn("scope", scope).where("scope is not null").drop("run__", "status", "completed_at")


def item_states(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """``file_id, component, state`` for every item and component: the best scope there is, with _CONFLICT if any of its evidence conflicts."""
    rank = F.when(F.col("scope") == "CURRENT", 3).when(F.col("scope") == "STALE", 2).when(F.col("scope") == "UNSCOPED", 1)
    best = evidence.groupBy("file_id", "component").agg(F.max(rank).alias("r"), F.bool_or("conflict").alias("conflict"))
    every = items.select("file_id", F.explode(F.array(*(F.lit(c) for c in COMPONENTS))).alias("component"))
    name = F.when(F.col("r") == 3, F.lit("CURRENT")).when(F.col("r") == 2, F.lit("STALE")).when(F.col("r") == 1, F.lit("UNSCOPED")).otherwise(F.lit("MISSING"))
    state = F.when(F.col("r").isNotNull() & F.col("conflict"), F.concat(name, F.lit("_CONFLICT"))).otherwise(name)
    return every.join(best, ["file_id", "component"], "left").select("file_id", "component", state.alias("state"))


def component_summary(states: DataFrame) -> DataFrame:
    """For each component: items, covered ones, coverage, freshness and whether there is a conflict."""
    known = F.col("state") != "MISSING"
    current, other = F.col("state").startswith("CURRENT"), F.col("state").rlike("^(STALE|UNSCOPED)")
    counted = states.groupBy("component").agg(F.count("*").alias("items"), F.count_if(known).alias("covered"), F.count_if(current).alias("current"), F.count_if(other).alias("other"), F.bool_or(F.col("state").endswith("_CONFLICT")).alias("conflict"))
    coverage = F.when(F.col("covered") == F.col("items"), F.lit("COMPLETE")).when(F.col("covered") > 0, F.lit("PARTIAL")).otherwise(F.lit("NONE"))
    fresh = F.when(F.col("covered") == 0, F.lit("UNKNOWN")).when(F.col("other") == 0, F.lit("CURRENT")).when(F.col("current") == 0, F.lit("STALE")).otherwise(F.lit("MIXED"))
    return counted.select("component", "items", "covered", coverage.alias("coverage"), fresh.alias("freshness"), F.when(F.col("conflict"), F.lit("PRESENT")).otherwise(F.lit("NONE")).alias("conflict"))


def seal(states: DataFrame) -> DataFrame:
    """The snapshot's digest over all item states in order."""
    return ordered_digest(states, ["file_id", "component"])


# Difference category by the component that newly has evidence.
NEWLY = (("ANALYSIS", "NEWLY_ANALYZED"), ("RESOLUTION", "NEWLY_RESOLVED"), ("REVIEW", "NEWLY_REVIEWED"), ("QUARANTINE", "NEWLY_BLOCKED"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``file_id, categories`` of two snapshots by file; rows have file_id, observation_id, format_name, size_bytes, technical (digest) and a boolean column for each of NEWLY's components.

    A file has changed technically if its format or size differs, or its digest under the same observation.
    """
    own = ("observation_id", "format_name", "size_bytes", "technical")
    names = [c.lower() for c, _ in NEWLY]
    old = before.select("file_id", *(F.col(c).alias(f"old_{c}") for c in own), *(F.col(c).alias(f"old_{c}") for c in names), F.lit(True).alias("was"))
    new = after.select("file_id", *own, *names, F.lit(True).alias("is"))
    both = old.join(new, "file_id", "full_outer")
    had, has = F.col("was").isNotNull(), F.col("is").isNotNull()
    newly = [F.when(had & has & F.col(c) & ~F.col(f"old_{c}"), F.lit(label)) for c, (_, label) in zip(names, NEWLY, strict=True)]
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    changed = differs("format_name") | differs("size_bytes") | (~differs("observation_id") & differs("technical"))
    found = F.array(F.when(~had, F.lit("ADDED")), F.when(~has, F.lit("DISAPPEARED")), F.when(had & has & changed, F.lit("TECHNICALLY_CHANGED")), *newly)
    return both.select("file_id", F.filter(found, lambda x: x.isNotNull()).alias("categories")).where(F.size("categories") > 0)


def diffable(states: DataFrame, technical: DataFrame) -> DataFrame:
    """One side of ``diff`` from item states and ``file_id, observation_id, format_name, size_bytes, technical``: evidence is there if current, a file is blocked by a conflict in consolidation or quarantine."""

    def seen(component: str, rule) -> Column:
        return F.coalesce(F.bool_or(F.when(F.col("component") == component, rule)), F.lit(False))

    current, conflict = F.col("state").startswith("CURRENT"), F.col("state").endswith("_CONFLICT")
    wide = states.groupBy("file_id").agg(seen("ANALYSIS", current).alias("analysis"), seen("RESOLUTION", current).alias("resolution"), seen("REVIEW", current).alias("review"), (seen("CONSOLIDATION", conflict) | seen("QUARANTINE", conflict)).alias("quarantine"))
    return technical.select("file_id", "observation_id", "format_name", "size_bytes", "technical").join(wide, "file_id")


def item_findings(states: DataFrame, facts: DataFrame) -> DataFrame:
    """``file_id, codes, covered``: what is found on each item, in the order of FINDINGS, and the dimensions that its evidence covers.

    states: file_id, component, state; a component without a row is MISSING. facts: file_id, fixity_values (a count),
    metadata_fields and review_states (arrays), metadata_truncated, quality_found, sidecar; nulls count as none.
    """
    wide = states.groupBy("file_id").agg(*(F.max(F.when(F.col("component") == c, F.col("state"))).alias(c) for c in COMPONENTS))
    rows = facts.join(wide, "file_id", "left")

    def state(component: str) -> Column:
        return F.coalesce(F.col(component), F.lit("MISSING"))

    def current(component: str) -> Column:
        return state(component).startswith("CURRENT")

    def conflict(component: str) -> Column:
        return state(component).endswith("_CONFLICT")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    def has(name: str, word: str) -> Column:
        return F.coalesce(F.array_contains(name, word), F.lit(False))

    fixity = F.coalesce("fixity_values", F.lit(0))
    depends = current("CALIBRE") | flag("sidecar") | current("ARCHIVE")
    rules = {
        "FULL_FIXITY_MISSING": fixity == 0, "FULL_FIXITY_CONFLICT": fixity > 1,
        "ANALYSIS_MISSING": state("ANALYSIS") == "MISSING", "ANALYSIS_STALE_OR_UNSCOPED": state("ANALYSIS").rlike("^(STALE|UNSCOPED)"), "ANALYSIS_CONFLICT": conflict("ANALYSIS"), "ANALYSIS_QUALITY_FINDING_PRESENT": flag("quality_found"),
        **{f"{w.upper()}_METADATA_MISSING": ~has("metadata_fields", w) for w in ("title", "contributor", "identifier", "language", "publisher")}, "METADATA_INDEX_TRUNCATED": flag("metadata_truncated"),
        "AUTHORITY_RESOLUTION_COVERAGE_GAP": ~current("RESOLUTION"), "AUTHORITY_RESOLUTION_CONFLICT": conflict("RESOLUTION"), "CLASSIFICATION_COVERAGE_GAP": ~current("CLASSIFICATION"), "CLASSIFICATION_CONFLICT": conflict("CLASSIFICATION"),
        "PENDING_REVIEW": has("review_states", "PENDING"), "DEFERRED_REVIEW": has("review_states", "DEFERRED"),
        "DUPLICATE_OR_VARIANT_EVIDENCE_PRESENT": current("MATCHING"), "MATCHING_COVERAGE_GAP": ~current("MATCHING"), "MATCHING_CONFLICT": conflict("MATCHING"),
        "CALIBRE_DEPENDENCY_PRESENT": current("CALIBRE"), "SIDECAR_DEPENDENCY_PRESENT": flag("sidecar"), "ARCHIVE_DEPENDENCY_PRESENT": current("ARCHIVE"), "DEPENDENCY_COVERAGE_GAP": ~depends,
        "CALIBRE_CONFLICT": conflict("CALIBRE"), "ARCHIVE_CONFLICT": conflict("ARCHIVE"), "CONSOLIDATION_BLOCKED": conflict("CONSOLIDATION"), "QUARANTINE_BLOCKED": conflict("QUARANTINE"),
    }
    described = has("metadata_fields", "title") & has("metadata_fields", "contributor") & ~flag("metadata_truncated") & current("RESOLUTION") & current("CLASSIFICATION")
    covers = {
        "SCAN_FIXITY": fixity == 1, "ANALYSIS_TOOL_COVERAGE": current("ANALYSIS"), "METADATA_AUTHORITY_CLASSIFICATION": described, "OPEN_REVIEWS": F.lit(True),
        "DUPLICATE_VARIANT_EVIDENCE": current("MATCHING"), "DEPENDENCIES": depends, "BLOCKED_OPERATIONS": F.lit(True),
    }

    def told(conditions: dict, order) -> Column:
        return F.filter(F.array(*(F.when(conditions[x], F.lit(x)) for x in order)), lambda x: x.isNotNull())

    return rows.select("file_id", told(rules, [c for c, *_ in FINDINGS]).alias("codes"), told(covers, list(dict.fromkeys(d for _, d, _ in FINDINGS))).alias("covered"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def health_findings(found: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``code, dimension, severity, n, samples`` from ``file_id, code``; the smallest ids are the samples."""
    spark = found.sparkSession
    rules = F.broadcast(spark.createDataFrame(FINDINGS, "code string, dimension string, severity string"))
    distinct = found.select("file_id", "code").distinct().join(rules, "code")
    counts = distinct.groupBy("code", "dimension", "severity").agg(F.count("*").alias("n"))
    ranked = distinct.withColumn("n__", F.row_number().over(Window.partitionBy("code").orderBy("file_id"))).where(F.col("n__") <= samples)
    first = ranked.groupBy("code").agg(F.sort_array(F.collect_list("file_id")).alias("samples"))
    return counts.join(first, "code")


def health_dimensions(found: DataFrame, total_items: int) -> DataFrame:
    """``dimension, affected, status``: how many items have findings, and the worst severity."""
    spark = found.sparkSession
    rules = F.broadcast(spark.createDataFrame([(c, d, SEVERITIES.index(s) + 1) for c, d, s in FINDINGS], "code string, dimension string, rank int"))
    dims = spark.createDataFrame([(d,) for d in dict.fromkeys(d for _, d, _ in FINDINGS)], "dimension string")
    counted = found.join(rules, "code").groupBy("dimension").agg(F.countDistinct("file_id").alias("affected"), F.max("rank").alias("rank"))
    status = F.element_at(F.array(*(F.lit(x) for x in ("CLEAR", "OBSERVED", "ATTENTION", "INCOMPLETE", "BLOCKED"))), F.coalesce("rank", F.lit(0)) + 1)
    return dims.join(counted, "dimension", "left").select("dimension", F.coalesce("affected", F.lit(0)).alias("affected"), F.lit(total_items).cast("bigint").alias("items"), status.alias("status"))


def health_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each finding's count between two health reports."""
    old, new = before.select("code", F.col("n").alias("old_n")), after.select("code", F.col("n").alias("new_n"))
    both = old.join(new, "code", "full_outer")
    return both.select("code", F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"), (F.coalesce("new_n", F.lit(0)) - F.coalesce("old_n", F.lit(0))).alias("delta"))

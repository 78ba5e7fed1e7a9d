"""Candidate blocks, pairs, rule scores and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Block types, and whether a block can show identity; SERIES_CONTEXT only supports.
BLOCK_TYPES = ("FILE_SHA256", "TEXT_FINGERPRINT", "EDITION_IDENTIFIER", "RESOLVED_EDITION", "RESOLVED_WORK", "AGENT_TITLE", "SERIES_CONTEXT")
PAIRWISE, MEMBERS, BLOCKS = 64, 256, 200
# Relation, feature, weight, effect (S supports, C contradicts), hard, required.
RULES = (
    ("EXACT_DUPLICATE", "FILE_SHA256_EQUAL", 100, "S", False, True),
    ("EXACT_DUPLICATE", "FILE_SHA256_DIFFERENT", 100, "C", True, False),
    ("SAME_EDITION", "EDITION_IDENTIFIER_COMPATIBLE", 35, "S", False, False),
    ("SAME_EDITION", "EDITION_IDENTIFIER_CONTRADICTORY", 100, "C", True, False),
    ("SAME_EDITION", "RESOLVED_EDITION_EQUAL", 50, "S", False, False),
    ("SAME_EDITION", "RESOLVED_EDITION_DIFFERENT", 100, "C", True, False),
    ("SAME_EDITION", "RESOLVED_WORK_EQUAL", 20, "S", False, False),
    ("SAME_EDITION", "RESOLVED_AGENT_EQUAL", 10, "S", False, False),
    ("SAME_EDITION", "TITLE_COMPATIBLE", 10, "S", False, False),
    ("SAME_EDITION", "TITLE_CONTRADICTORY", 30, "C", False, False),
    ("SAME_EDITION", "LANGUAGE_COMPATIBLE", 10, "S", False, False),
    ("SAME_EDITION", "LANGUAGE_CONTRADICTORY", 30, "C", False, False),
    ("SAME_EDITION", "NORMALIZED_TEXT_EQUAL", 30, "S", False, False),
    ("SAME_EDITION", "NORMALIZED_TEXT_DIFFERENT", 20, "C", False, False),
    ("SAME_EDITION", "MATERIAL_TEXT_CONTRADICTORY", 100, "C", True, False),
    ("SAME_EDITION", "FORMAT_DIFFERENT", 5, "S", False, False),
    ("SAME_WORK", "RESOLVED_WORK_EQUAL", 60, "S", False, False),
    ("SAME_WORK", "RESOLVED_WORK_DIFFERENT", 100, "C", True, False),
    ("SAME_WORK", "RESOLVED_AGENT_EQUAL", 20, "S", False, False),
    ("SAME_WORK", "TITLE_COMPATIBLE", 20, "S", False, False),
    ("SAME_WORK", "TITLE_CONTRADICTORY", 20, "C", False, False),
    ("SAME_WORK", "LANGUAGE_COMPATIBLE", 5, "S", False, False),
    ("SAME_WORK", "LANGUAGE_CONTRADICTORY", 5, "C", False, False),
    ("SAME_WORK", "NORMALIZED_TEXT_EQUAL", 15, "S", False, False),
    ("SAME_WORK", "NORMALIZED_TEXT_DIFFERENT", 15, "C", False, False),
)


# Relation, kind of both endpoints, effect on identity, evidence it needs.
RELATIONS = (
    ("EXACT_DUPLICATE", "FILE", "CONFIRMS_IDENTITY", ("FILE_SHA256",)),
    ("CONTENT_DUPLICATE", "FILE", "NONE", ("CONTENT_FINGERPRINT",)),
    ("FORMAT_VARIANT", "FILE", "NONE", ("FORMAT_EVIDENCE",)),
    ("QUALITY_VARIANT", "FILE", "NONE", ("QUALITY_EVIDENCE",)),
    ("SAME_EDITION", "EDITION", "CONFIRMS_IDENTITY", ("EDITION_IDENTIFIER",)),
    ("DIFFERENT_EDITION", "EDITION", "CONTRADICTS_IDENTITY", ("WORK_RESOLUTION", "EDITION_IDENTIFIER")),
    ("SAME_WORK", "WORK", "CONFIRMS_IDENTITY", ("WORK_RESOLUTION",)),
)


def relation_checks(relations: DataFrame) -> DataFrame:
    """Adds ``effect`` and ``violation`` to ``relation, left_kind, right_kind, evidence`` (an array): no contract, other endpoints, or evidence that lacks; null if it holds."""
    rules = relations.sparkSession.createDataFrame([(r, k, e, list(n)) for r, k, e, n in RELATIONS], "relation string, kind__ string, effect string, need__ array<string>")
    joined = relations.join(F.broadcast(rules), "relation", "left")
    lacks = F.size(F.array_except("need__", F.coalesce("evidence", F.array().cast("array<string>")))) > 0
    violation = (
        F.when(F.col("kind__").isNull(), F.lit("NO_CONTRACT"))
        .when(~F.col("left_kind").eqNullSafe(F.col("kind__")) | ~F.col("right_kind").eqNullSafe(F.col("kind__")), F.lit("ENDPOINT_KIND"))
        .when(lacks, F.lit("EVIDENCE_MISSING"))
    )
    return joined.withColumn("violation", violation).drop("kind__", "need__")


def blocks(evidence: DataFrame, pairwise: int = PAIRWISE, members: int = MEMBERS) -> DataFrame:
    """Blocks from ``block_type, block_key, member_id``: counts of all members, the first of them, status and representative.

    Fewer than two members make no block. FILE_SHA256 makes an EXACT_GROUP; more members
    than are compared pairwise need a SECONDARY key; others are READY.
    """
    distinct = evidence.where(F.col("block_key").isNotNull()).select("block_type", "block_key", "member_id").distinct()
    sizes = distinct.groupBy("block_type", "block_key").agg(F.count("*").alias("member_count"), F.min("member_id").alias("representative")).where("member_count > 1")
    ranked = distinct.withColumn("n", F.row_number().over(Window.partitionBy("block_type", "block_key").orderBy("member_id"))).where(F.col("n") <= members)
    first = ranked.groupBy("block_type", "block_key").agg(F.sort_array(F.collect_list("member_id")).alias("members"))
    status = F.when(F.col("block_type") == "FILE_SHA256", F.lit("EXACT_GROUP")).when(F.col("member_count") > pairwise, F.lit("SECONDARY_REQUIRED")).otherwise(F.lit("READY"))
    strength = F.when(F.col("block_type") == "SERIES_CONTEXT", F.lit("SUPPORTING_ONLY")).otherwise(F.lit("IDENTITY_CAPABLE"))
    return sizes.join(first, ["block_type", "block_key"]).select("block_type", "block_key", "member_count", "members", (F.col("member_count") > members).alias("truncated"), status.alias("status"), strength.alias("strength"), F.when(F.col("block_type") == "FILE_SHA256", F.col("representative")).alias("representative"))


def pairs(made: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Pairs to compare, each once: all of a READY identity block, and a star around the least member of an exact group or of an identity block too large for all its pairs.

    With the ``evidence`` of the blocks a star has all members of its block, else those that the block lists.
    """
    large = made.where("status = 'EXACT_GROUP' OR (status = 'SECONDARY_REQUIRED' AND strength = 'IDENTITY_CAPABLE')")
    if evidence is None:
        star = large.select("block_type", "block_key", F.element_at("members", 1).alias("left_id"), F.explode("members").alias("right_id")).where("left_id < right_id")
    else:
        # the least member comes with the keys of large blocks; rows are joined by key, so AQE may split a hot one
        least = large.select("block_type", "block_key", F.element_at("members", 1).alias("left_id"))
        star = evidence.select("block_type", "block_key", F.col("member_id").alias("right_id")).join(least, ["block_type", "block_key"]).select("block_type", "block_key", "left_id", "right_id").where("left_id < right_id")
    ready = made.where("status = 'READY' AND strength = 'IDENTITY_CAPABLE'")
    both = ready.select("block_type", "block_key", "members", F.posexplode("members").alias("at", "left_id"))
    every = both.select("block_type", "block_key", "left_id", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("right_id"))
    found = star.unionByName(every)
    return found.groupBy("left_id", "right_id").agg(F.sort_array(F.collect_set("block_type")).alias("block_types"))


def score(features: DataFrame) -> DataFrame:
    """``left_id, right_id, relation, feature, present`` to a confidence and a status for each pair and relation.

    Confidence is the weight of present supporting features in that of all assessed
    present ones, 0 without any. A hard contradiction rejects; an exact duplicate with all that is
    required is confirmed; anything else is for review.
    """
    spark = features.sparkSession
    rules = F.broadcast(spark.createDataFrame(RULES, "relation string, feature string, weight int, effect string, hard boolean, required boolean"))
    known = features.join(rules, ["relation", "feature"])
    here = F.col("present")
    total = known.groupBy("left_id", "right_id", "relation").agg(
        F.sum(F.when(here & (F.col("effect") == "S"), F.col("weight")).otherwise(0)).alias("supporting"),
        F.sum(F.when(here, F.col("weight")).otherwise(0)).alias("assessed"),
        F.bool_or(here & F.col("hard")).alias("rejected"),
        F.count_if(here & F.col("required")).alias("met"),
    )
    need = {r: sum(1 for x in RULES if x[0] == r and x[5]) for r, *_ in RULES}
    required = F.lit(0)
    for relation, n in need.items():
        required = F.when(F.col("relation") == relation, n).otherwise(required)
    confidence = F.when(F.col("assessed") > 0, F.col("supporting") / F.col("assessed")).otherwise(F.lit(0.0))
    status = F.when(F.col("rejected"), F.lit("REJECTED")).when((F.col("relation") == "EXACT_DUPLICATE") & (required > 0) & (F.col("met") >= required), F.lit("CONFIRMED")).otherwise(F.lit("REVIEW_REQUIRED"))
    return total.select("left_id", "right_id", "relation", "supporting", "assessed", confidence.alias("confidence"), status.alias("status"))


def accepted_resolutions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates that are AUTO_SAFE or whose latest decision, on the same evidence, is ACCEPT."""
    newest = decisions.groupBy("candidate_id").agg(F.max_by(F.struct("decision", "evidence_digest"), "sequence_no").alias("d")).select("candidate_id", F.col("d.decision").alias("decision"), F.col("d.evidence_digest").alias("seen_digest"))
    joined = candidates.join(newest, "candidate_id", "left")
    good = (F.col("disposition") == "AUTO_SAFE") | ((F.col("decision") == "ACCEPT") & (F.col("seen_digest") == F.col("evidence_digest")))
    return joined.where(F.coalesce(good, F.lit(False))).drop("decision", "seen_digest")

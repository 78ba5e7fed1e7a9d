"""Inventory and collection reports: duplicates, variants, hash candidates, review lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.functions.scalars import parts_digest
from veritome.operators.relational import consistent_value

# Review priority by severity; others aren't listed.
PRIORITY = (("ERROR", 0), ("FAILED", 1), ("ACTION_REQUIRED", 2), ("PARTIAL_FAILURE", 3), ("INCOMPLETE", 4), ("WARNING", 5), ("REVIEW", 6))


def duplicate_groups(members: DataFrame, value: str, member: str, size: str) -> DataFrame:
    """``value, group_id, member_count, total_bytes, redundant_bytes`` for values of two members or more; redundant is all but the largest."""
    grouped = members.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(member).alias("member_count"), F.sum(size).alias("total_bytes"), F.max(size).alias("max__"))
    return grouped.where("member_count > 1").select(value, parts_digest("duplicate-group/v1", F.col(value)).alias("group_id"), "member_count", "total_bytes", F.greatest(F.lit(0), F.col("total_bytes") - F.col("max__")).alias("redundant_bytes"))


def largest_groups(groups: DataFrame, k: int) -> DataFrame:
    """The ``k`` groups with most redundant bytes, then most members; among equals the larger id is kept."""
    return groups.orderBy(F.desc("redundant_bytes"), F.desc("member_count"), F.desc("group_id")).limit(k)


def most_members(groups: DataFrame, k: int) -> DataFrame:
    """The ``k`` groups with most members; among equals the smaller id is kept."""
    return groups.orderBy(F.desc("member_count"), "group_id").limit(k)


def group_members(members: DataFrame, value: str, least: int = 2) -> DataFrame:
    """Members whose value stands at least ``least`` times: counts are taken first, so a hot value is never in one task."""
    counts = members.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    return members.join(counts, value)


def content_variants(members: DataFrame, text: str, file: str) -> DataFrame:
    """Texts shared by files of two different contents or more."""
    grouped = members.where(F.col(text).isNotNull() & F.col(file).isNotNull()).groupBy(text).agg(F.count("*").alias("member_count"), F.countDistinct(file).alias("file_versions"))
    return grouped.where("file_versions > 1")


def hash_candidates(quick: DataFrame, full: DataFrame) -> DataFrame:
    """Targets whose only quick fingerprint collides with another's and which have no full one yet, with the size of their group."""
    agreed = consistent_value(quick, ["target_id"], "value")
    collide = agreed.groupBy("value").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return agreed.join(collide, "value").join(full.select("target_id").distinct(), "target_id", "left_anti")


def review_list(items: DataFrame, k: int) -> DataFrame:
    """The first ``k`` items by priority of status, then id."""
    rank = F.lit(99)
    for word, n in PRIORITY:
        rank = F.when(F.col("status") == word, n).otherwise(rank)
    return items.withColumn("priority", rank).where("priority < 99").orderBy("priority", "item_id").limit(k)


def counter_mismatches(children: DataFrame, stored: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Keys whose stored counter isn't the number of their children."""
    counted = children.groupBy(*keys).agg(F.count("*").alias("counted"))
    return stored.join(counted, keys, "left").withColumn("counted", F.coalesce("counted", F.lit(0))).where(F.col(counter) != F.col("counted"))


def literal_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``name, value, n`` of several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.name", "p.value").agg(F.count("*").alias("n"))

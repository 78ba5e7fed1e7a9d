"""Pairwise comparison, quality findings, keep preference and classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many values a dimension may hold.
CARDINALITY = (("DOMAIN", 1), ("GENRE", 8), ("SUBGENRE", 16), ("TOPIC", 32), ("AUDIENCE", 4), ("LANGUAGE", 8), ("FORM", 4))
SHORT_TEXT = 2000


def equal_state(left: Column, right: Column) -> Column:
    """SAME or DIFFERENT, INDETERMINATE if a side is missing: no evidence isn't evidence against."""
    return F.when(left.isNull() | right.isNull(), F.lit("INDETERMINATE")).when(left == right, F.lit("SAME")).otherwise(F.lit("DIFFERENT"))


def metadata_state(left: Column, right: Column) -> Column:
    """Of two maps from field to sorted values, over the fields of both; INDETERMINATE without any."""
    both = F.array_intersect(F.map_keys(left), F.map_keys(right))
    unequal = F.exists(both, lambda k: F.element_at(left, k) != F.element_at(right, k))
    return F.when(left.isNull() | right.isNull() | (F.size(both) == 0), F.lit("INDETERMINATE")).when(unequal, F.lit("DIFFERENT")).otherwise(F.lit("SAME"))


def overall_coverage(*states: Column) -> Column:
    known = sum((F.when(s.isin("SAME", "DIFFERENT"), 1).otherwise(0) for s in states), F.lit(0))
    return F.when(known == len(states), F.lit("COMPLETE")).when(known > 0, F.lit("PARTIAL")).otherwise(F.lit("NONE"))


def compare(pairs: DataFrame, facts: DataFrame, key: str, dimensions: dict[str, str]) -> DataFrame:
    """For ``left_id, right_id`` the state of each dimension (a column of ``facts``) and the coverage of all."""
    left = facts.select(F.col(key).alias("left_id"), *(F.col(c).alias(f"l_{d}") for d, c in dimensions.items()))
    right = facts.select(F.col(key).alias("right_id"), *(F.col(c).alias(f"r_{d}") for d, c in dimensions.items()))
    joined = pairs.join(left, "left_id", "left").join(right, "right_id", "left")
    states = {d: equal_state(F.col(f"l_{d}"), F.col(f"r_{d}")) for d in dimensions}
    return joined.select("left_id", "right_id", *(s.alias(d.lower()) for d, s in states.items()), overall_coverage(*states.values()).alias("coverage"))


def quality_findings(facts: DataFrame) -> DataFrame:
    """``item_id, dimension, code, severity`` from title, author, language, identifier, text length, cover and fatal or error counts."""
    def when(condition: Column, dimension: str, code: str, severity: str) -> Column:
        return F.when(condition, F.struct(F.lit(dimension).alias("dimension"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    rules = F.array(
        when(F.col("title").isNull(), "METADATA", "METADATA_TITLE_MISSING", "WARNING"),
        when(F.col("author").isNull(), "METADATA", "METADATA_AUTHOR_MISSING", "WARNING"),
        when(F.col("language").isNull(), "METADATA", "METADATA_LANGUAGE_MISSING", "INFO"),
        when(F.col("identifier").isNull(), "METADATA", "METADATA_IDENTIFIER_MISSING", "INFO"),
        when(F.col("text_chars").isNull(), "TEXT", "TEXT_EVIDENCE_INCOMPLETE", "WARNING"),
        when(F.col("text_chars") == 0, "TEXT", "TEXT_NOT_AVAILABLE", "ERROR"),
        when((F.col("text_chars") > 0) & (F.col("text_chars") < SHORT_TEXT), "TEXT", "TEXT_VERY_SHORT", "WARNING"),
        when(~F.col("has_cover"), "COVER", "COVER_MISSING", "WARNING"),
        when(F.col("fatal") > 0, "STRUCTURE", "EPUB_FATAL_ERRORS", "ERROR"),
        when((F.col("fatal") == 0) & (F.col("errors") > 0), "STRUCTURE", "EPUB_VALIDATION_ERRORS", "ERROR"),
        when(F.col("fatal").isNull(), "STRUCTURE", "STRUCTURAL_VALIDATION_UNAVAILABLE", "INFO"),
    )
    return facts.select("item_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("f")).select("item_id", "f.*")


def quality_status(findings: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, status``: ACTION_REQUIRED for an error, INCOMPLETE without evidence, REVIEW for a warning, else OK."""
    rank = F.when(F.col("severity") == "ERROR", 3).when(F.col("code").rlike("INCOMPLETE|UNAVAILABLE"), 2).when(F.col("severity") == "WARNING", 1).otherwise(0)
    worst = findings.groupBy("item_id").agg(F.max(rank).alias("r"))
    named = F.element_at(F.array(*(F.lit(x) for x in ("OK", "REVIEW", "INCOMPLETE", "ACTION_REQUIRED"))), F.coalesce("r", F.lit(0)) + 1)
    return items.join(worst, "item_id", "left").select("item_id", named.alias("status"))


def keep_preference(candidates: DataFrame, size: str = "DISABLED", formats: Sequence[str] = ()) -> DataFrame:
    """One row for each group: the file to keep, and why.

    candidates: group_id, file_id, incomplete, action_required, review (counts), format,
    size_bytes, blocked. Fewer incomplete dimensions win, then fewer that require action, then
    fewer to review, then the format by its place in ``formats`` (those not in it come last and are equal), then the size if a policy says so; equals are TIED. A blocked file blocks its group.
    """
    rank = F.lit(len(formats))
    for n, name in enumerate(formats):
        rank = F.when(F.col("format") == name, n).otherwise(rank)
    by_size = {"DISABLED": F.lit(0), "PREFER_SMALLER": F.col("size_bytes"), "PREFER_LARGER": -F.col("size_bytes")}[size].cast("long")
    # equal ranks are counted first, then each class of counts and format keeps its least; a group has few classes, as it has five dimensions
    counts = {"a": "incomplete", "b": "action_required", "c": "review"}
    ranked = candidates.select("group_id", "file_id", "blocked", *(F.col(c).cast("long").alias(k) for k, c in counts.items()), rank.cast("long").alias("d"), by_size.alias("e"))
    equal = ranked.groupBy("group_id", "a", "b", "c", "d", "e").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id"), F.bool_or("blocked").alias("blocked"))
    least = F.struct(F.struct("e").alias("size"), "n", "file_id")
    classes = equal.groupBy("group_id", "a", "b", "c", "d").agg(F.min(least).alias("least"), F.max(F.struct("e")).alias("most"), F.bool_or("blocked").alias("blocked"))
    told = classes.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "c", "d", "least", "most"))).alias("every"), F.bool_or("blocked").alias("blocked"))
    best, alone = F.get("every", F.lit(0)), F.get("every", F.lit(0))["least"]["size"] == F.get("every", F.lit(0))["most"]
    told = told.select("group_id", "blocked", best.alias("best"), F.when(alone, F.get("every", F.lit(1))).otherwise(best).alias("second"))
    told = told.withColumn("n_best", F.col("best.least.n")).withColumn("file_id", F.col("best.least.file_id"))
    reason = (
        F.when(F.col("best.a") != F.col("second.a"), F.lit("FEWER_INCOMPLETE_DIMENSIONS"))
        .when(F.col("best.b") != F.col("second.b"), F.lit("FEWER_ACTION_REQUIRED_DIMENSIONS"))
        .when(F.col("best.c") != F.col("second.c"), F.lit("FEWER_REVIEW_DIMENSIONS"))
        .when(F.col("best.d") != F.col("second.d"), F.lit("PREFERRED_FORMAT"))
        .otherwise(F.lit("SIZE_TIE_BREAKER"))
    )
    status = F.when(F.col("blocked"), F.lit("BLOCKED")).when((F.col("n_best") > 1) | F.col("second").isNull(), F.lit("TIED")).otherwise(F.lit("PREFERRED"))
    why = F.when(status == "BLOCKED", F.lit("HARD_CONSTRAINT")).when(status == "TIED", F.lit("TIED")).otherwise(reason)
    return told.select("group_id", status.alias("status"), why.alias("reason"), F.when(status == "PREFERRED", F.col("file_id")).alias("file_id"))


def project_classification(assertions: DataFrame) -> DataFrame:
    """``subject_id, dimension, status, values`` from ``subject_id, dimension, value, tier``.

    What users confirmed beats what was automated. Two values of an exclusive dimension, or more than it
    may hold, conflict and project nothing.
    """
    rank = F.when(F.col("tier") == "USER_CONFIRMED", 1).otherwise(0)
    w = Window.partitionBy("subject_id", "dimension")
    top = assertions.withColumn("r", rank).withColumn("best", F.max("r").over(w)).where("r = best")
    sets = top.groupBy("subject_id", "dimension").agg(F.sort_array(F.collect_set("value")).alias("values"))
    limit = F.lit(0)
    for name, n in CARDINALITY:
        limit = F.when(F.col("dimension") == name, n).otherwise(limit)
    status = F.when(F.size("values") > limit, F.lit("CONFLICT")).otherwise(F.lit("PROJECTED"))
    return sets.select("subject_id", "dimension", status.alias("status"), F.when(F.size("values") <= limit, F.col("values")).otherwise(F.array().cast("array<string>")).alias("values"))


def grouped_metadata(facts: DataFrame) -> DataFrame:
    """Dotted keys ``kind.index.part`` to one row for each kind and index with a map from part to its sorted values."""
    bits = F.split("key", r"\.")
    split = facts.where("key rlike '^[a-z]+[.][0-9]+[.][a-z]+$'").select("item_id", F.get(bits, 0).alias("kind"), F.get(bits, 1).cast("int").alias("place"), F.get(bits, 2).alias("part"), "value")
    part = split.groupBy("item_id", "kind", "place", "part").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return part.groupBy("item_id", "kind", "place").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", "values")))).alias("parts"))

"""Names and titles as candidates of authorities, file names as metadata, and what providers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.functions.scalars import file_stem, parent_path
from veritome.functions.unicode import credited_as, parenthesised, title_alias, without_annotations

# Confidence of what a file's name and its folder tell.
NAME_CONFIDENCE, FOLDER_CONFIDENCE = 0.2, 0.1
# File name patterns, first match wins.
NAME_PROFILES = (
    ("author-title-year", r"^(?<author>[^-]+?) - (?<title>.+?) \((?<year>[0-9]{4})\)$"),
    ("series-number-title", r"^(?<series>.+?) (?<number>[0-9]{1,3}) - (?<title>.+)$"),
    ("author-title", r"^(?<author>[^-]+?) - (?<title>.+)$"),
)


def name_candidates(names: DataFrame, key: str, name: str) -> DataFrame:
    """``key, kind, value``: a name as given, without annotations, what it is credited as, and what stands in brackets; each value once, of the first kind that gives it."""
    told = F.array(
        F.struct(F.lit(0).alias("rank"), F.lit("CANONICAL").alias("kind"), without_annotations(F.col(name)).alias("value")),
        F.struct(F.lit(1).alias("rank"), F.lit("CREDITED_AS").alias("kind"), credited_as(F.col(name)).alias("value")),
        F.struct(F.lit(2).alias("rank"), F.lit("ALIAS").alias("kind"), parenthesised(F.col(name)).alias("value")),
    )
    each = names.select(key, F.explode(told).alias("c")).select(key, "c.*").where("value is not null and value <> ''")
    return each.groupBy(key, "value").agg(F.min_by("kind", "rank").alias("kind"))


def title_candidates(titles: DataFrame, key: str, title: str) -> DataFrame:
    """``key, kind, value``: the title without annotations, and without its leading article if that differs."""
    plain = without_annotations(F.col(title))
    told = F.array(F.struct(F.lit("CANONICAL").alias("kind"), plain.alias("value")), F.when(title_alias(plain) != plain, F.struct(F.lit("ALIAS").alias("kind"), title_alias(plain).alias("value"))))
    return titles.select(key, F.explode(F.filter(told, lambda x: x.isNotNull())).alias("c")).select(key, "c.*")


def parsed_name(path: Column) -> Column:
    """Struct of the first profile that a file's stem matches and the parts that it names; null if none does."""
    stem = file_stem(path)
    found = F.lit(None).cast("struct<profile:string,author:string,title:string,series:string,number:string,year:string>")
    for profile, pattern in reversed(NAME_PROFILES):
        groups = [g.split(">")[0] for g in pattern.split("(?<")[1:]]
        part = {g: F.regexp_extract(stem, pattern, i + 1) for i, g in enumerate(groups)}
        made = F.struct(F.lit(profile).alias("profile"), *(part.get(g, F.lit(None).cast("string")).alias(g) for g in ("author", "title", "series", "number", "year")))
        found = F.when(stem.rlike(pattern), made).otherwise(found)
    return found


def path_evidence(files: DataFrame, key: str, path: str) -> DataFrame:
    """``key, source, value, confidence`` of a file's stem and of its folder's name."""
    folder = F.regexp_extract(parent_path(F.col(path)), "([^/]*)$", 1)
    told = F.array(F.struct(F.lit("FILE_NAME").alias("source"), file_stem(F.col(path)).alias("value"), F.lit(NAME_CONFIDENCE).alias("confidence")), F.struct(F.lit("FOLDER_NAME").alias("source"), folder.alias("value"), F.lit(FOLDER_CONFIDENCE).alias("confidence")))
    return files.select(key, F.explode(told).alias("c")).select(key, "c.*").where("value <> ''")


def smallest_payload(records: DataFrame, key: str) -> DataFrame:
    """Of records with equal keys the one whose JSON is smallest: a choice that doesn't depend on order."""
    body = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    return records.groupBy(key).agg(F.min_by(F.struct("*"), body).alias("row")).select("row.*")


def cache_decision(entries: DataFrame, now: Column, read_only: bool = False) -> DataFrame:
    """Adds ``decision``: USE a fresh entry, WAIT while a provider asked for it, SERVE_STALE or REFRESH a stale one, FETCH or give NOTHING for an expired or missing one."""
    fresh = F.col("fresh_until").isNotNull() & (now < F.col("fresh_until"))
    stale = F.col("expires_at").isNotNull() & (now < F.col("expires_at"))
    waiting = F.col("retry_after").isNotNull() & (now < F.col("retry_after"))
    decision = (
        F.when(fresh, F.lit("USE"))
        .when(stale & (waiting | F.lit(read_only)), F.lit("SERVE_STALE"))
        .when(waiting, F.lit("WAIT"))
        .when(stale, F.lit("REFRESH"))
        .otherwise(F.lit("NOTHING") if read_only else F.lit("FETCH"))
    )
    return entries.withColumn("decision", decision)


def pruned_cache(entries: DataFrame, now: Column, capacity: int) -> DataFrame:
    """Entries that haven't expired; more bytes than the capacity raise."""
    kept = entries.where(now < F.col("expires_at"))
    total = kept.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]
    if total > capacity:
        raise ValueError(f"cache holds {total} bytes; {capacity} are allowed")
    return kept

"""A matching run: block keys of seven types from resolved evidence, cases of blocks, and what of them is new.

A run over evidence that it has seen before appends nothing: a case is known by its relation, its ends, its evidence and its
block's set of cases, and a decision on exactly that is carried over.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.operators.matching import PAIRWISE, accepted_resolutions, blocks
from veritome.operators.relational import dense_ordinals, reusable_decision

Tables = Mapping[str, DataFrame]

# The profile of whole-file fingerprints, the kind of text ones, entities whose resolutions are keys, and the relation and feature of each type of block that makes cases.
WHOLE_FILE = ("FILE_SHA256", "sha256", "v1")
TEXT_KIND = "EBOOK_NORMALIZED_TEXT"
RESOLVED = (("RESOLVED_EDITION", "EDITION"), ("RESOLVED_WORK", "WORK"), ("SERIES_CONTEXT", "SERIES"))
CASES = (("FILE_SHA256", "FILE", "EXACT_DUPLICATE", "FILE_SHA256_EQUAL", "CONFIRMED"), ("EDITION_IDENTIFIER", "EDITION", "SAME_EDITION", "EDITION_IDENTIFIER_COMPATIBLE", "REVIEW_REQUIRED"), ("AGENT_TITLE", "WORK", "SAME_WORK", "TITLE_COMPATIBLE", "REVIEW_REQUIRED"))
#: What a case is known by.
IDENTITY = ("relation", "left_id", "right_id", "evidence_fingerprint", "candidate_set_fingerprint")


def _key(*parts: Column) -> Column:
    return F.to_json(F.array(*(p.cast("string") for p in parts)))


def resolved(t: Tables) -> DataFrame:
    """``observation_id, file_id, candidate_kind, entity_id, candidate_id``: accepted resolutions about a current observation or its file, each way an equi-join."""
    good = accepted_resolutions(t["resolution_candidates"].withColumnRenamed("id", "candidate_id"), t["decisions"]).select("candidate_id", "subject_kind", F.col("subject_id").cast("string").alias("subject_id"), "candidate_kind", F.col("candidate_entity_id").cast("string").alias("entity_id"))
    now = t["current"].select("observation_id", "file_id")
    subjects = now.select("*", F.lit("FILE_OBSERVATION").alias("subject_kind"), F.col("observation_id").cast("string").alias("subject_id")).unionByName(now.select("*", F.lit("FILE").alias("subject_kind"), F.col("file_id").cast("string").alias("subject_id")))
    return subjects.join(good, ["subject_kind", "subject_id"]).select("observation_id", "file_id", "candidate_kind", "entity_id", "candidate_id").distinct()


def block_keys(t: Tables, evidence: bool = True) -> DataFrame:
    """``block_type, block_key, observation_id, file_id, entity_id, evidence_id``: every key of every current observation, with what it rests on.

    Without ``evidence`` each key of an observation and entity stands once, which is what ``cases`` needs: a work of m titles that all say the
    same and n observations makes n rows in place of n times m.

    t: current (observation_id, file_id), fingerprints, resolution_candidates, decisions, identifiers, contributions, assertions.
    A fingerprint counts where all of its profile agree; resolutions where they are safe or accepted on the same evidence.
    Null values make no key.
    """
    held = ("entity_id", "block_key", "evidence_id") if evidence else ("entity_id", "block_key")
    now = t["current"].select("observation_id", "file_id")
    prints = t["fingerprints"].where("target_kind = 'FILE_OBSERVATION' and value is not null").withColumnRenamed("target_id", "observation_id")
    agreed = prints.groupBy("observation_id", "kind", "algorithm", "algorithm_version").agg(F.min("value").alias("value"), F.max("value").alias("other"), F.min("id").alias("evidence_id")).where("value = other")
    whole = (F.col("kind") == WHOLE_FILE[0]) & (F.col("algorithm") == WHOLE_FILE[1]) & (F.col("algorithm_version") == WHOLE_FILE[2])
    kind = F.when(whole, "FILE_SHA256").when(F.col("kind") == TEXT_KIND, "TEXT_FINGERPRINT")
    key = F.when(whole, _key(F.col("value"))).otherwise(_key(F.col("algorithm"), F.col("algorithm_version"), F.col("value")))
    found = [now.join(agreed.withColumn("block_type", kind).where("block_type is not null").withColumn("block_key", key), "observation_id").select("block_type", "block_key", "observation_id", "file_id", F.lit(None).cast("string").alias("entity_id"), F.col("evidence_id").cast("string").alias("evidence_id"))]
    known = resolved(t)
    if not evidence:
        known = known.drop("candidate_id").distinct()
    ends = ["observation_id", "file_id", "entity_id"]
    for block_type, entity in RESOLVED:
        found.append(known.where(F.col("candidate_kind") == entity).select(F.lit(block_type).alias("block_type"), _key(F.col("entity_id")).alias("block_key"), *ends, *([F.col("candidate_id").cast("string").alias("evidence_id")] if evidence else [])))
    names = t["identifiers"].where("target_kind = 'EDITION' and value is not null").select(F.col("target_id").cast("string").alias("entity_id"), _key(F.col("namespace"), F.col("value")).alias("block_key"), F.col("id").cast("string").alias("evidence_id")).select(*held).distinct()
    found.append(known.where("candidate_kind = 'EDITION'").join(names, "entity_id").select(F.lit("EDITION_IDENTIFIER").alias("block_type"), "block_key", *ends, *held[2:]))
    authors = t["contributions"].where("target_kind = 'WORK' and lower(role) = 'author' and agent_id is not null").select(F.col("target_id").cast("string").alias("entity_id"), "agent_id").distinct()
    titles = t["assertions"].where("target_kind = 'WORK' and field_name = 'work.title.normalized' and value is not null").select(F.col("target_id").cast("string").alias("entity_id"), "value", F.col("id").cast("string").alias("evidence_id"))
    if not evidence:
        titles = titles.drop("evidence_id").distinct()
    works = authors.join(titles, "entity_id").select("entity_id", _key(F.col("agent_id"), F.col("value")).alias("block_key"), *held[2:])
    found.append(known.where("candidate_kind = 'WORK'").join(works, "entity_id").select(F.lit("AGENT_TITLE").alias("block_type"), "block_key", *ends, *held[2:]))
    every = reduce(DataFrame.unionByName, (f if evidence else f.drop("evidence_id") for f in found))
    return every.distinct()


def key_blocks(keys: DataFrame) -> DataFrame:
    """Blocks of observations by their keys, as ``matching.blocks`` gives them."""
    return blocks(keys.select("block_type", "block_key", F.col("observation_id").alias("member_id")))


def cases(keys: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """``relation, end_kind, left_id, right_id, feature, status, block_type, evidence_fingerprint, candidate_set_fingerprint``.

    Ends are files of exact copies, editions of one identifier, works of one author and title; a block without two
    observations makes none. Exact copies, and blocks of more than ``pairwise`` ends, meet through their least end; others
    in all pairs. The same pair from several blocks is several cases, by their evidence.
    """
    kinds = {b: (k, r, f, s) for b, k, r, f, s in CASES}
    of = lambda i: F.coalesce(*(F.when(F.col("block_type") == b, F.lit(x[i])) for b, x in kinds.items()))
    mine = keys.where(F.col("block_type").isin(*kinds))
    full = mine.groupBy("block_type", "block_key").agg(F.min("observation_id").alias("low"), F.max("observation_id").alias("high")).where("low < high").select("block_type", "block_key")
    end = F.when(F.col("block_type") == "FILE_SHA256", F.col("file_id").cast("string")).otherwise(F.col("entity_id"))
    ends = mine.join(full, ["block_type", "block_key"], "left_semi").select("block_type", "block_key", end.alias("end")).distinct()
    sizes = ends.groupBy("block_type", "block_key").agg(F.count("*").alias("n"), F.min("end").alias("least")).where("n > 1")
    star = (F.col("block_type") == "FILE_SHA256") | (F.col("n") > pairwise)
    told = ends.join(sizes.withColumn("star", star), ["block_type", "block_key"])
    small = told.where("not star").groupBy("block_type", "block_key").agg(F.collect_list("end").alias("every"))
    # one join for both, not a union of two: in Spark 4.1 a union of these, spread by the same keys, counted as spread by them but had the partitions of both, and the shuffled join with the sets failed ("Can't zip RDDs")
    each = told.join(small, ["block_type", "block_key"], "left").select("block_type", "block_key", F.explode(F.when(F.col("star"), F.array("least")).otherwise(F.col("every"))).alias("left_id"), F.col("end").alias("right_id")).where("left_id < right_id")
    found = each.select(of(1).alias("relation"), of(0).alias("end_kind"), "left_id", "right_id", of(2).alias("feature"), of(3).alias("status"), "block_type", "block_key")
    found = found.withColumn("evidence_fingerprint", F.sha2(_key(F.col("relation"), F.col("left_id"), F.col("right_id"), F.col("feature"), F.col("block_key")), 256))
    # the set of a block's cases by sums of their digests: whatever their order, and combined before the shuffle
    sums = [F.sum(F.conv(F.substring("evidence_fingerprint", 8 * i + 1, 8), 16, 10).cast("long")).cast("string") for i in range(8)]
    sets = found.groupBy("block_type", "block_key").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("candidate_set_fingerprint"))
    return found.join(sets, ["block_type", "block_key"]).drop("block_key")


def run(found: DataFrame, stored: DataFrame, decisions: DataFrame, queued: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a run appends: candidates not stored yet, decisions it reuses, and new rows of the review queue with an ``ordinal`` after those there.

    found: ``cases``. stored: IDENTITY. decisions: IDENTITY, decided_at, sequence_no, decision_id, decision; the latest counts,
    and a DEFER doesn't. queued: IDENTITY, ordinal. Confirmed cases need no review.
    """
    keys = list(IDENTITY)
    new = found.join(stored.select(*keys), keys, "left_anti")
    open_ = found.where("status = 'REVIEW_REQUIRED'")
    reused = reusable_decision(decisions, open_, keys)
    waiting = open_.join(reused.select(*keys), keys, "left_anti").join(queued.select(*keys), keys, "left_anti")
    last = queued.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).cast("long")).first()[0]
    rows = dense_ordinals(waiting, keys).withColumn("ordinal", F.col("ordinal") + last)
    return new, reused, rows

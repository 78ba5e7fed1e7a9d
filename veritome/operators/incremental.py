"""Incremental scans: change states, absences, and files that moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.functions.scalars import change_state, deletion_confirmed, path_change
from veritome.operators.relational import dealt

# Evidence that a moved file is the same, best first.
EVIDENCE = (("FILE_SHA256", 2), ("QUICK_FILE", 1))


def reconcile(records: DataFrame, discovered: DataFrame, now, completed: bool = True) -> DataFrame:
    """The state of every known or found file after a scan, and what changed.

    records: relative_path, size_bytes, modified_at, presence_state, missing_since_at,
    misses. discovered: relative_path, size_bytes, modified_at. Absence counts only after a
    complete scan; a record then missing often and long enough is DELETED.
    """
    old = records.select("relative_path", F.col("size_bytes").alias("old_size"), F.col("modified_at").alias("old_at"), F.col("presence_state").alias("old_presence"), F.col("missing_since_at").alias("old_since"), F.col("misses").alias("old_misses"))
    new = discovered.select("relative_path", "size_bytes", "modified_at", F.lit(True).alias("found"))
    both = old.join(new, "relative_path", "full_outer")
    found = F.coalesce("found", F.lit(False))
    gone = ~found & F.lit(completed) & (F.col("old_presence") != "DELETED")
    misses = F.when(found, 0).when(gone, F.coalesce("old_misses", F.lit(0)) + 1).otherwise(F.col("old_misses"))
    since = F.when(found, F.lit(None)).when(gone, F.coalesce("old_since", F.lit(now))).otherwise(F.col("old_since"))
    step = both.withColumns({"misses": misses, "missing_since_at": since, "found": found, "gone": gone})
    deleted = F.col("gone") & deletion_confirmed(F.col("misses"), F.col("missing_since_at"), F.lit(now))
    event = (
        F.when(F.col("found"), change_state(F.col("old_presence"), F.col("old_size") == F.col("size_bytes"), F.col("old_at") == F.col("modified_at")))
        .when(deleted, F.lit("DELETED"))
        .when(F.col("gone") & (F.col("old_presence") == "PRESENT"), F.lit("MISSING"))
    )
    presence = F.when(F.col("found"), F.lit("PRESENT")).when(deleted, F.lit("DELETED")).when(F.col("gone"), F.lit("MISSING")).otherwise(F.col("old_presence"))
    return step.select("relative_path", F.coalesce("size_bytes", "old_size").alias("size_bytes"), F.coalesce("modified_at", "old_at").alias("modified_at"), presence.alias("presence_state"), "missing_since_at", "misses", event.alias("change_state"))


def relocations(missing: DataFrame, new: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Pairs of a missing and a new file whose evidence is unambiguous, by the best kind of evidence.

    missing, new: file_id, relative_path. fingerprints: file_id, kind, value. A value counts
    only if one missing and one new file have it; a pair is told once.
    """
    rank = F.lit(0)
    for kind, n in EVIDENCE:
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    known = fingerprints.select("file_id", "kind", "value").distinct().withColumn("rank", rank).where("rank > 0")
    # at most one of each side: two minima and maxima, no self-join of a hot value
    sides = known.join(missing.select("file_id", F.lit("S").alias("side")).unionByName(new.select("file_id", F.lit("T").alias("side"))), "file_id")
    one = F.when(F.col("side") == "S", F.col("file_id"))
    two = F.when(F.col("side") == "T", F.col("file_id"))
    single = sides.groupBy("kind", "rank", "value").agg(F.min(one).alias("source_id"), F.max(one).alias("s"), F.min(two).alias("target_id"), F.max(two).alias("t")).where("source_id = s AND target_id = t")
    best = single.groupBy("source_id", "target_id").agg(F.max_by(F.struct("kind", "value"), F.struct("rank", "value")).alias("e"))
    named = best.join(missing.select(F.col("file_id").alias("source_id"), F.col("relative_path").alias("before")), "source_id").join(new.select(F.col("file_id").alias("target_id"), F.col("relative_path").alias("after")), "target_id")
    return named.select("source_id", "target_id", F.col("e.kind").alias("evidence"), F.col("e.value").alias("value"), path_change(F.col("before"), F.col("after")).alias("change"))


def lineage(runs: DataFrame, rounds: int = 40) -> DataFrame:
    """``run_id, first_run, resumptions`` from ``run_id, resumed_from``: where a chain of resumed runs began, and how many resumptions lie between.

    Ways double in each round, so a chain of n runs takes log n joins. A run that is resumed from an unknown one begins its
    own chain. A circle, which no chain of at most 2^rounds runs is, raises. Every round is written to the shared folder.
    """
    from veritome.sources.shared import new_path

    spark = runs.sparkSession
    known = runs.select(F.col("run_id").alias("parent"))
    way = runs.select("run_id", F.col("resumed_from").alias("parent")).join(known.withColumn("known", F.lit(True)), "parent", "left")
    way = way.select("run_id", F.when(F.col("known"), F.col("parent")).alias("next"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"), F.when(F.col("known"), F.col("parent")).otherwise(F.col("run_id")).alias("first_run"))
    with dealt(spark, runs.count()):
        for _ in range(rounds):
            path = new_path(spark, "lineage")
            way.write.parquet(path)
            way = spark.read.parquet(path)
            if way.where("next is not null").isEmpty():
                return way.select("run_id", "first_run", F.col("steps").alias("resumptions"))
            on = way.select(F.col("run_id").alias("next"), F.col("next").alias("after"), F.col("steps").alias("more"), F.col("first_run").alias("first"))
            way = way.join(on, "next", "left").select("run_id", F.col("after").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("first", "first_run").alias("first_run"))
    raise ValueError("runs resume each other in a circle")

"""Relational building blocks: latest rows, consistent values, vocabularies, bounded lists, pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a task, and megabytes of a shuffle that a task reads, where what is shuffled follows the rows.
PER_TASK, READ_MB = 250_000, 8


@contextmanager
def dealt(spark: SparkSession, rows: int, per_task: int = PER_TASK) -> Iterator[None]:
    """While it lasts, Spark's shuffles go to a task for each ``per_task`` of ``rows``, or to as many as before if those are more.

    What a task sorts or sums up then doesn't grow with the table. It holds for what is written meanwhile, not for frames that
    are read later. AQE still joins small parts, up to READ_MB, and splits hot ones. The session's settings come back.
    """
    wanted = {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{READ_MB}m"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key, by one aggregate that combines before the shuffle."""
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("row"))
    return picked.select("row.*")


def latest_by_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The same by ``row_number() = 1``, for orders that mix directions."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("n__", n).where("n__ = 1").drop("n__")


def consistent_value(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value`` where all values of a key agree; keys in conflict are left out, not decided."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("max__")).where(F.col(value) == F.col("max__")).drop("max__")


def vocabulary_counts(rows: DataFrame, column: str, vocabulary: Sequence[str], default: str | None = None) -> DataFrame:
    """``ordinal, column, n`` for every word of the vocabulary in its order, zero where there are no rows. A word outside it raises."""
    spark = rows.sparkSession
    value = F.coalesce(F.col(column), F.lit(default)) if default is not None else F.col(column)
    counted = rows.groupBy(value.alias(column)).agg(F.count("*").alias("n"))
    words = F.broadcast(spark.createDataFrame(list(enumerate(vocabulary)), f"ordinal int, {column} string"))
    checked = counted.withColumn(column, F.when(F.col(column).isin(*vocabulary), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} outside its vocabulary: "), F.coalesce(F.col(column), F.lit("null"))))))
    return words.join(checked, column, "left").select("ordinal", column, F.coalesce("n", F.lit(0)).alias("n"))


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their place from 1; Spark keeps ``k`` a task before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", n).where(F.col("place") <= k)


def bounded_members(rows: DataFrame, keys: Sequence[str], member: str, k: int) -> DataFrame:
    """``keys, member_count, members`` with the first ``k`` members in order, the count of all, and whether any are left out."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("member_count"))
    # Spark cuts a filter on row_number to k rows for each task and key before the shuffle, so a hot key stays small
    ranked = rows.withColumn("n__", F.row_number().over(Window.partitionBy(*keys).orderBy(member))).where(F.col("n__") <= k)
    first = ranked.groupBy(*(F.col(c).alias(f"{c}__") for c in keys)).agg(F.sort_array(F.collect_list(member)).alias("members"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return counts.join(first, same).select(*keys, "member_count", "members", (F.col("member_count") > k).alias("truncated"))


def page(rows: DataFrame, order: Sequence[str], after: Sequence | None, limit: int) -> tuple[DataFrame, bool, tuple | None]:
    """A page after a key, whether more follow, and the key to go on from. One row more than the limit is looked at."""
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(x).alias(c) for c, x in zip(order, after, strict=True))))
    found = rows.orderBy(*order).limit(limit + 1)
    keys = [tuple(r) for r in found.select(*order).collect()]  # limit + 1 rows
    return found.limit(limit), len(keys) > limit, keys[limit - 1] if len(keys) > limit else None


def at_most(rows: DataFrame, limit: int, what: str) -> DataFrame:
    """``rows`` if there are no more than ``limit``; else an error, never a cut."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def current_observations(observations: DataFrame, records: DataFrame, run: str) -> DataFrame:
    """Observations of a run whose file is present and still has the path, size and time observed."""
    seen = observations.where(F.col("scan_run_id") == run)
    now = records.where((F.col("presence_state") == "PRESENT") & (F.col("media_type") == "EBOOK")).select("file_id", F.col("relative_path").alias("path__"), F.col("size_bytes").alias("size__"), F.col("modified_at").alias("at__"))
    same = (F.col("relative_path") == F.col("path__")) & (F.col("size_bytes") == F.col("size__")) & (F.col("modified_at") == F.col("at__"))
    return seen.join(now, "file_id").where(same).drop("path__", "size__", "at__")


def stacked_subjects(current: DataFrame) -> DataFrame:
    """Each current observation as subject under its own id and under its file's, so that evidence on either is found by one equi-join."""
    pairs = F.array(F.struct(F.lit("FILE_OBSERVATION").alias("target_kind"), F.col("observation_id").alias("target_id")), F.struct(F.lit("FILE").alias("target_kind"), F.col("file_id").alias("target_id")))
    return current.select("observation_id", "file_id", F.explode(pairs).alias("s")).select("observation_id", "file_id", "s.target_kind", "s.target_id")


def reusable(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Of wanted steps those with an equal successful one: provider, capability, input, versions and configuration; a null configuration is never reused."""
    keys = ["provider", "capability", "input_id", "tool_version", "adapter_version", "config"]
    return wanted.join(done.where("status = 'SUCCEEDED'").select(*keys).distinct(), keys, "left_semi")


def reusable_decision(decisions: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest decision on exactly equal keys by time, sequence and id; DEFER gives none."""
    newest = latest(decisions, keys, ["decided_at", "sequence_no", "decision_id"]).where("decision <> 'DEFER'")
    return wanted.join(newest.select(*keys, "decision", "decision_id"), list(keys))


def dense_ordinals(rows: DataFrame, order: Sequence[str], held: list | None = None) -> DataFrame:
    """Contiguous ``ordinal`` from 0 in a total order without one task that sees all rows: a range sort, and each part's offset. The sorted rows stay persisted; ``held`` gets them, so that who calls can release them."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part__", F.spark_partition_id()).withColumn("in__", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    parts = parts.persist()  # one plan for both uses: another one would sample other range bounds
    if held is not None:
        held.append(parts)
    sizes = sorted((r["part__"], r["n"]) for r in parts.groupBy("part__").agg(F.count("*").alias("n")).collect())  # a row for each partition
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part__ int, before__ long"))
    return parts.join(before, "part__").withColumn("ordinal", F.col("before__") + F.col("in__")).drop("part__", "in__", "before__")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those of equal keys, and its new ones."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def create_or_get(existing: DataFrame, wanted: DataFrame, key: Sequence[str], digest: str = "digest") -> DataFrame:
    """The rows of ``wanted`` to append; equal ones exist already, and one with another digest raises."""
    before = existing.select(*key, F.col(digest).alias("before__"))
    joined = wanted.join(before, list(key), "left")
    clash = F.col("before__").isNotNull() & (F.col("before__") != F.col(digest))
    kept = joined.where(F.when(clash, F.raise_error(F.lit("conflicting material under an existing key"))).otherwise(F.col("before__").isNull()))
    return kept.drop("before__")


def ordered_digest(rows: DataFrame, order: Sequence[str], bits: Sequence[int] = (24, 12, 0)) -> DataFrame:
    """One digest over all rows whatever their partitioning: a tree of digests by the leading ``bits`` of the key's hash, each node over its parts in order.

    With 16 million leaves a leaf holds some 60,000 rows of 10^12, and a node 4,096 parts at most. The digest of no rows is that of an empty text.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"}), 256)
    key = F.to_json(F.struct(*order))
    level = rows.select(key.alias("k"), row.alias("d")).withColumn("h", F.shiftrightunsigned(F.xxhash64("k"), 64 - bits[0]))
    for here, above in zip(bits, (*bits[1:], None)):
        whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), ""), 256).alias("d")
        if above is None:
            return level.agg(whole).select(F.col("d").alias("digest"))
        level = level.groupBy("h").agg(whole).select(F.format_string("%08x", "h").alias("k"), "d", F.shiftrightunsigned("h", here - above).alias("h"))
    raise ValueError("bits must not be empty")

"""Tables in versions that are written once: a commit names the version it was made on and fails if another came first.

A version is a small file that says where its rows lie. It is created only if it isn't there, which the file system does
as one step, so of two writers one fails. Rows are written before, to a folder of their own: a task that runs twice, or a writer that
dies, leaves nothing that a reader sees.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veritome.sources.shared import file_system


class Conflict(RuntimeError):
    """Another version was committed first."""


class Refused(ValueError):
    """Rows that break a rule."""


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version; 0 without one."""
    at, store = file_system(spark, f"{path}/_versions")
    if not store.exists(at):
        return 0
    names = [str(x.getPath().getName()) for x in store.listStatus(at)]
    return max((int(n) for n in names if re.fullmatch("[0-9]{12}", n)), default=0)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, the last if none is named; None without any."""
    number = latest(spark, path) if version is None else version
    if not number:
        return None
    at, store = file_system(spark, f"{path}/_versions/{number:012}")
    stream = store.open(at)
    try:
        folder = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{path}/{folder}")


def commit(rows: DataFrame, path: str, expected: int, rules: Mapping[str, Column] | None = None) -> int:
    """Writes ``rows`` as the version after ``expected`` and returns its number; raises Conflict if that isn't the last one any more.

    rules: conditions that every row must meet, counted while the rows are written; rows that break one are never committed.
    """
    spark = rows.sparkSession
    if latest(spark, path) != expected:
        raise Conflict(f"version {expected} isn't the last one")
    folder = f"rows-{uuid.uuid4().hex}"
    try:
        write_checked(rows, f"{path}/{folder}", rules or {})
        at, store = file_system(spark, f"{path}/_versions/{expected + 1:012}")
        try:
            stream = store.create(at, False)
        except Exception as there:
            raise Conflict(f"version {expected + 1} is there already") from there
        stream.write(bytearray(folder.encode()))
        stream.close()
    except BaseException:
        drop(spark, f"{path}/{folder}")
        raise
    return expected + 1


def drop(spark: SparkSession, path: str) -> None:
    at, store = file_system(spark, path)
    store.delete(at, True)


def checks(rules: Mapping[str, Column]) -> list[Column]:
    """How many rows don't meet each rule; a rule that is null isn't met."""
    return [F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()]


def write_checked(rows: DataFrame, path: str, rules: Mapping[str, Column]) -> dict[str, int]:
    """Writes Parquet and counts in the same pass what breaks each rule; if anything does, the files go and it raises. Returns the number of rows."""
    seen = Observation("checks")
    rows.observe(seen, F.count(F.lit(1)).alias("rows__"), *checks(rules)).write.mode("errorifexists").parquet(path)
    told = dict(seen.get)
    n = told.pop("rows__", 0)
    if broken := {k: v for k, v in told.items() if v}:
        drop(rows.sparkSession, path)
        raise Refused(", ".join(f"{k}: {v} of {n} rows" for k, v in sorted(broken.items())))
    return {"rows": n}


def digest(column: str) -> Column:
    """A SHA-256 in lower-case hex."""
    return F.col(column).rlike("^[0-9a-f]{64}$")


def one_of(column: str, words: Sequence[str]) -> Column:
    return F.col(column).isin(*words)


def counter(column: str) -> Column:
    return F.col(column) >= 0


def replaced(entries: DataFrame, candidates: DataFrame, now: Column, most_entries: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """A cache after ``candidates`` replace entries of the generation they expect, and the candidates that came too late.

    entries: key, generation, payload, expires_at. candidates: key, expected_generation, payload, expires_at, one for a key. A
    new key expects 0. Expired entries go unless a candidate names them. More entries or bytes than allowed raise.
    """
    own = entries.select("key", "generation", F.col("payload").alias("old_payload"), F.col("expires_at").alias("old_expires_at"))
    met = own.join(candidates.withColumn("asked", F.lit(True)), "key", "full_outer")
    asked = F.coalesce("asked", F.lit(False))
    fits = asked & (F.col("expected_generation") == F.coalesce("generation", F.lit(0)))
    late = met.where(asked & ~fits).select("key", "expected_generation", F.coalesce("generation", F.lit(0)).alias("generation"))
    kept = met.where(fits | (F.col("generation").isNotNull() & (asked | (now < F.col("old_expires_at")))))
    after = kept.select("key", F.when(fits, F.col("expected_generation") + 1).otherwise(F.col("generation")).cast("long").alias("generation"), F.when(fits, F.col("payload")).otherwise(F.col("old_payload")).alias("payload"), F.when(fits, F.col("expires_at")).otherwise(F.col("old_expires_at")).alias("expires_at"))
    held, size = after.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
    if held > most_entries or size > most_bytes:
        raise Refused(f"{held} entries of {size} bytes; {most_entries} of {most_bytes} are allowed")
    return after, late

"""Reports and write-once tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.functions.scalars import guard_cell


def report_json(report: dict) -> tuple[str, str]:
    """The report as JSON with sorted keys and a final newline, and its SHA-256; a number that isn't finite raises."""
    text = json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"
    return text, hashlib.sha256(text.encode()).hexdigest()


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    guarded = rows.select(*(guard_cell(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes))
    guarded.write.option("header", True).csv(path)


def write_once(rows: DataFrame, path: str, digest: str) -> None:
    """A sealed partition; writing it again raises."""
    rows.withColumn("content_digest", F.lit(digest)).write.mode("errorifexists").partitionBy("content_digest").parquet(path)


def checksums(spark, path: str) -> DataFrame:
    """``name, sha256`` of the files below a path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def checksum_failures(spark, path: str, manifest: DataFrame) -> DataFrame:
    """Names of the manifest that are missing or differ."""
    now = checksums(spark, path).withColumnRenamed("sha256", "now")
    return manifest.join(now, "name", "left").where("now is null or now <> sha256").select("name")


def append_decision(log: DataFrame, decision: DataFrame) -> DataFrame:
    """The rows to append if each names the latest decision of its item (or none where there is none); else it raises."""
    newest = log.groupBy("item_id").agg(F.max_by("decision_id", "sequence_no").alias("latest"), F.max("sequence_no").alias("n"))
    joined = decision.join(newest, "item_id", "left")
    fine = F.col("expected_latest").eqNullSafe(F.col("latest"))
    kept = joined.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("another decision came first")).cast("boolean")))
    return kept.select("item_id", "decision_id", (F.coalesce("n", F.lit(0)) + 1).alias("sequence_no"), "decision")

"""Queries over the driver's tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, per_task: int = 250_000) -> DataFrame:
    """Rows that grow by what is made of them, dealt out by ``keys`` to a number of tasks that follows the cores and the rows: a file that is small would be one task."""
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_task))
    return rows.repartition(tasks, *keys)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the role of observed files."""
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".epub", ".MOBI", ".azw", ".azw3", ".pdf", ".txt", ""))), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/book"), F.col("doc_id").cast("string"), suffix)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("root"), path.alias("relative_path"), F.col("n_chars").alias("size_bytes"), "text", "lang", F.sha2("text", 256).alias("sha"))


#: The same for the oracle, as a common table expression.
OBS = """obs AS (
  SELECT doc_id AS file_id, source AS root,
         source || '/' || lang || '/book' || cast(doc_id AS VARCHAR) || (CASE doc_id % 7 WHEN 0 THEN '.epub' WHEN 1 THEN '.MOBI' WHEN 2 THEN '.azw' WHEN 3 THEN '.azw3' WHEN 4 THEN '.pdf' WHEN 5 THEN '.txt' ELSE '' END) AS relative_path,
         n_chars AS size_bytes, text, lang, sha256(text) AS sha
  FROM documents)"""

#: The quick fingerprint of a text no longer than both edges, for the oracle.
QUICK = "sha256(encode('quick/v1') || unhex(lpad(to_hex(octet_length(encode(text))), 32, '0')) || encode(text))"

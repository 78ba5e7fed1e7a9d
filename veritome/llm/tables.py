"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a local session gets a temporary folder; a cluster gets an error, as its executors wouldn't see one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="veritome-"))
        found = _local[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's Python ends if not before."""
    path = f"{shared_dir(spark)}/veritome/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_all)
    _written[path] = spark
    return path


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffle files go when nothing on the driver refers to them any more
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and lost executors cost no recomputation."""
    return _write(df, name)[0]


class Scratch:
    """Tables that an operator needs only on its way to one that it has written: all are deleted where the block ends."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.named: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _write(df, name)
        self.paths.append(path)
        return table

    def bucketed(self, df: DataFrame, name: str, n: int, column: str) -> DataFrame:
        """``df`` as a table in ``n`` buckets by a column: what is grouped or joined by it is read in place, without a shuffle."""
        spark = df.sparkSession
        path = new_path(spark, name)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        self.paths.append(path)
        self.named.append((spark, table))
        df.write.bucketBy(n, column).option("path", path).saveAsTable(table)
        return spark.table(table)

    def __exit__(self, *_: object) -> None:
        for spark, table in self.named:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.paths:
            delete(path)


def delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_all() -> None:
    for path in list(_written):
        try:
            delete(path)
        except Exception:  # the session may be gone already
            return


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: str, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank`` from 1. The rows of a key are first cut down in parts by the hash of ``spread``, so no task meets all of them."""
    part, rank = own_name(df, "part"), F.row_number()
    shared = df.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(parts)))
    few = shared.withColumn("rank", rank.over(Window.partitionBy(*keys, part).orderBy(*order))).where(F.col("rank") <= n).drop(part)
    return few.withColumn("rank", rank.over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)

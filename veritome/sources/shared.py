"""A folder that the driver and all executors share, for tables that a query keeps on its way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_held: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="veritome-core-"))
        found = _local[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path there, deleted when the driver's Python ends."""
    if not _held:
        atexit.register(_delete_all)
    path = f"{shared_dir(spark)}/veritome/{name}-{uuid.uuid4().hex}"
    _held[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table there: what is used several times is made once, and its lineage ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it lies in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_all() -> None:
    for path, spark in list(_held.items()):
        try:
            at, store = file_system(spark, path)
            store.delete(at, True)
        except Exception:  # the session may be gone already
            return

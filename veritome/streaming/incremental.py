"""Spark extension of batch semantics: scans that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.operators.incremental import reconcile


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", at: str = "ts") -> DataFrame:
    """Events by type and window; with a stream, windows close once the watermark has passed them."""
    dated = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = dated.withWatermark(at, late) if events.isStreaming else dated
    return timed.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def reconcile_stream(scans: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str, now) -> object:
    """Each micro-batch of ``scans`` is one complete scan that is reconciled with the stored records; ``store`` must replace them atomically by batch number."""
    def step(batch: DataFrame, number: int) -> None:
        store(reconcile(load(), batch.select("relative_path", "size_bytes", "modified_at"), now), number)

    return scans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Event-time aggregation, the same for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) over tumbling windows; with ``late`` a watermark,
    so that a stream can drop finished windows."""
    ts = F.col("ts").cast("timestamp")
    e = events.withColumn("__t", ts)
    if late:
        e = e.withWatermark("__t", late)
    g = e.groupBy(F.window("__t", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def first_seen(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """A stream without repeats of a key within the watermark: the incremental extraction cache."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def deliver_changes(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Continuous upsert of batches into versioned Parquet folders, one per batch; a batch
    that is retried overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

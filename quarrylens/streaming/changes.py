"""Inventory records as a stream (an addition of this library): each micro-batch becomes a published snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylens.sources.snapshots import SnapshotStore


def publish_snapshots(records: DataFrame, store: SnapshotStore, root: str, checkpoint: str) -> StreamingQuery:
    """Append a snapshot per micro-batch of file records (file, language, lines, size, mtime, hash). The batch number
    gives the scan id, so a batch that runs again after a failure is not published twice."""

    def save(batch: DataFrame, epoch: int) -> None:
        scan_id = epoch + 1
        if store.manifest().where(F.col("scan_id") == scan_id).isEmpty():
            store.save(scan_id, root, str(scan_id), {"files": batch})

    return records.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def line_rates(records: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Files and lines per language and event-time window; rows later than ``late`` are left out."""
    timed = records.withColumn("at", F.timestamp_millis("mtime")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "language").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))

"""Structured Streaming: index tables that follow a stream of file versions, and windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import incremental


def follow_manifest(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the table at path the latest version of each file of a stream (file_path, content_sha, version, deleted, ...).

    Each micro-batch is folded into a new snapshot beside the old one, which a pointer then names, so a batch that is
    run again after a loss gives the same table."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = incremental.latest(batch)
        old = snapshot(spark, path)
        if old is not None:
            both = old.unionByName(now)
            now = incremental.latest(both)
        target = f"{path}/snapshot-{batch_id:012d}-{uuid.uuid4().hex[:8]}"
        now.write.parquet(target)
        spark.createDataFrame([(batch_id, target)], "batch long, target string").coalesce(1).write.mode("append").parquet(f"{path}/pointer")

    out = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out.start()


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The current table, deletions included as rows; null before the first batch."""
    try:
        pointer = spark.read.parquet(f"{path}/pointer")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return spark.read.parquet(pointer.agg(F.max_by("target", "batch").alias("t")).first()["t"])


def live(manifest: DataFrame) -> DataFrame:
    return manifest.where(~F.coalesce("deleted", F.lit(False)))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """(window_start, event_type, n, total) of events; a stream's late rows count until the watermark passes."""
    seen = events.withWatermark(at, late) if events.isStreaming else events
    out = seen.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour", at: str = "ts") -> DataFrame:
    seen = events.withWatermark(at, late) if events.isStreaming else events
    out = seen.groupBy(F.window(at, width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour", at: str = "ts", user: str = "user_id") -> DataFrame:
    """(user_id, session_start, n): runs of a user's events without a longer gap."""
    seen = events.withWatermark(at, late) if events.isStreaming else events
    out = seen.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), "n")

"""Continuous ingest and message streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.operators.ingest import latest, upsert


def watch_parquet(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    """New files of a folder as a stream, at most ``most_files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def ingest_stream(incoming: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Upsert each micro-batch of (path, content, arrived_at) into the artifacts that ``read`` returns;
    ``write`` stores the new version. Returns the started query, which stops when the input is used up."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = latest(batch.select("path", "content", "arrived_at"), ["arrived_at", "content"])
        write(upsert(read(), rows), number)

    return incoming.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; the watermark bounds the state."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessionized(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n, total): runs of a user's events without a longer pause than ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n", "total")

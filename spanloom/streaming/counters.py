"""Streaming upkeep of the additive statistics: popularity and windowed activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per key and time window of a stream; rows later than ``late`` are left out by the watermark.

    Works on batch tables as well, where nothing is late.
    """
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def stream_sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Gap sessions of a stream with the built-in session window (whose end is the last event plus the gap).

    Unlike the batch operator an event exactly one gap after the one before opens a new session.
    """
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def maintain_popularity(events: DataFrame, path: str, checkpoint: str):
    """Start a query that adds every micro-batch to the item counts below ``path``.

    Each batch is written to a folder named by its id, so a batch that is run again replaces itself;
    ``read_popularity`` adds the folders up.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def read_popularity(spark, path: str) -> DataFrame:
    """``(item_id, n)`` as of the last finished batch."""
    return spark.read.parquet(path).groupBy("item_id").agg(F.sum("n").alias("n"))

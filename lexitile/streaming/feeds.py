"""Change feeds: windows over events and memory updates from micro-batches.

Both work on batch and streaming DataFrames alike; late events beyond the watermark are dropped by the stream only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexitile.operators.memory import upsert


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and their values by window and type; NULL times belong to no window."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).where("at is not null")
    if e.isStreaming:
        e = e.withWatermark("at", lateness)
    g = e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events without a longer gap."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).where("at is not null and user_id is not null")
    if e.isStreaming:
        e = e.withWatermark("at", lateness)
    g = e.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("session_start"), "n")


def first_deliveries(rows: DataFrame, key: list[str], at: str, lateness: str = "1 day") -> DataFrame:
    """Each key once, as far as the watermark reaches back in a stream."""
    if rows.isStreaming:
        return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)
    return rows.dropDuplicates(key)


def memory_updates(pairs: DataFrame, current: Callable[[], DataFrame], save: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Upserts of each micro-batch against the current memory; ``save`` gets the written cells and the batch number, so a repeated batch can be told."""
    return pairs.writeStream.foreachBatch(lambda batch, n: save(upsert(current(), batch), n))

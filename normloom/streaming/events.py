"""Windowed counts of events, and retrieval results kept up to date as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their values per window and type; works on a stream and on a table.

    State older than the watermark is dropped; later rows are not counted by a stream.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    counts = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: runs of events with no gap longer than ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    s = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def best_scores(results: DataFrame, late: str = "7 days") -> DataFrame:
    """Highest score of each query and chunk, rows delivered twice counted once."""
    rows = results.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["result_id"])
    rows = rows.where("scores is not null and not isnan(scores)")
    return rows.groupBy("query_id", "chunk_idx").agg(F.max("scores").alias("score"))

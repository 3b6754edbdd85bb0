"""Structured Streaming forms: duplicate suppression, counters, sessions, latest values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(stream: DataFrame, late: str = "10 days") -> DataFrame:
    """Detections of a look-back ingest, each hash once within the watermark. detected_at must be a timestamp."""
    return stream.withWatermark("detected_at", late).dropDuplicatesWithinWatermark(["detection_hash"])


def counters(requests: DataFrame, ts: str, key: str, width: str = "60 seconds", limit: int = 100) -> DataFrame:
    """Requests a key and fixed window, and whether they exceed the limit."""
    g = requests.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("blocked"))


def sessions(rows: DataFrame, ts: str, key: str, gap: str = "48 hours") -> DataFrame:
    """Liveness: rows of a key without a longer pause."""
    g = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return g.select(key, "n", "first_seen", "last_seen")


def last_seen(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """The latest time of each key: never falls."""
    return rows.groupBy(key).agg(F.max(ts).alias("last_seen_at"))


def in_batches(stream: DataFrame, work, checkpoint: str):
    """Run a batch operator over what is new, then stop: scheduled jobs."""
    return stream.writeStream.foreachBatch(lambda batch, _: work(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

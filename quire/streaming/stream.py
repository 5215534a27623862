"""Streams of documents and events through the batch transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import quality
from quire.functions import text as T


def measured(docs: DataFrame) -> DataFrame:
    """Text metrics and quality of each document; stateless, so batch and stream agree."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", T.word_count(t).alias("n_words"), F.octet_length(t).cast("long").alias("n_bytes"), F.round(quality.quality_score(t), 9).alias("quality_score"))


def windowed_stats(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count and mean of value by event type and window of ts; later events than
    ``late`` are left out of a stream. ts may be without a time zone."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = stamped.groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = stamped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_seen(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents of a stream (ts, text) without texts seen before within the watermark."""
    return docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])

"""Extensions over event streams: counts per window, sessions, and questions told once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(questions: DataFrame, late: str = "1 day") -> DataFrame:
    """Each fingerprint once; in a stream within the watermark."""
    return questions.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["fingerprint"]) if questions.isStreaming else questions.dropDuplicates(["fingerprint"])

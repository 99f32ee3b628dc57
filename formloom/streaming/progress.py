"""Status of documents from a stream of progress events: the latest stage of each, kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(events: DataFrame) -> DataFrame:
    """Streaming or not: (doc_id, stage, at) of each document's last event of (doc_id, stage, ts). Update mode."""
    return events.groupBy("doc_id").agg(F.max_by("stage", "ts").alias("stage"), F.max("ts").alias("at"))


def stage_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per stage and time window; an extension for dashboards, with late events up to `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")

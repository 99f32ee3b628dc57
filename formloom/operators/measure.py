"""What the stages of a run take: rows and time, observed while their tables are written, without a second pass."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise


class Stages:
    """Writes each stage's table and notes its rows and time in order. A stage's time is that of its own writing; what it
    reads from earlier stages is a table by then."""

    def __init__(self):
        self.done: list[tuple[str, int, int, float]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        seen, began = Observation(f"{name}-{len(self.done)}"), time.monotonic()
        keys = [F.count("*").alias("rows"), F.approx_count_distinct("doc_id").alias("docs")] if "doc_id" in df.columns else [F.count("*").alias("rows"), F.lit(0).cast("long").alias("docs")]
        out = materialise(df.observe(seen, *keys), name)
        got = seen.get
        self.done.append((name, got["rows"], got["docs"], time.monotonic() - began))
        return out

    def note(self, name: str, rows: int, docs: int, seconds: float) -> None:
        self.done.append((name, rows, docs, seconds))

    def table(self, spark: SparkSession) -> DataFrame:
        """(at, stage, rows, docs, ms) in order; docs is Spark's approximate count of distinct documents."""
        rows = [(k, n, r, d, int(s * 1000)) for k, (n, r, d, s) in enumerate(self.done)]
        return spark.createDataFrame(rows, "at int, stage string, rows long, docs long, ms long")

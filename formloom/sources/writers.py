"""Writers: run data, layouts, the store's log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): each row's other columns as one JSON text."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to the store's log, one folder per bucket so that a bucket's scan prunes the others."""
    rows.write.mode("append").partitionBy("bucket").parquet(path)

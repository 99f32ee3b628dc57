"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where it is unset and all runs on
    this machine (tests). Elsewhere a folder of one machine would lose files, so that raises."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jdir = context._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="formloom-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back: later steps have a short lineage and survive lost
    executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/formloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._formloom_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark's own file systems reach it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that no later result reads."""
    path = getattr(df, "_formloom_path", None)
    if path:
        delete(df.sparkSession, path)

"""Helpers shared by the corpus operators: intermediate tables, words, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the five ASCII line and tab controls.
WORD_RE = r"[^\x20\x09-\x0D]+"


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


def give_back() -> None:
    """Return freed memory of this process to the machine: Arrow's pool and the C allocator keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def lean(step):
    """A mapInArrow function that gives freed memory back when its task ends, as workers live on for the next stages."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs, which it keeps until their handles are collected.

    Call it once nothing refers to the shuffled frames any more, that is after materialise() has returned."""
    for _ in range(2):  # the first round drops Python's handles in the JVM, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back; later stages survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/formloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._formloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that no later result reads."""
    path = getattr(df, "_formloom_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def byte_rows(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def flat_bytes(column: pa.Array, gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one uint8 array with gap zero bytes before, between and after them; their starts and lengths."""
    rows = byte_rows(column)
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    pad = b"\0" * gap
    flat = np.frombuffer(pad + pad.join(rows) + pad, np.uint8)
    starts = gap + np.concatenate(([0], np.cumsum(lens + gap)[:-1])) if len(rows) else np.zeros(0, np.int64)
    return flat, starts.astype(np.int64), lens


def slices(batch: pa.RecordBatch, column: int, limit: int = 2_000_000):
    """Parts of a batch whose texts in a column have about `limit` bytes at most (one row at least)."""
    texts = batch.column(column)
    if not batch.num_rows:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit)))
        yield batch.slice(at, end - at)
        at = end


def translated(text: bytes, to: bytes, piece: int):
    """bytes.translate(to) of a text in parts of about `piece` bytes that end before a space; only one long run of other
    bytes makes a part longer."""
    at = 0
    while at < len(text):
        end, last = at, -1
        while last < 1 and end < len(text):
            end += piece
            part = text[at:end].translate(to)
            last = part.rfind(b" ")
        if end < len(text):
            part, end = part[:last], at + last
        yield part
        at = end


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lens[i]-1 of every i, one after the other."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts.astype(np.int64) - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    return shift + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on a uint64 array (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_count(col) -> F.Column:
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_RE)), F.lit(0)).cast("long")

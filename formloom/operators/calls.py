"""Model calls made once: a ledger of replies in the shared folder, keyed by what was asked.

A call costs seconds and money, so no prompt may be asked twice, whatever fails. A task writes each reply to a file of its
own before it asks on, named after the run, the partition and the attempt; when the task is tried again it first reads what
earlier attempts left. When all tasks are through, the run's replies are written as one table and its small files go. A run
that died without that leaves its files in place, and the next run reads them like any other reply.

    ledger/replies/run=<id>/part-*.parquet    committed replies
    ledger/pending/<run>/<partition>-<attempt>-<n>.json    replies of a run that isn't committed

Failed calls are kept for the run that made them and asked again by the next one.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete

REPLY = "key string, reply string, input_tokens long, output_tokens long, error string"
_NAMES = ["key", "reply", "input_tokens", "output_tokens", "error"]
_ARROW = pa.schema([("key", pa.string()), ("reply", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string())])


def prompt_key(prompt: Column, purpose: str, model: str = "") -> Column:
    """What identifies a call: its purpose, the model, and the whole prompt."""
    return F.sha2(F.concat_ws("\x00", F.lit(purpose), F.lit(model), prompt), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


class ReplyLedger:
    """Replies under a path that the driver and all executors share, an address that both Spark and Arrow know. One run
    at a time may ask; Spark's speculative execution must be off, as two attempts at once would both ask."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def replies(self) -> DataFrame:
        """(key, reply, input_tokens, output_tokens, error) of all calls that were answered, committed or not, once a key."""
        out = self.spark.createDataFrame([], REPLY)
        if _exists(self.spark, f"{self.path}/replies"):
            out = out.unionByName(self.spark.read.schema(REPLY).parquet(f"{self.path}/replies").select(_NAMES))
        if _exists(self.spark, f"{self.path}/pending"):
            out = out.unionByName(self.spark.read.schema(REPLY).option("recursiveFileLookup", "true").json(f"{self.path}/pending").select(_NAMES))
        first = F.min_by(F.struct(*_NAMES[1:]), "reply").alias("r")
        return out.filter("key is not null and error is null").groupBy("key").agg(first).select("key", "r.*")

    def ask(self, prompts: DataFrame, client: Callable[[str], dict], purpose: str = "validate", model: str = "") -> DataFrame:
        """Per row of prompts(doc_id, prompt): doc_id, purpose, reply, input_tokens, output_tokens, error, and asked (its
        prompt was asked by this run). Equal prompts are asked once; tokens count where the call was made, so asked rows
        of one prompt show them all. A null prompt is never asked and has a null reply."""
        if str(self.spark.conf.get("spark.speculation", "false")).lower() == "true":
            raise ValueError("calls would be made twice under spark.speculation")
        run = uuid.uuid4().hex
        pending = f"{self.path}/pending/{run}"
        keyed = prompts.select("doc_id", "prompt").withColumn("key", F.when(F.col("prompt").isNotNull(), prompt_key(F.col("prompt"), purpose, model)))
        new = keyed.filter("key is not null").groupBy("key").agg(F.first("prompt").alias("prompt")).join(self.replies().select("key"), "key", "left_anti")
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        new.repartition(width, "key").mapInArrow(_calling(client, pending), REPLY).select("key").write.mode("overwrite").format("noop").save()
        return self._answers(keyed, self.commit(run), purpose)

    def commit(self, run: str) -> DataFrame:
        """A run's replies as one table; its small files go only when that is written. Returns them."""
        pending, done = f"{self.path}/pending/{run}", f"{self.path}/replies/run={run}"
        if not _exists(self.spark, pending):
            return self.spark.createDataFrame([], REPLY)
        rows = self.spark.read.schema(REPLY).json(pending).dropDuplicates(["key"])
        rows.write.mode("overwrite").parquet(done)
        delete(self.spark, pending)
        return self.spark.read.schema(REPLY).parquet(done)

    def _answers(self, keyed: DataFrame, mine: DataFrame, purpose: str) -> DataFrame:
        answered = self.replies().join(mine.select("key", F.lit(True).alias("asked")), "key", "left")
        failed = mine.filter("error is not null").withColumn("asked", F.lit(True))
        every = answered.unionByName(failed.join(answered.select("key"), "key", "left_anti"))
        out = keyed.join(every, "key", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        return out.select("doc_id", F.lit(purpose).alias("purpose"), "reply", F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), "error", "asked")


def _calling(client: Callable[[str], dict], pending: str):
    """mapInArrow step over (key, prompt): one file for each reply, written before the next call."""

    def run(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, root = afs.FileSystem.from_uri(pending) if "://" in pending or pending.startswith("file:") else (afs.LocalFileSystem(), pending)
        system.create_dir(root, recursive=True)
        known: dict[str, tuple] = {}
        for info in system.get_file_info(afs.FileSelector(root)):
            if info.base_name.startswith(f"{part}-") and info.base_name.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    row = json.loads(f.read().decode())
                known[row["key"]] = tuple(row.get(n) for n in _NAMES)
        asked = 0
        for batch in batches:
            out = []
            for key, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                if key not in known:
                    known[key] = row = (key, *_answer(client, prompt))
                    name = posixpath.join(root, f"{part}-{attempt}-{asked}")
                    with system.open_output_stream(name + ".tmp") as f:
                        f.write(json.dumps(dict(zip(_NAMES, row))).encode())
                    system.move(name + ".tmp", name + ".json")  # whole or not at all
                    asked += 1
                out.append(known[key])
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in out], schema=_ARROW)

    return run


def _answer(client: Callable[[str], dict], prompt: str) -> tuple:
    """(reply, input_tokens, output_tokens, error) of one call; a refusal is a row, so one prompt does not stop the others."""
    try:
        r = client(prompt)
        return r.get("reply"), int(r.get("input_tokens", 0)), int(r.get("output_tokens", 0)), None
    except Exception as e:  # noqa: BLE001  recorded in the row
        return None, 0, 0, f"{type(e).__name__}: {e}"

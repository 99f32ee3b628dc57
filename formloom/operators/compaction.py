"""The keyed store kept small: a log in buckets by key, compacted bucket by bucket, with tombstones and point look-ups.

The log is (bucket, id, seq, body, deleted) as store.latest() reads it, in folders by part = hash(bucket, id) mod PARTS, so all
writes of a key lie in one folder: a look-up of one key reads that folder alone, and each folder can be rewritten by
itself. Compaction keeps the last write of each key, tombstones with it: a stale write that arrives later still loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, discard, materialise
from .store import latest

PARTS = 64
LOG = "bucket string, id string, seq long, body string, deleted boolean"
_KEY = ["bucket", "id"]


def part_of(bucket: Column, key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(bucket, key), F.lit(parts)).cast("int")


class KeyedStore:
    """A store under a path. One writer compacts at a time; appends may go on, but not while a compaction runs."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def append(self, rows: DataFrame) -> None:
        """Writes (bucket, id, seq, body); a null body or deleted = true is a tombstone. Rows without a key are left out."""
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rows.columns else F.lit(False)
        rows = rows.filter("bucket is not null and id is not null and seq is not null").select("bucket", "id", F.col("seq").cast("long").alias("seq"), "body", (gone | F.col("body").isNull()).alias("deleted"))
        rows = rows.withColumn("part", part_of(F.col("bucket"), F.col("id"), self.parts))
        rows.repartition(self.parts, "part").write.mode("append").partitionBy("part").parquet(self.path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG + ", part int").parquet(self.path)

    def rows(self, tombstones: bool = False) -> DataFrame:
        """The last write of each key (of equal seq the greater body), without the deleted ones."""
        out = latest(self.log(), [*_KEY, "part"], "seq")
        return (out if tombstones else out.filter("not deleted")).select("bucket", "id", "seq", "body", "deleted")

    def get(self, bucket: str, key: str) -> DataFrame:
        """At most one row; the scan reads one folder of the log."""
        part = self.spark.range(1).select(part_of(F.lit(bucket), F.lit(key), self.parts)).first()[0]
        mine = self.log().filter((F.col("part") == part) & (F.col("bucket") == bucket) & (F.col("id") == key))
        return latest(mine, _KEY, "seq").filter("not deleted").select("bucket", "id", "seq", "body")

    def list(self, bucket: str) -> DataFrame:
        return self.rows().filter(F.col("bucket") == bucket).orderBy(F.desc("seq"), "id")

    def compact(self, forget: int | None = None) -> None:
        """Rewrite every folder that has more than one write of some key to the last writes. forget: tombstones of a
        seq up to this go for good (no older write may arrive any more). The new rows are a table of their own before any
        folder is replaced, so a compaction that dies leaves either state of a folder, never neither."""
        log = self.log()
        old = F.col("deleted") & (F.col("seq") <= F.lit(-1 if forget is None else forget))
        stale = log.groupBy("part", *_KEY).agg(F.count("*").alias("n"), F.bool_or(old if forget is not None else F.lit(False)).alias("old")).filter("n > 1 or old").select("part").distinct()
        kept = latest(log.join(F.broadcast(stale), "part"), [*_KEY, "part"], "seq")  # at most one row a folder
        if forget is not None:
            kept = kept.filter(~old)
        fresh = materialise(kept.select("bucket", "id", "seq", "body", "deleted", "part"), "compaction")
        emptied = [r.part for r in stale.join(fresh.select("part").distinct(), "part", "left_anti").collect()]  # folders: PARTS at most
        fresh.repartition(self.parts, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        for part in emptied:  # nothing of the folder is left, so the overwrite doesn't touch it
            delete(self.spark, f"{self.path}/part={part}")
        discard(fresh)

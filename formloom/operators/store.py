"""A keyed store as an append-only log of (bucket, id, seq, body, deleted): the last write of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key. A max over a struct combines before the shuffle, so hot keys stay small."""
    rest = [c for c in log.columns if c not in keys and c != seq]
    return log.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("r")).select(*keys, F.col(f"r.{seq}").alias(seq), *[F.col(f"r.{c}").alias(c) for c in rest])


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def newest_first(log: DataFrame, bucket: str) -> DataFrame:
    return latest(log.filter(F.col("bucket") == bucket), ["bucket", "id"], "seq").orderBy(F.desc("seq"))


def params_key(content: Column, *params: Column) -> Column:
    """The cache key of an upload: its SHA-256 and what it is processed with."""
    return F.concat_ws(":", F.sha2(content, 256), *[p.cast("string") for p in params])


def cached(requests: DataFrame, done: DataFrame, key: str = "params_key", seq: str = "seq") -> DataFrame:
    """requests with the id of the newest finished document of the same key, null where there is none."""
    newest = done.filter("status = 'done'").groupBy(key).agg(F.max_by("doc_id", seq).alias("cached_id"))
    return requests.join(newest, key, "left")


def overlay(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the patches' values where they aren't null; patched rows are sure and need no review."""
    p = patches.select(key, *[F.col(c).alias(f"p_{c}") for c in columns], F.lit(True).alias("patched"))
    j = rows.join(p, key, "left")
    hit = F.coalesce("patched", F.lit(False))
    out = j.withColumns({c: F.coalesce(f"p_{c}", c) for c in columns}).withColumn("patched", hit)
    if "confidence" in rows.columns:
        out = out.withColumn("confidence", F.when(hit, 1.0).otherwise(F.col("confidence")))
    if "needs_review" in rows.columns:
        out = out.withColumn("needs_review", ~hit & F.col("needs_review"))
    return out.drop(*[f"p_{c}" for c in columns])


def corrections(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The log of a patch: key, before and after."""
    j = rows.join(patches.select(key, *[F.col(c).alias(f"p_{c}") for c in columns]), key)
    return j.select(key, F.struct(*columns).alias("before"), F.struct(*[F.coalesce(f"p_{c}", c).alias(c) for c in columns]).alias("after"))


def settings(defaults: DataFrame, env: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, value): what is stored comes before the environment, that before the default; empty counts as unset."""
    v = lambda d, n: d.select("name", F.when(F.trim("value") != "", F.col("value")).alias(n))
    return v(defaults, "d").join(v(env, "e"), "name", "left").join(v(stored, "s"), "name", "left").select("name", F.coalesce("s", "e", "d").alias("value"))


def masked(secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", "").otherwise(F.concat(F.lit("…"), F.right(secret, F.lit(4))))

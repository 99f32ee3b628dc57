"""The store's log before and after compaction: same rows, fewer files, look-ups of one folder, tombstones that hold."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from formloom.operators.compaction import KeyedStore, part_of

ROW = "bucket string, id string, seq long, body string, deleted boolean"


def filled(spark, tmp_path, seed=1):
    rng = random.Random(seed)
    store = KeyedStore(spark, f"file://{tmp_path}/log", parts=8)
    last: dict = {}
    for k in range(4):
        rows = []
        for n in range(60):
            key, seq = (rng.choice("de"), f"k{rng.randrange(25)}"), k * 100 + n
            gone = rng.random() < 0.2
            rows.append((*key, seq, None if gone else f"body {seq}", None))
            last[key] = (seq, None if gone else f"body {seq}")
        store.append(spark.createDataFrame(rows + [(None, "x", 1, "b", None), ("d", None, 1, "b", None)], ROW))
    return store, last


def files(tmp_path):
    return list(Path(tmp_path).glob("log/part=*/*.parquet"))


def test_compaction_changes_nothing_but_files(spark, tmp_path):
    store, last = filled(spark, tmp_path)
    want = {k: v for k, v in last.items() if v[1] is not None}
    rows = lambda: {(r.bucket, r.id): (r.seq, r.body) for r in store.rows().collect()}
    assert rows() == want
    before = len(files(tmp_path))
    store.compact()
    assert rows() == want and len(files(tmp_path)) < before
    assert store.log().count() == len(last)  # tombstones stay
    store.compact()
    assert rows() == want
    # a stale write after the compaction loses against the tombstone
    dead = next(k for k, v in last.items() if v[1] is None)
    store.append(spark.createDataFrame([(*dead, 0, "late", None)], ROW))
    assert dead not in rows() and store.get(*dead).count() == 0
    store.append(spark.createDataFrame([(*dead, 9999, "again", None)], ROW))
    assert [r.body for r in store.get(*dead).collect()] == ["again"]
    seqs = [r.seq for r in store.list("d").collect()]
    assert seqs == sorted(seqs, reverse=True) and len(seqs) == sum(k[0] == "d" for k in rows())


def test_forgotten_tombstones_and_emptied_folders(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/log", parts=64)
    store.append(spark.createDataFrame([("d", "a", 1, "x", None), ("d", "b", 2, "y", None), ("d", "a", 3, None, None), ("e", "c", 4, "z", True)], ROW))
    store.compact(forget=3)
    assert {(r.id, r.seq, r.deleted) for r in store.log().collect()} == {("b", 2, False), ("c", 4, True)}
    store.compact(forget=10)
    assert {r.id for r in store.log().collect()} == {"b"} and [r.id for r in store.rows().collect()] == ["b"]


def test_a_get_reads_one_folder(spark, tmp_path):
    store, last = filled(spark, tmp_path)
    bucket, key = next(k for k, v in last.items() if v[1] is not None)
    got = store.get(bucket, key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    part = spark.range(1).select(part_of(F.lit(bucket), F.lit(key), 8)).first()[0]
    assert f"(part#" in plan and f" = {part})" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(id" in plan
    assert [(r.seq, r.body) for r in got.collect()] == [last[bucket, key]]
    assert store.get("d", "never").count() == 0

"""Job states of a stream with late events, missing ends and jobs that come back."""

import time

from pyspark.sql import functions as F

from formloom.streaming import jobs

BASE = 28_000_000  # minutes since 1970, where a stream's first watermark stands


def run(spark, tmp_path, batches, **args):
    """Each list of (doc_id, stage, minute) is a batch; the changes in order of batches, and the state rows left."""
    folder = f"{tmp_path}/in"
    schema = "doc_id long, stage string, ts timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(folder)
    name = f"jobs{time.time_ns()}"
    out, seen = [], 0
    q = jobs.job_states(stream, **args).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        for batch in batches:
            rows = [(d, s, None if m is None else float(BASE + m) * 60) for d, s, m in batch]
            frame = spark.createDataFrame(rows, "doc_id long, stage string, m double").select("doc_id", "stage", F.timestamp_seconds("m").alias("ts"))
            frame.coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
            q.processAllAvailable()
            now = [(r.doc_id, r.state, r.stage, int(r.s // 60) - BASE, r.events) for r in spark.table(name).withColumn("s", F.unix_seconds("at")).collect()]
            out.append(sorted(now[seen:]))
            seen = len(now)
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    return out, left


def test_stages_stall_finish_and_are_forgotten(spark, tmp_path):
    batches = [
        [(1, "queued", 0), (2, "queued", 0), (1, "reading", 1), (3, "queued", 1), (None, "queued", 1), (4, None, 1), (5, "queued", None)],
        [(1, "done", 3), (3, "reading", 2)],
        [(1, "reading", 2), (9, "queued", 14)],  # late for a finished job; the watermark goes to 4
        [(9, "reading", 18)],  # watermark 8: 2 and 3 have been silent since 0 and 2
        [(3, "done", 19)],  # comes back and ends
        [(9, "done", 60)],  # watermark 50
        [(8, "queued", 120)],  # watermark 110
    ]
    out, left = run(spark, tmp_path, batches)
    assert out[0] == [(1, "running", "reading", 1, 2), (2, "running", "queued", 0, 1), (3, "running", "queued", 1, 1)]
    assert out[1] == [(1, "finished", "done", 3, 3), (3, "running", "reading", 2, 2)]
    assert out[2] == [(9, "running", "queued", 14, 1)]
    assert out[3] == [(2, "stalled", "queued", 0, 1), (3, "stalled", "reading", 2, 2), (9, "running", "reading", 18, 2)]
    assert out[4] == [(3, "finished", "done", 19, 3)]
    assert (9, "finished", "done", 60, 3) in out[5]
    assert out[6] == [(8, "running", "queued", 120, 1)]
    assert left == 2  # the stalled job 2 within its day, and 8


def test_late_events_count_but_do_not_turn_back(spark, tmp_path):
    out, _ = run(spark, tmp_path, [[(1, "reading", 5)], [(1, "queued", 4)], [(1, "grouping", 5)], [(1, "rejected", 6)], [(1, "done", 7)]])
    assert [x[-1:] for x in out] == [[(1, "running", "reading", 5, 1)], [(1, "running", "reading", 5, 2)], [(1, "running", "reading", 5, 3)], [(1, "finished", "rejected", 6, 4)], []]


def test_stalled_jobs_are_forgotten_too(spark, tmp_path):
    out, left = run(spark, tmp_path, [[(1, "queued", 0)], [(2, "done", 30)], [(2, "done", 31)], [(3, "done", 200)], [(4, "done", 400)]], silent=60, late=60, forget=3600)
    changes = [c for x in out for c in x]
    assert (1, "stalled", "queued", 0, 1) in changes and left == 1

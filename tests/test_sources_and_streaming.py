"""Readers, writers and the status stream."""

import json

from pyspark.sql import functions as F

from formloom.operators import tokens
from formloom.sources import readers, writers
from formloom.streaming import progress


def test_payload_pages_are_numbered(spark, tmp_path):
    doc = {"doc_id": 5, "filename": "a", "pages": [{"width": 600, "height": 800, "tokens": [{"text": "Name:", "bbox": [1, 2, 3, 4]}, {"text": "x", "bbox": [5, 6, 7, 8], "confidence": 0.5}]}, {"number": 9, "tokens": [{"text": "y", "bbox": [0, 0, 1, 1]}]}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    got = tokens.page_tokens(readers.payloads(spark, str(tmp_path))).orderBy("page", "pos").collect()
    assert [(r.page, r.pos, r.text, r.confidence) for r in got] == [(1, 0, "Name:", 1.0), (1, 1, "x", 0.5), (9, 0, "y", 1.0)]


def test_uploads_and_samples(spark, tmp_path):
    import hashlib

    (tmp_path / "en_form.pdf").write_bytes(b"%PDF")
    (tmp_path / "de_x.PDF").write_bytes(b"1")
    (tmp_path / "bad.exe").write_bytes(b"MZ")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.uploads(spark, str(tmp_path)).collect()}
    assert got["bad.exe"].refused.startswith("415") and got["de_x.PDF"].refused is None
    assert got["en_form.pdf"].sha256 == hashlib.sha256(b"%PDF").hexdigest()
    assert [tuple(r) for r in readers.samples(spark, str(tmp_path)).collect()] == [("en_form.pdf", "en")]


def test_first_reader_with_enough_tokens(spark):
    rows = [(1, 1, "text", 0, ["a"]), (1, 1, "local", 1, ["a", "b", "c"]), (1, 1, "model", 2, ["x"] * 5)]
    got = readers.best_reader(spark.createDataFrame(rows, "doc_id int, page int, reader string, priority int, tokens array<string>")).collect()
    assert [(r.reader, len(r.tokens)) for r in got] == [("local", 3)]


def test_log_and_json(spark, tmp_path):
    log = spark.createDataFrame([("d", "a", 1, "x"), ("e", "b", 2, "y")], "bucket string, id string, seq int, body string")
    writers.append_log(log, f"{tmp_path}/log")
    writers.append_log(log.withColumn("seq", F.col("seq") + 5), f"{tmp_path}/log")
    back = spark.read.parquet(f"{tmp_path}/log").filter("bucket = 'd'")
    assert sorted(r.seq for r in back.collect()) == [1, 6]
    assert writers.json_rows(log.select(F.col("id").alias("doc_id"), "seq")).orderBy("doc_id").collect()[0].json == '{"seq":1}'


def test_latest_status_of_a_stream(spark, tmp_path):
    schema = "doc_id long, stage string, ts timestamp_ntz"
    rows = [(1, "queued", "2024-01-01 00:00:00"), (1, "done", "2024-01-01 00:09:00"), (2, "queued", "2024-01-01 00:01:00"), (1, "reading", "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "doc_id long, stage string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/events")
    q = progress.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("status").start()
    try:
        q.processAllAvailable()
        assert {r.doc_id: r.stage for r in spark.table("status").collect()} == {1: "done", 2: "queued"}
    finally:
        q.stop()
    c = progress.stage_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        c.processAllAvailable()
        assert sum(r.n for r in spark.table("counts").collect()) == 4
    finally:
        c.stop()

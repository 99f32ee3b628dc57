"""Calls are made once: through retried tasks, died runs and reruns."""

import os
import subprocess
import sys
import textwrap
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from formloom.operators.calls import ReplyLedger


def counting(folder, fail=()):
    """A client that leaves a file for each call, in whatever process it runs."""

    def client(prompt):
        (Path(folder) / uuid.uuid4().hex).write_text(prompt)
        if prompt in fail:
            raise RuntimeError("overloaded")
        return {"reply": prompt.upper(), "input_tokens": len(prompt), "output_tokens": 1}

    return client


def asked(folder):
    return sorted(p.read_text() for p in Path(folder).iterdir())


def test_equal_prompts_and_reruns_ask_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(k, f"prompt {k % 7}") for k in range(40)] + [(90, None), (91, "bad"), (92, "")]
    prompts = spark.createDataFrame(rows, "doc_id long, prompt string").repartition(5)
    ledger = ReplyLedger(spark, f"file://{tmp_path}/ledger")
    got = {r.doc_id: r for r in ledger.ask(prompts, counting(calls, ["bad"])).collect()}
    assert asked(calls) == sorted(["", "bad", *(f"prompt {k}" for k in range(7))])
    assert len(got) == len(rows) and got[3].reply == "PROMPT 3" and got[3].asked and got[90].reply is None and not got[90].asked
    assert got[91].error == "RuntimeError: overloaded" and got[91].reply is None and got[92].reply == ""
    assert not (tmp_path / "ledger" / "pending").exists() or not any((tmp_path / "ledger" / "pending").iterdir())
    more = spark.createDataFrame([(1, "prompt 1"), (2, "new"), (3, "bad")], "doc_id long, prompt string")
    again = {r.doc_id: r for r in ReplyLedger(spark, f"file://{tmp_path}/ledger").ask(more, counting(calls)).collect()}
    assert not again[1].asked and again[1].reply == "PROMPT 1" and again[2].asked and again[3].reply == "BAD"  # a failed call is asked again
    assert len(asked(calls)) == 11
    assert ledger.ask(more, counting(calls)).filter("asked").count() == 0 and len(asked(calls)) == 11
    other = ledger.ask(more, counting(calls), model="another")
    assert other.filter("asked").count() == 3 and len(asked(calls)) == 14


def test_a_died_run_leaves_its_replies(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    prompts = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))
    plain = counting(calls)

    def dying(prompt):
        if len(list(Path(calls).iterdir())) >= 9:
            os._exit(1)  # the worker process dies
        return plain(prompt)

    ledger = ReplyLedger(spark, str(tmp_path / "ledger"))
    try:
        ledger.ask(prompts, dying)
        raise AssertionError("the run went through")
    except Exception as e:  # noqa: BLE001
        assert "went through" not in str(e)
    before = len(asked(calls))
    assert 0 < before < 30
    got = ledger.ask(prompts, plain).collect()
    assert len(got) == 30 and all(r.reply == f"P{r.doc_id}" for r in got)
    assert asked(calls) == sorted(f"p{k}" for k in range(30))


def test_a_retried_task_asks_only_the_rest(tmp_path):
    """A task that fails half-way is tried again by Spark, in a session of its own that allows it."""
    (tmp_path / "calls").mkdir()
    script = textwrap.dedent(f"""
        import os, uuid
        from pathlib import Path
        from pyspark.sql import SparkSession
        from formloom.operators.calls import ReplyLedger
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        folder = Path("{tmp_path}/calls")
        def client(prompt):
            (folder / uuid.uuid4().hex).write_text(prompt)
            return {{"reply": prompt * 2}}
        def failing(prompt):
            if prompt == "p11" and not os.path.exists("{tmp_path}/failed"):
                Path("{tmp_path}/failed").touch()
                raise SystemExit("lost")
            return client(prompt)
        prompts = spark.range(25).selectExpr("id doc_id", "concat('p', id) prompt")
        rows = ReplyLedger(spark, "file://{tmp_path}/ledger").ask(prompts, failing).collect()
        assert sorted(r.reply for r in rows) == sorted(f"p{{k}}" * 2 for k in range(25)), rows
        assert os.path.exists("{tmp_path}/failed")
        os._exit(0)
    """)
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", script], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert asked(tmp_path / "calls") == sorted(f"p{k}" for k in range(25))

"""Pages that read alike, digits aside, are looked at once."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from formloom.functions import normalise as N
from formloom.operators import gate, grouping, layouts, templates, tokens
from formloom.plans import evaluation, extract, forms

DIR = "/root/testdata/sf0.001"


def test_alike(spark):
    given = ["Total", "4,516.95", "7", "1", "11", "l1I", "Customer#000000042", "A1B2"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string").orderBy("k").select(layouts.alike(F.col("t"))).collect()]
    assert got == ["Total", "0,000.00", "0", "1", "11", "l1I", "Customer#000000000", "A0B0"]


def test_composed_each(spark):
    rows = [(1, ["Name 12", "ｎｏ. ７1"]), (2, ["abc"]), (3, []), (4, None)]
    got = dict(spark.createDataFrame(rows, "k int, t array<string>").coalesce(1).select("k", N.composed_each(F.col("t"))).collect())
    assert got == {1: ["Name 12", "no. 71"], 2: ["abc"], 3: [], 4: None}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", ["q30_junk_genuine", "q33_pruning_baseline", "q36_prompt", "q49_recall_precision", "q70_pruning_figures"])
def test_once_per_print(spark, monkeypatch, name):
    """The grouping, and all that follows on it, sees prints and not the 1,650 forms."""
    seen, plain = [], grouping.baseline_pages

    def counted(pages, *a, **b):
        seen.append(pages.count())
        return plain(pages, *a, **b)

    monkeypatch.setattr(grouping, "baseline_pages", counted)
    rows = entry.queries()[name](spark, DIR).select("doc_id").distinct().count()
    assert rows == 1650 and len(seen) == 1 and seen[0] < 500


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_drawn_gate_once_per_print(spark, monkeypatch):
    seen, plain = [], gate.signals

    def counted(tokens, *a, **b):
        seen.append(tokens.select("doc_id").distinct().count())
        return plain(tokens, *a, **b)

    monkeypatch.setattr(gate, "signals", counted)
    assert entry.queries()["q75c_eval_gate"](spark, DIR).count() == 150 and seen[0] < 120


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_run_reads_its_tokens_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    t = forms.form_tokens(spark, DIR).filter("doc_id < 3").withColumn("pos", F.col("row") * 10 + F.col("pos"))
    n = t.count()
    toks = t.mapInArrow(counted, t.schema)
    assert extract.run(toks, t.select("doc_id").distinct(), templates.catalogue(spark))["fields"].count() > 0
    assert read.value == n


def _customers(spark, path, rows):
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_drawn_forms_once_per_print(spark, monkeypatch, tmp_path):
    """Both passes see prints: 40 of 400 customers, by kind of form and by where it stands."""
    d, seen, plain = _customers(spark, tmp_path, [(k, f"Customer#{k:09d}", 2000.5 + k) for k in range(2000, 2400)]), [], grouping.group_pages

    def counted(t, *a, **b):
        seen.append(t.select("doc_id").distinct().count())
        return plain(t, *a, **b)

    monkeypatch.setattr(grouping, "group_pages", counted)
    rows = evaluation.evaluation(spark, d, search=False).collect()
    assert seen == [40] and len({r.doc_id for r in rows}) == len(rows) == 400
    assert all(r.is_form and r.group_recall == r.answer_accuracy == 1.0 for r in rows)


def test_drawn_forms_as_form_by_form(spark, monkeypatch, tmp_path):
    """Customers whose names and sums are odd get what the evaluation of each form gives: digits that differ in a label, in an
    answer found in another cell, in words of strokes, and names that are missing, blank, wide or long."""
    odd = ["7", "42", "1 1", "1 2", "5 Elm St", "6 Elm St", "Page 2 of 2", "Page 1 of 2", "Item 3 Description", "Item 99 Description", "Total: 3", "Total: 4", "Date: 3", "____ 5", "____ 6", "☐ 6", "☐ A 7", "1,234", "1,235", "",
           None, " ", "  9", "A 9", "12/03/2024", "13/04/2024", "x" * 90 + " 4", "x" * 90 + " 5", "Bank 12 No. 34 " * 4, "w 8 " * 90]
    names = [n for n in odd for _ in range(2)]
    rows = [(8 * k + kind, n, None if k % 7 == 3 else -k * 10.25 if k % 3 else k * 1.0) for k, n in enumerate(names) for kind in (0, 3, 5, 7)]
    rows += [(-7, "A 1", 1.0), (-8, "A 2", 2.0), (-15, "A 3", 3.0), (None, "A 4", 4.0)]
    d, alone, plain = _customers(spark, tmp_path, rows), [], evaluation._figures

    def counted(spark, d, customers, search):
        alone.append(customers.count())
        return plain(spark, d, customers, search)

    monkeypatch.setattr(evaluation, "_figures", counted)
    got = evaluation.evaluation(spark, d, search=False)
    want = plain(spark, d, evaluation._with_values(evaluation._customers(spark, d)), False).select(got.columns)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert len(alone) == 2 and 0 < alone[1] < len(rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_summary_makes_no_tokens_of_documents(spark, monkeypatch):
    """The summary's gate counts documents by line, as q14 does."""
    monkeypatch.setattr(tokens, "reflow", lambda docs: pytest.fail("tokens of all documents are made"))
    rows = {r.lang: r for r in entry.queries()["q77_eval_summary"](spark, DIR).collect()}
    assert set(rows) == {"all", *(k[:2] for k in evaluation.FORMS)} and rows["all"].n == 350
    assert rows["all"].gate_accuracy == rows["all"].group_recall == 1.0 and sum(r.n for k, r in rows.items() if k != "all") == 150

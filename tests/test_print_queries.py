"""Queries over forms look at each print once (see layouts.prints), and odd pages get what a look at each of them gives."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from formloom.functions import normalise as N
from formloom.operators import boundary as B
from formloom.operators import grouping, layouts, pruning, templates, tokens
from formloom.operators import report as R
from formloom.plans import extract, forms, queries, service_queries

DIR = "/root/testdata/sf0.001"
NAMED = {"q33b_pruning_search": "baseline_pages", "q50_quality_report": "group_pages", "q51_questions": "baseline_pages", "q52_normalised_fields": "baseline_pages", "q66_token_report": "baseline_pages", "q74_form_run": "group_pages"}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", NAMED)
def test_forms_once_per_print(spark, monkeypatch, name):
    seen, plain = [], getattr(grouping, NAMED[name])

    def counted(pages, *a, **b):
        seen.append(pages.select("doc_id").distinct().count())
        return plain(pages, *a, **b)

    monkeypatch.setattr(grouping, NAMED[name], counted)
    rows = entry.queries()[name](spark, DIR).select("doc_id").distinct().count()
    assert rows == 1650 and seen and max(seen) < 500


WORDS = ["Name:", "Total", "Total 7", "Total 8", "12", "13", "7", "1", "11", "l1", "No. 12 No. 13", "No. 12 No. 12", "Date 3/3", "Date 3/4", "12/03/2024", "13/03/2024", "☐", "☐ A 7", "____", "Page 1", "Page 2", "1)", "2) City",
         "10", "No. 7 / 8 of 9", "３ 4", "½ 5", "नाम 5", "E-mail 0", "4,516.95", "-12.50", "a@b.c7", "✓ 8", "31/31/2024", "5 mai 2024", "Customer#000000042", "", " 9", "Signature", "please fill 3 of 4 here", "phone 12 34", "2)"]


@pytest.fixture(scope="module")
def odd(spark):
    """Page rows of odd words: 40 pages, and for each two more that differ from it in some digits only."""
    rng, rows = random.Random(5), []
    for k in range(40):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(1, 9))]
        if k % 4 == 0:
            words += ["Item 3", "Item 3"]
        place = [(at // 3, at % 3) for at in range(len(words))]
        for n in range(3):
            said = words if n == 0 else ["".join(rng.choice("0123456789") if c in "23456789" and rng.random() < 0.6 else c for c in w) for w in words]
            rows += [(3 * k + n, 1, at, r, w, 40.0 + 90 * p, 60.0 + 13 * r, 6.0 * len(w), 12.0) for at, (w, (r, p)) in enumerate(zip(said, place))]
    return layouts.gathered(spark.createDataFrame(rows, "doc_id long, page int, pos int, row int, text string, x double, y double, w double, h double")).localCheckpoint()


@pytest.fixture
def over_odd(monkeypatch, odd):
    pages = lambda spark, d, of_kind=None: odd
    monkeypatch.setattr(queries, "form_pages", pages)
    return pages


def _same(got, want):
    key = lambda r: str(tuple(r))
    assert got.columns == want.columns
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def _alone(pages, candidates, spark):
    """Candidates of every odd page, no two taken for one."""
    return queries._candidates_of(spark, pages, candidates)


def test_odd_pages_are_pruned_alike(spark, over_odd, odd):
    _same(queries.q33b_pruning_search(spark, ""), pruning.prune_search(pruning.evidence(_alone(odd, None, spark))))


def test_odd_pages_are_reported_alike(spark, over_odd, odd):
    catalogue = templates.catalogue(spark)
    sizes = extract.page_sizes(odd.select("doc_id", "page", F.inline(F.arrays_zip("h", "y"))))
    out, plain = (extract.passes(odd, catalogue, search, sizes=sizes) for search in (True, False))
    want = R.quality(out["candidates"], plain["candidates"], out["fields"], plain["fields"])
    got = queries.q50_quality_report(spark, "")
    _same(got.select(want.columns), want)


def test_odd_pages_cost_alike(spark, over_odd, odd):
    size = lambda c: B.estimate_tokens(F.coalesce(c, F.lit("")))
    c = queries.with_options(pruning.numbered_both(pruning.evidence(_alone(odd, None, spark))))
    want = c.groupBy("doc_id").agg(size(B.prompt(F.col("kept_id"))).alias("sent"), size(B.prompt(F.col("field_id"))).alias("unpruned"))
    got = service_queries.q66_token_report(spark, "")
    _same(got.select("doc_id", (F.col("prompt_sent") - 50).alias("sent"), (F.col("prompt_unpruned") - 50).alias("unpruned")), want)


def test_odd_pages_are_asked_and_normalised_alike(spark, over_odd, odd):
    c = _alone(odd, None, spark).select("doc_id", "candidate_id", "label", "value", "has_box")
    asked = templates.questions(c, templates.catalogue(spark))
    _same(queries.q51_questions(spark, ""), pruning.add_options(asked))
    _same(queries.q52_normalised_fields(spark, ""), N.normalise_fields(asked.withColumns({"original_label": F.col("label"), "needs_review": F.lit(False)})))


def test_odd_pages_go_through_the_run_alike(spark, odd):
    catalogue = templates.catalogue(spark)
    sizes = extract.page_sizes(odd.select("doc_id", "page", F.inline(F.arrays_zip("h", "y"))))
    want = N.normalise_fields(B.pass_through(extract.passes(odd, catalogue, sizes=sizes)["fields"]).withColumn("original_label", F.col("label")))
    got = extract.fields_by_print(odd, catalogue)
    _same(got, want.select(got.columns))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_documents_like_forms_go_through_the_run(spark, monkeypatch, tmp_path):
    """Only documents that pass the gate become tokens, and their fields are those of the run over all tokens."""
    for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey")):
        spark.read.parquet(f"{DIR}/{t}.parquet").orderBy(k).limit(3).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    texts = ["Name: ____\nDate: 12/03/2024\nCity:\n\nTotal: 7", "Name: ____\nDate: 13/03/2024\nCity:\n\nTotal: 8", "الاسم: ٣\nCity: 4", "words of plain prose that go on " * 40, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 20_000_000_000)
    own = forms.all_tokens(spark, str(tmp_path))
    t = tokens.reflow(docs).unionByName(own).withColumn("pos", F.row_number().over(extract.reading_order()) - 1)
    want = extract.run(t, docs.select("doc_id").unionByName(own.select("doc_id").distinct()), templates.catalogue(spark))["fields"]
    seen, plain = [], tokens.reflow
    monkeypatch.setattr(tokens, "reflow", lambda d: (seen.append(d.count()), plain(d))[1])
    got = service_queries.q74_form_run(spark, str(tmp_path))
    _same(got, want.select(got.columns))
    assert seen == [got.filter("doc_id >= 20000000000").select("doc_id").distinct().count()] and seen[0] > 1


def test_labels_without_letters_keep_their_case(spark):
    given = ["12/03/2024", "-12.50", "", "a 7", "12 of 3", "7\n", "e-mail 7", "№ 7"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(given)), "k int, t string").orderBy("k").select(N.title_case(F.col("t"))).collect()]
    assert got == ["12/03/2024", "-12.50", "", "A 7", "12 of 3", "7", "E-Mail 7", "№ 7"]


def test_doubtful_prints_are_done_by_their_words(spark):
    """Two labels that differ from page to page in whether they are the same."""
    rows = [(k, 1, at, 0, w, 40.0 + 90 * at, 60.0, 36.0, 12.0) for k, ws in enumerate([("Item 3", "Item 3"), ("Item 3", "Item 4"), ("Item 5", "Item 5")]) for at, w in enumerate(ws)]
    pages = layouts.gathered(spark.createDataFrame(rows, "doc_id long, page int, pos int, row int, text string, x double, y double, w double, h double"))
    step = lambda p: p.select("doc_id", F.struct(F.size(F.array_distinct("text")).alias("n"), (F.get("text", F.lit(0)) == F.get("text", F.lit(1))).alias("twin")).alias("found"))
    got = {d: {r.doc_id: r.found.n for r in layouts.prints(pages, step, F.lit(1), doubt=d and F.col(d)).collect()} for d in (None, "found.twin")}
    assert got == {None: {0: 1, 1: 1, 2: 1}, "found.twin": {0: 1, 1: 2, 2: 1}}

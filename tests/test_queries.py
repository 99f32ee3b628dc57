"""Every query with an oracle against DuckDB on the smallest tables, and the entry point."""

import os

import pytest

import __spark_entry__ as entry
from formloom.plans import forms as spark_forms

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    key = lambda r: tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    got = sorted(key(r) for r in df.select(sorted(df.columns)).collect())
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    order = [names.index(n) for n in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(key([r[k] for k in order]) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.fixture(scope="module")
def forms(spark, tmp_path_factory):
    """A folder of three customers and four orders, and the ids of their seven forms."""
    folder = f"file://{tmp_path_factory.mktemp('forms')}"
    c, o = (spark.read.parquet(f"{DIR}/{t}.parquet").orderBy(k).limit(n) for t, k, n in (("customer", "c_custkey", 3), ("orders", "o_orderkey", 4)))
    c.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    o.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder, {r[0] for r in c.select("c_custkey").collect()} | {10_000_000_000 + r[0] for r in o.select("o_orderkey").collect()}, {10_000_000_000 + r.o_orderkey: r for r in o.collect()}


def test_all_forms_are_pruned_asked_and_normalised(spark, forms):
    folder, ids, orders = forms
    got = {n: entry.queries()[n](spark, folder).collect() for n in ("q33b_pruning_search", "q36_prompt", "q51_questions", "q52_normalised_fields")}
    for n, rows in got.items():
        assert {r.doc_id for r in rows} == ids, n
    boxes = [r for r in got["q51_questions"] if r.doc_id in orders and r.label.startswith("Priority")]
    assert len(boxes) == len(orders) and {r.type for r in boxes} == {"checkbox"}
    # the forms' wide gaps part a date from its label, so it is a candidate of its own
    assert all(any(r.label == f"{o.o_orderdate:%d/%m/%Y}" for r in got["q52_normalised_fields"] if r.doc_id == k) for k, o in orders.items())
    lines = {r.doc_id: r.prompt.split("\n") for r in got["q36_prompt"]}
    assert all(any(f"|{r.o_orderdate:%d/%m/%Y}|" in x for x in lines[k]) for k, r in orders.items())


def test_all_forms_are_grouped_and_reported(spark, forms):
    folder, ids, orders = forms
    got = {n: entry.queries()[n](spark, folder).collect() for n in ("q27_row_clustering", "q29_grouping_search", "q50_quality_report")}
    for n, rows in got.items():
        assert {r.doc_id for r in rows} == ids, n
    tokens = spark_forms.all_tokens(spark, folder).collect()
    places = {i: iter(sorted((r.row, r.pos) for r in tokens if r.doc_id == i)) for i in ids}
    want = sorted((i, k, row, pos) for i in ids for k, (row, pos) in enumerate(places[i]))
    assert sorted((r.doc_id, r.pos, r.row_no, r.place) for r in got["q27_row_clustering"]) == want
    assert all(any(r.has_box for r in got["q29_grouping_search"] if r.doc_id == i) for i in orders)


def test_replies_are_merged_whole(spark, tmp_path):
    long = "the same first thirty characters of every text, "
    said = [(c, k, "user" if k % 2 else "assistant", f"{long * 30}{c} {k}") for c in (1, 2) for k in range(1, 6)]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = {(c, k): s for c, k, _, s in said}
    got = {(r.doc_id, r.field_id): r for r in entry.queries()["q34_merge_replies"](spark, f"file://{tmp_path}").collect()}
    assert {k: (r.label, r.value) for k, r in got.items()} == {(c, f"f_{k:03d}"): (text[c, k], text.get((c, k + 1), "")) for c in (1, 2) for k in (1, 3, 5)}

"""The incremental search kernel against the plain one: same states, costs, steps and evaluations."""

import random
import time

import pytest

from formloom.operators import grouping, pruning

from tests import plain_search as plain
from tests.test_baseline import random_pages


def split(seed, n):
    toks, lines, sizes = random_pages(seed, n)
    for doc, _, width, _ in sizes:
        mine = [t for t in toks if t[0] == doc]
        yield mine, width, [line[2:] for line in lines if line[0] == doc]


def page_of(toks, width, lines):
    return grouping.Page([t[4] for t in toks], [t[5] for t in toks], [t[6] for t in toks], [t[7] for t in toks], [t[8] for t in toks], [t[10] for t in toks], width, lines)


def test_same_search_as_the_plain_kernel():
    for n, (toks, width, lines) in enumerate(split(11, 60)):
        want, other = plain.searched([plain.Tok(t[4], t[5], t[6], t[7], t[8], t[10]) for t in toks], width, lines, 3, 40, n)
        page = page_of(toks, width, lines)
        got = page.search(3, 40, n)
        said = lambda ks: " ".join(page.text[k] for k in ks)
        pieces = [(said(p.label), said(p.value), p.sep, p.score) for r, cuts in enumerate(got.state) for p in page.pieces(r, cuts)]
        assert pieces == want
        assert (got.iterations, got.evaluations) == (other.iterations, other.evaluations)
        assert got.cost == pytest.approx(other.cost, abs=1e-9) and got.start_cost == pytest.approx(other.start_cost, abs=1e-9)


def test_a_moves_cost_is_the_new_states_cost():
    for toks, width, lines in split(5, 12):
        page = page_of(toks, width, lines)
        state = page.plain()
        row, cuts, cost, tried = page.best_move(state, page.cost(state))
        assert tried == sum(len(list(plain_moves(c, len(g)))) for c, g in zip(state, page.gaps))
        if row >= 0:
            assert page.cost([*state[:row], cuts, *state[row + 1 :]]) == pytest.approx(cost, abs=1e-9)


def plain_moves(cuts, n):
    for k in range(n):
        yield cuts ^ 1 << k
        if cuts >> k & 1:
            yield from (1 for j in (k - 1, k + 1) if 0 <= j < n and not cuts >> j & 1)


def test_an_evaluation_is_cheap():
    """65 tokens, as the sample page: a generous bound that only a kernel which looks at every row again would miss."""
    toks, k = [], 0
    for row in range(17):
        x = 40.0
        for text in ["Label", "Name:", "value", "____"][: 4 if row % 5 else 3]:
            toks.append((0, 1, row, k, text, x, 40.0 + 30 * row, 6.0 * len(text), 12.0, 1.0, False))
            x += 6.0 * len(text) + (5.0 if k % 3 else 60.0)
            k += 1
    best = min(timed(lambda: page_of(toks, 600.0, []).search(6, 150, 0)) for _ in range(3))
    assert best < 30e-6


def timed(run):
    began = time.process_time()
    got = run()
    return (time.process_time() - began) / got.evaluations


def test_cluster_rows_by_hand():
    x, middle = [50.0, 10.0, 12.0, 90.0, 10.0], [10.0, 12.0, 30.0, 33.0, 200.0]
    assert grouping.cluster_rows(x, middle, 5.0) == [[1, 0], [2, 3], [4]]
    assert grouping.cluster_rows([], [], 5.0) == []


def test_same_pruning_as_the_plain_kernel():
    rng = random.Random(3)
    for n in range(80):
        size = rng.choice([1, 2, 5, 12, 25])
        junk, genuine = ([round(rng.random(), rng.choice([1, 3])) for _ in range(size)] for _ in range(2))
        band = [rng.randrange(5) for _ in range(size)]
        near = sorted({(a, b) for a, b in ((rng.randrange(size), rng.randrange(size)) for _ in range(size)) if a < b})
        want = plain.pruned(junk, genuine, band, near, 3, 40, n)
        got = pruning.Choice(junk, genuine, band, near).search(3, 40, n)
        assert frozenset(k for k, kept in enumerate(got.state) if kept) == want.state
        assert (got.iterations, got.evaluations) == (want.iterations, want.evaluations)
        assert got.cost == pytest.approx(want.cost, abs=1e-9) and got.start_cost == pytest.approx(want.start_cost, abs=1e-9)


def test_pages_cross_batches(spark):
    """Pages in order, whole, whatever the size of Arrow's batches."""
    rows = [(d, p, k, "x") for d in range(7) for p in (1, 2) for k in range(d + 3)]
    t = spark.createDataFrame(rows, "doc_id long, page int, pos int, text string").repartition(5)
    step = lambda p: [(p["doc_id"][0], p["page"][0], len(p["pos"]), float(p["pos"] == list(range(len(p["pos"])))))]
    for size in ("1", "4", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted(map(tuple, grouping.map_pages(t, step, "doc_id long, page int, n int, ok double").collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == [(d, p, d + 3, 1.0) for d in range(7) for p in (1, 2)]
    assert grouping.map_pages(t.limit(0), step, "doc_id long, page int, n int, ok double").count() == 0

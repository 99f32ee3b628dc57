"""Source audit, collocations and page text against brute force, on small tables with nulls, empties, ties and repeats."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from formloom.llm import collocations, page_text, source_audit
from formloom.llm.common import translated

SCHEMA = "doc_id long, lang string, source string, text string, value string, n long"


def rows_of(seed=3, n=90):
    rng = random.Random(seed)
    words = ["the", "Of", "ÉON", "été", "x", "İz", "und", "naïve", "東京", "re-do", "a1b"]
    out = [(0, None, None, None, "v", 1), (1, "en", None, "", "v", 1), (2, "en", "s1", " .,;\t\n ", "v", 1), (3, "", "s1", "alone", None, None), (4, "xx", "lonely", "no twin", None, 2)]
    for k in range(5, n):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "s10", "é", None])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", "\t", ", ", "  "]) for _ in range(rng.randrange(60)))
        out.append((k, lang, source, text, "v", k))
    out += [out[9], out[9], (9, "en", "s2", "the of the " * 400, "v", 0)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_audit(rows, min_docs, top):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, lang, source, text, *_ in rows]
    df, total, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in texts:
        df[lang].update(set(terms))
        groups[lang].add(source)
        total[lang].update(terms)
        count[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        q, p = share(total[lang]), {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:limit], 1)]
    return out


@pytest.mark.parametrize("min_docs, top", [(3, 200), (1, 4), (100, 5)])
def test_audit_is_the_sum_over_all_terms(docs, rows, min_docs, top):
    got = [tuple(r) for r in source_audit.audit(docs, min_docs, top).collect()]
    assert sorted(got) == sorted(brute_audit(rows, min_docs, top))


def test_audit_hands_counts_on_when_many_keys_are_held(docs, rows, monkeypatch):
    counts = lambda: sorted(tuple(r) for r in source_audit.postings(docs, 1).collect())
    whole = counts()
    batch = docs.select("lang", "source", "text").limit(0).toArrow()  # the names only
    assert batch.num_rows == 0
    monkeypatch.setattr(source_audit, "HELD", 5)
    monkeypatch.setattr(source_audit, "PIECE", 7)
    import pyarrow as pa

    table = pa.table({"lang": ["en"] * 3, "source": ["a", "b", "a"], "text": ["Aa bb aa cc dd ee", "aa ff gg hh ii jj kk ll", "bb bb " * 5]})
    got = Counter()
    for part in source_audit._count(iter(table.to_batches())):
        for r in part.to_pylist():
            got[r["source"], r["term"]] += np.array([r["n"], r["docs"]])
    assert got["a", "aa"].tolist() == [2, 1] and got["a", "bb"].tolist() == [11, 2] and got["b", "ll"].tolist() == [1, 1]
    assert whole


def test_audit_of_nothing(none):
    assert source_audit.audit(none).collect() == []
    assert source_audit.audit(none).columns == ["lang", "source", "part", "item", "value", "rank"]


def brute_phrases(rows, min_count, report):
    counts, total = defaultdict(Counter), Counter()
    for _, lang, _, text, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        inside = lambda s, g: any(g[i : i + len(s)] == s for i in range(len(g) - len(s) + 1))
        frequent = [g for g in f if len(g) > 1 and f[g] >= min_count]
        mine = []
        for g in frequent:
            if any(len(h) > len(g) and inside(g, h) and 100 * f[h] >= 80 * f[g] for h in frequent):
                continue
            score, _, l, r = min((2_000_000 * f[g] // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            mine.append((score, f[g], " ".join(g), l, r))
        mine.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, rank, phrase, a, l, r, total[lang], score) for rank, (score, a, phrase, l, r) in enumerate(mine[:report], 1)]
    return out


@pytest.mark.parametrize("min_count, cells, chunk", [(5, 1 << 12, 6_000_000), (2, 1 << 16, 50), (30, 8, 300), (300, 1 << 14, 64)])
def test_collocations_at_any_width_and_chunk(docs, rows, min_count, cells, chunk):
    got = [tuple(r) for r in collocations.collocations(docs, min_count, 40, cells, chunk).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, min_count, 40))


def test_sketch_never_loses_a_frequent_phrase(docs, rows):
    """With 32 cells nearly everything collides; the second count is exact all the same, and of frequent n-grams only."""
    got = {(r.lang, r.phrase): r.a for r in collocations.frequent(docs, 20, 32).filter("k > 0").collect()}
    wide = {(r.lang, r.phrase): r.a for r in collocations.frequent(docs, 20, 1 << 18).filter("k > 0").collect()}
    assert got == wide and min(got.values()) >= 20


def test_collocations_of_nothing(none, spark):
    assert collocations.collocations(none, cells=1 << 10).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA), cells=1 << 10).collect() == []


def test_merged_cells_stop_at_the_cap():
    sketch = np.zeros(4, np.uint8)
    collocations.add(sketch, np.array([1, 2]), 30, np.array([29, 700]))
    collocations.add(sketch, np.array([1, 3]), 30, np.array([29, 1]))
    assert sketch.tolist() == [0, 30, 30, 1]


def test_translated_parts_join_to_the_whole():
    table = bytes(range(256))
    for text in (b"", b"a", b"aa bb  cc " * 9, b"x" * 50 + b" y", b" " * 30, b" lead", b"abcdefgh " + b"z" * 40):
        parts = list(translated(text, table, 8))
        assert b"".join(parts) == text and b" ".join(b" ".join(p.split()) for p in parts).split() == text.split()


# --- pages


def brute_best(crf, scores):
    def value(path):
        return crf.first[path[0]] + crf.last[path[-1]] + sum(scores[k][x] for k, x in enumerate(path)) + sum(crf.move[a][b] for a, b in zip(path, path[1:]))

    paths = list(itertools.product(range(3), repeat=len(scores)))
    return max(paths, key=lambda p: (value(p), [-x for x in p])), np.log(sum(np.exp(value(p)) for p in paths)), value


@pytest.fixture(scope="module")
def model():
    return page_text.default_model()


def test_viterbi_and_likelihood_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    for length in (1, 2, 5):
        crf = page_text.Crf({}, None, rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
        scores = rng.normal(size=(length, 3))
        path, whole, value = brute_best(crf, scores)
        assert tuple(crf.best(scores)) == path
        gold = rng.integers(0, 3, length)
        emit, mask = np.zeros((1, length + 2, 3)), np.zeros((1, length + 2), bool)
        emit[0, :length], mask[0, :length] = scores, True
        labels = np.zeros((1, length + 2), np.int64)
        labels[0, :length] = gold
        got = page_text.likelihood(emit, crf.move, crf.first, crf.last, labels, mask)
        assert got[0] == pytest.approx(value(tuple(gold)) - whole)
        # gradients by differences
        for k, j in ((0, 1), (length - 1, 2)):
            moved = emit.copy()
            moved[0, k, j] += 1e-5
            assert (page_text.likelihood(moved, crf.move, crf.first, crf.last, labels, mask)[0] - got[0]) / 1e-5 == pytest.approx(got[1][0, k, j], abs=1e-3)
        for k, part in ((2, "move"), (3, "first"), (4, "last")):
            at = (1, 2) if part == "move" else (1,)
            args = {n: getattr(crf, n).copy() for n in ("move", "first", "last")}
            args[part][at] += 1e-5
            assert (page_text.likelihood(emit, args["move"], args["first"], args["last"], labels, mask)[0] - got[0]) / 1e-5 == pytest.approx(got[k][at], abs=1e-3)


def test_held_out_pages_are_labelled(model):
    right = blocks = whole = 0
    pages = page_text.labelled_pages(150, seed=991)
    for html in pages:
        leaves = page_text.leaves(html)
        best = model.best(model.scores(page_text.features(leaves)))
        same = [(x.part == page_text.MAIN) == (b == page_text.MAIN) for x, b in zip(leaves, best)]
        right, blocks, whole = right + sum(same), blocks + len(same), whole + all(same)
    assert right / blocks > 0.985 and whole / len(pages) > 0.85


W = "The river rose in the night and the lower town was under water by dawn, said the mayor."
PAGES = {
    "blog": (f'<html><body><header class="site-header"><h1>My Blog</h1><nav><a href=/>Home</a></nav></header><div class="post-content"><h2>Flood</h2><p>{W}</p><p>It was quiet.</p></div><aside class="sidebar"><h3>Recent</h3><ul><li><a href=/1>One more day</a></li></ul></aside><section id="comments"><h3>2 Comments</h3><div class="comment"><p>I was there too and saw it all.</p></div></section><footer>© 2020</footer>', f"Flood\n{W}\nIt was quiet."),
    "inside": (f'<nav><a href=/>Home</a></nav><article><h1>Flood</h1><p>{W}</p><aside><p>Read also our story on the dam that broke.</p></aside><p>{W}</p><div class="comments"><p>I disagree with the mayor, the dam was at fault.</p></div></article><div class="notice">This site will be down on Monday.</div><footer>&copy; x</footer>', f"Flood\n{W}\n{W}"),
    "unclosed": (f"<article><h1>A &amp; B &#8212; c&nbsp;d<p>{W}<p><b>All rights reserved.<br>x\n\t y</b><script>var t='</p><p>no';</script><style>p{{}}</style></article><footer>&copy; site", f"A & B — c d\n{W}\nAll rights reserved. x y"),
    "main": (f'<div class="cookie-notice"><p>We use cookies to improve your visit.</p><button>OK</button></div><main><h1>Flood</h1><p>{W}</p><div class="ad">Buy the best boots in the world today.</div><p>{W}</p></main><form><label>Your email</label><button>Subscribe</button></form><footer><p>Contact</p></footer>', f"Flood\n{W}\n{W}"),
    "text": (W, W),
}


@pytest.mark.parametrize("name", PAGES)
def test_usual_layouts(model, name):
    html, text = PAGES[name]
    assert model.text(html) == text


def test_odd_pages(spark, model):
    deep = "<div>" * 30_000 + f"<p>{W}" + "<b>" * 2000
    odd = [None, "", "   ", "<", "<>", "</p></div>", "<p", "<![foo[x]]>", "<!-- never closed", "<script>x", "a&#0;b", "<a href='x>" + W, deep, "<article>" + f"<p>{W}</p>" * 3000 + "</article>"]
    rows = [(k, None if k == 1 else f"u{k}", x, "extra", "t") for k, x in enumerate(odd)] + [(0, "u0", None, "", "")] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = {r.page_id: r for r in page_text.extract(frame, model).collect()}
    assert page_text.extract(frame, model).count() == len(rows) and got[1].url is None
    assert got[0].text == "" and got[2].text == "" and got[12].text == W and got[13].text == "\n".join([W] * 3000)
    assert all(r.n_chars == len(r.text) for r in got.values())
    none = page_text.extract(frame.limit(0), model)
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_chars"]


def test_labels_of_ones_own_fit():
    """Labelled pages of another kind: here the article is what stands in lists."""
    pages = [f"<ul data-part=main><li>{W} {k}</li></ul><p>{W}</p>" for k in range(30)]
    crf = page_text.fit(pages, rounds=60)
    assert crf.text("<p>other words here</p><ul><li>these</li><li>and these</li></ul>") == "these\nand these"
    assert page_text.fit([]).text("<p>x</p>") == ""

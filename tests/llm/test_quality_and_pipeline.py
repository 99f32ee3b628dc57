"""Divergence rules, co-training and the pipeline against brute force and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import cotrain, divergence
from tests.llm.test_corpus_ops import WORD, jaccard_groups, removed_bytes

P = pytest.importorskip("public_tokenizers")
EN = "the of and to in is that for with as ation ing stre ment oure thing heed".split()
FR = "le la de et les des en un une que eaux ment éche tion oire ère çon".split()


def prose(rng, words, n):
    out = []
    while len(out) < n:
        s = [rng.choice(words) + (rng.choice(words[10:]) if rng.random() < 0.4 else "") for _ in range(rng.randrange(5, 14))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + rng.choice([".", ".", ".\n"])]
    return " ".join(out[:n])


def rows(n=160, seed=4):
    """(doc_id, text, lang, source, n_chars, good)"""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        t, good = prose(rng, EN if lang == "en" else FR, rng.randrange(60, 200)), 1
        kind = rng.random()
        if kind < 0.15:
            t, good = " ".join(w + rng.choice(["###", "$$$", "***", "&&&"]) for w in t.split()), 0
        elif kind < 0.25:
            t, good = t.upper().replace(" ", "!! "), 0
        elif kind < 0.3:
            t, good = " ".join(w for w in t.split() for _ in range(5)), 0
        elif kind < 0.4:
            t += " idiot moron"
            good = 2
        out.append((i, t, lang, f"src{i % 5}", len(t), good))
    out += [(n, None, None, None, None, 1), (n + 1, "", "en", None, 0, 1), (n + 2, "a b c a b c a b", "xx", "s", 15, 1), (n + 3, "x y\nx y\n \n \nz\nx y", "en", "s", 18, 1)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r[:5] for r in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], int(r[5] > 0), int(r[5] == 2)) for r in rows() if r[0] % 4] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for k, g in enumerate(grams) if n[g] > 1 for j in (k, k + 1, k + 2)}
    lines, again = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            again += x in lines
            lines.add(x)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), failed


def histograms(text):
    t = text or ""
    kinds = [0.0] * len(divergence.CLASSES)
    for c in t:
        k = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\f\r" else 4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>" else 6 if ord(c) > 127 else 7
        kinds[k] += 1
    vocabulary = sorted({w for ws in divergence.COMMON_WORDS.values() for w in ws})
    w = Counter(WORD.findall(t))
    words = [float(w[v]) for v in vocabulary]
    words.append(sum(w.values()) - sum(words))
    share = lambda x: [v / sum(x) if sum(x) else 0.0 for v in x]
    return share(kinds), share(words)


def jensen_shannon(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(0.0, total))


def test_divergence_rules(docs, spark):
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}
    by_lang = defaultdict(list)
    for r in rows():
        assert (got[r[0]].n_words, got[r[0]].word_chars, got[r[0]].n_symbols, got[r[0]].n_dup_lines, got[r[0]].n_repeat_words, got[r[0]].base_failed) == base(r[1]), r[1]
        if r[2] in divergence.COMMON_WORDS and not base(r[1])[5] and len(r[1]) >= divergence.MIN_CHARS and base(r[1])[0] >= divergence.MIN_WORDS:
            by_lang[r[2]].append(histograms(r[1]))
    mean = lambda hs, k: [sum(h[k][j] for h in hs) / len(hs) for j in range(len(hs[0][k]))]
    refs = [(mean(hs, 0), mean(hs, 1)) for hs in by_lang.values()]
    for r in rows():
        p, q = histograms(r[1])
        near = min((jensen_shannon(p, a) + jensen_shannon(q, b), jensen_shannon(p, a), jensen_shannon(q, b)) for a, b in refs)
        assert got[r[0]].char_distance == pytest.approx(near[1], abs=1e-9)
        assert got[r[0]].word_distance == pytest.approx(near[2], abs=1e-9)
        n = len(r[1] or "")
        kept = not base(r[1])[5] and (n < divergence.MIN_CHARS or near[1] <= divergence.MAX_CHAR_DISTANCE + divergence.SHORT / math.sqrt(n)) and (base(r[1])[0] < divergence.MIN_WORDS or near[2] <= divergence.MAX_WORD_DISTANCE)
        assert got[r[0]].kept == kept
    # on either side of both guards: foreign words are judged from MIN_WORDS on, foreign characters from MIN_CHARS on
    words = [f"zu{a}{b}" for a in "bcdfghkl" for b in "mnprstvw"]
    near_en = lambda n: " ".join(["y" if k % 2 else w.capitalize() + "." if k % 8 == 0 else w + "###" if k % 8 == 4 else w for k, w in enumerate(words[:n])]).ljust(divergence.MIN_CHARS + 9, "s")
    odd = [(9001, near_en(divergence.MIN_WORDS - 1), "en"), (9002, near_en(divergence.MIN_WORDS), "en"),
           (9003, " ".join("éè" + w[2:4] for w in words[:55]), "en"), (9004, " ".join("éèêëà" + w[2:4] for w in words[: divergence.MIN_WORDS + 3]), "en")]
    more = {r.doc_id: r for r in divergence.judge(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))).filter("doc_id > 9000").collect()}
    assert not any(r.base_failed for r in more.values()) and len(odd[2][1]) < divergence.MIN_CHARS <= len(odd[3][1])
    assert (more[9001].kept, more[9002].kept, more[9003].kept, more[9004].kept) == (True, False, True, False)
    assert divergence.judge(docs.limit(0)).count() == 0
    clash = docs.withColumns({"r1": F.lit(1), "words": F.lit(2), "p": F.lit(3)})
    assert divergence.judge(clash).count() == len(rows())


def test_divergence_plan_is_native(docs):
    plan = divergence.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cotraining_on_held_out_labels(docs, labels):
    got = {r.doc_id: r for r in cotrain.classify(docs, cotrain.good_labels(labels)).collect()}
    held = [r for r in rows() if r[0] % 4 == 0 and r[1]]
    right = sum(got[r[0]].q_kept == (r[5] == 1) for r in held)
    assert len(got) == len(rows()) and right / len(held) > 0.85
    again = {r.doc_id: r for r in cotrain.classify(docs.repartition(7), cotrain.good_labels(labels)).collect()}
    assert all(abs(again[k].q_score - got[k].q_score) < 1e-6 for k in got)


def test_cotraining_without_labels(docs, labels):
    got = cotrain.classify(docs, cotrain.good_labels(labels.limit(0)))
    assert got.filter("q_kept and q_score = 0.5").count() == len(rows())
    assert cotrain.classify(docs.limit(0), cotrain.good_labels(labels)).count() == 0


def test_cotraining_takes_pseudo_labels_from_all_unlabelled(spark, monkeypatch):
    """2,400 unlabelled documents: each round's choice is the surest of all of them, and words count all labelled ones."""
    data = [(i, *rows()[i % 160][1:]) for i in range(2600)]
    docs = spark.createDataFrame([r[:5] for r in data], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(r[0], r[5] == 1) for r in data[:200]], "doc_id long, good boolean")
    asked, counted, count = [], [], cotrain.telling_words
    monkeypatch.setattr(cotrain, "telling_words", lambda known, n0, n1: counted.append((known.count(), n0 + n1)) or count(known, n0, n1))
    fitted = cotrain.CoTrained.fit

    def fit(self, a, b, y, held, surest, rounds=3):
        def spied(at, each, gone):
            got = surest(at, each, gone)
            asked.append((at.a, at.b, each, set(gone.tolist()), got))
            return got

        return fitted(self, a, b, y, held, spied, rounds)

    monkeypatch.setattr(cotrain.CoTrained, "fit", fit)
    model = cotrain.fit(docs, labels, max_labelled=150)
    assert counted and counted[0][0] == counted[0][1] > 112  # three quarters of 200, not of the 150 sampled
    text = [r[1] or "" for r in data[200:]]
    shape, doc, words = cotrain.shape_features(cotrain.pa.array(text))
    layout = cotrain.size_columns([r[4] for r in data[200:]])
    a = cotrain.text_columns(shape.astype(np.float32), model.presence(doc, words, len(text)))
    b = np.column_stack((layout.astype(np.float32), cotrain.meta_columns(cotrain.meta_codes([r[3] for r in data[200:]], [r[2] for r in data[200:]]))))
    for view_a, view_b, each, gone, (by_a, by_b) in asked:
        for view, x, (ids, _, _, label), taken in ((view_a, a, by_a, gone), (view_b, b, by_b, gone | set(by_a[0].tolist()))):
            z = {200 + k: v for k, v in enumerate(view.logit(x)) if 200 + k not in taken}
            sure = sorted((abs(v) for v in z.values() if abs(v) >= math.log(0.97 / 0.03)), reverse=True)[:each]
            assert sorted((abs(z[k]) for k in ids.tolist()), reverse=True) == pytest.approx(sure, abs=1e-4)
            assert [int(z[k] > 0) for k in ids.tolist()] == label.tolist()
    assert len(asked[0][4][0][0])


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    data, rng = rows(), random.Random(2)
    shared = prose(rng, EN, 30)
    data += [(1000 + i, data[i][1], data[i][2], "copy", data[i][4], data[i][5]) for i in range(0, 30, 3)]
    data += [(2000 + i, prose(rng, EN, 70) + " " + shared + " " + prose(rng, EN, 20), "en", "src1", 500, 1) for i in range(12)]
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([r[:5] for r in data], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[5] > 0), int(r[5] == 2)) for r in data if r[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "mixing sources", "packing"]
    step, at = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, f) in enumerate(pipeline.STAGES):
        out = f(spark, at, folder)
        out.write.parquet(f"{folder}/stage{k}")
        at = spark.read.parquet(f"{folder}/stage{k}")
        if k < 4:
            assert at.columns == docs.columns
        step[k] = at.collect()
    kept = [(r.doc_id, r.text, r.source) for r in step[0]]
    assert len([r for r in step[0] if r.doc_id >= 2000]) == 12
    want = {d for d, (_, _, keep) in jaccard_groups(kept, 80).items() if keep}
    assert {r.doc_id for r in step[1]} == want
    before = [(r.doc_id, r.text, r.source) for r in step[1]]
    gone = removed_bytes(before)
    for r in step[2]:
        assert len((r.text or "").encode()) <= gone[r.doc_id][0] - gone[r.doc_id][1]
        if not gone[r.doc_id][1]:
            assert r.text == (dict((b[0], b[1]) for b in before)[r.doc_id] or "")
    assert any(g[1] for g in gone.values())
    times = Counter(r.doc_id for r in step[3])
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in step[2]}
    assert set(times) <= {d for d, n in words.items() if n} and max(times.values()) <= 3
    tokens = defaultdict(int)
    for r in step[4]:
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(times)
    one = pipeline.run(spark, folder)
    assert sorted(map(tuple, one.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in step[4])


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, columns named as the operators' own, and empty tables."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    text = prose(rng, EN, 90)
    odd = [(None, text, "en", "s", 5), (None, None, None, None, None), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, "", "en", None, 0), (3, prose(rng, EN, 80), None, "s", None), (4, text.replace("the", "xx", 1), "en", "t", 7)]
    spark.createDataFrame([(i, 1, 0) for i in (1, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["q_text", "q_kept", "mix_rest", "mix_taken", "mix_key", "lpf_th", "n", "label", "component_id", "row", "doc", "col"]
    docs = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit("own") for c in names})
    folder = f"file://{tmp_path}"
    at = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, at, folder)
        out.write.parquet(f"{folder}/odd{k}")
        at = spark.read.parquet(f"{folder}/odd{k}")
        rows_ = at.collect()
        if k < 4:
            assert at.columns == docs.columns and all(r[c] == "own" for r in rows_ for c in names), name
        if k == 0:
            assert len(rows_) == len(odd)  # one class only: all are kept
        if k in (1, 2):  # the rows of document 1 stay together, 4 goes as their near copy; rows without an id stay
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows_) == [(False, 1), (False, 1), (False, 2), (False, 3), (True, 0), (True, 0)], name
        if k == 3:
            assert all((r.text or "").strip() for r in rows_) and len({r.doc_id for r in rows_}) >= 2
        if k == 4:
            assert rows_ and all(r.length > 0 for r in rows_)

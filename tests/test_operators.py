"""Operators on small pages, with the semantics the catalogue's SQL cannot reach."""

import random

import pytest
from pyspark.sql import functions as F

from formloom.operators import boundary, climb, evaluation, gate, grouping, layout, pruning, report, service, store, templates, tokens
from formloom.plans import extract

TOKEN = "doc_id long, page int, row int, pos int, text string, x double, y double, w double, h double, confidence double"


def page(rows, doc=1):
    """rows: lists of (text, x) with y and h; widths 6 a character."""
    out, pos = [], 0
    for r, (y, h, words) in enumerate(rows):
        for text, x in words:
            out.append((doc, 1, r, pos, text, float(x), float(y), 6.0 * len(text), float(h), 1.0))
            pos += 1
    return out


FORM = page([
    (30, 20, [("APPLICATION", 200), ("FORM", 290)]), (90, 12, [("Name:", 40), ("____________", 100)]), (120, 12, [("Date", 40), ("of", 68), ("Birth:", 84)]),
    (150, 12, [("Gender:", 40), ("☐", 100), ("Male", 115), ("☐", 150), ("Female", 165)]), (180, 12, [("City:", 40), ("Paris", 80), ("Phone:", 300), ("______", 350)]),
    (210, 12, [("Signature", 40), ("________", 200)]), (830, 9, [("Page", 280), ("1", 310)]),
])
PROSE = page([(40 + 18 * k, 12, [(w, 40 + 50 * i) for i, w in enumerate("several words of running prose make a long line here".split())]) for k in range(12)], doc=2)


@pytest.fixture(scope="module")
def both(spark):
    return spark.createDataFrame(FORM + PROSE, TOKEN).repartition(3).cache()


def test_gate_tells_form_from_prose(spark, both):
    g = gate.decide(gate.signals(tokens.with_gaps(both)).withColumn("score", gate.score()))
    got = {r.doc_id: r for r in g.collect()}
    assert got[1].is_form and got[1].score >= gate.ACCEPT and not got[2].is_form
    verdicts = spark.createDataFrame([(1, False, 0.9), (2, True, 0.9)], "doc_id long, v_form boolean, v_confidence double")
    again = {r.doc_id: r for r in gate.decide(g.select("doc_id", "score"), verdicts).collect()}
    assert again[1].is_form and not again[2].is_form and not again[1].used_classifier
    middle = gate.decide(spark.createDataFrame([(1, 0.4), (2, 0.5)], "doc_id long, score double"), verdicts)
    assert [(r.is_form, r.used_classifier) for r in middle.orderBy("doc_id").collect()] == [(False, True), (True, True)]


def test_rows_cluster_despite_jitter(spark):
    moved = [(*t[:6], t[6] + (t[3] * 7 % 5), *t[7:]) for t in FORM]
    got = grouping.row_clusters(spark.createDataFrame(moved, TOKEN)).collect()
    want = {t[3]: t[2] for t in FORM}
    assert {r.pos: r.row_no for r in got} == want


def test_search_finds_labels_and_keeps_every_token(both):
    got = grouping.group_pages(both).filter("doc_id = 1").collect()
    labels = {r.label for r in got}
    assert {"Name:", "Date of Birth:", "City:", "Phone:", "Signature"} <= labels
    gender = next(r for r in got if r.label.startswith("Gender"))
    assert "Male" in gender.value + gender.label and "Female" in gender.value + gender.label
    used = sorted(k for r in got for k in [*r.label_tokens, *r.value_tokens])
    assert used == sorted(t[3] for t in FORM)
    assert all(r.pass_cost <= r.pass_start_cost for r in got)


def test_search_does_not_depend_on_partitions(both):
    key = lambda d: sorted((r.doc_id, r.candidate_id, r.label, r.value) for r in grouping.group_pages(d).collect())
    assert key(both) == key(both.repartition(1)) == key(both.repartition(7))


def test_baseline_agrees_with_the_kernel(both):
    t = tokens.with_gaps(both)
    a = sorted((r.label, r.value, r.separator) for r in grouping.baseline(t).collect())
    b = sorted((r.label, r.value, r.separator) for r in grouping.group_pages(both, search=False).collect())
    assert a == b


def test_right_to_left_rows(spark):
    t = [(1, 1, 0, 0, "________", 40.0, 90.0, 48.0, 12.0, 1.0, False), (1, 1, 0, 1, "الاسم:", 500.0, 90.0, 36.0, 12.0, 1.0, True)]
    got = grouping.group_pages(spark.createDataFrame(t, TOKEN + ", rtl boolean")).collect()
    assert any(r.label == "الاسم:" and r.has_separator for r in got)


def test_ruled_line_and_blank_below(spark):
    t = spark.createDataFrame(page([(90, 12, [("Remarks", 40)]), (120, 12, [("Address", 520), ]), (140, 12, [("__________", 520)])]), TOKEN)
    lines = spark.createDataFrame([(1, 1, 120.0, 103.0, 300.0, 1.0)], "doc_id long, page int, x double, y double, w double, h double")
    got = {r.label: r for r in grouping.group_pages(t, lines=lines, search=False).collect()}
    assert got["Remarks"].separator == "line" and got["Address"].separator == "blank"


def test_climb_reaches_the_minimum():
    run = climb.descend(40, lambda s: (s - 7) ** 2, lambda s: (s - 1, s + 1), 100)
    assert (run.state, run.cost, run.start_cost) == (7, 0, 33**2) and run.iterations == 34
    bumpy = lambda s: min((s - 5) ** 2, (s - 60) ** 2 - 10)
    assert climb.restarts(lambda r: r.randrange(100), bumpy, lambda s: (s - 1, s + 1), 12, 200).cost == -10


def candidates(spark, rows):
    base = dict(value="", page_height=850.0, strength=0.0, template_key=None, has_separator=False, has_box=False, separator="", grouping_score=0.55, region_w=0.0, prose_row=False, label_h=12.0, label_confidence=1.0, mh=12.0, y=300.0)
    kinds = "doc_id long, page int, candidate_id string, label string, value string, page_height double, strength double, template_key string, has_separator boolean, has_box boolean, separator string, grouping_score double, region_w double, prose_row boolean, label_h double, label_confidence double, mh double, y double, x double, w double, h double"
    names = [c.split()[0] for c in kinds.split(", ")]
    full = [{**base, "doc_id": 1, "page": 1, "candidate_id": f"c{k}", "x": 40.0, "w": 100.0, "h": 12.0, **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], kinds)


def test_pruning_drops_titles_and_page_numbers(spark):
    c = pruning.evidence(candidates(spark, [
        dict(label="APPLICATION FORM", y=30.0, label_h=30.0), dict(label="Name:", has_separator=True, separator="colon", strength=1.0, template_key="full_name", y=100.0), dict(label="Page 1", y=840.0),
        dict(label="Please fill in all of the parts below before you sign.", y=200.0, prose_row=True), dict(label="City:", has_separator=True, separator="colon", y=400.0), dict(label="--", y=500.0),
    ])).cache()
    assert {r.label for r in pruning.keep_plain(c).collect()} == {"Name:", "City:"}
    kept = {r.candidate_id for r in pruning.prune_search(c, pruning.overlaps(c)).collect()}
    assert kept == {"c1", "c4"}
    assert [r.field_id for r in pruning.numbered(pruning.keep_plain(c)).orderBy("field_id").collect()] == ["f_001", "f_002"]


def test_overlap_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [dict(label=rng.choice(["a", "A ", "b"]), x=rng.uniform(0, 100), y=rng.uniform(0, 800), w=rng.uniform(50, 300), h=rng.uniform(5, 300)) for _ in range(60)]
    got = {(r.a, r.b) for r in pruning.overlaps(candidates(spark, rows)).collect()}

    def iou(a, b):
        i = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])) * max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
        return i / (a["w"] * a["h"] + b["w"] * b["h"] - i)

    want = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            x, y = f"c{i}", f"c{j}"
            if x < y and (iou(a, b) > 0.45 or (a["label"].strip().lower() == b["label"].strip().lower() and abs(a["y"] - b["y"]) < 24)):
                want.add((x, y))
    assert got == want


def test_options(spark):
    c = spark.createDataFrame([("Gender:", "☐ Male ☐ Female", True, None, "text"), ("Agree", "☐", True, None, "text"), ("Ok?", "☐ a ☐ b", True, None, "text")], "label string, value string, has_box boolean, template_key string, type string")
    got = {r.label: r for r in pruning.add_options(c.withColumns({"options": F.array().cast("array<string>"), "question": F.lit("q"), "label_en": F.col("label")})).collect()}
    assert got["Gender:"].options == ["Male", "Female"] and got["Gender:"].type == "multiple-choice" and "Gender" in got["Gender:"].question
    assert got["Agree"].type == "checkbox" and got["Ok?"].question == "Ok?"


FIELDS = "doc_id long, field_id string, label string, value string, type string, question string, template_key string, strength double, grouping_score double, options array<string>"


def test_merge_takes_first_known_reply(spark):
    f = spark.createDataFrame([(1, "f_001", "Name", "", "text", "q1", "full_name", 1.0, 0.8, []), (1, "f_002", "Foo", "x", "text", "q2", None, 0.0, 0.8, []), (1, "f_003", "Bar", "", "date", "q3", None, 0.0, 0.1, [])], FIELDS)
    r = spark.createDataFrame([(1, "f_001", 0, "Full Name", "text", "Ann", True, None), (1, "f_001", 1, "Other", "text", "Bob", False, None), (1, "f_009", 2, "?", "text", "?", False, None), (1, "f_002", 3, None, "poem", None, True, ["a"])], "doc_id long, field_id string, at int, label string, type string, value string, review boolean, options array<string>")
    a, b, c = boundary.merge(f, r).orderBy("field_id").collect()
    assert (a.label, a.value, a.needs_review, a.confidence, a.question) == ("Full Name", "Ann", True, 0.9, "q1")
    assert (b.label, b.type, b.value, b.options, b.question) == ("Foo", "text", "x", ["a"], "What is the foo?")
    assert c.needs_review and c.confidence == pytest.approx(0.47)
    sent = f.filter("field_id <> 'f_003'")
    assert boundary.merge(f, r.filter("at < 0"), sent).filter("needs_review").count() == 3


def test_calls_prompts_and_fallbacks(spark):
    f = spark.createDataFrame([(1, "f_002", "Gender", "", "text", "q", "gender", 1.0, 0.8, ["Male", "Female"]), (1, "f_001", "Foo", "x", "text", "q", None, 0.0, 0.8, [])], FIELDS)
    p = boundary.prompts(f)
    assert p.collect()[0].prompt == "f_001|Foo|?|x\nf_002|Gender|gender|opts:Male/Female"
    busy = lambda _: (_ for _ in ()).throw(RuntimeError("overloaded"))
    broken = lambda _: (_ for _ in ()).throw(ValueError("bad key"))
    good = lambda s: {"reply": s[:5], "input_tokens": 7, "output_tokens": 2}
    ok = boundary.call(p, boundary.with_fallbacks([busy, good])).collect()[0]
    assert (ok.reply, ok.input_tokens, ok.error) == ("f_001", 7, None)
    assert "bad key" in boundary.call(p, boundary.with_fallbacks([broken, good])).collect()[0].error
    assert boundary.ledger(boundary.call(p, good)).collect()[0].calls == 1


def test_vision_boxes_are_clamped(spark):
    v = spark.createDataFrame([(0.5, -0.2, 1.7, 0.1, "essay", None, 600.0, 800.0)], "x double, y double, w double, h double, type string, confidence double, page_width double, page_height double")
    r = boundary.vision_fields(v).collect()[0]
    assert (r.x, r.y, r.w, r.h, r.type, r.confidence, r.needs_review) == (300.0, 0.0, 600.0, pytest.approx(80.0), "text", 0.7, False)


def test_token_cleanup(spark):
    t = spark.createDataFrame([(1, 1, 0, "Address____", 0.0, 110.0), (1, 1, 1, "口", 200.0, 10.0), (1, 1, 2, "性别:口男口女", 300.0, 70.0), (1, 1, 3, "plain", 400.0, 30.0)], "doc_id long, page int, pos int, text string, x double, w double")
    got = tokens.normalise_tokens(t).orderBy("pos").collect()
    assert [r.text for r in got] == ["Address", "____", "☐", "性别:", "☐", "男", "☐", "女", "plain"]
    assert got[1].x == pytest.approx(70.0) and [r.pos for r in got] == list(range(9))


def test_blocks_become_tokens(spark):
    b = spark.createDataFrame([
        (1, 0, "text", "one line here", 0.0, 0.0, 200.0, 20.0), (1, 1, "text", "two\nlines", 0.0, 100.0, 90.0, 40.0), (1, 2, "text", "wrapped\nby reader", 0.0, 200.0, 300.0, 20.0), (1, 3, "image", "no", 0.0, 300.0, 10.0, 10.0),
        (1, 4, "text", "line", 10.0, 2.0, 50.0, 10.0), (1, 5, "table", "<td>a</td><td>$b</td>", 0.0, 400.0, 100.0, 20.0),
    ], "doc_id long, block int, kind string, content string, x double, y double, w double, h double")
    got = tokens.block_tokens(b).collect()
    text = {}
    for r in sorted(got, key=lambda r: (r.block, r.line, r.pos)):
        text.setdefault((r.block, r.line), []).append(r.text)
    assert list(text.values()) == [["one", "line", "here"], ["two"], ["lines"], ["wrapped", "by", "reader"], ["a", "b"]]


def test_store(spark):
    log = spark.createDataFrame([("d", "a", 1, "x"), ("d", "b", 2, "y"), ("d", "a", 3, "z"), ("e", "a", 4, "w")], "bucket string, id string, seq int, body string")
    assert [(r.id, r.body) for r in store.newest_first(log, "d").collect()] == [("a", "z"), ("b", "y")]
    rows = spark.createDataFrame([(1, "p", "q", 0.5, True), (2, "p", "q", 0.5, True)], "id int, a string, b string, confidence double, needs_review boolean")
    patch = spark.createDataFrame([(1, "new", None)], "id int, a string, b string")
    got = store.overlay(rows, patch, "id", ["a", "b"]).orderBy("id").collect()
    assert tuple(got[0])[:5] == (1, "new", "q", 1.0, False) and tuple(got[1])[:5] == (2, "p", "q", 0.5, True)
    c = store.corrections(rows, patch, "id", ["a", "b"]).collect()
    assert len(c) == 1 and c[0].before.a == "p" and c[0].after.a == "new"
    s = lambda *r: spark.createDataFrame(list(r), "name string, value string")
    assert {r.name: r.value for r in store.settings(s(("m", "1"), ("n", "2")), s(("m", "3")), s(("m", " "), ("n", "4"))).collect()} == {"m": "3", "n": "4"}


def test_layouts(spark):
    f = spark.createDataFrame([(1, "f1", 0, 0, 6, 1, 0), (1, "f2", 3, 0, 6, 1, 1), (1, "f3", 6, 0, 6, 1, 2), (1, "f4", 0, 30, 20, 1, 3)], "doc_id int, field_id string, x int, y int, w int, h int, at int")
    pushed = {r.field_id: r.y for r in layout.push_below(f, f.filter("field_id = 'f1'")).collect()}
    assert pushed == {"f1": 0, "f2": 1, "f3": 0, "f4": 30}
    assert {r.field_id: (r.x, r.y) for r in layout.shelf_pack(f).collect()} == {"f1": (0, 0), "f2": (6, 0), "f3": (0, 1), "f4": (0, 2)}
    assert {r.field_id: r.page_no for r in layout.grid_to_page(f).collect()}["f4"] == 1
    assert layout.next_free_row(f).collect()[0].next_row == 31


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, "name", "Ann"), (1, "total", "1,000"), (1, "city", "Rome")], "doc_id int, norm string, value string")
    found = spark.createDataFrame([(1, "f1", "full name", "Bob"), (1, "f2", "name", "Ann"), (1, "f3", "total", "1000"), (1, "f4", "junk", "x")], "doc_id int, field_id string, norm string, value string")
    r = evaluation.recall_precision(truth, found).collect()[0]
    assert (r.recall, r.precision) == (pytest.approx(2 / 3), pytest.approx(3 / 4))
    assert evaluation.answer_accuracy(truth, found).collect()[0].accuracy == pytest.approx(2 / 3)


def test_long_lines_are_laid_out_in_proportion(spark):
    rng = random.Random(1)
    words = ["w" * rng.randrange(1, 9) for _ in range(64_000)]
    got = tokens.reflow(spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "doc_id long, text string")).select("doc_id", "pos", "x", "gap_after").orderBy("pos").collect()
    at, want = 40.0, []
    for k, w in enumerate(words):
        want.append((1, k, at, 5.0 if k + 1 < len(words) else None))
        at += 6.0 * len(w) + 5
    assert [tuple(r) for r in got] == want


def test_lines_of_long_blocks_keep_their_ids(spark):
    b = spark.createDataFrame([(1, 0, "text", "\n".join(f"l{k}" for k in range(1002)), 0.0, 0.0, 90.0, 9000.0), (1, 1, "text", "\n".join(f"m{k}" for k in range(5)), 500.0, 0.0, 90.0, 90.0)], "doc_id long, block int, kind string, content string, x double, y double, w double, h double")
    got = tokens.block_tokens(b)
    assert got.count() == 1007 == got.select("doc_id", "block", "line", "pos").distinct().count()


def test_documents_without_tokens_are_rejected(spark):
    docs = spark.createDataFrame([(1, "Name: ____"), (2, None), (3, " \n ")], "doc_id long, text string")
    got = {r.doc_id: r for r in gate.decide(gate.signals(tokens.reflow(docs), docs=docs).withColumn("score", gate.score())).collect()}
    assert set(got) == {1, 2, 3} and all(not got[k].is_form and got[k].confidence == 1.0 and got[k].token_count == 0 for k in (2, 3)) and got[1].token_count == 2


def test_second_opinions_and_messages(spark):
    d = spark.createDataFrame([(1, False, 0.9, 40), (2, True, 0.8, 10), (3, True, 0.8, 40), (4, False, 0.9, 0)], "doc_id long, is_form boolean, confidence double, token_count int")
    v = spark.createDataFrame([(1, True, 0.7), (2, None, None), (3, False, 0.9), (4, False, None)], "doc_id long, v_form boolean, v_confidence double")
    got = {r.doc_id: r for r in gate.second_opinion(d, v).withColumn("m", service.rejection_message(F.col("token_count"), F.col("confidence"), F.col("second"))).collect()}
    assert [(got[k].is_form, got[k].confidence, got[k].second) for k in (1, 2, 3, 4)] == [(True, 0.7, True), (True, 0.8, False), (True, 0.8, False), (False, 0.5, True)]
    assert got[4].m == service.NO_TEXT and "(form likelihood 30%) (checked" in got[1].m.replace(" (checked", " (checked")


def test_pruning_merges_overlapping_pairs(spark):
    rows = [(1, 1, "c1", 0.1, 0.9, 10.0, 100.0), (1, 1, "c2", 0.1, 0.6, 12.0, 100.0), (1, 1, "c3", 0.9, 0.0, 90.0, 100.0)]
    c = spark.createDataFrame(rows, "doc_id long, page int, candidate_id string, junk double, genuine double, y double, page_height double")
    pairs = spark.createDataFrame([(1, 1, "c1", "c2")], "doc_id long, page int, a string, b string")
    with_pair = pruning.prune_search(c, pairs).collect()
    without = pruning.prune_search(c, pairs.limit(0)).collect()
    assert {r.candidate_id for r in with_pair} == {"c1", "c2"} == {r.candidate_id for r in without}
    assert with_pair[0].prune_evaluations > without[0].prune_evaluations  # the merge is a move of its own


def test_whole_run(spark, both):
    t, _ = both if isinstance(both, tuple) else (both, None)
    toks = tokens.with_gaps(t.drop("gap_after"))
    docs = toks.select("doc_id").distinct().unionByName(spark.createDataFrame([(99,)], "doc_id long"))

    def client(prompt):
        return {"reply": '[{"id": "f_001", "label": "Full name", "type": "text", "value": "ann", "review": true}]', "input_tokens": 7, "output_tokens": 3}

    out = extract.run(toks, docs, templates.catalogue(spark), client)
    gate_of = {r.doc_id: r.is_form for r in out["gate"].collect()}
    assert gate_of[1] and not gate_of[2] and not gate_of[99]
    fields = out["fields"].collect()
    assert {r.doc_id for r in fields} == {1} and len({r.field_id for r in fields}) == len(fields)
    calls = out["calls"].collect()
    assert [(r.doc_id, r.input_tokens, r.error) for r in calls] == [(1, 7, None)]
    first = next(r for r in fields if r.field_id == "f_001")
    assert (first.value, first.label, first.confidence, first.needs_review) == ("ann", "Full Name", 0.9, True)
    plain = {r.field_id: r for r in extract.run(toks, docs, templates.catalogue(spark))["fields"].collect()}
    assert set(plain) == {r.field_id for r in fields} and plain["f_001"].value != "ann"
    stages = out["stages"].collect()
    assert [r.stage for r in stages] == ["gate", "forms", "candidates", "evidence", "fields", "calls"]
    rows = {r.stage: (r.rows, r.docs) for r in stages}
    assert rows["gate"] == (3, 3) and rows["forms"] == (toks.filter("doc_id = 1").count(), 1) and rows["fields"] == (len(fields), 1) and rows["calls"] == (1, 1)
    assert rows["candidates"] == rows["evidence"] and all(r.ms > 0 for r in stages)
    account = out["tokens"].collect()
    assert [r.doc_id for r in account] == [1] and account[0].saved_vs_unpruned >= 0 and account[0].prompt_raw_text > 0


def test_reports(spark):
    marks = spark.createDataFrame([(1, 1, "gate", 5), (1, 2, "group", 9), (1, 3, "gate", 10)], "doc_id long, seq int, stage string, at long")
    assert {r.stage: r.took for r in report.stage_laps(marks).collect()} == {"gate": 1, "group": 4}
    one = lambda *ids: spark.createDataFrame([(i, None) for i in ids], "doc_id long, template_key string")
    got = {r.doc_id: r for r in report.quality(one(1, 1, 2), one(1), one(1), one(1)).collect()}
    assert (got[1].candidates, got[1].fields, got[1].junk_removed, got[1].template_hit_rate, got[2].fields) == (2, 1, 1, 0.0, 0)


def test_export_formats(spark):
    f = layout.new_fields(spark.createDataFrame([(1, "a", "L<", "date", 99, -4, True, None, None, "T")], "doc_id long, field_id string, label string, type string, x int, y int, required boolean, options array<string>, value string, title string"))
    r = f.first()
    assert (r.x, r.y, r.w, r.h) == (8, 0, 4, 1)
    assert '"format":"date"' in layout.export(f, "json").first().body and "L&lt;" in layout.export(f, "html").first().body and layout.export(f, "pdf").first().page_no == 0
    with pytest.raises(ValueError):
        layout.export(f, "doc")

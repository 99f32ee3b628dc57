"""Steps that run once per layout: as many layouts as differ, and the results of a step per page."""

import random

from pyspark.sql import functions as F

from formloom.operators import grouping, layouts

TOKEN = "doc_id long, page int, row int, pos int, text string, x double, y double, w double, h double, confidence double"


def forms(n, seed=1):
    """Forms of two layouts; only the words differ."""
    rng, out = random.Random(seed), []
    for d in range(n):
        word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
        rows = [["Name:", word(6), word(4)], ["City", "Country"]] + ([["Sign", "____"]] if d % 2 else [])
        pos = 0
        for r, ws in enumerate(rows):
            for k, t in enumerate(ws):
                out.append((d, 1, r, pos, t, 40.0 + 150 * k, 40.0 + 30 * r, 6.0 * len(t), 12.0, 1.0))
                pos += 1
    return out


def test_pages_of_one_layout_are_searched_once(spark, monkeypatch):
    seen, own = [], layouts.once

    def counted(pages, parts, step, weight):
        return own(pages, parts, lambda distinct: (seen.append(distinct.count()), step(distinct))[1], weight)

    monkeypatch.setattr(layouts, "once", counted)
    rows = forms(30)
    t = spark.createDataFrame(rows, TOKEN)
    got = {}
    for r in grouping.group_pages(t).orderBy("doc_id", "candidate_id").collect():
        got.setdefault(r.doc_id, []).append((r.label, r.value, r.separator, r.grouping_score, r.pass_evaluations))
    assert seen == [2]
    for d in range(30):
        mine = [r for r in rows if r[0] == d]
        page = grouping.Page(*[[r[k] for r in mine] for k in (4, 5, 6, 7, 8)], [False] * len(mine), 600.0, [])
        won = page.search(6, 150, 0)
        said = lambda ks: " ".join(page.text[k] for k in ks)
        want = [(said(p.label), said([k for k in p.value if not page.blank[k]]), p.sep, p.score, won.evaluations) for r, cuts in enumerate(won.state) for p in page.pieces(r, cuts)]
        assert got[d] == want


def test_results_meet_pages_by_sorted_keys_as_by_broadcast(spark, monkeypatch):
    pages = layouts.gathered(spark.createDataFrame(forms(9), TOKEN))
    key = lambda df: sorted((r.doc_id, r.row, r.seg, r.label, r.value, r.separator, r.grouping_score) for r in df.collect())
    small = key(grouping.baseline_pages(pages))
    monkeypatch.setattr(layouts, "BROADCAST", 0)
    assert key(grouping.baseline_pages(pages)) == small == key(grouping.baseline(spark.createDataFrame(forms(9), TOKEN)))


def test_marks_say_what_the_words_say(spark):
    words = ["Name:", "____", "☐", "[x]", "12/03/2024", "AB-12", "x²", "नाम", "...", "", " ☐ ", "a"]
    got = [r.m for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").select("k", layouts.marks(F.col("w")).alias("m")).orderBy("k").collect()]
    n = len(words)
    own = grouping.Page(words, [0.0] * n, [0.0] * n, [1.0] * n, [1.0] * n, [False] * n, 600.0, [])
    told = grouping.Page(None, [0.0] * n, [0.0] * n, [1.0] * n, [1.0] * n, [False] * n, 600.0, [], got)
    for kind in ("colon", "blank", "box", "boxed", "alnum", "like"):
        assert getattr(own, kind) == getattr(told, kind), kind


def test_pairs_of_a_page_are_those_of_the_table(spark):
    from formloom.operators import pruning

    rng = random.Random(4)
    rows = [(d, 1, f"c{k:02d}", rng.choice(["Name", "name ", "City", None]), 40.0 * rng.randrange(4), 30.0 * rng.randrange(9), rng.choice([80.0, 200.0]), rng.choice([20.0, 150.0])) for d in range(12) for k in range(14)]
    c = spark.createDataFrame(rows, "doc_id long, page int, candidate_id string, label string, x double, y double, w double, h double")
    want = sorted(map(tuple, pruning.overlaps(c).collect()))
    got = []
    for d in range(12):
        mine = [r for r in rows if r[0] == d]
        got += [(d, 1, mine[a][2], mine[b][2]) for a, b in pruning.pairs_near([r[2] for r in mine], [r[4:8] for r in mine], [None if r[3] is None else r[3].strip().lower() for r in mine], 24.0)]
    assert got == want and want
    c = c.withColumns({"junk": F.lit(0.4) + F.rand(3) / 5, "genuine": F.lit(0.5), "page_height": F.lit(850.0)}).localCheckpoint()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(pruning.prune_search(c)) == key(pruning.prune_search(c, pruning.overlaps(c)))


def test_no_exploded_side_is_broadcast(spark):
    """A small file of documents with many blocks or candidates each isn't a small table."""
    from formloom.operators import pruning, tokens

    b = spark.range(50).selectExpr("id doc_id", "explode(sequence(1, 3)) block", "40D x", "90D + block y", "500D w", "100D + block h")
    c = b.selectExpr("doc_id", "1 page", "string(block) candidate_id", "'a' label", "x", "y", "w", "h", "0.4D junk", "0.5D genuine", "850D page_height")
    for df in (tokens.drop_contained(b), pruning.overlaps(c), pruning.prune_search(c, pruning.overlaps(c))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_gate_on_rows_and_layouts_as_on_tokens(spark):
    from formloom.operators import gate, tokens

    texts = ["Name: ____\nplain words only here\n\n☐ yes [x] no\tend:", None, "", "one " * 90 + "\n---\nAge： 12", "( ) a\n...... b:"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    assert key(gate.signals_of_rows(tokens.reflow_rows(docs), docs=docs)) == key(gate.signals(tokens.reflow(docs), docs=docs))
    t = tokens.with_gaps(spark.createDataFrame(forms(8), TOKEN))
    pages = layouts.gathered(t).join(t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gap_after"))), lambda r: r["gap_after"]).alias("gap_after")), "doc_id")
    assert key(gate.signals_of_layouts(pages)) == key(gate.signals(t))


def test_labels_that_differ_in_digits_are_matched_once(spark):
    from formloom.operators import templates

    labels = spark.createDataFrame([(x,) for x in ("Customer#000000017", "Customer#000000099", "Total 12", "Total 999", "Item 3 of 4", "Total", "Dat3", "Invoice no 77", "12/03/1999")], "label string")
    index = templates.alias_index(templates.catalogue(spark))
    made = labels.withColumn("norm", templates.match_label(F.col("label")))
    got = {r.label: (r.key, r.strength) for r in templates.match(labels, templates.catalogue(spark)).collect()}
    each = {r.norm: (r.key, r.strength) for r in templates.match_norms(made.select("norm").distinct(), index).collect()}
    assert got == {r.label: each[r.norm] for r in made.collect()}
    same = made.select(templates._alike(F.col("norm"), False).alias("n"), templates._alike(F.col("norm"), True).alias("m"))
    assert (same.select("n").distinct().count(), same.select("m").distinct().count()) == (8, 9)


def test_kept_numbers_are_those_of_the_kept_alone(spark):
    from formloom.operators import pruning

    c = spark.range(40).selectExpr("id % 3 doc_id", "1 page", "double(id % 7) y", "double(id % 5) x", "string(id) candidate_id", "if(id % 4 = 0, 0.9D, 0.1D) junk")
    both = {r.candidate_id: (r.field_id, r.kept_id) for r in pruning.numbered_both(c).collect()}
    every, kept = ({r.candidate_id: r.field_id for r in pruning.numbered(x).collect()} for x in (c, pruning.keep_plain(c)))
    assert both == {k: (v, kept.get(k)) for k, v in every.items()}


def test_compressed_payloads_of_pages(spark, tmp_path):
    from formloom.sources.token_pages import TokenPagesReader, payload_of_pages, payload_rows, read_pages

    t = spark.createDataFrame(forms(20), TOKEN)
    made = payload_of_pages(layouts.gathered(t))
    assert sorted(r[0] for r in made.collect()) == sorted(r[0] for r in payload_rows(t).collect())
    made.repartition(4).write.text(f"file://{tmp_path}/p", compression="gzip")
    got = read_pages(spark, f"file://{tmp_path}/p").select("doc_id", "page", "pos", "text", "x", "y", "w", "h", "confidence").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[k] for k in (0, 1, 3, 4, 5, 6, 7, 8, 9)) for r in forms(20))
    assert len(TokenPagesReader({"path": f"{tmp_path}/p", "groupbytes": "3000"}).partitions()) == 4

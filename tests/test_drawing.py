"""Drawn form pages: geometry of cells, words, mirrored and wide scripts, and what the pipeline makes of them."""

import pytest
from pyspark.sql import functions as F

from formloom.operators import drawing, templates, tokens
from formloom.plans import evaluation, extract

CELLS = "doc_id long, row int, cell int, cells int, label string, kind string, value string, options array<string>, rtl boolean"


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([
        (5, 0, 0, 1, "Full Name", "colon", "", [], False), (5, 1, 0, 2, "City", "blank", "", [], False), (5, 1, 1, 2, "Total", "value", "1,234.50", [], False),
        (5, 2, 0, 1, "Sex", "boxes", "", ["M", "F x"], False), (5, 40, 0, 1, "Late", "colon", "", [], False), (6, 0, 0, 1, "تاريخ الميلاد", "colon", "", [], True), (6, 1, 0, 1, "姓名", "blank", "", [], False),
        (7, 0, 0, 1, None, "colon", None, None, False),
    ], CELLS)


def test_words_stand_where_their_cell_puts_them(cells):
    every = drawing.tokens(cells).collect()
    got = {(r.doc_id, r.page, r.row, r.text): r for r in every}
    name = got[5, 1, 2, "Name:"]
    assert (name.x, name.w, name.h) == (60.0 + 5 * 5, 25.0, 12.0) and got[5, 1, 2, "Full"].x == 60.0
    assert got[5, 1, 3, "Total:"].x == 60 + 475 / 2 and got[5, 1, 3, "1,234.50"].x == 60 + 475 / 2 + 30 + 8
    blank = next(r for k, r in got.items() if k[:3] == (5, 1, 3) and set(k[3]) == {"_"})
    assert blank.x == 60 + 20 + 6 and blank.x + blank.w <= 60 + 475 / 2
    boxes = sorted((r.x, r.text) for r in every if (r.doc_id, r.page, r.row) == (5, 1, 4))
    assert [t for _, t in boxes] == ["Sex:", "☐", "M", "☐", "F", "x"] and boxes[3][0] - boxes[1][0] == 15 + 16
    assert (5, 3, 6, "Late:") in got  # row 40 is the fifth of the third page
    first, second = got[6, 1, 2, "تاريخ"], got[6, 1, 2, "الميلاد:"]
    assert first.x + first.w == 595 - 60 and second.x + second.w == first.x - 5
    assert got[6, 1, 3, "姓名"].w == 20.0
    assert len({(r.doc_id, r.page, r.pos) for r in every}) == len(every) and not any(k[0] == 7 for k in got)


def test_lines_pages_and_furniture(spark, cells):
    lines = sorted((r.doc_id, r.page, r.x, r.w) for r in drawing.lines(cells).collect())
    assert lines[0] == (5, 1, 60 + 50 + 6, 475 - 50 - 20) and lines[-1] == (6, 1, 595 - (60 + 70 + 6) - (475 - 70 - 20), 475 - 70 - 20)
    assert sorted((r.doc_id, r.page) for r in drawing.pages(cells).collect()) == [(5, 1), (5, 2), (5, 3), (6, 1), (7, 1)]
    heads = spark.createDataFrame([(5, "A FORM", None, "end", False)], "doc_id long, title string, hint string, footer string, rtl boolean")
    got = {r.text: r for r in drawing.tokens(cells.limit(0), drawing.furniture(heads)).collect()}
    assert set(got) == {"A", "FORM", "end", "Page", "1", "of"} and got["A"].h == pytest.approx(19.2) and got["end"].y > 700
    assert drawing.tokens(cells.limit(0)).count() == 0 and drawing.pages(cells.limit(0)).count() == 0


def test_page_sizes_come_from_the_input_or_the_tokens(spark):
    toks = spark.createDataFrame([(1, 1, 30.0, 12.0), (1, 1, 2182.0, 12.0), (1, 2, 10.0, 0.0), (2, 1, 5.0, 8.0)], "doc_id long, page int, y double, h double")
    given = spark.createDataFrame([(2, 1, 1240.0, 1754.0), (1, 2, None, None)], "doc_id long, page int, width double, height double")
    got = {(r.doc_id, r.page): (r.width, r.height, r.mh) for r in extract.page_sizes(toks, given).collect()}
    assert got == {(1, 1): (600.0, 2222.0, 12.0), (1, 2): (600.0, 850.0, 12.0), (2, 1): (1240.0, 1754.0, 8.0)}
    assert {r.height for r in extract.page_sizes(toks).collect()} == {2222.0, 850.0}


def test_footer_words_of_a_tall_page_are_judged_by_its_own_height(spark):
    """A label in the middle of a tall page is no footer, though it is below where a page of 850 would end."""
    rows = [(1, 1, k, k, t, 40.0 + 80 * j, 40.0 + 40 * (k // 2), 6.0 * len(t), 12.0, 1.0) for k in range(120) for j, t in [(0, f"Label{k:03d}")] if k % 2 == 0]
    toks = spark.createDataFrame(rows, "doc_id long, page int, row int, pos int, text string, x double, y double, w double, h double, confidence double")
    c = extract.passes(toks, templates.catalogue(spark), search=False)["candidates"]
    late = c.filter("y between 1000 and 2000")
    assert late.count() > 10 and late.filter("junk >= 0.45").count() == 0
    assert c.agg(F.max("page_height")).first()[0] == 40.0 + 40 * 59 + 40


def test_drawn_forms_are_found_again(spark, tmp_path):
    """The figures of the evaluation on two customers of every form: gate, both recalls and the filled-in answers."""
    names = [(k, f"Customer#{k:09d}", 100.5 * k - 300) for k in range(16)]
    spark.createDataFrame(names, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    rows = evaluation.evaluation(spark, str(tmp_path)).collect()
    assert len(rows) == 16 and all(r.is_form for r in rows)
    assert all(r.group_recall == 1.0 and r.prune_recall == 1.0 and r.answer_accuracy == 1.0 for r in rows)
    assert sum(r.prune_precision for r in rows) / 16 > 0.9
    assert {r.lang for r in rows} == set(evaluation.FORMS)
    toks = drawing.tokens(evaluation.cells(spark, str(tmp_path)))
    assert tokens.with_direction(toks.drop("rtl")).filter("rtl").select("doc_id").distinct().count() == 2

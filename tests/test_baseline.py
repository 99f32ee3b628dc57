"""The native grouping against the kernel's start, piece by piece, on pages with right-to-left rows, ruled lines and blanks
below their labels."""

import random

import pytest
from pyspark.sql import functions as F

from formloom.operators import drawing, grouping, tokens
from formloom.plans import evaluation

TOKEN = "doc_id long, page int, row int, pos int, text string, x double, y double, w double, h double, confidence double, rtl boolean"
LATIN = ["Name:", "City", "of", "____", "______", "☐", "☐", "Male", "12/03/2024", "Total", "a", "[", "Ref.", "☑Yes", "Date:", "1,200", "No"]
ARABIC = ["الاسم:", "المدينة", "____", "☐", "التاريخ", "12", "Name"]


def random_pages(seed, n):
    rng = random.Random(seed)
    toks, lines, sizes = [], [], []
    for doc in range(n):
        pos, y, width = 0, 40.0, rng.choice([600.0, 595.0, 400.0])
        sizes.append((doc, 1, width, 850.0))
        for row in range(rng.randint(1, 9)):
            back = rng.random() < 0.3
            h, x = rng.choice([12.0, 12.0, 12.0, 9.0, 20.0]), rng.choice([40.0, 40.0, 90.0, 320.0, 520.0])
            prose = rng.random() < 0.1
            for _ in range(rng.choice([8, 11]) if prose else rng.choice([1, 1, 2, 3, 5, 9, 14])):
                text = rng.choice(["plain", "words", "run", "on"] if prose else ARABIC if back else LATIN)
                toks.append((doc, 1, row, pos, text, x, y, 6.0 * len(text), h, rng.choice([1.0, 0.8]), back and any("؀" < c < "܀" for c in text)))
                pos += 1
                x += 6.0 * len(text) + (5.0 if prose else 0) + rng.choice([0.0] if prose else [3.0, 5.0, 5.0, 5.0, 31.0, 33.0, 40.0, 90.0])
            if rng.random() < 0.4:
                lines.append((doc, 1, rng.choice([60.0, 150.0, 300.0]), y + h + rng.choice([-3.0, 0.0, 9.0, 10.0, 30.0]), rng.choice([40.0, 200.0, 500.0]), 0.5))
            if rng.random() < 0.15:
                lines.append((doc, 1, rng.choice([500.0, 590.0, 300.0]), y - 5, 1.0, rng.choice([30.0, 300.0])))
            y += h + rng.choice([14.0, 16.0, 24.0])
    return toks, lines, sizes


def compared(native, kernel):
    a = sorted(((r.doc_id, r.page, r.label, r.value, r.separator, r.has_separator, r.has_box, r.prose_row, r.label_h, r.label_confidence, r.grouping_score, r.region, r.bbox) for r in native), key=repr)
    b = sorted(((r.doc_id, r.page, r.label, r.value, r.separator, r.has_separator, r.has_box, r.prose_row, r.label_h, r.label_confidence, r.grouping_score, r.region, r.bbox) for r in kernel), key=repr)
    key = lambda r: (r[:3], [round(v) for v in r[11]])
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:11] == y[:11]
        assert x[11] == pytest.approx(y[11], abs=0.051) and x[12] == pytest.approx(y[12], abs=0.051)
    return a


def test_native_grouping_is_the_kernels_start(spark):
    toks, lines, sizes = random_pages(4, 220)
    t = spark.createDataFrame(toks, TOKEN).repartition(4)
    box = "doc_id long, page int, x double, y double, w double, h double"
    ruled, pages = spark.createDataFrame(lines, box), spark.createDataFrame(sizes, "doc_id long, page int, width double, height double")
    native = grouping.baseline(t, pages=pages, lines=ruled)
    got = compared(native.collect(), grouping.group_pages(t, pages, ruled, search=False).collect())
    kinds = {r[4] for r in got}
    assert kinds == {"colon", "blank", "box", "line", ""} and any(r[7] for r in got)
    plan = native._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_native_grouping_of_drawn_forms(spark, tmp_path):
    rows = [(k, f"Customer#{k:09d}", 100.5 * k) for k in range(16)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    made = evaluation.cells(spark, str(tmp_path))
    t = tokens.with_direction(drawing.tokens(made).drop("rtl")).drop("script").cache()
    got = compared(grouping.baseline(t, pages=drawing.pages(made), lines=drawing.lines(made)).collect(), grouping.group_pages(t, drawing.pages(made), drawing.lines(made), search=False).collect())
    assert len(got) > 150


def test_native_grouping_of_odd_tokens(spark):
    odd = spark.createDataFrame([(1, 1, 0, 0, "", 1.0, 1.0, 0.0, 0.0, None, None), (1, 1, 1, 1, "x", 5.0, 30.0, 6.0, 12.0, 1.0, False), (1, 2, 0, 0, "____", 5.0, 30.0, 24.0, 12.0, 1.0, None)], TOKEN)
    got = {(r.page, r.row): r for r in grouping.baseline(odd).collect()}
    assert got[1, 1].label == "x" and got[1, 0].label == "" and got[2, 0].label == "____" and got[1, 1].mh == 12.0
    assert grouping.baseline(odd.limit(0)).count() == 0
    lines = spark.createDataFrame([(1, 1, 40.0, 43.0, 200.0, 0.5)] * 2, "doc_id long, page int, x double, y double, w double, h double")
    assert grouping.baseline(odd, lines=lines).filter(F.col("separator") == "line").count() == 1

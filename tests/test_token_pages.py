"""The token page source: rows, limits, pushed conditions, bad files."""

import json

from pyspark.sql import functions as F

from formloom.sources import token_pages as T

TOKEN = {"text": "Name:", "bbox": [1, 2, 3, 4]}


def folder(tmp_path):
    docs = [{"doc_id": k, "pages": [{"number": n + 1, "width": 600, "height": 800 + n, "tokens": [TOKEN, {"text": f"d{k}", "bbox": [5, 6, 7, 8], "confidence": 0.5, "script": "latin"}], "lines": [[1, 2, 3, n]]} for n in range(k % 4)]} for k in range(12)]
    for k in range(3):
        (tmp_path / f"part{k}.json").write_text("\n".join(json.dumps(d) for d in docs[k::3]) + "\n\n")
    (tmp_path / "_SUCCESS").write_text("")
    return docs


def test_tokens_pages_and_lines(spark, tmp_path):
    docs = folder(tmp_path)
    got = T.read_pages(spark, f"file://{tmp_path}").collect()
    assert len(got) == 2 * sum(len(d["pages"]) for d in docs) and all(r.error is None for r in got)
    one = sorted((r.page, r.pos, r.text, r.x, r.confidence, r.script) for r in got if r.doc_id == 6)
    assert one == [(1, 0, "Name:", 1.0, 1.0, None), (1, 1, "d6", 5.0, 0.5, "latin"), (2, 0, "Name:", 1.0, 1.0, None), (2, 1, "d6", 5.0, 0.5, "latin")]
    pages = T.read_pages(spark, str(tmp_path), "pages").collect()
    assert sorted((r.doc_id, r.page, r.width, r.height) for r in pages) == sorted((d["doc_id"], p["number"], 600.0, float(p["height"])) for d in docs for p in d["pages"])
    lines = T.read_pages(spark, str(tmp_path), "lines").filter("doc_id = 3").collect()
    assert sorted(r.h for r in lines) == [0.0, 1.0, 2.0]
    assert T.read_pages(spark, str(tmp_path), groupBytes=1).rdd.getNumPartitions() == 3 and T.read_pages(spark, str(tmp_path)).rdd.getNumPartitions() == 1


def test_conditions_are_pushed(spark, tmp_path):
    folder(tmp_path)
    df = T.read_pages(spark, str(tmp_path)).filter("doc_id in (3, 7, 99) and page <= 2 and text <> 'Name:'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x and "BatchScan" not in x]
    assert all("doc_id" not in x and "page" not in x for x in filters), plan
    assert sorted((r.doc_id, r.page) for r in df.collect()) == [(3, 1), (3, 2), (7, 1), (7, 2)]
    reader = T.TokenPagesReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([T.EqualTo(("doc_id",), 3), T.LessThan(("page",), 3), T.EqualTo(("text",), "x")]))
    assert len(left) == 1 and [k[:2] for k in reader.kept] == [("doc_id", "EqualTo"), ("page", "LessThan")]
    rows = [r for b in reader.read(T.Group([f"{tmp_path}/part0.json"])) for r in b.to_pylist()]
    assert {(r["doc_id"], r["page"]) for r in rows} == {(3, 1), (3, 2)}


def test_page_limit_and_bad_files(spark, tmp_path):
    many = {"doc_id": 1, "pages": [{"tokens": [TOKEN]}] * 30 + [None]}
    (tmp_path / "a.json").write_text(json.dumps(many | {"pages": many["pages"][:30]}))
    (tmp_path / "b.json").write_bytes(b'{"doc_id": 2, "pages": [{"tokens": [{"text": "x"}]}]}\nnot json\n\xff\xfe\n{"doc_id": 4, "pages": null}\n{"pages": []}')
    (tmp_path / "c.json").write_text("")
    got = T.read_pages(spark, str(tmp_path)).collect()
    good, bad = [r for r in got if r.error is None], [r for r in got if r.error]
    assert [r.page for r in sorted(good, key=lambda r: r.page)] == list(range(1, 21))
    assert len(bad) == 4 and all(r.path.endswith("b.json") and r.doc_id is None for r in bad)
    assert T.read_pages(spark, str(tmp_path), maxPages=0).filter("error is null").count() == 30


def test_payloads_come_back(spark, tmp_path):
    rows = [(d, p, k, f"t{d}{p}{k}", 1.5 * k, 2.0, 3.0, 4.0, 0.9) for d in (1, 2) for p in (1, 2, 3) for k in range(4)]
    toks = spark.createDataFrame(rows, "doc_id long, page int, pos int, text string, x double, y double, w double, h double, confidence double")
    pages = toks.select("doc_id", "page").distinct().withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    T.payload_rows(toks, pages).write.text(f"{tmp_path}/out")
    back = T.read_pages(spark, f"{tmp_path}/out").select(toks.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert {(r.width, r.height) for r in T.read_pages(spark, f"{tmp_path}/out", "pages").collect()} == {(595.0, 842.0)}

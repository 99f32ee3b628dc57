"""Grid layouts of form fields: placing, pushing apart, pages, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A4 points and row sizes of the page export; widths of new fields by type.
PAGE_W, PAGE_H, MARGIN, ROW_H, HEAD, COLUMNS = 595.0, 842.0, 40.0, 34.0, 40.0, 12
JSON_TYPES = {"text": "string", "date": "string", "checkbox": "boolean", "signature": "string", "number": "number", "multiple-choice": "string", "table-cell": "string"}

WIDTHS = {"text": 6, "date": 4, "checkbox": 4, "signature": 6, "number": 4, "multiple-choice": 6, "table-cell": 3}
EDITOR_ONLY = ["question", "label_original_language", "source_document_id"]


def width_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in WIDTHS.items() for v in kv]), kind), F.lit(6))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def new_fields(fields: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """Extracted fields (with x and y where they were dropped) as layout fields: width by type, one row high, inside the
    grid, empty placeholder; missing required, options and value get their defaults. Other columns pass through."""
    w = width_of(F.col("type"))
    return fields.withColumns({
        "w": w, "h": F.lit(1), "x": clamp(F.col("x"), F.lit(0), F.lit(columns) - w), "y": F.greatest(F.lit(0), "y"), "placeholder": F.lit(""),
        "required": F.coalesce("required", F.lit(False)), "options": F.coalesce("options", F.array().cast("array<string>")), "value": F.coalesce("value", F.lit("")),
    })


def placed(fields: DataFrame, layout: DataFrame, yes: bool = True) -> DataFrame:
    """The fields whose id is in their layout (yes), or isn't."""
    return fields.join(layout.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_semi" if yes else "left_anti")


def update(layout: DataFrame, patches: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """layout after patches (doc_id, field_id, x, y, w; one field of a layout, nulls change nothing), which stay in the
    grid; what then overlaps the changed field goes below it."""
    p = patches.select("doc_id", "field_id", *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "w")], F.lit(True).alias("hit"))
    j = layout.join(p, ["doc_id", "field_id"], "left")
    w = F.coalesce("p_w", "w")
    x = F.when(F.col("hit"), clamp(F.coalesce("p_x", "x"), F.lit(0), F.lit(columns) - w)).otherwise(F.col("x"))
    changed = j.withColumns({"x": x, "y": F.coalesce("p_y", "y"), "w": w}).drop("p_x", "p_y", "p_w")
    moved = changed.filter("hit").select("doc_id", "field_id", "x", "y", "w", "h")
    return push_below(changed.drop("hit"), moved)


def palette(fields: DataFrame, query: str = "", only_review: bool = False) -> DataFrame:
    """Fields whose label, original label or question holds the query in any case; only those to review if asked."""
    text = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("label_original_language", F.lit("")), F.coalesce("question", F.lit(""))))
    shown = F.contains(text, F.lit(query.lower())) if query else F.lit(True)
    return fields.filter(shown & F.coalesce("needs_review", F.lit(False))) if only_review else fields.filter(shown)


def stripped(layout: DataFrame) -> DataFrame:
    """The layout as it is saved: without what only the editor uses."""
    return layout.drop(*EDITOR_ONLY)


def percent(value: Column, most: Column) -> Column:
    """A bar's length: value as a whole percentage of most, at most 100, 0 where most is 0."""
    return F.when(F.coalesce(most, F.lit(0)) != 0, F.least(F.lit(100), F.floor(value / most * 100 + 0.5))).otherwise(F.lit(0)).cast("long")


def export(fields: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, body) of each layout as "json" or "html", or the field boxes on pages as "pdf" rows; else ValueError."""
    if fmt == "json":
        return json_schema(fields).select("doc_id", F.col("schema").alias("body"))
    if fmt == "html":
        return html(fields).select("doc_id", F.col("html").alias("body"))
    if fmt == "pdf":
        return grid_to_page(fields)
    raise ValueError(f"unknown format {fmt!r}")


def grid_to_page(fields: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """Layout cells x, y, w, h as points: px, page_no, py (from the page's top), pw, ph."""
    col = (PAGE_W - 2 * MARGIN) / max(columns, 1)
    top = MARGIN + HEAD + F.col("y") * ROW_H
    usable = PAGE_H - 2 * MARGIN - ROW_H
    page = F.floor((top - MARGIN) / usable)
    return fields.select(
        *fields.columns, (MARGIN + F.col("x") * col).alias("px"), page.cast("int").alias("page_no"), (top - page * usable).alias("py"),
        (F.greatest(F.lit(col), F.col("w") * col) - 6).alias("pw"), (F.greatest(F.lit(1), F.col("h")) * ROW_H - 8).alias("ph"),
    )


def next_free_row(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    return fields.groupBy(key).agg(F.coalesce(F.max(F.col("y") + F.col("h")), F.lit(0)).alias("next_row"))


def push_below(fields: DataFrame, moved: DataFrame) -> DataFrame:
    """Fields that overlap their layout's moved one (doc_id, field_id, x, y, w, h) go right below it; it stays put."""
    m = moved.select("doc_id", *[F.col(c).alias(f"m_{c}") for c in ("field_id", "x", "y", "w", "h")])
    j = fields.join(m, "doc_id", "left")
    meets = lambda a, n: (F.col(a) < F.col(f"m_{a}") + F.col(f"m_{n}")) & (F.col(f"m_{a}") < F.col(a) + F.col(n))
    hit = (F.col("field_id") != F.col("m_field_id")) & meets("x", "w") & meets("y", "h")
    return j.select(*[c for c in fields.columns if c != "y"], F.when(hit, F.col("m_y") + F.col("m_h")).otherwise(F.col("y")).alias("y"))


def shelf_pack(fields: DataFrame, columns: int = COLUMNS, layout: DataFrame | None = None) -> DataFrame:
    """Fields (doc_id, field_id, at, w) placed left to right in order of at, a new row where the width runs out: x and y.

    With a layout, fields that are in it already are left out and the first new row is its next free one. A field given
    twice counts once, where it comes first. A fold over each layout's ordered list; a layout is one user's form, so
    the list is short."""
    fields = fields.groupBy("doc_id", "field_id").agg(F.min(F.struct("at", "w")).alias("f")).select("doc_id", "field_id", "f.*")
    if layout is not None:
        fields = placed(fields, layout, yes=False).join(next_free_row(layout), "doc_id", "left")
    else:
        fields = fields.withColumn("next_row", F.lit(0))
    item = F.struct("at", "field_id", F.greatest(F.lit(1), F.least("w", F.lit(columns))).alias("w"))
    lists = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.coalesce(F.max("next_row"), F.lit(0)).cast("int").alias("first"))
    kind = "array<struct<field_id:string,w:int,x:int,y:int>>"
    empty = F.array().cast(kind)

    def place(a: Column, i: Column) -> Column:
        wrap = a["x"] + i["w"] > columns
        x, y = F.when(wrap, F.lit(0)).otherwise(a["x"]), F.when(wrap, a["y"] + 1).otherwise(a["y"])
        return F.struct((x + i["w"]).alias("x"), y.alias("y"), F.concat(a["out"], F.array(F.struct(i["field_id"], i["w"].cast("int").alias("w"), x.alias("x"), y.alias("y"))).cast(kind)).alias("out"))

    folded = F.aggregate("items", F.struct(F.lit(0).alias("x"), F.col("first").alias("y"), empty.alias("out")), place, lambda a: a["out"])
    return lists.select("doc_id", F.inline(folded))


def json_schema(fields: DataFrame) -> DataFrame:
    """(doc_id, schema): each layout as a JSON Schema text."""
    types = F.create_map(*[F.lit(v) for kv in JSON_TYPES.items() for v in kv])
    prop = F.struct(
        types[F.col("type")].alias("type"), F.col("label").alias("title"), F.when(F.col("type") == "date", "date").alias("format"),
        F.when((F.col("type") == "multiple-choice") & (F.size("options") > 0), F.col("options")).alias("enum"),
        F.when(F.col("type") == "signature", "base64").alias("contentEncoding"), F.when(F.col("type") == "signature", "Signature image").alias("description"),
    )
    rows = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "field_id", prop.alias("p"), "required"))).alias("f"), F.first("title").alias("title"))
    entries = F.map_from_entries(F.transform("f", lambda r: F.struct(r["field_id"], r["p"])))
    needed = F.transform(F.filter("f", lambda r: r["required"]), lambda r: r["field_id"])
    body = F.struct(F.lit("https://json-schema.org/draft/2020-12/schema").alias("$schema"), F.col("title"), F.lit("object").alias("type"), entries.alias("properties"), needed.alias("required"))
    return rows.select("doc_id", F.to_json(body).alias("schema"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html(fields: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """(doc_id, html): each layout as an HTML form, fields by (y, x)."""
    name, label = escape_html(F.col("field_id")), escape_html(F.col("label"))
    req = F.when(F.col("required"), " required").otherwise("")
    text = F.format_string
    choice = F.array_join(F.transform("options", lambda o: F.concat(F.lit("<option>"), escape_html(o), F.lit("</option>"))), "")
    kind = F.when(F.col("type") == "date", "date").when(F.col("type") == "number", "number").otherwise("text")
    control = (
        F.when(F.col("type") == "checkbox", text('<label><input type="checkbox" name="%s"%s> %s</label>', name, req, label))
        .when(F.col("type") == "multiple-choice", text('<label>%s<select name="%s"%s>%s</select></label>', label, name, req, F.when(choice != "", choice).otherwise("<option></option>")))
        .when(F.col("type") == "signature", text('<label>%s<div class="sig" data-name="%s">Sign here</div></label>', label, name))
        .otherwise(text('<label>%s<input type="%s" name="%s" placeholder="%s"%s></label>', label, kind, name, escape_html(F.coalesce("placeholder", F.lit(""))), req))
    )
    cell = text('<div class="field" style="grid-column: span %d">%s</div>', F.greatest(F.lit(1), F.least("w", F.lit(columns))), control)
    rows = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", cell.alias("c")))).alias("c"), F.first("title").alias("title"))
    body = F.array_join(F.transform("c", lambda r: r["c"]), "\n")
    page = F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), escape_html(F.col("title")), F.lit(f"</title><style>form{{display:grid;grid-template-columns:repeat({columns},1fr)}}</style></head><body>\n<form>\n"), body, F.lit("\n</form></body></html>"))
    return rows.select("doc_id", page.alias("html"))

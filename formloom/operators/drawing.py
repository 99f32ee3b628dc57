"""Form pages drawn from rows of cells: tokens, ruled lines and page sizes, as a page reader would deliver them.

A cell is (doc_id, row, cell, cells, label, kind, value, options, rtl): the cell-th of the row's cells. kind says how the
answer is asked for:

* colon: `label:` and a ruled line up to the column's end
* blank: the label and a drawn blank that fills the column
* boxes: `label:` and a checkbox before each option
* value: `label:` and the value beside it

Rows go down the page at a fixed pitch with a little jitter, on as many pages as they need. Furniture is free text on a page
(title, instructions, footer, page number). Right-to-left texts are mirrored, characters of unspaced scripts are twice as
wide. Every step is a column expression on the cell at hand: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A page of A4 in points and where things stand on it.
WIDTH, HEIGHT, MARGIN, TOP, PITCH, ROWS = 595.0, 842.0, 60.0, 125.0, 34.0, 18
SIZE, RULE = 10.0, 0.5
#: Baselines move by the document's id, the same for all ids that are equal modulo this.
JITTER = 5
#: So many positions (see position()) a cell's value has before the next cell's begin.
VALUE_SPAN = 160
WIDE = r"[^\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}]"


def units(text: Column) -> Column:
    """Width of a text in half letters' heights: one a character, two where the script is written in squares."""
    return F.length(text) + F.length(F.regexp_replace(text, WIDE, ""))


def position(row, cell, piece):
    """pos of a piece's first word; row counts from the page's top, two rows of furniture above the cells. A value is piece 1."""
    return row * 1000 + cell * 200 + piece * 40


def _placed(cells: DataFrame) -> DataFrame:
    """cells with the column's width cw, the cell's x0, page, band (of the page's rows), baseline y, shown and its width tw."""
    cw = F.lit(WIDTH - 2 * MARGIN) / F.col("cells")
    c = cells.withColumns({
        "cw": cw, "x0": MARGIN + F.col("cell") * cw, "page": (F.floor(F.col("row") / ROWS) + 1).cast("int"), "band": (F.col("row") % ROWS).cast("int"),
        "shown": F.when(F.col("kind") == "blank", F.col("label")).otherwise(F.concat("label", F.lit(":"))),
    })
    jitter = F.pmod(F.col("doc_id") * 7 + F.col("row") * 13, F.lit(JITTER)) - 2
    return c.withColumns({"y": TOP + PITCH * F.col("band") + jitter, "tw": SIZE / 2 * units(F.col("shown"))})


def lines(cells: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, w, h) of the lines under the answers of colon cells."""
    c = _placed(cells).filter("kind = 'colon'")
    x, w = F.col("x0") + F.col("tw") + 6, F.col("cw") - F.col("tw") - 20
    return c.filter(w > 0).select("doc_id", "page", F.when(F.col("rtl"), WIDTH - x - w).otherwise(x).alias("x"), (F.col("y") + 2).alias("y"), w.alias("w"), F.lit(RULE).alias("h"))


def pages(cells: DataFrame) -> DataFrame:
    """(doc_id, page, width, height) of every page that the cells need."""
    n = cells.groupBy("doc_id").agg((F.floor(F.max("row") / ROWS) + 1).cast("int").alias("n"))
    return n.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def furniture(titles: DataFrame) -> DataFrame:
    """Free texts (doc_id, page, band, text, x, y, size, rtl) of titles(doc_id, title, hint, footer, rtl), on the first page."""
    text = lambda band, t, x, y, size, rtl: F.struct(F.lit(band).alias("band"), t.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(size).alias("size"), rtl.alias("rtl"))
    r = F.col("rtl")
    rows = F.array(
        text(-2, F.col("title"), MARGIN, 55.0, 16.0, r), text(-1, F.col("hint"), MARGIN, 80.0, 8.0, r), text(ROWS, F.col("footer"), MARGIN, HEIGHT - 40, 7.0, r),
        text(ROWS + 1, F.lit("Page 1 of 1"), WIDTH / 2 - 15, HEIGHT - 25, 8.0, F.lit(False)),
    )
    return titles.select("doc_id", F.lit(1).alias("page"), F.explode(rows).alias("f")).select("doc_id", "page", "f.*")


def _pieces(cells: DataFrame) -> DataFrame:
    """Texts of the cells with their places: doc_id, page, band, cell, piece, text, x, y, size, rtl."""
    piece = lambda text, dx: F.struct(text.alias("text"), dx.cast("double").alias("dx"))
    tw, half = F.col("tw"), SIZE / 2
    blank = F.repeat(F.lit("_"), F.greatest(F.lit(4), F.floor((F.col("cw") - tw - 24) / half).cast("int")))
    boxed = lambda o: F.concat(F.lit("☐ "), o)
    before = lambda i: F.aggregate(F.slice("options", F.lit(1), i), F.lit(0.0), lambda a, o: a + half * units(boxed(o)) + 16)
    options = F.transform("options", lambda o, i: piece(boxed(o), tw + 12 + before(i)))
    first = F.array(piece(F.col("shown"), F.lit(0.0)))
    more = F.when(F.col("kind") == "blank", F.array(piece(blank, tw + 6))).when(F.col("kind") == "value", F.array(piece(F.col("value"), tw + 8))).when(F.col("kind") == "boxes", options)
    c = _placed(cells).withColumn("p", F.concat(first, F.coalesce(more, F.array().cast("array<struct<text:string,dx:double>>"))))
    c = c.select("doc_id", "page", "band", "cell", "x0", "y", "rtl", F.posexplode("p").alias("piece", "p"))
    return c.select("doc_id", "page", "band", "cell", "piece", "p.text", (F.col("x0") + F.col("p.dx")).alias("x"), "y", F.lit(SIZE).alias("size"), "rtl")


def tokens(cells: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """doc_id, page, row, pos, text, x, y, w, h, confidence, rtl of every word of the cells and of free texts (furniture()).

    row counts a page's bands from the top. Null texts, and cells without a label, give no words; a row of more cells than
    fit, or longer texts than their column, overlap as they would on paper."""
    p = _pieces(cells)
    if free is not None:
        p = p.unionByName(free.select("doc_id", "page", "band", F.lit(0).alias("cell"), F.lit(0).alias("piece"), "text", "x", "y", "size", "rtl"))
    words = F.filter(F.split("text", " "), lambda w: w != "")
    # a piece is a label, an option or a line of furniture: a few words
    start = lambda ws, i: F.when(i == 0, 0).otherwise(units(F.array_join(F.slice(ws, F.lit(1), i), " ")) + 1)
    p = p.withColumn("ws", words)
    p = p.select("doc_id", "page", "band", "cell", "piece", "x", "y", "size", "rtl", F.posexplode(F.transform("ws", lambda w, i: F.struct(w.alias("text"), start(F.col("ws"), i).alias("before")))).alias("k", "t"))
    x, w = F.col("x") + F.col("size") / 2 * F.col("t.before"), F.col("size") / 2 * units(F.col("t.text"))
    row = F.col("band") + 2
    return p.select(
        "doc_id", "page", row.alias("row"), (position(row, F.col("cell"), F.col("piece")) + F.col("k")).alias("pos"), F.col("t.text").alias("text"),
        F.when(F.col("rtl"), WIDTH - x - w).otherwise(x).alias("x"), (F.col("y") - F.col("size")).alias("y"), w.alias("w"), (F.col("size") * 1.2).alias("h"), F.lit(1.0).alias("confidence"), "rtl",
    )

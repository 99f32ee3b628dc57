"""Pages as single rows of parallel arrays, and steps done once per distinct layout.

A page row is doc_id, page and arrays of one length: row, pos, text, x, y, w, h, confidence, rtl and mark (what kind of word
it is). Printed forms differ in their words far more than in their boxes. What a step needs besides the words is the page's
layout, so it is done once for each distinct layout and joined back; as nothing else goes in, the results are those of
a step per page. Pages that all differ cost the step each, and one shuffle of layouts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.normalise import SPACES
from ..shared import materialise

TOKEN = ["row", "pos", "text", "x", "y", "w", "h", "confidence", "rtl", "mark"]
#: Results up to so many tokens or candidates in all are broadcast to the pages, larger ones meet them by sorted keys.
BROADCAST = 100_000
#: What Python's str.isdigit takes beyond decimal digits.
_DIGITS = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}]"
COLON, BLANK, BOX, SOME_BOX, LETTERS, ALNUM, LIKE = (1 << k for k in range(7))


def marks(text: Column) -> Column:
    """What a word is, as bits; a literal's are told when the query is planned."""
    bare = F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")
    tests = [
        (G.colon_ended(text), COLON), (G.blank_line(text), BLANK), (G.box_glyph(bare), BOX), (G.has_box(text), SOME_BOX), (text.rlike(r"\p{L}"), LETTERS), (text.rlike(r"[\p{L}\p{N}]"), ALNUM),
        ((bare != "") & bare.rlike(G.P.VALUE_LIKE) & bare.rlike(_DIGITS), LIKE),
    ]
    return sum((F.when(test, bit).otherwise(0) for test, bit in tests[1:]), F.when(tests[0][0], tests[0][1]).otherwise(0)).cast("int")


def has(mark: Column, bit: int) -> Column:
    return mark.bitwiseAND(F.lit(bit)) > 0


def gathered(tokens: DataFrame, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Page rows of a table of tokens, each page's in the given order; row, confidence and rtl may be absent."""
    own = tokens.columns
    text = F.coalesce("text", F.lit(""))
    made = {
        "row": F.col("row").cast("int") if "row" in own else F.lit(0), "pos": F.col("pos").cast("int"), "text": text, **{c: F.col(c).cast("double") for c in "xywh"},
        "confidence": F.col("confidence").cast("double") if "confidence" in own else F.lit(1.0), "rtl": F.coalesce("rtl", F.lit(False)) if "rtl" in own else F.lit(False), "mark": marks(text),
    }
    names = [*order, *(n for n in made if n not in order)]
    t = tokens.select("doc_id", "page", F.struct(*[made[n].alias(n) for n in names]).alias("t"))
    t = t.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return t.select("doc_id", "page", *[F.col(f"t.{n}").alias(n) for n in TOKEN])


def exploded(layouts: DataFrame, keep: list[str]) -> DataFrame:
    """The tokens of layouts (layout_id, layout) as rows, with place (from 0) and the layout's single values in keep."""
    listed = [f.name for f in layouts.schema["layout"].dataType if f.name not in keep]
    t = layouts.select("layout_id", *[F.col(f"layout.{k}").alias(k) for k in keep], F.posexplode(F.arrays_zip(*[F.col(f"layout.{n}").alias(n) for n in listed])).alias("place", "t"))
    return t.select("layout_id", *keep, "place", *[F.col(f"t.{n}").alias(n) for n in listed])


def once(pages: DataFrame, parts: list[str], step: Callable[[DataFrame], DataFrame], weight: Column, doubt: Column | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """pages with `found`: what step gives for each layout (the columns named in parts), from a table (layout_id, layout) to
    one of (layout_id, found). weight: how much a found value holds, which decides how it gets to the pages. Pages whose
    found value is in doubt get what again makes of them instead."""
    keyed = pages.withColumn("layout", F.struct(*parts))
    distinct = materialise(keyed.select("layout").distinct().withColumn("layout_id", F.monotonically_increasing_id()), "layouts")
    found = materialise(distinct.join(step(distinct).hint("merge"), "layout_id").select("layout", "found"), "found")
    unsure = F.lit(False) if doubt is None else F.coalesce(doubt, F.lit(False))
    size, doubts = found.agg(F.sum(weight), F.count_if(unsure)).first()
    out = keyed.join(F.broadcast(found) if (size or 0) <= BROADCAST else found.hint("merge"), "layout").drop("layout")
    return out.filter(~unsure).unionByName(again(out.filter(unsure).drop("found"))) if doubts else out


def alike(text: Column) -> Column:
    """One text for all that differ in digits only. No pattern, word list or alias without digits tells them apart, except that
    patterns.NOISE takes a 1 for a stroke in words of up to three strokes: those stay."""
    stroke = (F.length(text) <= 3) & text.rlike(r"^[|l1I]{1,3}$")
    return F.when(stroke, text).otherwise(F.translate(text, "123456789", "0" * 9))


def prints(pages: DataFrame, step: Callable[[DataFrame], DataFrame], weight: Column, digits: bool = False, own: tuple[str, ...] = (), doubt: Column | None = None) -> DataFrame:
    """pages with `found`: what step makes of page rows that read alike, digits aside, once for all of them. step gets page
    rows, one per print with a doc_id of its own, and returns (doc_id, found) without rows for prints that have nothing; own names
    further columns of the page that it reads. digits: digits do matter to step. What depends on a page's own digits is made
    from its text and the positions found. doubt tells, from found, the prints whose pages may differ in what step makes of them:
    step gets those pages by their very words."""
    parts = ["page", "row", "pos", "x", "y", "w", "h", "confidence", "rtl", "read", *own]

    def of(distinct: DataFrame) -> DataFrame:
        p = distinct.select(F.col("layout_id").alias("doc_id"), "layout.*").withColumnRenamed("read", "text")
        return step(p.withColumn("mark", F.transform("text", marks))).withColumnRenamed("doc_id", "layout_id")

    if digits:
        return once(pages.withColumn("read", F.col("text")), parts, of, weight).drop("read")
    by_words = lambda rest: prints(rest.drop("read"), step, weight, True, own).withColumn("read", F.col("text"))
    return once(pages.withColumn("read", F.transform("text", alike)), parts, of, weight, doubt, by_words).drop("read")


def said(text: Column, at: Column) -> Column:
    """A page's words at these positions."""
    return F.trim(F.array_join(F.transform(at, lambda k: F.get(text, k)), " "))


def same_on_all(text: Column) -> Column:
    """A print's text that all its pages share, null if it holds digits that stand for others (see alike())."""
    return F.when(~F.contains(text, F.lit("0")), text)

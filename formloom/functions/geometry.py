"""Token predicates and box geometry as column expressions. A box is four columns x, y, w, h in page pixels."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from . import patterns as P


def colon_ended(text: Column) -> Column:
    return text.rlike(P.COLON_END)


def blank_line(text: Column) -> Column:
    return text.rlike(P.BLANK_LINE)


def box_glyph(text: Column) -> Column:
    """The token is a checkbox and nothing else."""
    return F.trim(text).rlike("^" + P.BOX_TOKEN + "$")


def has_box(text: Column) -> Column:
    return text.rlike(P.BOX_TOKEN)


def value_like(text: Column) -> Column:
    return F.trim(text).rlike(P.VALUE_LIKE) & text.rlike(r"\p{Nd}")


def median_height(h: Column, over: WindowSpec | None = None) -> Column:
    """Aggregate (or over a window): the median of positive heights, 12 where there is none."""
    median = F.median(F.when(h > 0, h.cast("double")))
    return F.coalesce(median if over is None else median.over(over), F.lit(12.0))


def union_box(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Aggregates x, y, w, h of the hull."""
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + w) - F.min(x)).alias("w"), (F.max(y + h) - F.min(y)).alias("h")]


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[k] + a[k + 2], b[k] + b[k + 2]) - F.greatest(a[k], b[k]))
    return side(0) * side(1)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (lists of x, y, w, h); 0 where they are apart."""
    both = overlap_area(a, b)
    return F.when(both > 0, both / (a[2] * a[3] + b[2] * b[3] - both)).otherwise(F.lit(0.0))


def line_near(box: list[Column], line: list[Column], tol: Column, max_width: Column) -> Column:
    """A ruled line runs just under the box, or just right of it; level lines over max_width don't count."""
    (x, y, w, h), (lx, ly, lw, lh) = box, line
    level = (lw > lh) & (lw <= max_width) & (F.abs(ly - (y + h)) <= tol) & (lx < x + w) & (lx + lw > x)
    upright = (lw <= lh) & (F.abs(lx - (x + w)) <= tol) & (ly < y + h) & (ly + lh > y)
    return level | upright

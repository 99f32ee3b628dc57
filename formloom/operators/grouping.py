"""Grouping a page's tokens into label and value candidates.

group_pages() searches, once per distinct layout: where to cut each text row into segments. baseline() is
the search's deterministic start (cut at gaps over three text heights) in array functions and joins only.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions.normalise import SPACES
from . import climb, layouts

MAX_LABEL = 7
_COLON, _BLANK, _BOX, _HAS = (re.compile(p) for p in (P.COLON_END, P.BLANK_LINE, "^" + P.BOX_TOKEN + "$", P.BOX_TOKEN))
_VALUE = re.compile(P.VALUE_LIKE.replace(r"\p{Nd}", r"\d").replace(r"\p{L}\p{N}_", r"\w"))


def text_height(heights: list[float]) -> float:
    """The median of the positive heights, 12 without any."""
    hs = sorted(h for h in heights if h > 0)
    return (hs[(len(hs) - 1) // 2] + hs[len(hs) // 2]) / 2 if hs else 12.0


def cluster_rows(x: list[float], middle: list[float], reach: float) -> list[list[int]]:
    """Token numbers by text row, each from left to right: a token, in order of height, joins the latest of the last
    three rows whose mean middle is within reach."""
    rows: list[list[int]] = []
    means: list[float] = []
    for k in sorted(range(len(x)), key=lambda k: (middle[k], x[k])):
        home = next((r for r in range(len(rows) - 1, max(-1, len(rows) - 4), -1) if abs(means[r] - middle[k]) <= reach), None)
        if home is None:
            rows.append([k])
            means.append(middle[k])
        else:
            rows[home].append(k)
            means[home] += (middle[k] - means[home]) / len(rows[home])
    rows = [sorted(r, key=x.__getitem__) for r in rows]
    return sorted(rows, key=lambda r: middle[r[0]])


class Piece(NamedTuple):
    """What a run of a row's tokens reads as, and what it costs."""

    label: list[int]
    value: list[int]
    sep: str
    box: bool
    region: tuple[float, float, float, float]
    score: float
    cost: float
    start: float | None  # where its label begins, if that can be part of a column


class Page:
    """One page as a search problem. A state is a list of bit sets, one per row: bit k cuts after the row's k-th token.

    What a token is (colon, drawn blank, box, ...) is looked up once. A run of tokens is read once, whatever states hold
    it; a row's cost and column starts are kept by its bit set; so a move costs its own row's look-up and the few columns that
    change."""

    def __init__(self, text, x, y, w, h, rtl, width: float, lines: list[tuple], marks: list[int] | None = None):
        """marks, where given, say of each token what is otherwise read from its text."""
        self.text, self.x, self.y, self.h, self.width = text, x, y, h, width
        self.right, self.low = [a + b for a, b in zip(x, w)], [a + b for a, b in zip(y, h)]
        self.unit = u = text_height(h)
        if marks is None:
            bare = [t.strip() for t in text]
            self.colon, self.blank = [bool(_COLON.search(t)) for t in text], [bool(_BLANK.match(t)) for t in text]
            self.box = [bool(_BOX.match(t)) for t in bare]
            self.boxed = [b or bool(_HAS.search(t)) for b, t in zip(self.box, text)]
            self.alnum = [any(map(str.isalnum, t)) for t in text]
            self.like = [bool(t and _VALUE.match(t)) and any(map(str.isdigit, t)) for t in bare]
            letters = [any(map(str.isalpha, t)) for t in text]
        else:
            told = lambda bit: [bool(m & bit) for m in marks]
            self.colon, self.blank, self.box, self.alnum, self.like = (told(b) for b in (layouts.COLON, layouts.BLANK, layouts.BOX, layouts.ALNUM, layouts.LIKE))
            self.boxed, letters = told(layouts.BOX | layouts.SOME_BOX), told(layouts.LETTERS)
        self.rows = cluster_rows(x, [a + b / 2 for a, b in zip(y, h)], 0.6 * u)
        self.back = [2 * sum(rtl[k] for k in r if letters[k]) > sum(letters[k] for k in r) for r in self.rows]
        for r, back in zip(self.rows, self.back):
            if back:
                r.reverse()
        self.gaps = [[x[a] - self.right[b] if back else x[b] - self.right[a] for a, b in zip(r, r[1:])] for r, back in zip(self.rows, self.back)]
        self.level = [(a, b, c) for a, b, c, d in lines if c > d and c <= 0.75 * width]
        self.upright = [(a, b, d) for a, b, c, d in lines if c <= d]
        self.bucket = max(2.0, 0.8 * u)
        self.read: list[dict[tuple[int, int], Piece]] = [{} for _ in self.rows]
        self.views: list[dict[int, tuple[float, list[tuple[int, int]]]]] = [{} for _ in self.rows]
        self.free: list[list[int] | None] = [None] * len(self.rows)

    # --- reading a run of tokens

    def hull(self, ks: list[int]) -> tuple[float, float, float, float]:
        """x, y, right and lower end of tokens."""
        return min(self.x[k] for k in ks), min(self.y[k] for k in ks), max(self.right[k] for k in ks), max(self.low[k] for k in ks)

    def divide(self, ks: list[int]) -> tuple[list[int], list[int], str, float]:
        """Label, value, kind of separator and the widest space that counts. The first mark that applies decides: a colon,
        drawn blanks beside other words, boxes beside other tokens, at last a wide space."""
        spaces = [self.x[b] - self.right[a] for a, b in zip(ks, ks[1:])]
        colon = next((n for n, k in enumerate(ks, 1) if self.colon[k]), 0)
        if colon:
            return ks[:colon], ks[colon:], "colon", 0.0
        for kind, marks, needed in (("blank", self.blank, 0), ("box", self.box, 2)):
            of = [k for k in ks if marks[k]]
            if of and (len(of) < len(ks) if kind == "blank" else len(ks) >= needed):
                rest = [k for k in ks if not marks[k]]
                return (rest, of, kind, 0.0) if rest else (ks, [], "", 0.0)
        widest = max(spaces, default=0.0)
        if widest > 2.5 * self.unit:
            n = spaces.index(widest) + 1
            return ks[:n], ks[n:], "", widest
        return ks, [], "", widest

    def piece(self, row: int, first: int, last: int) -> Piece:
        known = self.read[row].get((first, last))
        if known is not None:
            return known
        u, order = self.unit, self.rows[row]
        ks = order[first : last + 1]
        label, value, sep, inner = self.divide(ks)
        if len(label) > 1:
            inner = max(self.x[b] - self.right[a] for a, b in zip(label, label[1:]))
        box = any(self.boxed[k] for k in ks)
        lx, ly, lr, ll = self.hull(label)
        reach = 0.0
        if value:
            vx, vy, vr, vl = self.hull(value)
            region, reach = (vx, vy, vr - vx, vl - vy), vx - lr
        else:
            after = order[last + 1] if last + 1 < len(order) else None
            if self.back[row]:
                start, end = u if after is None else self.right[after] + 0.5 * u, lx - 0.3 * u
            else:
                start, end = lr + 0.3 * u, self.width - u if after is None else self.x[after] - 0.5 * u
            region = (start, ly, max(0.0, end - start), ll - ly)
            if not sep and region[2] >= 2 * u:
                sep = "line" if self.ruled(region) else ""
            elif not sep:
                under = next((k for k in self.loose_blanks(row + 1) if self.x[k] < lr and self.right[k] > lx and 0 <= self.y[k] - ll < 2.5 * u), None)
                if under is not None:
                    region = (self.x[under], self.y[under], self.right[under] - self.x[under], self.h[under])
                    sep, reach = "blank", self.y[under] - ll
        room = region[2]
        orphan = not value and not sep and room < 3 * u and not box
        like = all(self.like[k] for k in label)
        cost = (
            1.5 * orphan + 0.4 * max(0, len(label) - MAX_LABEL) + 1.5 * (not any(self.alnum[k] for k in label))
            + (1.2 + min(3.0, inner / (6 * u)) if inner > 3 * u else 0.0) + 0.8 * (reach > 6 * u)
            + ((-0.5 if sep == "line" else -0.9) - 0.3 * bool(value) + 0.6 * (not value and room < 2 * u and not box) if sep else 0.0)
            - 0.4 * box + 1.0 * like + 2.0 * (first > 0 and self.box[ks[0]]) + 0.05 * max(0, len(value) - 12)
            + (0.0 if value else -0.5 * (room >= 3 * u and not like) + 0.6 * (not sep and room < 2 * u))
        )
        sure = 0.55 + 0.25 * bool(sep) + 0.1 * box + 0.1 * (not value and room >= 3 * u) - 0.35 * orphan - 0.2 * (inner > 3 * u) - 0.15 * (len(label) > MAX_LABEL)
        column = self.x[label[0]] if first == 0 or self.gaps[row][first - 1] > 2 * u else None
        self.read[row][first, last] = out = Piece(label, value, sep, box, region, round(max(0.0, min(1.0, sure)), 3), cost, column)
        return out

    def ruled(self, region: tuple) -> bool:
        """A ruled line runs under the region or stands at its right end."""
        x, y, w, h = region
        near = 0.8 * self.unit
        return any(abs(b - (y + h)) <= near and a < x + w and a + c > x for a, b, c in self.level) or any(abs(a - (x + w)) <= near and b < y + h and b + d > y for a, b, d in self.upright)

    def loose_blanks(self, row: int) -> list[int]:
        """A row's drawn blanks that have no word of the row beside them."""
        if row >= len(self.rows):
            return []
        if self.free[row] is None:
            words = [k for k in self.rows[row] if not self.blank[k]]
            beside = lambda k: any(min(abs(self.x[k] - self.right[o]), abs(self.x[o] - self.right[k])) < 3 * self.unit for o in words)
            self.free[row] = [k for k in self.rows[row] if self.blank[k] and not beside(k)]
        return self.free[row]

    # --- states

    def pieces(self, row: int, cuts: int) -> list[Piece]:
        out, first = [], 0
        for k in range(len(self.gaps[row])):
            if cuts >> k & 1:
                out.append(self.piece(row, first, k))
                first = k + 1
        out.append(self.piece(row, first, len(self.gaps[row])))
        return out

    def view(self, row: int, cuts: int) -> tuple[float, list[tuple[int, int]]]:
        """A row's cost without columns, and its column starts as (bucket, how many)."""
        known = self.views[row].get(cuts)
        if known is None:
            ps = self.pieces(row, cuts)
            cost = sum(p.cost for p in ps) + 0.25 * (len(ps) - 1)
            for a, b in zip(ps, ps[1:]):
                if a.box:
                    cost += 2.0 if b.box else 1.5 if not b.sep and not b.value and len(b.label) <= 2 else 0.0
            starts: dict[int, int] = {}
            for p in ps:
                if p.start is not None:
                    n = int(p.start // self.bucket)
                    starts[n] = starts.get(n, 0) + 1
            self.views[row][cuts] = known = (cost, list(starts.items()))
        return known

    def columns(self, state: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for r, cuts in enumerate(state):
            for n, m in self.view(r, cuts)[1]:
                out[n] = out.get(n, 0) + m
        return out

    def cost(self, state: list[int]) -> float:
        return sum(self.view(r, cuts)[0] for r, cuts in enumerate(state)) - 0.35 * sum(n for n in self.columns(state).values() if n > 1)

    def plain(self) -> list[int]:
        return [sum(1 << k for k, g in enumerate(gs) if g > 3 * self.unit) for gs in self.gaps]

    def draw(self, rng: random.Random) -> list[int]:
        if rng.random() < 0.34:
            return self.plain()
        wide = rng.uniform(1.5, 5.0) * self.unit
        return [sum(1 << k for k, g in enumerate(gs) if g > wide or rng.random() < 0.08) for gs in self.gaps]

    def best_move(self, state: list[int], bar: float) -> tuple[int, int, float, int]:
        """Of all moves of one cut (set, lift, shift to a neighbour) the cheapest under the bar, the first of equals: row
        (-1: none), its new cuts, the cost, and how many were looked at."""
        views = [self.view(r, cuts) for r, cuts in enumerate(state)]
        columns, total = self.columns(state), sum(v[0] for v in views)
        counted = sum(n for n in columns.values() if n > 1)
        best, tried = (-1, 0, bar), 0
        for r, cuts in enumerate(state):
            others = total - views[r][0]
            own = dict(views[r][1])
            shared = counted - sum((n if n > 1 else 0) - (n - m if n - m > 1 else 0) for n, m in ((columns[b], m) for b, m in own.items()))
            known = self.views[r]
            last = len(self.gaps[r])
            for k in range(last):
                bit = 1 << k
                moves = [cuts ^ bit]
                if cuts & bit:
                    if k and not cuts & bit >> 1:
                        moves.append(cuts ^ bit | bit >> 1)
                    if k + 1 < last and not cuts & bit << 1:
                        moves.append(cuts ^ bit | bit << 1)
                for other in moves:
                    tried += 1
                    cost, starts = known.get(other) or self.view(r, other)
                    n = shared
                    for b, m in starts:
                        before = columns.get(b, 0) - own.get(b, 0)
                        after = before + m
                        n += (after if after > 1 else 0) - (before if before > 1 else 0)
                    cost = others + cost - 0.35 * n
                    if cost < best[2] - climb.EPSILON:
                        best = (r, other, cost)
        return *best, tried

    def search(self, restarts: int, most: int, seed: int) -> climb.Climb:
        """The best of several descents from drawn states; one seeded generator draws all. Counts add up."""
        rng, best, steps, tried = random.Random(seed), None, 0, 0
        for _ in range(max(1, restarts)):
            state = self.draw(rng)
            start = cost = self.cost(state)
            tried += 1
            for _ in range(most):
                steps += 1
                row, cuts, _, n = self.best_move(state, cost)
                tried += n
                if row < 0:
                    break
                state = [*state[:row], cuts, *state[row + 1 :]]
                cost = self.cost(state)  # afresh, so differences don't add up
            if best is None or cost < best.cost - climb.EPSILON:
                best = climb.Climb(state, cost, start)
        return climb.Climb(best.state, best.cost, best.start_cost, steps, tried)

    def prose(self, row: int) -> bool:
        ks = self.rows[row]
        return len(ks) >= 8 and all(g < 1.2 * self.unit for g in self.gaps[row]) and not any(self.colon[k] or self.blank[k] or self.box[k] for k in ks)


def map_pages(t: DataFrame, step: Callable[[dict[str, list]], list[tuple]], schema: str, order: str = "pos") -> DataFrame:
    """step over each page of t (doc_id, page, ..., ordered by `order`): its columns as lists, the result's rows.

    Pages lie one after the other in sorted partitions, so many share an Arrow batch both ways; one that goes on in the next
    batch is kept until it is whole. They are dealt over all shuffle partitions: a search costs far more time than its few
    bytes tell, and partitions of a given number are not merged by their bytes."""
    width = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    names = t.columns
    arrow = arrow_schema(schema)

    def run(batches):
        open_: dict[str, list] = {n: [] for n in names}

        def whole(final: bool):
            """Result rows of the pages that are complete."""
            docs, pages = open_["doc_id"], open_["page"]
            edges = [0, *(k for k in range(1, len(docs)) if docs[k] != docs[k - 1] or pages[k] != pages[k - 1])]
            ends = [*edges[1:], len(docs)] if final else edges[1:]
            out = []
            for a, b in zip(edges, ends):
                if b > a:
                    out += step({n: c[a:b] for n, c in open_.items()})
            done = ends[-1] if ends else 0
            for n in names:
                open_[n] = open_[n][done:]
            return out

        for batch in batches:
            for n, c in zip(names, batch.columns):
                open_[n] += c.to_pylist()
            yield from _batches(whole(False), arrow)
        yield from _batches(whole(True), arrow)

    return t.repartition(width, "doc_id", "page").sortWithinPartitions("doc_id", "page", order).mapInArrow(run, schema)


def _batches(rows: list[tuple], arrow: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


_FOUND = (
    "struct<state:array<struct<label:array<int>,value:array<int>,shown:array<int>,region:array<double>,bbox:array<double>,score:double,sep:string,box:boolean,prose:boolean,label_h:double>>,"
    "cost:double,start_cost:double,iterations:int,evaluations:int>"
)


def _map_layouts(distinct: DataFrame, step: Callable[[dict], object], found: str) -> DataFrame:
    """step over each layout in Arrow batches: (layout_id, found). Dealt over all shuffle partitions, as a layout is few bytes
    and much time."""
    spark = distinct.sparkSession
    schema = f"layout_id long, found {found}"
    kind = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            ids = batch.column("layout_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([step(v) for v in batch.column("layout").to_pylist()], kind.field("found").type)], schema=kind)

    return distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "layout_id").select("layout_id", "layout").mapInArrow(run, schema)


def group_pages(tokens: DataFrame, pages: DataFrame | None = None, lines: DataFrame | None = None, search: bool = True, restarts: int = 6, most: int = 150, seed: int = 0, width: float = 600.0) -> DataFrame:
    """Candidates of every (doc_id, page) of tokens (pos, text, x, y, w, h, confidence, rtl optional), or of page rows (see
    layouts).

    A page is searched by its layout: boxes, kinds of words, width and ruled lines. Pages of one layout are searched once. The
    seed is used anew for each, so results do not depend on the partitioning."""
    t = tokens if "mark" in tokens.columns else layouts.gathered(tokens)
    if pages is not None:
        t = t.join(pages.select("doc_id", "page", F.col("width").cast("double").alias("width")).hint("merge"), ["doc_id", "page"])
    else:
        t = t.withColumn("width", F.lit(width))
    box = F.array(*[F.col(c).cast("double") for c in "xywh"])
    if lines is not None:
        t = t.join(lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(box)).alias("ruled")).hint("merge"), ["doc_id", "page"], "left")
    else:
        t = t.withColumn("ruled", F.lit(None).cast("array<array<double>>"))

    def run(p: dict) -> dict:
        page = Page(None, p["x"], p["y"], p["w"], p["h"], p["rtl"], p["width"], [tuple(b) for b in p["ruled"] or []], p["mark"])
        if search:
            got = page.search(restarts, most, seed)
        else:
            c = page.cost(page.plain())
            got = climb.Climb(page.plain(), c, c, 0, 1)
        out = []
        for r, cuts in enumerate(got.state):
            prose = page.prose(r)
            for q in page.pieces(r, cuts):
                x, y, right, low = page.hull(q.label + q.value)
                rx, ry, rw, rh = q.region
                x, y, right, low = min(x, rx), min(y, ry), max(right, rx + rw), max(low, ry + rh)
                out.append({
                    "label": q.label, "value": q.value, "shown": [k for k in q.value if not page.blank[k]], "region": [round(v, 1) for v in q.region], "bbox": [round(v, 1) for v in (x, y, right - x, low - y)],
                    "score": q.score, "sep": q.sep, "box": q.box, "prose": prose, "label_h": max(page.h[k] for k in q.label),
                })
        return {"state": out, "cost": round(got.cost, 3), "start_cost": round(got.start_cost, 3), "iterations": got.iterations, "evaluations": got.evaluations}

    t = layouts.once(t, ["x", "y", "w", "h", "rtl", "mark", "width", "ruled"], lambda distinct: _map_layouts(distinct, run, _FOUND), F.size("found.state"))
    figures = [F.col(f"found.{c}").alias(f"pass_{c}") for c in ("cost", "start_cost", "iterations", "evaluations")]
    t = t.select("doc_id", "page", "pos", "text", "confidence", *figures, F.posexplode("found.state").alias("k", "c"))
    of = lambda listed, at: F.transform(at, lambda k: F.get(listed, k))
    said = lambda at: F.regexp_replace(F.array_join(of(F.col("text"), F.col(at)), " "), f"^{SPACES}|{SPACES}$", "")
    return t.select(
        "doc_id", "page", F.format_string("p%d_c%03d", "page", F.col("k") + 1).alias("candidate_id"), of(F.col("pos"), F.col("c.label")).alias("label_tokens"), said("c.label").alias("label"),
        of(F.col("pos"), F.col("c.value")).alias("value_tokens"), said("c.shown").alias("value"), "c.region", "c.bbox", F.col("c.score").alias("grouping_score"), (F.col("c.sep") != "").alias("has_separator"),
        F.col("c.box").alias("has_box"), F.col("c.sep").alias("separator"), F.col("c.prose").alias("prose_row"), "c.label_h", F.array_min(of(F.col("confidence"), F.col("c.label"))).alias("label_confidence"),
        *[f"pass_{c}" for c in ("cost", "start_cost", "iterations", "evaluations")],
    )


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def row_clusters(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, pos, row_no, place) of every token by row clustering."""

    def run(p: dict) -> list[dict]:
        rows = cluster_rows(p["x"], [y + h / 2 for y, h in zip(p["y"], p["h"])], 0.6 * text_height(p["h"]))
        return [{"k": k, "row_no": n, "place": at} for n, r in enumerate(rows) for at, k in enumerate(r)]

    t = tokens if "mark" in tokens.columns else layouts.gathered(tokens.select("doc_id", "page", "pos", F.lit("").alias("text"), *"xywh"))
    t = layouts.once(t, ["x", "y", "h"], lambda distinct: _map_layouts(distinct, run, "array<struct<k:int,row_no:int,place:int>>"), F.size("found"))
    return t.select("doc_id", "page", "pos", F.explode("found").alias("c")).select("doc_id", "page", F.get("pos", F.col("c.k")).alias("pos"), "c.row_no", "c.place")


STRIP = 100.0  #: height of the strips by which label regions and ruled lines meet


def _hull(toks: Column) -> list[Column]:
    """x, y, right, bottom of an array of tokens."""
    side = lambda f: F.transform(toks, f)
    return [F.array_min(side(lambda t: t["x"])), F.array_min(side(lambda t: t["y"])), F.array_max(side(lambda t: t["r"])), F.array_max(side(lambda t: t["y"] + t["h"]))]


def _spaces(toks: Column) -> Column:
    """The gaps between neighbours of an array of tokens, from left to right."""
    return F.zip_with(F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: b["x"] - a["r"])


def page_rows(tokens: DataFrame, pages: DataFrame | None = None, width: float = 600.0) -> DataFrame:
    """Rows of pages: doc_id, page, row, t (the row's tokens in reading order), back (it reads from right to left), u (the
    page's median text height), width, and free (drawn blanks of the next row with no word beside them).

    Tokens are gathered by row before they are shuffled, so what moves is one value a row; the page's height comes from
    counts of heights, which combine in the same way."""
    text = F.col("text")
    rtl = F.coalesce(F.col("rtl"), F.lit(False)) if "rtl" in tokens.columns else F.lit(False)
    box = [F.col(c).cast("double").alias(c) for c in "xywh"]
    if "mark" in tokens.columns:
        kinds = [layouts.has(F.col("mark"), bit).alias(n) for n, bit in (("colon", layouts.COLON), ("blank", layouts.BLANK), ("box", layouts.BOX), ("some_box", layouts.SOME_BOX), ("letters", layouts.LETTERS))]
    else:
        kinds = [G.colon_ended(text).alias("colon"), G.blank_line(text).alias("blank"), G.box_glyph(text).alias("box"), G.has_box(text).alias("some_box"), text.rlike(r"\p{L}").alias("letters")]
    tok = F.struct(
        box[0], "pos", "text", box[1], box[3], (F.col("x") + F.col("w")).cast("double").alias("r"), F.col("confidence").cast("double").alias("confidence") if "confidence" in tokens.columns else F.lit(1.0).alias("confidence"), rtl.alias("rtl"), *kinds,
    )
    # dealt by page in a given number of partitions, which are not merged by their few bytes: what follows costs more time
    # than those tell. The join and the window follow on that.
    rows = tokens.groupBy("doc_id", "page", "row").agg(F.array_sort(F.collect_list(tok)).alias("t"))
    rows = rows.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "doc_id", "page")
    heights = tokens.groupBy("doc_id", "page").agg(G.median_height(F.col("h")).alias("u"))
    if pages is not None:
        heights = heights.join(pages.select("doc_id", "page", F.col("width").cast("double").alias("width")).dropDuplicates(["doc_id", "page"]), ["doc_id", "page"], "left").withColumn("width", F.coalesce("width", F.lit(width)))
    else:
        heights = heights.withColumn("width", F.lit(width))
    count = lambda f: F.size(F.filter("t", f))
    rows = rows.join(heights, ["doc_id", "page"]).withColumn("back", 2 * count(lambda t: t["letters"] & t["rtl"]) > count(lambda t: t["letters"]))
    rows = rows.withColumn("t", F.when(F.col("back"), F.reverse("t")).otherwise(F.col("t")))
    beside = lambda t: F.exists("t", lambda o: ~o["blank"] & (F.least(F.abs(t["x"] - o["r"]), F.abs(o["x"] - t["r"])) < 3 * F.col("u")))
    blanks = F.when(F.exists("t", lambda t: t["blank"]), F.filter("t", lambda t: t["blank"] & ~beside(t)))
    blanks = F.transform(F.coalesce(blanks, F.slice("t", 1, 0)), lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["r"].alias("r"), t["h"].alias("h")))
    return rows.withColumn("free", blanks).withColumn("free", F.lead("free").over(W.partitionBy("doc_id", "page").orderBy("row")))


def baseline(tokens: DataFrame, width: float = 600.0, pages: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """The deterministic grouping (cut at gaps over three text heights) in column expressions: what group_pages() gives
    without search, for tokens that carry their row (and rtl, where rows may read from right to left).

    doc_id, page, row, seg, label, value, separator, has_separator, has_box, grouping_score, prose_row, label_h,
    label_confidence, region and bbox (x, y, w, h), y (of the label) and mh. Ruled lines (doc_id, page, x, y, w, h) meet the
    regions of labels without value or separator by strips of the page, so a page of many lines is no product."""
    return _baseline(tokens, width, pages, lines).drop("label_at", "value_at")


def _baseline(tokens: DataFrame, width: float = 600.0, pages: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """baseline() with the positions of the label's and the shown value's tokens."""
    u = F.col("u")
    s = page_rows(tokens, pages, width)
    n = F.size("t")
    # spaces in reading order; a row that reads backwards has its next token to the left
    ahead = F.zip_with(F.slice("t", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("t", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(F.col("back"), a["x"] - b["r"]).otherwise(b["x"] - a["r"]))
    s = s.withColumn("gaps", ahead)
    marked = F.exists("t", lambda t: t["colon"] | t["blank"] | t["box"])
    s = s.withColumn("prose_row", (n >= 8) & F.forall("gaps", lambda g: g < 1.2 * u) & ~marked)
    ends = F.concat(F.filter(F.transform("gaps", lambda g, k: F.when(g > 3 * u, k + 1).otherwise(0)), lambda k: k > 0), F.array(n))
    s = s.withColumn("ends", ends).withColumn("parts", F.transform("ends", lambda e, k: F.struct(
        k.alias("seg"), F.slice("t", F.when(k == 0, 1).otherwise(F.get("ends", k - 1) + 1), e - F.when(k == 0, 0).otherwise(F.get("ends", k - 1))).alias("t"), F.get("t", e).alias("next"),
    )))
    # a row has a part at least; explode() would add a filter on that, which repeats all of the above
    s = s.select("doc_id", "page", "row", "u", "width", "back", "free", "prose_row", F.explode_outer("parts").alias("part")).select("*", "part.*").drop("part")
    some = lambda f: F.exists("t", lambda x: x[f])
    every = lambda f: F.forall("t", lambda x: x[f])
    stop = F.array_position(F.transform("t", lambda x: x["colon"]), True)
    by_blank = (stop == 0) & some("blank") & ~every("blank")
    boxed = (stop == 0) & ~by_blank & some("box") & (n > 1)
    by_box = boxed & ~every("box")
    s = s.withColumns({"stop": stop, "by_blank": by_blank, "boxed": boxed, "by_box": by_box, "inner": _spaces(F.col("t"))})
    by_gap = (F.col("stop") == 0) & ~F.col("by_blank") & ~F.col("boxed") & (F.array_max("inner") > 2.5 * u)
    s = s.withColumn("by_gap", F.coalesce(by_gap, F.lit(False)))
    end = F.when(F.col("stop") > 0, F.col("stop")).when(F.col("by_gap"), F.array_position("inner", F.array_max("inner"))).otherwise(n).cast("int")
    pick = lambda f, on: F.filter("t", lambda x: x[f] == on)
    s = s.withColumns({
        "l": F.when(F.col("by_blank"), pick("blank", False)).when(F.col("by_box"), pick("box", False)).otherwise(F.slice("t", F.lit(1), end)),
        "v": F.when(F.col("by_blank"), pick("blank", True)).when(F.col("by_box"), pick("box", True)).otherwise(F.slice("t", end + 1, F.greatest(n - end, F.lit(0)))),
        "sep": F.when(F.col("stop") > 0, "colon").when(F.col("by_blank"), "blank").when(F.col("by_box"), "box").otherwise(""), "has_box": some("some_box") | some("box"),
    })
    widest = F.when(F.size("l") > 1, F.array_max(_spaces(F.col("l")))).when(F.col("by_gap"), F.array_max("inner")).otherwise(0.0)
    lab, val = _hull(F.col("l")), _hull(F.col("v"))
    s = s.withColumns({"inner": widest, "empty": F.size("v") == 0, **{f"l{k}": c for k, c in enumerate(lab)}, **{f"v{k}": c for k, c in enumerate(val)}})
    start = F.when(F.col("back"), F.when(F.col("next").isNull(), u).otherwise(F.col("next.r") + 0.5 * u)).otherwise(F.col("l2") + 0.3 * u)
    stop_at = F.when(F.col("back"), F.col("l0") - 0.3 * u).otherwise(F.when(F.col("next").isNull(), F.col("width") - u).otherwise(F.col("next.x") - 0.5 * u))
    s = s.withColumns({"rx": F.when(F.col("empty"), start).otherwise(F.col("v0")), "rw": F.when(F.col("empty"), F.greatest(F.lit(0.0), stop_at - start)).otherwise(F.col("v2") - F.col("v0"))})
    s = s.withColumns({"ry": F.when(F.col("empty"), F.col("l1")).otherwise(F.col("v1")), "rh": F.when(F.col("empty"), F.col("l3") - F.col("l1")).otherwise(F.col("v3") - F.col("v1"))})
    bare = F.col("empty") & (F.col("sep") == "")
    room = F.col("rw") >= 2 * u
    if lines is not None:
        asked = s.filter(bare & room).select("doc_id", "page", "row", "seg", *[F.col(f"r{c}") for c in "xywh"], "u", "width")
        strips = lambda low, high: F.explode(F.sequence(F.floor(low / STRIP), F.floor(high / STRIP)))
        asked = asked.withColumn("strip", strips(F.col("ry") - 0.8 * u, F.col("ry") + F.col("rh") + 0.8 * u))
        ruled = lines.select("doc_id", "page", *[F.col(c).cast("double").alias(f"line_{c}") for c in "xywh"])
        ruled = ruled.withColumn("strip", strips(F.col("line_y"), F.col("line_y") + F.greatest("line_h", F.lit(0.0))))
        near = G.line_near([F.col(f"r{c}") for c in "xywh"], [F.col(f"line_{c}") for c in "xywh"], 0.8 * u, 0.75 * F.col("width"))
        hit = asked.join(ruled, ["doc_id", "page", "strip"]).filter(near).select("doc_id", "page", "row", "seg").distinct().withColumn("ruled", F.lit(True))
        s = s.join(hit, ["doc_id", "page", "row", "seg"], "left")
    else:
        s = s.withColumn("ruled", F.lit(None).cast("boolean"))
    under = F.filter("free", lambda t: (t["x"] < F.col("l2")) & (t["r"] > F.col("l0")) & (t["y"] - F.col("l3") >= 0) & (t["y"] - F.col("l3") < 2.5 * u))
    s = s.withColumn("below", F.when(bare & ~room, F.get(under, F.lit(0))))
    s = s.withColumn("sep", F.when(F.coalesce("ruled", F.lit(False)), "line").when(F.col("below").isNotNull(), "blank").otherwise(F.col("sep")))
    place = lambda c, own: F.coalesce(own, F.col(c))
    s = s.withColumns({"rx": place("rx", F.col("below.x")), "rw": place("rw", F.col("below.r") - F.col("below.x")), "ry": place("ry", F.col("below.y")), "rh": place("rh", F.col("below.h"))})
    bonus = lambda c, v: F.when(c, v).otherwise(F.lit(0.0))
    no_sep, wide = F.col("sep") == "", F.col("rw") >= 3 * u
    orphan = F.col("empty") & no_sep & ~wide & ~F.col("has_box")
    score = 0.55 + bonus(~no_sep, 0.25) + bonus(F.col("has_box"), 0.1) + bonus(F.col("empty") & wide, 0.1) - bonus(orphan, 0.35) - bonus(F.col("inner") > 3 * u, 0.2) - bonus(F.size("l") > MAX_LABEL, 0.15)
    joined = lambda a: F.trim(F.array_join(F.transform(a, lambda x: x["text"]), " "))
    whole = _hull(F.col("t"))
    bx, by = F.least(whole[0], F.col("rx")), F.least(whole[1], F.col("ry"))
    return s.select(
        "doc_id", "page", "row", F.col("seg").cast("int").alias("seg"), joined("l").alias("label"), joined(F.filter("v", lambda x: ~x["blank"])).alias("value"), F.col("sep").alias("separator"), (~no_sep).alias("has_separator"), "has_box",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3).alias("grouping_score"), "prose_row", F.array_max(F.transform("l", lambda x: x["h"])).alias("label_h"), F.array_min(F.transform("l", lambda x: x["confidence"])).alias("label_confidence"),
        F.array(*[F.col(f"r{c}") for c in "xywh"]).alias("region"), F.array(bx, by, F.greatest(whole[2], F.col("rx") + F.col("rw")) - bx, F.greatest(whole[3], F.col("ry") + F.col("rh")) - by).alias("bbox"), F.col("l1").alias("y"), u.alias("mh"),
        F.transform("l", lambda x: x["pos"]).alias("label_at"), F.transform(F.filter("v", lambda x: ~x["blank"]), lambda x: x["pos"]).alias("value_at"),
    )


def baseline_pages(pages: DataFrame, width: float = 600.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """baseline() of page rows (see layouts), once per distinct layout; the words come in at the end, and nothing but layouts is
    shuffled. With label_at and value_at, the places of the label's and the shown value's words. keep: further columns of the pages."""
    said = ["row", "seg", "separator", "has_separator", "has_box", "grouping_score", "prose_row", "label_h", "label_confidence", "region", "bbox", "y", "mh", "label_at", "value_at"]

    def step(distinct: DataFrame) -> DataFrame:
        t = layouts.exploded(distinct, []).withColumnsRenamed({"layout_id": "doc_id", "place": "pos"}).withColumns({"page": F.lit(1), "text": F.lit("")})
        return _baseline(t, width).groupBy(F.col("doc_id").alias("layout_id")).agg(F.array_sort(F.collect_list(F.struct(*said))).alias("found"))

    t = layouts.once(pages, ["row", "x", "y", "w", "h", "confidence", "rtl", "mark"], step, F.size("found"))
    t = t.select("doc_id", "page", *keep, "text", F.explode("found").alias("c"))
    joined = lambda at: layouts.said(F.col("text"), F.col(at))
    return t.select("doc_id", "page", *keep, joined("c.label_at").alias("label"), joined("c.value_at").alias("value"), *[f"c.{n}" for n in said])


def label_columns(starts: Column, unit: float = 12.0) -> Column:
    """The column bucket of a label's start."""
    return F.floor(starts / max(2.0, 0.8 * unit))

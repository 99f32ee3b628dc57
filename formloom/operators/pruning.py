"""Keeping real fields and dropping junk among candidates."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from . import climb
from .grouping import map_pages

BANDS = 5


def options_of(value: Column) -> Column:
    """The texts between checkbox glyphs."""
    return F.filter(F.transform(F.split(value, P.BOX_TOKEN), lambda o: F.regexp_replace(o, "^[ :]+|[ :]+$", "")), lambda o: o != "")


def add_options(asked: DataFrame) -> DataFrame:
    """Two or more boxes in the value make a multiple choice of the texts between them, one box a checkbox."""
    boxes = F.when(F.col("has_box") & (F.col("value") != ""), F.regexp_count("value", F.lit(P.BOX_TOKEN))).otherwise(F.lit(0))
    found = options_of(F.col("value"))
    many = (boxes >= 2) & (F.size(found) > 0)
    bare = F.trim(F.regexp_replace(F.trim("label"), "[:：]+$", ""))
    unnamed = many & F.col("template_key").isNull()
    return asked.withColumns({
        "options": F.when(many, found).otherwise(F.col("options")),
        "question": F.when(unnamed, F.when(bare.endswith("?"), bare).otherwise(F.concat(F.lit("Which option applies for '"), bare, F.lit("'?")))).otherwise(F.col("question")),
        "label_en": F.when(unnamed, bare).otherwise(F.col("label_en")),
        "type": F.when(many, "multiple-choice").when((boxes == 1) & (F.col("type") != "multiple-choice"), "checkbox").otherwise(F.col("type")),
    })


def evidence(c: DataFrame) -> DataFrame:
    """candidates with junk and genuine, each up to 1.

    Needs label, value, y, page_height, strength, template_key, has_separator, has_box, separator, grouping_score,
    region_w, prose_row, label_h, label_confidence and mh (the page's median height)."""
    norm, match = F.trim("label"), F.col("strength")
    words = F.size(F.filter(F.split(norm, r"\s+"), lambda w: w != ""))
    strong = F.col("has_separator") & (F.col("separator") != "line")
    weak, unsure = ~strong, match < 0.9
    at = F.col("y") / F.greatest(F.col("page_height"), F.lit(1.0))
    add = lambda cond, v: F.when(cond, F.lit(float(v))).otherwise(F.lit(0.0))
    # what costs little comes first, as a pattern isn't tried where that says no already
    junk = [
        add(weak & norm.rlike(P.PAGE_NUMBER), 0.9), add(norm.rlike(P.NOISE), 0.8), add(weak & ~F.col("has_box") & (F.length(norm) <= 2) & (words == 1), 0.5),
        add(weak & ~F.col("has_box") & unsure & ((at < 0.08) | (at > 0.93)), 0.45), add(weak & unsure & F.concat(norm, F.lit(" "), F.col("value")).rlike(P.any_word(P.TITLE_WORDS)), 0.35),
        add(weak & (words >= 4) & norm.rlike(P.any_word(P.INSTRUCTION_WORDS)), 0.45), add(weak & (words >= 9), 0.4),
        add(weak & ((F.length(norm) >= 18) | (words >= 5)) & norm.rlike(r"[.。।!?]$"), 0.5), add(weak & unsure & (words >= 6), 0.3),
        add(norm.rlike(r"^[\s" + P.BOX + r"\[\]()xX✓✔]+$"), 0.9), add(weak & unsure & (words >= 3) & (norm == F.upper(norm)) & (norm != F.lower(norm)), 0.2),
        F.when((F.col("label_h") > 2.2 * F.col("mh")) & weak, 0.35).when((F.col("label_h") > 1.5 * F.col("mh")) & weak & unsure, 0.2).otherwise(0.0),
        add(F.col("label_confidence") < 0.4, 0.3), add(G.blank_line(norm), 0.7), add(F.col("grouping_score") < 0.35, 0.25), add(weak & F.col("prose_row"), 0.6),
    ]
    good = [
        F.when(strong, 0.45).when(F.col("has_separator"), 0.2).otherwise(0.0), add(F.col("has_box"), 0.3), F.when(F.col("template_key").isNotNull(), 0.5 * match).otherwise(0.0),
        add(F.col("region_w") >= 3 * F.col("mh"), 0.15), add(~F.col("has_separator") & (F.col("value") != "") & words.between(1, 5), 0.1), 0.2 * F.col("grouping_score"),
    ]
    # added up by a function on an array: as one generated method these sums pass the size that the JVM compiles
    total = lambda parts: F.least(F.lit(1.0), F.aggregate(F.array(*parts), F.lit(0.0), lambda a, x: a + x))
    return c.withColumns({"junk": total(junk), "genuine": total(good)})


def overlaps(c: DataFrame, mh: float | Column = 12.0) -> DataFrame:
    """Pairs (doc_id, page, a, b) of candidates a < b that cover each other or repeat a label nearby.

    Boxes x, y, w, h meet by the horizontal strips they touch (one text height of slack), so pages of many candidates do
    not compare all pairs."""
    strip = 100.0
    mh = mh if isinstance(mh, Column) else F.lit(float(mh))
    t = c.withColumn("slack", 2 * mh)
    low, high = F.floor((F.col("y") - F.col("slack")) / strip), F.floor((F.greatest(F.col("y") + F.col("h"), F.col("y") + F.col("slack"))) / strip)
    t = t.select("doc_id", "page", "candidate_id", "x", "y", "w", "h", "slack", F.lower(F.trim("label")).alias("key"), F.explode(F.sequence(low, high)).alias("strip"))
    a, b = t.alias("a"), t.alias("b")
    box = lambda s: [F.col(f"{s}.{k}") for k in "xywh"]
    same = (F.col("a.key") == F.col("b.key")) & (F.abs(F.col("a.y") - F.col("b.y")) < F.col("a.slack"))
    near = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.strip") == F.col("b.strip")) & (F.col("a.candidate_id") < F.col("b.candidate_id"))
    return a.join(b.hint("merge"), near & ((G.iou(box("a"), box("b")) > 0.45) | same)).select("a.doc_id", "a.page", F.col("a.candidate_id").alias("a"), F.col("b.candidate_id").alias("b")).distinct()


def twins(c: DataFrame) -> DataFrame:
    """Candidates of prints (see layouts.prints) with twin: another one of the page has the same label in overlaps()'s eyes, and
    it holds digits, in which the two may differ on the pages of the print."""
    key = F.lower(F.trim("label"))
    same = F.count("*").over(W.partitionBy("doc_id", "page", key))
    return c.withColumn("twin", F.coalesce(F.contains(key, F.lit("0")), F.lit(False)) & (same > 1))


def bands(c: DataFrame) -> DataFrame:
    """Candidates per fifth of the page, and the variance of the counts that aren't zero."""
    band = F.least(F.lit(BANDS - 1), F.floor(F.col("y") / F.greatest(F.col("page_height"), F.lit(1.0)) * BANDS).cast("int"))
    n = c.groupBy("doc_id", "page", band.alias("band")).agg(F.count("*").alias("n"))
    return n.groupBy("doc_id", "page").agg(F.max(F.struct("n", "band")).getField("n").alias("fullest"), F.count("*").alias("bands"), F.var_pop("n").alias("variance"))


def keep_plain(c: DataFrame) -> DataFrame:
    """Without search: candidates of junk under one half."""
    return c.filter("junk < 0.5")


def numbered(c: DataFrame) -> DataFrame:
    """field_id f_001, .. over a document's kept candidates, by page and place."""
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "y", "x", "candidate_id"))
    return c.withColumn("field_id", F.format_string("f_%03d", k))


def numbered_both(c: DataFrame) -> DataFrame:
    """field_id of numbered() over all candidates, and kept_id of numbered(keep_plain()), null for those it drops; one window."""
    w = W.partitionBy("doc_id").orderBy("page", "y", "x", "candidate_id")
    kept = F.coalesce(F.col("junk") < 0.5, F.lit(False))
    at = F.count_if(kept).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return c.withColumns({"field_id": F.format_string("f_%03d", F.row_number().over(w)), "kept_id": F.when(kept, F.format_string("f_%03d", at))})


class Choice:
    """Which of a page's candidates to keep, as a search problem; a state is a list of booleans.

    Keeping costs junk and spares genuine, dropping the other way round; kept ones that overlap cost one a pair, an empty page
    five, uneven bands of the page a little. A move changes one candidate, so it is priced by what that one changes."""

    def __init__(self, junk: list[float], genuine: list[float], band: list[int], near: list[tuple[int, int]]):
        self.junk, self.genuine, self.band = junk, genuine, band
        self.keep = [1.6 * j - 0.9 * g for j, g in zip(junk, genuine)]
        self.lose = [1.1 * g - 0.4 * j for j, g in zip(junk, genuine)]
        self.both: list[list[int]] = [[] for _ in junk]
        self.later: list[list[int]] = [[] for _ in junk]
        for a, b in near:
            self.both[a].append(b)
            self.both[b].append(a)
            self.later[a].append(b)

    @staticmethod
    def uneven(counts: list[int]) -> float:
        used = [n for n in counts if n]
        if len(used) < 2:
            return 0.0
        mean = sum(used) / len(used)
        return 0.02 * sum((n - mean) ** 2 for n in used) / len(used)

    def counts(self, state: list[bool]) -> list[int]:
        out = [0] * BANDS
        for b, kept in zip(self.band, state):
            out[b] += kept
        return out

    def cost(self, state: list[bool]) -> float:
        pairs = sum(state[o] for k, kept in enumerate(state) if kept for o in self.later[k])
        return sum(a if kept else b for a, b, kept in zip(self.keep, self.lose, state)) + pairs + (0.0 if any(state) else 5.0) + self.uneven(self.counts(state))

    def draw(self, rng: random.Random) -> list[bool]:
        if rng.random() < 0.34:
            return [True] * len(self.junk)
        bar = rng.uniform(0.3, 0.9)
        return [j < bar or rng.random() < 0.1 for j in self.junk]

    def best_move(self, state: list[bool], bar: float) -> tuple[int, float, int]:
        """Of all moves (drop or add back each candidate; of two kept ones that overlap drop the weaker, their merge) the
        cheapest under the bar, the first of equals: which candidate changes (-1: none), the cost, how many were looked at."""
        counts, size = self.counts(state), sum(state)
        now = self.cost(state) - self.uneven(counts) - (0.0 if size else 5.0)
        priced: dict[int, float] = {}

        def price(k: int) -> float:
            if k not in priced:
                sign = -1 if state[k] else 1
                counts[self.band[k]] += sign
                moved = now + sign * (self.keep[k] - self.lose[k] + sum(state[o] for o in self.both[k])) + (0.0 if size + sign else 5.0) + self.uneven(counts)
                counts[self.band[k]] -= sign
                priced[k] = moved
            return priced[k]

        best, tried = (-1, bar), 0
        for k, kept in enumerate(state):
            asked = [k]
            if kept:
                asked += [k if self.genuine[k] < self.genuine[o] else o for o in self.later[k] if state[o]]
            for other in asked:
                tried += 1
                cost = price(other)
                if cost < best[1] - climb.EPSILON:
                    best = (other, cost)
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
                k, _, n = self.best_move(state, cost)
                tried += n
                if k < 0:
                    break
                state = [*state[:k], not state[k], *state[k + 1 :]]
                cost = self.cost(state)
            if best is None or cost < best.cost - climb.EPSILON:
                best = climb.Climb(state, cost, start)
        return climb.Climb(best.state, best.cost, best.start_cost, steps, tried)


def pairs_near(names: list[str], boxes: list[tuple[float, float, float, float]], keys: list, slack: float) -> list[tuple[int, int]]:
    """overlaps() within one page: numbers of candidates a, b (name of a before b's) that cover each other or repeat a key
    nearby. Candidates are looked at from the top down, each with those that start before it ends."""
    order = sorted((k for k, b in enumerate(boxes) if None not in b), key=lambda k: boxes[k][1])
    out = []
    for n, a in enumerate(order):
        x, y, w, h = boxes[a]
        end = max(y + h, y + slack)
        for b in order[n + 1 :]:
            bx, by, bw, bh = boxes[b]
            if by >= end:
                break
            both = max(0.0, min(x + w, bx + bw) - max(x, bx)) * max(0.0, min(y + h, by + bh) - max(y, by))
            same = keys[a] is not None and keys[a] == keys[b] and abs(y - by) < slack
            if names[a] != names[b] and (same or (both > 0 and both / (w * h + bw * bh - both) > 0.45)):
                out.append((a, b) if names[a] < names[b] else (b, a))
    return sorted(out)


#: So many pages' choices are kept in a task; a page like one of them isn't searched again.
KNOWN = 20_000


def prune_search(c: DataFrame, pairs: DataFrame | None = None, restarts: int = 6, most: int = 200, seed: int = 0, mh: float | Column = 12.0) -> DataFrame:
    """Candidates (doc_id, page, candidate_id, junk, genuine, y, page_height) the search keeps, with its figures. Without pairs
    those of overlaps() are found page by page, from x, y, w, h and label, and no table of them is made."""
    band = F.least(F.lit(BANDS - 1), F.floor(F.col("y") / F.greatest(F.col("page_height"), F.lit(1.0)) * BANDS).cast("int")).alias("band")
    base = ["doc_id", "page", "candidate_id", "junk", "genuine", band]
    if pairs is not None:
        linked = pairs.groupBy("doc_id", "page", F.col("a").alias("candidate_id")).agg(F.collect_set("b").alias("others"))
        t = c.select(*base).join(linked.hint("merge"), ["doc_id", "page", "candidate_id"], "left")
    else:
        t = c.select(*base, *[F.col(k).cast("double").alias(k) for k in "xywh"], F.lower(F.trim("label")).alias("key"), (2 * (mh if isinstance(mh, Column) else F.lit(float(mh)))).alias("slack"))

    given, known = pairs is not None, {}

    def run(p: dict[str, list]) -> list[tuple]:
        ids = p["candidate_id"]
        if not given:
            first: dict = {}
            keys = [None if k is None else first.setdefault(k, n) for n, k in enumerate(p["key"])]
            asked = (*p["junk"], *p["genuine"], *p["band"], *p["x"], *p["y"], *p["w"], *p["h"], *keys, p["slack"][0])
        else:
            place = {x: k for k, x in enumerate(ids)}
            near = [(k, place[o]) for k, others in enumerate(p["others"]) for o in sorted(others or []) if o in place]
            asked = (*p["junk"], *p["genuine"], *p["band"], *near)
        found = known.get(asked)
        if found is None:
            if not given:
                near = pairs_near(ids, list(zip(p["x"], p["y"], p["w"], p["h"])), keys, p["slack"][0])
            got = Choice(p["junk"], p["genuine"], p["band"], near).search(restarts, most, seed)
            found = (got.state, (round(got.cost, 3), round(got.start_cost, 3), got.iterations, got.evaluations))
            if len(known) < KNOWN:
                known[asked] = found
        state, figures = found
        return [(p["doc_id"][0], p["page"][0], x, *figures) for x, kept in zip(ids, state) if kept]

    schema = "doc_id long, page int, candidate_id string, prune_cost double, prune_start_cost double, prune_iterations int, prune_evaluations int"
    return map_pages(t, run, schema, "candidate_id")

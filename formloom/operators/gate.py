"""Is a document a form? Structural signals of its tokens, weighed into a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import layouts

# Signal weights and thresholds.
WEIGHTS = {
    "separator_ratio": 2.2, "blank_ratio": 2.0, "checkbox_ratio": 2.0, "rule_line_density": 1.2,
    "short_row_ratio": 1.3, "gap_regularity": 1.0, "label_gap_ratio": 1.6, "prose_penalty": -2.2,
}
ACCEPT, REJECT, MIDDLE = 0.55, 0.32, 0.45


def signals(tokens: DataFrame, pages: DataFrame | None = None, lines: DataFrame | None = None, page_width: float = 600.0, page_area: float = 600.0 * 850.0, docs: DataFrame | None = None) -> DataFrame:
    """Per document the eight signals and token_count; tokens carry gap_after. pages (doc_id, page, width, height)
    and ruled lines (doc_id, page, ...) are optional: pages default to one of page_width and page_area. docs (doc_id)
    lists the documents: those without tokens get a row of zeros.

    What a token's text says is told before the shuffle; tokens are dealt by document once, and the page's median height
    and both aggregations follow on that."""
    text = F.col("text")
    if "mark" in tokens.columns:
        kinds = [layouts.has(F.col("mark"), bit).alias(n) for n, bit in (("sep", layouts.COLON), ("blank", layouts.BLANK), ("box", layouts.SOME_BOX))]
    else:
        kinds = [G.colon_ended(text).alias("sep"), G.blank_line(text).alias("blank"), G.has_box(text).alias("box")]
    t = tokens.select("doc_id", "page", "row", *kinds, "x", (F.col("x") + F.col("w")).alias("right"), "h", "gap_after")
    if pages is not None:
        t = t.join(pages.select("doc_id", "page", F.col("width").cast("double")), ["doc_id", "page"])
    else:
        t = t.withColumn("width", F.lit(page_width))
    # a given number of partitions isn't merged by bytes: a token is few, but each is looked at
    t = t.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "doc_id").withColumn("mh", G.median_height(F.col("h"), W.partitionBy("doc_id", "page")))
    one = lambda c: F.count_if(c)
    rows = t.groupBy("doc_id", "page", "row").agg(
        F.count("*").alias("n"), one(F.col("sep")).alias("sep"), one(F.col("blank")).alias("blank"), one(F.col("box")).alias("box"),
        one(F.col("gap_after") > 4 * F.col("mh")).alias("gaps"), (F.first("width") - F.max(F.struct("x", "right"))["right"]).alias("rest"), F.first("width").alias("width"),
    )
    return signals_of_rows(rows, pages, lines, page_area, docs)


def signals_of_rows(rows: DataFrame, pages: DataFrame | None = None, lines: DataFrame | None = None, page_area: float = 600.0 * 850.0, docs: DataFrame | None = None) -> DataFrame:
    """signals() from rows of text (doc_id, page, row, width, and what is counted of a row's tokens: n, sep, blank, box, gaps over
    four text heights, and rest, the space right of its last token). Sums combine before they are shuffled."""
    one = lambda c: F.count_if(c)
    spaced = (F.col("n") <= 5) & ((F.col("rest") > 0.35 * F.col("width")) | (F.col("gaps") > 0))
    d = rows.groupBy("doc_id").agg(
        F.sum("n").alias("tokens"), F.sum("sep").alias("sep"), F.sum("blank").alias("blank"), F.sum("box").alias("box"), F.count("*").alias("rows"),
        one(F.col("n") <= 4).alias("short"), F.sum("gaps").alias("gaps"), one(spaced).alias("spaced"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("spread"),
    )
    ruled = F.lit(0.0)
    if lines is not None:
        d = d.join(lines.groupBy("doc_id").agg(F.count("*").alias("ruled")), "doc_id", "left")
        ruled = F.coalesce(F.col("ruled"), F.lit(0)).cast("double")
    area = F.lit(float(page_area))
    if pages is not None:
        d = d.join(pages.groupBy("doc_id").agg(F.sum(F.col("width") * F.col("height")).alias("area")), "doc_id")
        area = F.col("area")
    cap = lambda c: F.least(F.lit(1.0), c)
    prose = cap((F.col("mean") - 8) / 8 + 0.4)
    prose = F.when(F.col("mean") < 8, 0.0).when(F.col("spread") < 3, cap(prose + 0.2)).otherwise(prose)
    out = d.select(
        "doc_id", cap(F.col("sep") / F.col("tokens") * 6).alias("separator_ratio"), cap(F.col("blank") / F.col("tokens") * 8).alias("blank_ratio"),
        cap(F.col("box") / F.col("tokens") * 10).alias("checkbox_ratio"), cap(ruled / F.greatest(F.lit(1.0), area / 1e6) / 15).alias("rule_line_density"),
        (F.col("short") / F.col("rows")).alias("short_row_ratio"), cap(F.col("gaps") / F.col("rows")).alias("gap_regularity"), (F.col("spaced") / F.col("rows")).alias("label_gap_ratio"),
        prose.alias("prose_penalty"), F.col("tokens").alias("token_count"),
    )
    if docs is None:
        return out
    return docs.select("doc_id").join(out, "doc_id", "left").na.fill(0.0, list(WEIGHTS)).na.fill(0, ["token_count"])


def signals_of_layouts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """signals() of documents that are one page row each (see layouts; with gap_after), once per distinct layout. keep: further
    columns of the pages."""

    def step(distinct: DataFrame) -> DataFrame:
        t = layouts.exploded(distinct, ["page"]).withColumnRenamed("layout_id", "doc_id")
        return signals(t).select(F.col("doc_id").alias("layout_id"), F.struct(*WEIGHTS, "token_count").alias("found"))

    return layouts.once(docs, ["page", "row", "x", "w", "h", "mark", "gap_after"], step, F.lit(1)).select("doc_id", *keep, "found.*")


def score() -> Column:
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    best = sum(w for w in WEIGHTS.values() if w > 0)
    return F.when(F.col("token_count") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / best * 1.6)))


def second_opinion(decided: DataFrame, verdicts: DataFrame, least_tokens: int = 15) -> DataFrame:
    """decide()d documents (with token_count) after a look at their page image: a verdict (doc_id, v_form, v_confidence)
    replaces the decision where the document was rejected or has fewer than least_tokens tokens. A verdict that failed
    (null v_form) or is missing changes nothing."""
    j = decided.join(verdicts.select("doc_id", "v_form", "v_confidence"), "doc_id", "left")
    used = F.col("v_form").isNotNull() & (~F.col("is_form") | (F.col("token_count") < least_tokens))
    return j.withColumns({
        "second": used, "is_form": F.when(used, F.col("v_form")).otherwise(F.col("is_form")),
        "confidence": F.when(used, F.round(F.coalesce("v_confidence", F.lit(0.5)), 3)).otherwise(F.col("confidence")),
    }).drop("v_form", "v_confidence")


def decide(scored: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """is_form and confidence (of the verdict) from score. Between the thresholds a verdict (doc_id, v_form,
    v_confidence) of a classifier decides where there is one, a failed one (null v_form) counts one half."""
    s = F.col("score")
    middle, sure = s >= MIDDLE, 0.5 + F.abs(s - MIDDLE)
    if verdicts is not None:
        scored = scored.join(verdicts.withColumn("v_used", F.lit(True)), "doc_id", "left")
        used = F.coalesce("v_used", F.lit(False))
        middle = F.coalesce("v_form", middle)
        sure = F.when(used, F.coalesce("v_confidence", F.lit(0.5))).otherwise(sure)
    clear = (s >= ACCEPT) | (s <= REJECT)
    out = scored.withColumns({
        "is_form": F.when(s >= ACCEPT, True).when(s <= REJECT, False).otherwise(middle),
        "confidence": F.round(F.when(s >= ACCEPT, s).when(s <= REJECT, 1 - s).otherwise(sure), 3),
    })
    return out.withColumn("used_classifier", ~clear & F.coalesce("v_used", F.lit(False))).drop("v_used", "v_form", "v_confidence") if verdicts is not None else out

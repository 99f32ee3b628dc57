"""Per document accounts of a run: tokens saved, quality with and without search, pass figures, stage times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens a model is expected to answer with for one field.
REPLY_TOKENS = 70


def _share(part: Column, whole: Column) -> Column:
    return F.round(100 * F.greatest(F.lit(0), part) / F.greatest(whole, F.lit(1)), 1)


def token_report(docs: DataFrame) -> DataFrame:
    """docs (doc_id, sent, unpruned, raw_text, image, system, fields, scanned, ai_called) with the system prompt's tokens
    added to the four prompts, and what pruning saves against each; the baseline is the image for a scan, else the raw
    text. estimated_if_called is 0 where the model was called."""
    prompts = docs.withColumns({c: F.col(c) + F.col("system") for c in ("sent", "unpruned", "raw_text", "image")})
    saved = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("sent"))
    base = F.when(F.col("scanned"), F.col("image")).otherwise(F.col("raw_text"))
    return prompts.select(
        "doc_id", F.col("sent").alias("prompt_sent"), F.col("unpruned").alias("prompt_unpruned"), F.col("raw_text").alias("prompt_raw_text"), F.col("image").alias("prompt_image"),
        *[saved(c).alias(f"saved_vs_{c}") for c in ("unpruned", "raw_text", "image")], _share(F.col("raw_text") - F.col("sent"), F.col("raw_text")).alias("saved_pct_vs_raw_text"),
        F.when(F.col("scanned"), "image").otherwise("raw_text").alias("baseline"), F.greatest(F.lit(0), base - F.col("sent")).alias("tokens_saved"), _share(base - F.col("sent"), base).alias("saved_pct"),
        F.when(F.col("ai_called"), 0).otherwise(F.col("sent") + REPLY_TOKENS * F.col("fields")).alias("estimated_if_called"),
    )


def pass_figures(pages: DataFrame) -> DataFrame:
    """Per document the sums over its pages (doc_id, restarts, iterations, evaluations, cost, start_cost) of a pass."""
    total = lambda c: F.sum(c).alias(c)
    return pages.groupBy("doc_id").agg(total("restarts"), total("iterations"), total("evaluations"), F.round(F.sum("cost"), 3).alias("cost"), F.round(F.sum("start_cost"), 3).alias("start_cost"))


def hit_rate(fields: DataFrame) -> DataFrame:
    """Per document fields, and the share of them that a template knows."""
    return fields.groupBy("doc_id").agg(F.count("*").alias("fields"), F.round(F.count_if(F.col("template_key").isNotNull()) / F.greatest(F.count("*"), F.lit(1)), 3).alias("template_hit_rate"))


def quality(searched: DataFrame, baseline: DataFrame, fields: DataFrame, baseline_fields: DataFrame) -> DataFrame:
    """Per document candidates and fields with and without search, junk removed and the hit rate. searched and baseline
    are candidate tables, fields (with template_key) and baseline_fields what pruning kept of them."""
    n = lambda d, name: d.groupBy("doc_id").agg(F.count("*").alias(name))
    out = n(searched, "candidates").join(n(baseline, "baseline_candidates"), "doc_id", "full").join(hit_rate(fields), "doc_id", "left").join(n(baseline_fields, "baseline_fields"), "doc_id", "left")
    out = out.na.fill(0, ["candidates", "baseline_candidates", "fields", "baseline_fields"]).na.fill(0.0, ["template_hit_rate"])
    return out.withColumn("junk_removed", F.col("candidates") - F.col("fields"))


def choose_vision(geometry: DataFrame, vision: DataFrame) -> DataFrame:
    """Per document whose fields are taken: the image reader's where it found any and at least as many as geometry did."""
    n = lambda d, name: d.groupBy("doc_id").agg(F.count("*").alias(name))
    j = n(geometry, "geometry_fields").join(n(vision, "vision_fields"), "doc_id", "full").na.fill(0)
    use = (F.col("vision_fields") > 0) & (F.col("vision_fields") >= F.col("geometry_fields"))
    return j.select("doc_id", "geometry_fields", "vision_fields", use.alias("use_vision"), F.when(use, F.col("vision_fields")).otherwise(F.col("geometry_fields")).alias("fields"))


def stage_laps(marks: DataFrame) -> DataFrame:
    """Marks (doc_id, seq, stage, at) as laps, in the unit of at: each stage took the time since the mark before it, the
    first one 0; a stage that comes again adds up."""
    lap = F.col("at") - F.lag("at").over(W.partitionBy("doc_id").orderBy("seq"))
    return marks.withColumn("lap", F.coalesce(lap, F.lit(0))).groupBy("doc_id", "stage").agg(F.sum("lap").alias("took"))

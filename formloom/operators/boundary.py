"""Around model calls: what to ask, the prompt, merging replies, accounting. The call itself is a client function run
in mapInPandas; a deterministic fake stands in for tests."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPES = ["text", "date", "checkbox", "signature", "number", "multiple-choice", "table-cell"]


def field_needs_model() -> Column:
    valued = (F.trim("value") != "") & (F.size("options") == 0)
    return F.col("template_key").isNull() | valued | (F.col("grouping_score") < 0.6)


def needs_model() -> Column:
    """Aggregate over a document's fields: any answer to confirm, or over a fifth of the fields without a template."""
    valued = F.bool_or((F.trim("value") != "") & (F.size("options") == 0))
    return valued | (F.avg(F.col("template_key").isNull().cast("int")) > 0.2)


def document_needs_model(fields: DataFrame, scanned: Column | None = None) -> DataFrame:
    """(doc_id, needs_model): any answer to confirm, or over a fifth of the fields without a template, or a scan."""
    out = fields.groupBy("doc_id").agg(needs_model().alias("needs_model"))
    return out if scanned is None else out.withColumn("needs_model", F.col("needs_model") | scanned)


def prompt_line(field_id: Column, label: Column, key: Column, value: Column, options: Column) -> Column:
    """A field's line of the prompt: id|label|hint|value."""
    return F.concat_ws("|", field_id, label, F.coalesce(key, F.lit("?")), F.when(F.size(options) > 0, F.concat(F.lit("opts:"), F.array_join(options, "/"))).otherwise(value))


def prompt(field_id: Column) -> Column:
    """Aggregate over a document's fields: a line for each that has an id, in the order of ids."""
    line = prompt_line(field_id, *map(F.col, ("label", "template_key", "value", "options")))
    listed = F.collect_list(F.when(field_id.isNotNull(), F.struct(field_id.alias("id"), line.alias("s"))))
    return F.array_join(F.transform(F.array_sort(listed), lambda r: r["s"]), "\n")


def prompts(fields: DataFrame) -> DataFrame:
    """One prompt per document."""
    return fields.groupBy("doc_id").agg(prompt(F.col("field_id")).alias("prompt"))


def estimate_tokens(text: Column) -> Column:
    """About 4 ASCII or 1.5 other characters a token, and one for each line end."""
    beyond = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(F.floor((F.length(text) - beyond) / 4 + beyond / 1.5) + ends, F.lit(0)).cast("long")


def estimate_image_tokens(width: Column, height: Column, side: int = 1536, tile: int = 768, each: int = 258) -> Column:
    w, h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    scale = F.least(F.lit(1.0), side / F.greatest(w, h))
    return (each * F.ceil(w * scale / tile) * F.ceil(h * scale / tile)).cast("long")


def pass_through(fields: DataFrame) -> DataFrame:
    """Fields as they are, with the confidence of their template and grouping."""
    sure = 0.45 + 0.35 * F.col("strength") + 0.2 * F.col("grouping_score")
    return fields.withColumns({"value": F.when(F.size("options") > 0, "").otherwise(F.col("value")), "confidence": F.round(F.least(sure, F.lit(0.95)), 3), "needs_review": sure < 0.6})


def first_replies(replies: DataFrame) -> DataFrame:
    """The first reply of each (doc_id, field_id), by at."""
    return replies.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "field_id").orderBy("at"))).filter("n = 1").drop("n")


def merge(fields: DataFrame, replies: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """Fields overlaid with replies (doc_id, field_id, at, label, type, value, review, options).

    Unknown ids are ignored and the first reply of an id wins; an unknown type or a missing label or value falls back to
    the field's; review counts only with a value. Fields without a reply pass through, marked where they were sent."""
    r = first_replies(replies).select("doc_id", "field_id", F.col("label").alias("r_label"), F.col("type").alias("r_type"), F.col("value").alias("r_value"), F.col("review").alias("r_review"), F.col("options").alias("r_options"), F.lit(True).alias("answered"))
    f = pass_through(fields.withColumn("own_value", F.col("value")))
    j = f.join(r, ["doc_id", "field_id"], "left")
    asked = F.lit(True)
    if sent is not None:
        j = j.join(sent.select("doc_id", "field_id", F.lit(True).alias("was_sent")), ["doc_id", "field_id"], "left")
        asked = F.coalesce("was_sent", F.lit(False))
    hit = F.coalesce("answered", F.lit(False))
    label = F.when(F.coalesce("r_label", F.lit("")) != "", F.col("r_label")).otherwise(F.col("label"))
    value = F.coalesce("r_value", "own_value", F.lit(""))
    out = j.withColumns({
        "question": F.when(hit & F.col("template_key").isNull(), F.concat(F.lit("What is the "), F.lower(label), F.lit("?"))).otherwise(F.col("question")),
        "label": F.when(hit, label).otherwise(F.col("label")),
        "type": F.when(hit & F.col("r_type").isin(TYPES), F.col("r_type")).otherwise(F.col("type")),
        "needs_review": F.when(hit, F.coalesce("r_review", F.lit(False)) & (F.trim(value) != "")).otherwise(F.col("needs_review") | asked),
        "value": F.when(hit, value).otherwise(F.col("value")),
        "confidence": F.when(hit, F.lit(0.9)).otherwise(F.col("confidence")),
        "options": F.when(hit & (F.size(F.coalesce("r_options", F.array().cast("array<string>"))) > 0), F.col("r_options")).otherwise(F.col("options")),
    })
    return out.drop("r_label", "r_type", "r_value", "r_review", "r_options", "answered", "was_sent", "own_value")


def call(prompts: DataFrame, client: Callable[[str], dict], purpose: str = "validate") -> DataFrame:
    """One call per document: (doc_id, purpose, reply JSON, input_tokens, output_tokens, error). A failing call is a row
    with its error, so one document does not stop the others."""

    def run(frames):
        for frame in frames:
            out = []
            for doc, prompt in zip(frame["doc_id"], frame["prompt"]):
                try:
                    r = client(prompt)
                    out.append((doc, purpose, r.get("reply"), int(r.get("input_tokens", 0)), int(r.get("output_tokens", 0)), None))
                except Exception as e:  # noqa: BLE001  recorded in the row
                    out.append((doc, purpose, None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "purpose", "reply", "input_tokens", "output_tokens", "error"])

    return prompts.mapInPandas(run, "doc_id long, purpose string, reply string, input_tokens long, output_tokens long, error string")


def with_fallbacks(clients: list[Callable[[str], dict]], overloaded=lambda e: "overload" in str(e).lower()) -> Callable[[str], dict]:
    """A client that tries the next one only when a call is refused for load."""

    def run(prompt: str) -> dict:
        for k, client in enumerate(clients):
            try:
                return client(prompt)
            except Exception as e:
                if k + 1 == len(clients) or not overloaded(e):
                    raise
        raise ValueError("no clients")

    return run


def vision_fields(replies: DataFrame) -> DataFrame:
    """Fields read from page images (fractions of the page): boxes clamped and scaled, odd types text, low confidence
    to review."""
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    conf = F.coalesce("confidence", F.lit(0.7))
    return replies.withColumns({
        "x": part(F.col("x")) * F.col("page_width"), "y": part(F.col("y")) * F.col("page_height"), "w": part(F.col("w")) * F.col("page_width"), "h": part(F.col("h")) * F.col("page_height"),
        "type": F.when(F.col("type").isin(TYPES), F.col("type")).otherwise("text"), "confidence": conf, "needs_review": conf < 0.6,
    })


def ledger(calls: DataFrame) -> DataFrame:
    return calls.groupBy("doc_id", "purpose").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def first_success(attempts: DataFrame, keys: list[str], order: str, overloaded: str, ok: str) -> DataFrame:
    """Logged attempts of a call as a chain of fallbacks would make them: the next model is tried only while those before
    it were overloaded. Per call: tried (attempts made), answered (the order of the one that ended the chain without
    overload, null if none did) and worked (whether that one was ok). Combines before the shuffle."""
    at = F.col(order)
    ends = attempts.groupBy(*keys).agg(F.min(F.when(~F.col(overloaded), F.struct(at.alias("at"), F.col(ok).alias("ok")))).alias("e"))
    j = attempts.select(*keys, order).join(ends, keys)
    return j.groupBy(*keys).agg(F.count_if(F.col("e").isNull() | (at <= F.col("e.at"))).alias("tried"), F.max("e.at").alias("answered"), F.coalesce(F.bool_or("e.ok"), F.lit(False)).alias("worked"))

"""The whole run over tables of tokens: gate, grouping, templates, pruning, prompts, replies, normalisation, reports.

Every step is set-oriented over all documents; a page is the unit of both searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import normalise as N
from ..operators import boundary as B
from ..operators import gate, grouping, layouts, pruning, templates, tokens
from ..operators import report as R
from ..operators.calls import ReplyLedger
from ..operators.measure import Stages
from ..shared import materialise

# The page of inputs that bring no sizes; a page is at least so high, and reaches 40 below its last token.
PAGE_WIDTH, PAGE_HEIGHT, BELOW = 600.0, 850.0, 40.0


def page_sizes(toks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, width, height, mh) of every page with tokens: its size as pages (doc_id, page, width, height) has
    it, or measured from its tokens where that is absent or null, and its median text height."""
    t = toks.groupBy("doc_id", "page").agg(G.median_height(F.col("h")).alias("mh"), F.max(F.col("y")).alias("_low"))
    if pages is None:
        t = t.withColumns({"width": F.lit(None).cast("double"), "height": F.lit(None).cast("double")})
    else:
        t = t.join(pages.select("doc_id", "page", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")).dropDuplicates(["doc_id", "page"]), ["doc_id", "page"], "left")
    return t.select("doc_id", "page", F.coalesce("width", F.lit(PAGE_WIDTH)).alias("width"), F.coalesce("height", F.greatest(F.lit(PAGE_HEIGHT), F.col("_low") + BELOW)).alias("height"), "mh")


def reading_order():
    return W.partitionBy("doc_id", "page").orderBy("row", "pos")


def passes(toks: DataFrame, catalogue: DataFrame, search: bool = True, lines: DataFrame | None = None, pages: DataFrame | None = None, stages: Stages | None = None, sizes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Both passes over tokens (doc_id, page, pos, text, x, y, w, h, confidence): candidates with their template, junk and
    genuine, and fields, what pruning keeps of them, with options and field_id. pages: see page_sizes(), whose result sizes is
    where it is known already."""
    stages = stages or Stages()
    sizes = page_sizes(toks, pages) if sizes is None else sizes
    found = stages.write(grouping.group_pages(toks, sizes, lines, search), "candidates")  # searched once, however many steps read it
    c = found.join(sizes.select("doc_id", "page", "mh", F.col("height").alias("page_height")).hint("merge"), ["doc_id", "page"]).withColumns({n: F.col("bbox")[k] for k, n in enumerate("xywh")})
    c = c.withColumn("region_w", F.col("region")[2])
    c = pruning.add_options(templates.questions(c, catalogue))
    c = stages.write(pruning.evidence(c), "evidence")
    if search:
        kept = pruning.prune_search(c, mh=F.col("mh"))
        fields = c.join(kept.hint("merge"), ["doc_id", "page", "candidate_id"])
    else:
        fields = pruning.keep_plain(c)
    return {"candidates": c, "fields": stages.write(pruning.numbered(fields), "fields")}


def in_doubt(candidates: DataFrame) -> DataFrame:
    """(doc_id, doubt): for the candidates that passes() found of prints (see layouts.prints), whether pages of the print may
    differ in what their templates and the search make of them."""
    counted = templates.digits_counted(N.match_label(F.col("label")))
    return pruning.twins(candidates).groupBy("doc_id").agg(F.bool_or(F.col("twin") | counted).alias("doubt"))


def fields_by_print(pages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Normalised fields, without model calls, of documents that are one page row each (see layouts): doc_id, field_id, label, type,
    value, confidence, needs_review and template_key, as run() gives them. Both passes look at a print once; fields whose words
    hold digits have their texts from the page, unless those go beyond ASCII: then the print is done by its words."""
    names = ["field_id", "label", "type", "value", "confidence", "needs_review", "template_key"]
    digits = F.contains("label", F.lit("0")) | F.contains("value", F.lit("0"))
    ascii = F.concat("label", "value").rlike(r"^[\x00-\x7F]*$")

    def step(p: DataFrame) -> DataFrame:
        p = p.withColumn("pos", F.transform("pos", lambda _, k: k))  # so that label_tokens and value_tokens are places in text
        sizes = materialise(page_sizes(p.select("doc_id", "page", F.inline(F.arrays_zip("h", "y")))), "sizes")
        got = passes(p, catalogue, sizes=sizes)
        f = B.pass_through(got["fields"].withColumns({"own": digits & ascii, "beyond": digits & ~ascii, "label_at": F.col("label_tokens"), "value_at": F.col("value_tokens"), "listed": F.size("options") > 0}))
        f = N.normalise_fields(f.withColumns({"original_label": F.col("label"), "unsure": F.col("needs_review")}))
        f = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names, "own", "unsure", "listed", "options", "label_at", "value_at"))).alias("fields"), F.bool_or("beyond").alias("beyond"))
        t = in_doubt(got["candidates"]).join(f, "doc_id", "left")
        return t.select("doc_id", F.struct("fields", (F.col("doubt") | F.coalesce("beyond", F.lit(False))).alias("doubt")).alias("found"))

    t = layouts.prints(pages, step, F.greatest(F.size("found.fields"), F.lit(1)), digits=templates.has_digits(catalogue), doubt=F.col("found.doubt"))
    part = lambda own: F.explode(F.filter("found.fields", lambda c: c["own"] == own)).alias("c")
    same = t.select("doc_id", part(False)).select("doc_id", *[f"c.{n}" for n in names])
    said = lambda at: F.regexp_replace(layouts.said(F.col("text"), at), f"^{N.SPACES}|{N.SPACES}$", "")
    shown = F.filter("c.value_at", lambda k: ~G.blank_line(F.get("text", k)))
    own = t.select("doc_id", "text", part(True)).select("doc_id", "c.*", said(F.col("c.label_at")).alias("own_label"), F.when(F.col("c.listed"), "").otherwise(said(shown)).alias("own_value"))
    own = own.withColumns({"label": F.col("own_label"), "original_label": F.col("own_label"), "value": F.col("own_value"), "question": F.lit(""), "needs_review": F.col("unsure")})
    return same.unionByName(N.normalise_fields(own, compose=False).select(same.columns))


def run(toks: DataFrame, docs: DataFrame, catalogue: DataFrame, client=None, search: bool = True, lines: DataFrame | None = None, pages: DataFrame | None = None, ledger: ReplyLedger | None = None) -> dict[str, DataFrame]:
    """From tokens (with row and gap_after) of docs (doc_id) to normalised fields.

    pages (doc_id, page, width, height) gives page sizes, measured from the tokens where they are absent.
    client answers one prompt (see boundary.call) with {"reply": JSON array of {id, label, type, value, review}}; without
    one all fields pass through; with a ledger no prompt is asked twice, also by later runs. Returns gate (every document), candidates, fields (of forms), prompts, calls, tokens
    (what the prompts save) and stages (rows, documents and time of each stage, observed as it ran)."""
    stages = Stages()
    toks = materialise(toks, "input")  # each step below reads it again, however it was made
    sizes = materialise(page_sizes(toks, pages), "sizes")
    decided = stages.write(gate.decide(gate.signals(toks, sizes, lines, docs=docs).withColumn("score", gate.score())), "gate")
    forms = stages.write(toks.join(decided.filter("is_form").select("doc_id"), "doc_id", "left_semi"), "forms")
    got = passes(tokens.with_direction(forms), catalogue, search, lines, pages, stages, sizes)
    fields = got["fields"]
    prompts = B.prompts(fields)
    if client is None:
        merged, calls = B.pass_through(fields), None
    else:
        needing = B.document_needs_model(fields).filter("needs_model").select("doc_id")
        asked = prompts.join(needing, "doc_id", "left_semi")
        calls = stages.write(ledger.ask(asked, client) if ledger else B.call(asked, client), "calls")
        said = F.from_json("reply", "array<struct<id:string,label:string,type:string,value:string,review:boolean>>")
        replies = calls.filter("error is null").select("doc_id", F.posexplode(said).alias("at", "r"))
        replies = replies.select("doc_id", F.col("r.id").alias("field_id"), "at", "r.label", "r.type", "r.value", "r.review", F.lit(None).cast("array<string>").alias("options"))
        sent = fields.join(calls.filter("error is null").select("doc_id"), "doc_id", "left_semi").filter(B.field_needs_model()).select("doc_id", "field_id")
        merged = B.merge(fields, replies, sent)
    final = N.normalise_fields(merged.withColumn("original_label", F.col("label")))
    size = lambda c: B.estimate_tokens(F.coalesce(c, F.lit("")))
    whole = got["candidates"].groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "candidate_id", "label", F.lit("?"), "value"))), "\n").alias("all"))
    per_doc = prompts.join(whole, "doc_id", "full").join(tokens.text_of(forms), "doc_id", "full").join(fields.groupBy("doc_id").agg(F.count("*").alias("fields")), "doc_id", "left")
    per_doc = per_doc.join(sizes.groupBy("doc_id").agg(F.sum(B.estimate_image_tokens(F.col("width"), F.col("height"))).alias("image")), "doc_id", "left")
    account = R.token_report(per_doc.select(
        "doc_id", size(F.col("prompt")).alias("sent"), size(F.col("all")).alias("unpruned"), size(F.col("text")).alias("raw_text"), F.coalesce("image", F.lit(0)).alias("image"),
        F.lit(0).alias("system"), F.coalesce("fields", F.lit(0)).alias("fields"), F.lit(False).alias("scanned"), F.lit(client is not None).alias("ai_called"),
    ))
    return {"gate": decided, "candidates": got["candidates"], "fields": final, "prompts": prompts, "calls": calls, "tokens": account, "stages": stages.table(toks.sparkSession)}

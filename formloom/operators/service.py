"""What a document service answers: uploads, listings, states, rejections, settings. Column work over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import latest, masked

# Fixed values.
DOCUMENT_TYPES = ["pdf", "xps", "oxps", "epub", "mobi", "fb2", "cbz", "svg", "txt"]
IMAGE_TYPES = ["png", "jpg", "jpeg", "jp2", "tif", "tiff", "bmp", "gif", "pnm", "pgm", "ppm", "pam", "webp"]
MODEL_ID = r"^[A-Za-z0-9][A-Za-z0-9._\-]{1,80}$"
MOST_RESTARTS, MOST_ITERATIONS, UPLOAD_BYTES = 12, 1000, 25 << 20
NO_TEXT = "No readable text was found in this file, so it cannot be checked as a form. Try a sharper scan/photo, or a PDF with a text layer."
NO_FORM = "Only forms can be uploaded. This file does not look like a fillable form (form likelihood %d%%)%s. Upload a form with labels and blanks/boxes to fill."


def extension(filename: Column) -> Column:
    """The lower-case extension, empty where there is none."""
    name = F.coalesce(filename, F.lit(""))
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def scan_dpi(words_on_first_page: Column, dpi: Column) -> Column:
    """A page that has its words needs no fine scan."""
    return F.when(words_on_first_page >= 20, F.least(dpi, F.lit(120))).otherwise(dpi)


def upload_checks(uploads: DataFrame, limit: int = UPLOAD_BYTES) -> DataFrame:
    """uploads (filename, bytes, restarts, iterations) with status (415 for an unknown type, 413 for too many bytes, else
    202) and the search effort within bounds."""
    known = extension(F.col("filename")).isin(DOCUMENT_TYPES + IMAGE_TYPES)
    bound = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c).cast("int")))
    return uploads.withColumns({
        "status": F.when(~known, 415).when(F.col("bytes") > limit, 413).otherwise(202),
        "restarts": bound("restarts", 1, MOST_RESTARTS), "iterations": bound("iterations", 10, MOST_ITERATIONS),
    })


def listed(log: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The last state of every document that isn't rejected, newest write first."""
    return latest(log, [key], seq).filter("status <> 'rejected'").orderBy(F.desc(seq))


def fetched(asked: DataFrame, log: DataFrame) -> DataFrame:
    """asked (doc_id) with the code and message a request for the document's fields gets by its last state."""
    last = latest(log.select("doc_id", "seq", "status", "error"), ["doc_id"], "seq")
    status = F.col("status")
    code = F.when(status.isNull(), 404).when(status == "rejected", 422).when(status.isin("queued", "processing"), 409).when(status == "error", 500).otherwise(200)
    message = (
        F.when(status.isNull(), "document not found").when(status == "rejected", "document is not a form")
        .when(status.isin("queued", "processing"), F.concat(F.lit("document is still "), status)).when(status == "error", F.coalesce("error", F.lit("pipeline error"))).otherwise("")
    )
    return asked.join(last, "doc_id", "left").select("doc_id", code.alias("code"), message.alias("message"))


def rejection_message(token_count: Column, confidence: Column, used_classifier: Column) -> Column:
    """Why a document was turned away; confidence is that of the verdict "not a form"."""
    likely = F.bround((1 - confidence) * 100, 0).cast("int")
    via = F.when(used_classifier, " (checked with the AI vision model)").otherwise("")
    return F.when(token_count == 0, F.lit(NO_TEXT)).otherwise(F.format_string(NO_FORM, likely, via))


def valid_model(model: Column) -> Column:
    return F.regexp_replace(F.trim(model), "^models/", "").rlike(MODEL_ID)


def settings_view(providers: DataFrame, keys: DataFrame) -> DataFrame:
    """providers (provider, label, default_model, stored_model) with the keys (provider, stored, env) they have: model,
    has_key, hint (the last four characters) and source; what is stored comes before the environment."""
    text = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))
    j = providers.join(keys, "provider", "left")
    key = F.coalesce(text("stored"), text("env"))
    source = F.when(text("stored").isNotNull(), "settings").when(text("env").isNotNull(), "environment").otherwise("none")
    return j.select("provider", "label", F.coalesce(text("stored_model"), "default_model").alias("model"), key.isNotNull().alias("has_key"), masked(key).alias("hint"), source.alias("source"))


def page_lines(reply: DataFrame) -> DataFrame:
    """Lines (doc_id, line, text, box array) that a model read off a page image, as boxes inside the page: lines without
    four numbers, text, width or height go."""
    unit = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get("box", F.lit(k)).cast("double")))
    out = reply.filter((F.size("box") == 4) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("doc_id", "line", F.trim("text").alias("text"), *[unit(k).alias(c) for k, c in enumerate("xywh")])
    return out.filter("w > 0 and h > 0")

"""Readers: token payloads, uploads, ground truth, sample listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions taken as documents and as images, the page limit and the upload limit in bytes.
DOCUMENT_EXT = ["pdf", "xps", "oxps", "epub", "mobi", "fb2", "cbz", "svg", "txt"]
IMAGE_EXT = ["png", "jpg", "jpeg", "jp2", "tif", "tiff", "bmp", "gif", "pnm", "pgm", "ppm", "pam", "webp"]
MAX_PAGES, MAX_BYTES = 20, 25 * 1024 * 1024

TOKEN = "struct<text:string,bbox:array<double>,confidence:double,page:int,script:string>"
PAYLOAD = f"doc_id long, filename string, use_llm boolean, hill_climb boolean, restarts int, pages array<struct<number:int,width:double,height:double,tokens:array<{TOKEN}>,lines:array<array<double>>>>"
TRUTH = "name string, is_form boolean, lang string, fields array<struct<label:string,type:string,value:string>>, junk array<string>"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).json(path)


def truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).json(path, multiLine=True)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with extension, SHA-256 and why they are refused (null: taken)."""
    f = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    reason = F.when(~ext.isin(DOCUMENT_EXT + IMAGE_EXT), "415 unsupported").when(F.col("length") > MAX_BYTES, "413 too large")
    return f.select("path", "length", ext.alias("ext"), F.sha2("content", 256).alias("sha256"), reason.alias("refused"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Listed sample files: name, and lang before its first underscore."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return f.select("name", F.substring_index("name", "_", 1).alias("lang")).orderBy("name")


def limited(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("page") <= MAX_PAGES)


def best_reader(read: DataFrame, least_tokens: int = 3) -> DataFrame:
    """Of (doc_id, page, reader, priority, tokens array) the tokens of the first reader that found enough."""
    ok = read.filter(F.size("tokens") >= least_tokens)
    return ok.groupBy("doc_id", "page").agg(F.min_by("reader", "priority").alias("reader"), F.min_by("tokens", "priority").alias("tokens"))

"""A training-data pipeline over `documents`: each stage reads what the one before it wrote.

The stages are in STAGES; run() applies them all. SQL can't express a trained classifier or a suffix order, so
ORACLE_SQL is None and tests/llm holds the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import cotrain, minhash, mixing, packing, suffix_dedup
from formloom.llm.common import materialise, release, table, word_count

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    Null text is empty; null source or language is a value of its own; without labels of both classes all are kept. Ties
    and repeated rows are judged alike; all columns pass through, those named q_* as the classifier's too."""
    own = {c: f"own_{c}" for c in docs.columns if c in cotrain.NEW}
    out = cotrain.classify(docs.withColumnsRenamed(own), cotrain.good_labels(table(spark, sf_dir, "labels"))).filter("q_kept")
    return out.drop(*cotrain.NEW).withColumnsRenamed({v: k for k, v in own.items()})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more: that of the smallest doc_id.

    Texts without words (or null) and rows without doc_id link with nothing and stay; rows of one doc_id stay or go
    together; an empty table gives no rows; all columns pass through."""
    gone = minhash.groups(docs.select("doc_id", "text"), percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat a document of smaller doc_id, n_chars counted anew.

    Emptied documents stay as rows; null text becomes empty; rows without doc_id keep their text, rows of one doc_id
    don't match each other; an empty table gives no rows; all other columns pass through, whatever their names."""
    own = {c: f"own_{c}" for c in docs.columns if c.startswith("lpf_")}
    out = suffix_dedup.remove_repeats(docs.withColumnsRenamed(own)).withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times.

    Null text and texts without words have size 0 and are not taken; null sources are one source; rows of one doc_id and
    size are taken alike; all columns pass through, whatever their names; an empty table gives no rows."""
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "mix-sizes")
    planned = mixing.plan(sized, F.array("source"), F.col("words"), F.col("doc_id"))
    own = docs.select(F.struct(*docs.columns).alias("doc"))
    taken = mixing.take(own, planned, F.array("doc.source"), word_count(F.col("doc.text")), F.col("doc.doc_id"))
    times = F.floor(F.col("mix_taken") / F.col("mix_size")).cast("int")
    return taken.filter("mix_taken > 0").select("doc", F.explode(F.sequence(F.lit(1), times))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; null text is an empty document of one end id, null and
    repeated doc_ids are packed row by row, an empty table gives no rows, further columns are left out."""
    import public_tokenizers

    return packing.pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release(spark)
    return docs

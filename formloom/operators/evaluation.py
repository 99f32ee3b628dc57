"""Comparing extracted labels with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def labels_match(a: Column, b: Column) -> Column:
    """Normalised labels are equal or one holds the other; an empty one matches nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def matches_any(norm: Column, known: Column) -> Column:
    """norm matches one of an array of normalised labels."""
    return F.exists(known, lambda t: labels_match(t, norm))


def is_junk(norm: Column, truth: Column, junk: Column) -> Column:
    """norm matches a known junk label of the array, or lies inside one, and matches no truth."""
    return F.exists(junk, lambda t: labels_match(t, norm) | F.contains(t, norm)) & ~matches_any(norm, truth)


def recall_precision(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per document recall (truths with a match) and precision (found with a match), from (doc_id, norm) tables.

    Each side is distinct per document first and documents are the join key."""
    t, f = truth.select("doc_id", "norm").distinct(), found.select("doc_id", F.col("norm").alias("f_norm")).distinct()
    on = labels_match(F.col("norm"), F.col("f_norm"))
    pair = t.join(f, "doc_id").filter(on)
    hit_t, hit_f = pair.select("doc_id", "norm").distinct().groupBy("doc_id").agg(F.count("*").alias("ht")), pair.select("doc_id", "f_norm").distinct().groupBy("doc_id").agg(F.count("*").alias("hf"))
    nt, nf = t.groupBy("doc_id").agg(F.count("*").alias("nt")), f.groupBy("doc_id").agg(F.count("*").alias("nf"))
    j = nt.join(nf, "doc_id", "full").join(hit_t, "doc_id", "left").join(hit_f, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select("doc_id", (zero("ht") / F.greatest(zero("nt"), F.lit(1))).alias("recall"), (zero("hf") / F.greatest(zero("nf"), F.lit(1))).alias("precision"))


def holds(a: Column, b: Column) -> Column:
    """One of two values holds the other, commas aside."""
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    return F.contains(bare(a), bare(b)) | F.contains(bare(b), bare(a))


def answering(truth: DataFrame, fields: DataFrame, by: tuple[str, ...] = ("norm", "value")) -> DataFrame:
    """Each document's truths (doc_id, norm, value), one per `by`, with the field that answers them: its norm and value as f_norm
    and f_value, its other columns, and fits. An equal label is taken before one that only matches, then the first field."""
    j = truth.join(fields.withColumnsRenamed({"norm": "f_norm", "value": "f_value"}), "doc_id", "left")
    j = j.withColumn("fits", F.coalesce(labels_match(F.col("norm"), F.col("f_norm")), F.lit(False)))
    first = F.row_number().over(W.partitionBy("doc_id", *by).orderBy(F.desc("fits"), F.desc(F.coalesce(F.col("norm") == F.col("f_norm"), F.lit(False))), "field_id"))
    return j.withColumn("k", first).filter("k = 1").drop("k")


def answer_accuracy(truth: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document the share of truths (doc_id, norm, value) whose field (see answering()) holds the value, commas aside."""
    ok = F.col("fits") & holds(F.col("f_value"), F.col("value"))
    return answering(truth, fields.select("doc_id", "field_id", "norm", "value")).groupBy("doc_id").agg(F.avg(F.coalesce(ok, F.lit(False)).cast("int")).alias("accuracy"))


def gate_accuracy(decided: DataFrame) -> DataFrame:
    """Accuracy, false accepts and false rejects of (is_form, truth)."""
    wrong = lambda yes: F.count_if((F.col("is_form") != F.col("truth")) & (F.col("is_form") == yes))
    return decided.agg(F.avg((F.col("is_form") == F.col("truth")).cast("int")).alias("accuracy"), wrong(True).alias("false_accepts"), wrong(False).alias("false_rejects"), F.count("*").alias("n"))


def pruning_figures(truth: DataFrame, junk: DataFrame, kept: DataFrame) -> DataFrame:
    """Per document of kept fields (doc_id, field_id, norm, template_key): kept, junk_kept (they match a known junk label,
    or lie inside one, and no truth) and template_rate."""
    own = kept.select("doc_id", "field_id", F.col("norm").alias("f_norm"), "template_key")
    good = own.join(truth.select("doc_id", "norm").distinct(), "doc_id").filter(labels_match(F.col("norm"), F.col("f_norm"))).select("doc_id", "field_id").distinct()
    bad = own.join(junk.select("doc_id", "norm").distinct(), "doc_id").filter(labels_match(F.col("norm"), F.col("f_norm")) | F.contains("norm", "f_norm")).select("doc_id", "field_id").distinct()
    bad = bad.join(good, ["doc_id", "field_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("junk_kept"))
    out = own.groupBy("doc_id").agg(F.count("*").alias("kept"), (F.count("template_key") / F.count("*")).alias("template_rate"))
    return out.join(bad, "doc_id", "left").na.fill(0, ["junk_kept"]).select("doc_id", "kept", "junk_kept", "template_rate")


def averages(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The mean of each column over the documents that have it (null: none has)."""
    return rows.agg(*[F.avg(c).alias(c) for c in columns])

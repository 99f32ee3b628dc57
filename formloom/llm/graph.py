"""Connected components of an edge table, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges(a, b): label is the smallest node of the component.

    Each round every node takes the least label among its own, its neighbours' and its label's label; stars settle in
    one round, chains in about the logarithm of their length. Each round is a written table, so lineage stays short.
    Nodes appear once, whatever loops or repeated edges there are; rows with a null end are ignored.
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = materialise(both.union(both.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").withColumn("low", F.least("label", "near"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = materialise(step.join(jump, "low", "left").select("node", F.least("low", "jump").alias("label"), (F.least("low", F.coalesce("jump", "low")) < F.col("label")).alias("moved")), "labels")
        moved = not new.filter("moved").isEmpty()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels.select("node", "label")

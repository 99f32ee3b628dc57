r"""Chat formatting of reply trees.

Messages are rows (tree, node, parent, role, text, score). Iterative self-joins that double their reach each round
give every node the summed score of its path from the root, and leave a table of ancestors at distance 1, 2, 4, ...; a
tree's leaves are ranked by their score. Only the best leaves' paths are then walked, over the same tables from the farthest
distance down, each node of a path being reached once, and written as conversations:

    ### <role>: <text></turn>\n   for each turn

Inside roles and texts the four characters \ # < : would clash with the markup; \, # and < (and : in roles) are
written \b, \h, \l and \c. No other backslash occurs, so the change is undone exactly and no text can forge a turn.
The loss mask is the list of (start, length) in code points of the assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

TURN_END = "</turn>\n"


def escape(col: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(col, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(col: Column) -> Column:
    out = F.replace(F.replace(F.replace(col, F.lit("\\c"), F.lit(":")), F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def same(tree: str, node: str):
    return F.col("tree").eqNullSafe(F.col(tree)) & (F.col("node") == F.col(node))


def once_each(messages: DataFrame) -> DataFrame:
    """One row per (tree, node): of several the least by parent (null first), role, text and score."""
    rest = [c for c in ("parent", "role", "text", "score") if c in messages.columns]
    return messages.groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("r")).select("tree", "node", "r.*")


def leaf_scores(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, path_score) of every leaf, and the tables (tree, node, top) of ancestors at distance 1, 2, 4, ...

    messages has each (tree, node) once. A parent that is not in its tree counts as none. Nodes on or under a cycle have
    no root and give no path."""
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    links = links.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("top"), "score")
    reach = materialise(links, "reach")
    parents = reach.filter("top is not null").select(F.col("tree").alias("t"), F.col("top").alias("n")).distinct()
    leaves = materialise(reach.join(parents, same("t", "n"), "left_anti").select(F.col("tree").alias("lt"), F.col("node").alias("leaf")), "leaves")
    tables, most = [], max(1, reach.count()).bit_length() + 1
    while len(tables) < most and not reach.filter("top is not null").isEmpty():
        open_ = reach.filter("top is not null")
        tables.append(open_.select("tree", "node", "top"))
        up = reach.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("top").alias("up_top"), F.col("score").alias("up_score"))
        # nodes that have reached their root stay as they are; only the others meet their ancestors
        farther = open_.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("top") == F.col("n"))).select("tree", "node", F.col("up_top").alias("top"), (F.col("score") + F.col("up_score")).alias("score"))
        reach = materialise(reach.filter("top is null").unionByName(farther), "reach")
    done = reach.filter("top is null").join(leaves, F.col("tree").eqNullSafe(F.col("lt")) & (F.col("node") == F.col("leaf")), "left_semi")
    return done.select("tree", F.col("node").alias("leaf"), F.col("score").alias("path_score")), tables


def conversations_of(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """The per_tree best paths of every tree as conversations: tree, leaf, path_score, formatted, loss_mask.

    Equal scores: the smaller leaf first. Null text and null role are empty; null scores count 0; all rows of a null tree
    are one tree; of repeated (tree, node) rows one counts (see once_each). Extra columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    messages = materialise(once_each(messages), "nodes")
    scored, tables = leaf_scores(messages)
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    chosen = scored.withColumn("rank", rank).filter(F.col("rank") <= per_tree)
    steps = materialise(chosen.select("tree", "leaf", "path_score", F.col("leaf").alias("node"), F.lit(0).alias("pos")), "steps")
    for k in reversed(range(len(tables))):
        t = tables[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "top")
        back = steps.join(t, same("t", "n")).select("tree", "leaf", "path_score", F.col("top").alias("node"), (F.col("pos") - (1 << k)).alias("pos"))
        steps = materialise(steps.unionByName(back), "steps")
    m = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("pos", F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": ")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    turns = steps.join(m, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    span = lambda t: F.length(t["head"]) + F.length(t["body"]) + F.lit(len(TURN_END))
    empty = F.array().cast("array<struct<start:int,length:int>>")
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), empty.alias("mask")),
        lambda a, t: F.struct((a["at"] + span(t)).alias("at"), F.when(t["learn"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(a["mask"]).alias("mask")),
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "")
    return turns.select("tree", "leaf", "path_score", formatted.alias("formatted"), walk["mask"].alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array<struct<role, text>>."""
    raw = F.filter(F.split(formatted, TURN_END), lambda x: x != "")
    return F.transform(raw, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(5)), ":", 1)).alias("role"), unescape(F.substr(x, F.instr(x, ":") + 2)).alias("text")))


def chain(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one path each, by turn (ties: role, text; null turns first)."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text").withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(1.0)})


def branching(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: of four successive conv_ids, all but the first answer the first one's first turn.
    Messages score the length of their text modulo 7."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    tree = F.floor(F.col("conv_id") / 4).cast("long")
    rows = conversations.filter("conv_id is not null").select(tree.alias("tree"), "conv_id", at.alias("at"), "role", "text")
    first = rows.groupBy("tree").agg(F.min("conv_id").alias("first"))
    rows = rows.join(first, "tree").withColumn("node", F.col("conv_id") * 1_000_000 + F.col("at"))
    parent = F.when(F.col("at") > 1, F.col("node") - 1).when(F.col("conv_id") != F.col("first"), F.col("first") * 1_000_000 + 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", (F.length(F.coalesce("text", F.lit(""))) % 7).cast("double").alias("score"))


def op5b_ranked_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best branches of every tree of branching()."""
    out = conversations_of(branching(table(spark, sf_dir, "conversations")), per_tree=2)
    return out.select("tree", "leaf", "path_score", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    out = materialise(conversations_of(materialise(chain(rows.unionByName(more)), "messages")), "formatted")
    turns = parse(F.col("formatted"))
    learned = unescape(F.array_join(F.transform("loss_mask", lambda s: F.substr("formatted", s["start"] + 1, s["length"])), ""))
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""Exact top-k inner-product search by no-random-access aggregation of sorted lists.

Rows and queries meet in pairs of bounded blocks, so no task grows with the data. In a row block every dimension is a
list of (value, row) sorted by value. The queries read the lists step by step, each from the end where its component
scores most; a row is never looked up: its partial score is what the lists have shown of it so far. Its lower bound takes
the worst value of each list that has not shown it yet, its upper bound the value at that list's head; a row that no list
has shown has the sum of the heads as its upper bound. A query stops when at most a few rows can still reach its k-th lower
bound; only those rows' final scores are then resolved from their vectors. All queries of a chunk read in step: what a step
shows is the same for all that read a list from one end, so a step is a product of what it shows with the queries. Dense
vectors of even components make such bounds tighten late (reads of three quarters of the lists are usual); skewed or
sparse ones stop early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

ROW_BLOCK, QUERY_BLOCK = 2048, 8192
#: Lists are read in so many steps at most; so many queries read together.
STEPS, CHUNK = 8, 512


def nra(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the positions and int64 scores of its k best rows with another id (ties to the smaller id), and
    how many entries of each list it has read."""
    n, dims = rows.shape
    top = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (queries, rows)]
    reach = dims * top[0] * top[1]
    if reach >= 2**63:
        raise OverflowError("scores of these vectors may not fit 64 bits: give smaller components or a smaller scale")
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64  # exact each time, up to 64-bit scores
    least = np.iinfo(np.int64).min // 2 if kind is np.int64 else -np.inf
    order = np.argsort(rows, axis=0, kind="stable")
    value = rows.T.astype(kind)
    lists = np.take_along_axis(value, order.T, axis=1)
    place = np.empty((dims, n), np.int64)
    np.put_along_axis(place, order.T, np.arange(n)[None, :], axis=1)
    far = np.concatenate((n - 1 - place, place))  # entries before a row in each list, from the top and from the bottom
    shown = np.concatenate((value, value))
    step, few = max(1, -(-n // STEPS)), max(4 * k, n // 16)
    out: list[tuple[np.ndarray, np.ndarray, int]] = [None] * len(queries)  # type: ignore[list-item]
    for first in range(0, len(queries), CHUNK):
        open_q = np.arange(first, min(len(queries), first + CHUNK))
        q = queries[open_q].astype(kind)
        q = np.concatenate((np.maximum(q, 0), np.minimum(q, 0)), axis=1)  # what reads from the top, and from the bottom
        partial = np.zeros((len(q), n), kind)
        depth = 0
        while len(open_q):
            end = min(n, depth + step)
            partial += q @ np.where((far >= depth) & (far < end), shown, 0).astype(kind)
            hidden, depth = (far >= end).astype(kind), end
            worst, head = (np.concatenate((lists[:, x], lists[:, y])) for x, y in ((0, -1), (n - depth, depth - 1)))
            lower, upper = partial + (q * worst) @ hidden, partial + (q * head) @ hidden
            own = row_ids[None, :] == query_ids[open_q][:, None]
            lower[own] = least
            at = n - min(k, n)
            can = (upper >= np.partition(lower, at, axis=1)[:, at : at + 1]) & ~own
            done = np.count_nonzero(can, axis=1) <= few if depth < n else np.ones(len(open_q), bool)
            for j in np.flatnonzero(done):
                mine = np.flatnonzero(can[j])
                score = rows[mine] @ queries[open_q[j]]
                best = np.lexsort((row_ids[mine], -score))[:k]
                out[open_q[j]] = mine[best], score[best], depth
            q, partial, open_q = q[~done], partial[~done], open_q[~done]
    return out


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component; rows with a null id, or a null vector, null or
    non-finite components, are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query by integer inner product: query_id, rank, vec_id, score, and depth (how many
    entries of each list the query read in that row's block).

    Both inputs are (vec_id, v). A query sees every row of another id; ties go to the smaller vec_id. Repeated query
    ids count once (their least vector); repeated rows are each listed. Vectors of unequal length count as padded
    with zeros. Empty inputs give no rows. Scores are 64-bit integers: where the largest components could give larger
    ones (dimensions times the largest of the queries times that of the rows reaches 2^63) the search fails with an error.
    """
    queries = queries.groupBy(F.col("vec_id").alias("q_id")).agg(F.min("v").alias("q_v")).select(F.col("q_id").alias("vec_id"), F.col("q_v").alias("v"))
    rb = max(1, -(-rows.count() // ROW_BLOCK))
    qb = max(1, -(-queries.count() // QUERY_BLOCK))
    left = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(rb)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    # names and attributes of their own on either side, also where both sides come from one table
    right = queries.select((F.col("vec_id") + 0).alias("vec_id"), F.col("v").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"), F.pmod(F.xxhash64("vec_id"), F.lit(qb)).cast("int").alias("qb"))

    def dense(t: pa.Table, dims: int) -> np.ndarray:
        column = t["v"].combine_chunks()
        lens = np.asarray(column.value_lengths(), np.int64)
        flat = np.asarray(column.flatten(), np.int64)
        out = np.zeros((t.num_rows, dims), np.int64)
        out[np.repeat(np.arange(t.num_rows), lens), np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(lens)[:-1])), lens)] = flat
        return out

    def pair(r: pa.Table, q: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if r.num_rows and q.num_rows:
            dims = max(max(np.asarray(t["v"].combine_chunks().value_lengths()).max() for t in (r, q)), 1)
            r_ids, q_ids = np.asarray(r["vec_id"], np.int64), np.asarray(q["vec_id"], np.int64)
            got = nra(dense(q, dims), q_ids, dense(r, dims), r_ids, k)
            width = [len(x[0]) for x in got]
            out = [np.repeat(q_ids, width), r_ids[np.concatenate([x[0] for x in got])], np.concatenate([x[1] for x in got]), np.repeat([x[2] for x in got], width)]
        return pa.table({n: x.astype(np.int64) for n, x in zip(("query_id", "vec_id", "score", "depth"), out)})

    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(pair, "query_id long, vec_id long, score long, depth long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


def op2_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return search(rows.filter(F.col("vec_id") % 50 == 0), rows, 5).drop("depth")


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER "rank", vec_id, score FROM s)
SELECT * FROM r WHERE "rank" <= 5
"""

"""Packing tokenised documents into fixed-size training sequences by attention cost.

A piece of n tokens costs linear * n + quadratic * n * n. Documents are taken in descending length and each goes to
the sequence of the lowest cost so far that has room; when none has room the document is cut at the fullest gap. A
window of documents opens exactly as many sequences as its tokens fill, and its last partial sequence is opened as
sequences of powers of two, so nothing is padded.

Windows follow the input's partitions: no shuffle, no state beyond one window, and a lost task reruns alone.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import byte_rows, lean, table
from .tokenise import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack documents of the given lengths.

    Returns pieces (rows of document index, start, length, sequence, offset), sequence sizes and sequence costs.
    Ties: equal lengths in input order, equal costs to the lower sequence number. Empty documents give no piece.
    """
    lengths = np.asarray(lengths, np.int64)
    whole = lengths // capacity
    rest = lengths - whole * capacity
    pieces = []
    for k in np.flatnonzero(whole):
        for j in range(int(whole[k])):
            pieces.append((int(k), j * capacity, capacity, len(pieces), 0))
    first = len(pieces)
    total = int(rest.sum())
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    room = np.array(sizes, np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    heap = [(-int(rest[k]), int(k), int(whole[k]) * capacity) for k in np.flatnonzero(rest)]
    heapq.heapify(heap)
    while heap:
        n, k, start = heapq.heappop(heap)
        n = -n
        fits = room >= n
        b = int(np.where(fits, cost, np.inf).argmin())
        take = n
        if not fits[b]:
            b = int(room.argmax())
            take = int(room[b])
            heapq.heappush(heap, (-(n - take), k, start + take))
        pieces.append((k, start, take, first + b, int(size[b] - room[b])))
        room[b] -= take
        cost[b] += linear * take + quadratic * take * take
    full = linear * capacity + quadratic * capacity * capacity
    return np.array(pieces, np.int64).reshape(-1, 5), np.concatenate((np.full(first, capacity, np.int64), size)), np.concatenate((np.full(first, full), cost))


def pack_tokens(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, window_tokens: int = 4_000_000, linear: float = 1.0, quadratic: float = 1 / 4096, with_ids: bool = False) -> DataFrame:
    """Tokenise docs(doc_id, text) and pack them; one row per piece, with its ids where with_ids is set.

    Special tokens' strings in a text are ordinary text (see tokenise). Null text is an empty document (its end id only). Null and repeated doc_id pass through, each row packed on its
    own. An empty table gives no rows; further columns are ignored.
    """

    def run(batches):
        enc = encoder(tokenizer)
        seq = TaskContext.get().partitionId() << 32
        ids_of, docs_of, held = [], [], 0

        def flush():
            nonlocal seq, ids_of, docs_of, held
            pieces, sizes, costs = assign(np.array([len(x) for x in ids_of]), capacity, linear, quadratic)
            k, start, length, s, offset = pieces.T
            cut = [ids_of[a][b : b + n] for a, b, n in zip(k.tolist(), start.tolist(), length.tolist())]
            columns = [
                pa.array([docs_of[a] for a in k.tolist()], pa.int64()), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([len(ids_of[a]) for a in k.tolist()], pa.int64()),
                pa.array(seq + s), pa.array(offset), pa.array(sizes[s]), pa.array(costs[s]),
            ]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in cut], pa.list_(pa.int64())))
                names.append("ids")
            seq += len(sizes)
            ids_of, docs_of, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(byte_rows(part.column(1)))):
                    ids_of.append(np.concatenate((ids, end)).astype("<u4"))
                    docs_of.append(doc)
                    held += len(ids) + 1
                if held >= window_tokens:
                    yield flush()
        if ids_of:
            yield flush()

    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), schema)


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

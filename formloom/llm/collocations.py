"""Collocations: phrases of two to four words, found through count-min sketches.

1. Every task counts the hashes of all its n-grams (one to four words) into a sketch of ROWS x cells; the sketches are
   added cell by cell, block by block. Cells stop counting at the least count that matters. A merged cell is at least the count of
   every n-gram in it, so an n-gram one of whose cells stays below the least count is rare, for certain.
2. A second pass counts exactly, by their words, the n-grams none of whose cells (nor those of the n-grams inside it) is
   below; what only collided falls at this count. So nothing frequent is lost at any width of the sketch: a sketch
   that is narrow for its corpus only lets more rare n-grams into the second count.
3. Candidates are scored by their worst cut and dropped where a longer candidate explains most of their occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, lean, materialise, mix64, shuffle_width, table, translated

LONGEST, MIN_COUNT, REPORT, FACTOR, COVER = 4, 30, 2000, 2_000_000, 80
#: Width of a sketch row (a power of two up to 2**32) and its rows; a task holds ROWS * CELLS bytes, the driver an eighth of that.
CELLS, ROWS, BLOCK = 1 << 26, 2, 1 << 20
#: Bytes of text whose words a task holds at once.
CHUNK = 6_000_000
_END = b"."  # stands for every separator of pieces, so it is never part of a word
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(46 if c in _SEPARATORS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


class _Words(dict):
    """Numbers words in order of appearance; the separator is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(batches, limit: int):
    """(lang, words, n): words are those of whole texts and separators; n-grams that start before n belong to this chunk.

    A text beyond the limit comes in several chunks, each beginning with the words that its last n-grams may still need."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            if not text:
                continue
            words = held.setdefault(lang, [])
            for part in translated(text, _TABLE, limit):
                words += part.replace(_END, b" . ").split()
                size += len(part)
                if size > limit:
                    cut = max(0, len(words) - LONGEST + 1)
                    yield lang, words, cut
                    held[lang] = words = words[cut:]
                    for other, rest in held.items():
                        if other != lang:
                            yield other, rest, len(rest)
                    held, size = {lang: words}, 0
            words.append(_END)
    for lang, words in held.items():
        yield lang, words, len(words)


class Grams:
    """The n-grams of a chunk: word numbers, which places start an n-gram of k words, and their hashes."""

    def __init__(self, lang: str, words: list[bytes], n: int):
        known = _Words({_END: 0})
        self.ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        seed = xxhash.xxh32_intdigest(lang.encode())
        self.word_hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known))[self.ids]
        self.n = n

    def orders(self):
        """For k = 1 to LONGEST: (k, places where an n-gram starts as a mask, those from n on among them, their hashes)."""
        valid = self.ids != 0
        ok, h = valid, self.word_hash
        for k in range(1, LONGEST + 1):
            if k > 1:
                ok, h = ok[:-1] & valid[k - 1 :], mix64(h[:-1] * _U(0x9E3779B97F4A7C15) + self.word_hash[k - 1 :])
            yield k, ok, h


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix64(h + _U(row * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) & _U(cells - 1)).astype(np.uint32)


def add(sketch: np.ndarray, cells: np.ndarray, cap: int, times: np.ndarray | int = 1) -> None:
    """Add to distinct cells, up to the cap."""
    sketch[cells] = np.minimum(sketch[cells].astype(np.uint64) + np.minimum(times, cap).astype(np.uint64), cap).astype(sketch.dtype)


def _cell_type(cap: int):
    return np.uint8 if cap < 256 else np.uint32


def sketching(cells: int, cap: int, chunk: int):
    """mapInArrow step: a task's sketch as rows (row, block, full, body), empty blocks left out."""
    block = min(BLOCK, cells)

    @lean
    def run(batches):
        codec = pa.Codec("zstd", 1)
        sketch = np.zeros((ROWS, cells), _cell_type(cap))
        for lang, words, n in chunks(batches, chunk):
            for _, ok, h in Grams(lang, words, n).orders():
                h = h[:n][ok[:n]]
                for r in range(ROWS):
                    at = np.sort(cells_of(h, r, cells))
                    first = np.flatnonzero(np.concatenate((at[:1] == at[:1], at[1:] != at[:-1])))
                    add(sketch[r], at[first], cap, np.diff(np.append(first, len(at))))
        for r in range(ROWS):
            for b in range(cells // block):
                part = sketch[r, b * block : (b + 1) * block]
                at = np.flatnonzero(part).astype(np.uint32)
                if len(at):
                    full = len(at) * 16 > block
                    body = part.tobytes() if full else at.tobytes() + part[at].tobytes()
                    yield pa.record_batch([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([-1 if full else len(at)], pa.int32()), pa.array([len(body)], pa.int64()), pa.array([codec.compress(body, asbytes=True)], pa.binary())], ["row", "block", "some", "size", "body"])

    return run


def merging(cells: int, cap: int):
    """mapInArrow step: the sum of all parts of each block, as bits of the cells that reach the cap."""
    block, kind = min(BLOCK, cells), _cell_type(cap)

    @lean
    def run(batches):
        codec = pa.Codec("zstd")
        sums: dict[tuple[int, int], np.ndarray] = {}  # a sketch's size at most
        for batch in batches:
            for r, b, some, size, body in zip(*(c.to_pylist() for c in batch.columns)):
                raw = codec.decompress(body, size, asbytes=True)
                total = sums.setdefault((r, b), np.zeros(block, kind))
                if some < 0:
                    add(total, np.arange(block), cap, np.frombuffer(raw, kind))
                else:
                    add(total, np.frombuffer(raw, np.uint32, some), cap, np.frombuffer(raw, kind, some, 4 * some))
        for (r, b), total in sums.items():
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([np.packbits(total >= cap, bitorder="little").tobytes()], pa.binary())], ["row", "block", "bits"])

    return run


def survivors(held, cells: int, chunk: int):
    """mapInArrow step: (lang, k, phrase, a), counts of a chunk's n-grams that the sketch lets through; k = 0: all words."""

    @lean
    def run(batches):
        bits = held.value
        for lang, words, n in chunks(batches, chunk):
            grams = Grams(lang, words, n)
            ids, passed, pair, total = grams.ids, None, None, 0
            for k, ok, h in grams.orders():
                if k == 1:
                    total = int(ok[:n].sum())
                at = np.flatnonzero(ok if k == 1 else ok & passed[: len(ok)] & passed[1 : len(ok) + 1])
                for r in range(ROWS):
                    c = cells_of(h[at], r, cells)
                    at = at[(bits[r][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 == 1]
                passed = np.zeros(len(ok), bool)
                passed[at] = True
                every, at = at, at[at < n]
                # exact keys: word numbers, pairs of them, then numbers of pairs
                key = ids[at] if k == 1 else ids[at] << 32 | ids[at + 1] if k == 2 else pair[at] << 32 | (ids[at + 2] if k == 3 else pair[at + 2])
                if k == 2:  # pairs that start after n are parts of longer n-grams too
                    pair = np.zeros(len(ids), np.int64)
                    pair[every] = np.unique(ids[every] << 32 | ids[every + 1], return_inverse=True)[1]
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                if len(first):
                    phrases = [b" ".join(words[i : i + k]) for i in at[first].tolist()]
                    m = len(phrases)
                    yield pa.record_batch([pa.array([lang] * m), pa.array([k] * m, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["lang", "k", "phrase", "a"])
            yield pa.record_batch([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([total], pa.int64())], ["lang", "k", "phrase", "a"])

    return run


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, cells: int = CELLS, chunk: int = CHUNK) -> DataFrame:
    """(lang, k, phrase, a) of all n-grams with at least min_count occurrences, and per language all words (k = 0)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parts = texts.mapInArrow(sketching(cells, min_count, chunk), "row int, block int, some int, size long, body binary")
    merged = parts.repartition(shuffle_width(spark), "row", "block").mapInArrow(merging(cells, min_count), "row int, block int, bits binary")
    merged = materialise(merged, "sketch")
    bits = np.zeros((ROWS, max(1, cells // 8)), np.uint8)
    for r in merged.collect():  # ROWS * cells / 8 bytes, whatever the corpus
        at = r.block * min(BLOCK, cells) // 8
        bits[r.row, at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    discard(merged)
    counted = texts.mapInArrow(survivors(spark.sparkContext.broadcast(bits), cells, chunk), "lang string, k int, phrase string, a long")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a")).filter((F.col("a") >= min_count) | (F.col("k") == 0))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, report: int = REPORT, cells: int = CELLS, chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) for docs(lang, text): each language's best phrases of 2 to 4 words.

    Null text is empty, null lang is `und`; repeated rows count each time; phrases never cross pieces or texts; texts
    are read whole, however long; ties go by count, then by the phrase's UTF-8 bytes; other columns are ignored; an
    empty table, or one without frequent phrases, gives no rows.
    """
    found = materialise(frequent(docs, min_count, cells, chunk), "frequent")
    words = F.split("phrase", " ")
    candidates = found.filter("k >= 2")
    parts = found.filter((F.col("k") > 0) & (F.col("k") < LONGEST)).select("lang", "phrase", "a")
    cuts = candidates.withColumn("w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", exact("a") * F.lit(FACTOR).cast("decimal(10,0)"), exact("l") + exact("r"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    inner = candidates.filter("k > 2").withColumn("w", words).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1), lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(exact("longer") * 100 < exact("a") * COVER, F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= report)
    totals = found.filter("k = 0").select("lang", F.col("a").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d), w AS (SELECT lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda v: v <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS ph FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ph, string_split(ph, ' ') AS v, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_COUNT}),
h AS (SELECT lang, ph, a, cut, array_to_string(v[1:cut], ' ') AS x, array_to_string(v[cut + 1:k], ' ') AS y FROM f, (VALUES (1), (2), (3)) u(cut) WHERE cut < k),
c AS (SELECT h.*, x.a AS l, y.a AS r, (h.a::HUGEINT * {FACTOR}) // (x.a + y.a) AS score FROM h JOIN f x ON x.lang = h.lang AND x.ph = h.x JOIN f y ON y.lang = h.lang AND y.ph = h.y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) AS o FROM c),
s AS (SELECT DISTINCT lang, array_to_string(v[i:i + m - 1], ' ') AS ph, a FROM (SELECT lang, v, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM f, (VALUES (2), (3)) v(m) WHERE m < k)),
e AS (SELECT lang, ph AS phrase, a, l, r, score FROM b WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.lang = b.lang AND s.ph = b.ph AND 100 * s.a >= {COVER} * b.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN t USING (lang) WHERE rank <= {REPORT}"""

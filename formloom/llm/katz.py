"""Katz back-off language model of any order: Good-Turing discounted n-grams, backing off to shorter ones.

    P(w | h) = d(c) c(h, w) / c(h)   where c(h, w) > 0,   else alpha(h) P(w | h without its first word)
    P(w)     = d(c) c(w) / N         where c(w) > 0,      else the mass the discounts leave (one unknown word)
    alpha(h) = (1 - sum of the seen) / (1 - sum of the lower order's P over the words seen after h), or 1 for an unseen h

so the words seen in training and the unknown word sum to 1 after every history. Words are 64-bit hashes. Texts are cut
into blocks once; the rest is exchanged as packed integer columns by hash bucket. First words are counted and numbered.
Then, level by level, each block asks for its distinct n-grams; a bucket adds up their counts, writes its part of the
n-gram table and answers with counts, and for n-grams that training lacks with what their history's back-off weight
needs; the block evaluates its tokens from the level below. An n-gram is dealt by its history, and by history and word
where the history holds more than a set share of a bucket, so no key is one task's work; the sums of such histories are
added up over the buckets. All tables are written to the shared folder.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, flat_bytes, lean, materialise, mix64, release, shuffle_width, table
from .minhash import word_hashes
from . import suffix_dedup
from .suffix_dedup import runs

BLOCK_BYTES, CHUNK_BYTES = 8_000_000, 1_500_000
#: Above bigrams, a level's n-grams go in this many rounds over the buckets, which divides what is exchanged at once.
ROUNDS = 2
SPLIT = 4  #: a history with more than this part of a bucket's fair share of all tokens is dealt by its words
KATZ = 5  #: counts above this are not discounted
BOS = 0xFFFFFFFF
END_HASH = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64


def planes(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes, after their size."""
    raw = suffix_dedup.planes(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(column: pa.ChunkedArray | list, kind: str) -> np.ndarray:
    """The integers of all cells of a column (or list) of planes()."""
    cells = column if isinstance(column, list) else column.to_pylist()
    return suffix_dedup.unplanes([pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd").to_pybytes() for b in cells if b], kind)


def discounts(n: list[int]) -> list[float]:
    """d(1) .. d(KATZ) from the numbers of types seen 1 .. KATZ + 1 times.

    Good-Turing by Katz's formula where it gives values in (0, 1); else, as with few or odd counts, absolute
    discounting by n1 / (n1 + 2 n2), or by a half where there is no n1.
    """
    if all(n[: KATZ + 1]):
        tail = (KATZ + 1) * n[KATZ] / n[0]
        if tail < 1:
            d = [((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) for r in range(1, KATZ + 1)]
            if all(0 < x < 1 for x in d):
                return d
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [(r - cut) / r for r in range(1, KATZ + 1)]


class Unigrams:
    """P(w) from c(w)."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, d = total, types, discounts(n)
        self.d = np.array([1.0, *d])
        low = sum(n[r - 1] * r * (1 - d[r - 1]) for r in range(1, KATZ + 1))
        self.scale = 1.0 if low or not total else total / (total + 1)
        self.rest = 1.0 if not total else low / total if low else 1 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        d = np.where(c <= KATZ, self.d[np.minimum(c, KATZ).astype(np.int64)], 1.0)
        return np.where(c > 0, d * c / max(self.total, 1) * self.scale, self.rest)


def _rows(rows: list[tuple], n: int) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * n]
    names = ["bucket", "block", "kind", *(f"p{k}" for k in range(1, n + 1))]
    return pa.table({x: pa.array([r[k] for r in rows], t) for k, (x, t) in enumerate(zip(names, kinds))})


def _schema(n: int) -> str:
    return "bucket int, block long, kind int" + "".join(f", p{k} binary" for k in range(1, n + 1))


@dataclass(frozen=True)
class Model:
    """What all tasks know: totals, and per level the discounts and the sums of the histories that are dealt by word."""

    total: int
    types: int
    buckets: int
    uni: Unigrams
    d: dict[int, list[float]]
    hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    split: float

    def kept(self, level: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        dd = np.array([1.0, *self.d[level]])
        return np.where(c <= KATZ, dd[np.minimum(c, KATZ).astype(np.int64)], 1.0) * c

    def alpha(self, level: int, total: np.ndarray, n: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Back-off weights of histories from their totals, their numbers of words seen 1 .. KATZ times (a row each) and
        the lower order's probability of all words seen after them. One without counts to discount gives up 1 / (c(h) + 1)."""
        total = total.astype(np.float64)
        lost = n @ (np.arange(1, KATZ + 1) * (1 - np.array(self.d[level])))
        lost = np.where(n.any(1), lost / np.maximum(total, 1), 1 / (total + 1))
        return np.where(total > 0, lost / np.where(total > 0, 1 - seen, 1), 1.0)

    def sums(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n and seen, as alpha() takes them, of histories dealt by word."""
        known, n, seen = self.hot[level]
        at = np.searchsorted(known, keys)
        return n[at], seen[at]


class Block:
    """The tokens of one block's documents as level `level` meets them.

    key, total: each token's history and how often training has it; low, low_total: the count one level below (twice
    the count and a bit for an undiscounted history from level 3 on) and its history's total; p: the probability there.
    """

    def __init__(self, b: pa.Table | pa.RecordBatch, row: int, level: int, m: Model, with_p: bool):
        def get(name: str, kind: str) -> np.ndarray:
            return unplanes([b.column(name)[row].as_py()], kind)

        self.m, self.level, self.rounds = m, level, rounds_of(level)
        self.ids, self.flags, self.lens = get("ids", "<i8"), get("flags", "u1"), get("lens", "<u4").astype(np.int64)
        codes, number, count = get("codes", "<u4"), get("number", "<u4"), get("count", "<u8")
        self.first = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.train = (self.flags & 1)[self.doc] == 0
        self.w, self.c = number[codes].astype(np.uint64), count[codes]
        ends = self.c[self.lens[0] - 1]  # training documents, as each has one end: what (start, start, ...) counts
        back = self.before(self.w, _U(BOS))
        self.key, self.total, self.low, self.low_total, self.p = back, self.before(self.c, ends), self.c, None, m.uni.p(self.c) if with_p else None
        for k in range(2, level):
            back = self.before(back, _U(BOS))
            self.key = self.key << _U(32) | back if k == 2 else mix64(mix64(self.key) + back)
            g = get(f"g{k}", "<u8")
            if with_p:
                self.advance(k, g, np.frombuffer(b.column(f"a{k}")[row].as_py()))
            self.low, self.low_total, self.total = g, self.total, self.before(g >> _U(1), ends)
        share = self.total.astype(np.float64) * m.split * m.buckets
        self.hot = share > m.total
        self.home = (mix64(self.key + np.where(self.hot, mix64(self.w + _U(1)), _U(0))) % _U(m.buckets)).astype(np.int64)

    def before(self, x: np.ndarray, start: np.uint64) -> np.ndarray:
        """Of each token, what x has for the one before it in the document."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def advance(self, level: int, g: np.ndarray, a: np.ndarray) -> None:
        """p one level up, from g (twice the count, and the bit) and the back-off weights of tokens without a count."""
        c, none = g >> _U(1), g & _U(1)
        p = self.m.kept(level, c) / np.maximum(self.total + none, _U(1))
        unseen = c == 0
        p[unseen] = a * self.p[unseen]
        self.p = p

    def grams(self, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens whose n-gram's home has this turn: their positions, one position per distinct n-gram (by home,
        history, word) and each token's n-gram."""
        mine = np.flatnonzero(self.home % self.rounds == turn)
        history = self.key[mine] if self.level == 2 else grouped(self.key[mine])[1].astype(np.uint64)
        first, of = grouped(history << _U(32) | self.w[mine])
        order = np.argsort(self.home[mine[first]], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return mine, mine[first[order]], place[of]

    def requests(self, block: int, turn: int) -> list[tuple]:
        """One row per home: its n-grams of this block with their training counts here and what lower orders know."""
        mine, rep, of = self.grams(turn)
        count = np.bincount(of, weights=self.train[mine], minlength=len(rep)).astype(np.uint64)
        first, out = runs(self.home[rep]), []
        for x, y in zip(first.tolist(), np.append(first[1:], len(rep)).tolist()):
            m = rep[x:y]
            h = runs(self.key[m])
            low_total = planes(self.low_total[m[h]]) if self.level > 2 else None
            out.append((int(self.home[m[0]]), block, 0, planes(steps(self.key[m[h]])), planes(np.diff(np.append(h, y - x)).astype(np.uint32)), planes(steps(self.w[m].astype(np.uint32))), planes(count[x:y]), planes(self.low[m]), low_total, planes(self.hot[m[h]].astype(np.uint8))))
        return out

    def answered(self, a: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """g of each token and the back-off weights of those without a count, from the homes' answers."""
        told = {k: p for k, *p in zip(*(a[x].to_pylist() for x in ("bucket", "p1", "p2", "p3")))}
        g_all, a_all = np.zeros(len(self.w), np.uint64), np.ones(len(self.w))
        for turn in range(self.rounds):
            mine, rep, of = self.grams(turn)
            homes = self.home[rep[runs(self.home[rep])]].tolist()
            cells = [[told[h][k] for h in homes] for k in range(3)]
            g, n = unplanes(cells[0], "<u8"), unplanes(cells[1], "<u4").reshape(-1, KATZ).astype(np.float64)
            seen, weight = np.frombuffer(b"".join(cells[2])).copy(), np.ones(len(rep))
            hot, new = self.hot[rep], np.flatnonzero(g == 0)
            by_word = hot[new]
            n[by_word], seen[by_word] = self.m.sums(self.level, self.key[rep[new[by_word]]])
            weight[new] = self.m.alpha(self.level, self.total[rep[new]], n, seen)
            known = np.flatnonzero(hot & (g > 0))
            g[known] |= (~self.m.sums(self.level, self.key[rep[known]])[0].any(1)).astype(np.uint64)
            g_all[mine], a_all[mine] = g[of], weight[of]
        return g_all, a_all[g_all == 0]


def rounds_of(level: int) -> int:
    return 1 if level == 2 else ROUNDS


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct value of x, values ascending, and of each entry the rank of its value."""
    order = np.argsort(x)
    first = runs(x[order])
    of = np.empty(len(x), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    return order[first], of


def steps(x: np.ndarray) -> np.ndarray:
    """Differences (wrapping) of neighbours, which compress where x is sorted; np.cumsum undoes it."""
    out = x.copy()
    out[1:] = x[1:] - x[:-1]
    return out


def tally(t: pa.Table, level: int, m: Model) -> pa.Table:
    """All requests to one bucket: its table of n-grams seen in training, and an answer per block."""
    asked = [(k, unplanes([h], "<u8"), unplanes([n], "<u4"), *rest) for k, h, n, *rest in zip(*(t[x].to_pylist() for x in ("block", *(f"p{k}" for k in range(1, 8)))))]
    part = lambda k, kind: [unplanes([x[k]], kind) for x in asked]
    keys = np.concatenate([np.cumsum(x[1], dtype=np.uint64) for x in asked])
    at, of = grouped(keys)
    keys = keys[at]
    hot = np.concatenate(part(7, "u1"))[at] > 0
    history = np.repeat(of, np.concatenate([x[2] for x in asked])).astype(np.uint64)
    w = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in part(3, "<u4")])
    gram = history << _U(32) | w
    first, at_gram = grouped(gram)
    gram = gram[first]
    c = np.bincount(at_gram, weights=np.concatenate(part(4, "<u8")), minlength=len(gram)).astype(np.uint64)
    low, of_gram = np.concatenate(part(5, "<u8"))[first], (gram >> _U(32)).astype(np.int64)
    if level == 2:
        p = m.uni.p(low)
    else:
        p = m.kept(level - 1, low >> _U(1)) / np.maximum(np.concatenate(part(6, "<u8"))[at][of_gram] + (low & _U(1)), _U(1))
    n = np.stack([np.bincount(of_gram[c == r], minlength=len(keys)) for r in range(1, KATZ + 1)], 1).astype(np.uint32)
    seen = np.bincount(of_gram, weights=np.where(c > 0, p, 0), minlength=len(keys))
    g = c * _U(2) + ((c > 0) & ~hot[of_gram] & ~n.any(1)[of_gram]).astype(np.uint64)
    bucket, rows, have = t["bucket"][0].as_py(), [], c > 0
    types = np.bincount(np.minimum(c[have], KATZ + 2).astype(np.int64), minlength=KATZ + 3)[1 : KATZ + 2].astype(np.int64)
    some = np.unique(of_gram[have])
    rows.append((bucket, -1, 2, planes(steps(keys[some])), planes(np.bincount(of_gram[have], minlength=len(keys))[some].astype(np.uint32)), planes(steps(gram[have].astype(np.uint32))), planes(c[have]), types.tobytes(), keys[hot].tobytes(), n[hot].tobytes(), seen[hot].tobytes()))
    a = 0
    for x in asked:
        mine = at_gram[a : a + int(x[2].sum())]
        a += len(mine)
        new = of_gram[mine[c[mine] == 0]]
        rows.append((bucket, x[0], 1, planes(g[mine]), planes(n[new].ravel()), seen[new].tobytes(), *[None] * 5))
    return _rows(rows, 8)


def hot_sums(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (ascending), n and seen of the histories dealt by word: at most SPLIT x buckets, as each has more than that
    share of all training tokens."""

    def each(batches):
        for batch in batches:
            for keys, n, seen in zip(*(x.to_pylist() for x in batch.columns)):
                n = np.frombuffer(n, np.uint32).reshape(-1, KATZ).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), *(pa.array(n[:, k]) for k in range(KATZ)), pa.array(np.frombuffer(seen))], names=["key", *(f"n{k}" for k in range(KATZ)), "seen"])

    rows = table.filter("kind = 2").select("p6", "p7", "p8").mapInArrow(each, "key long, " + ", ".join(f"n{k} long" for k in range(KATZ)) + ", seen double")
    got = rows.groupBy("key").agg(*(F.sum(x).alias(x) for x in rows.columns[1:])).collect()
    keys = np.array([r[0] for r in got], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r[1:-1] for r in got], np.float64).reshape(-1, KATZ)[order], np.array([r[-1] for r in got], np.float64)[order]


def score(docs: DataFrame, held_out=lambda doc_id: zlib.crc32(str(doc_id).encode()) % 7 == 2, order: int = 3) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    order (2 or more): the longest n-grams. Trains on the documents that held_out (a function of doc_id) leaves. Null text
    is empty (one end token); a null doc_id trains; repeated rows count each; other columns aren't read; an empty table
    gives no rows. base_score is the add-one unigram model. With no training documents base_score is that of no counts
    and score is 0. Words are told apart by 64-bit hashes, histories exactly up to order 3 and by 64-bit hashes beyond;
    up to 2^32 - 2 distinct words.
    """
    spark = docs.sparkSession
    buckets = shuffle_width(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").alias("n"))

    def encode(batches):
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal block, held, size
            ids = [i for x in held for i in x[0]]
            h = np.concatenate([x[1] for x in held])
            lens = np.concatenate([x[2] for x in held])
            out_of = np.array([i is not None and held_out(i) for i in ids], np.uint8)
            vocab, codes = np.unique(h, return_inverse=True)
            train = np.repeat(out_of == 0, lens)
            counts = np.bincount(codes[train], minlength=len(vocab))
            null = np.array([i is None for i in ids], np.uint8)
            row = (part << 32 | block, planes(np.array([i or 0 for i in ids], np.int64)), planes(out_of + 2 * null), planes(lens.astype(np.uint32)), planes(vocab), planes(counts.astype(np.uint32)), planes(codes.astype(np.uint32)))
            block, held, size = block + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if k else pa.int64()) for k, x in enumerate(row)], names=["block", "ids", "flags", "lens", "vocab", "counts", "codes"])

        for batch in batches:
            at, total = 0, np.cumsum(np.asarray(batch.column(2).fill_null(0), np.int64))
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK_BYTES)))
                piece = batch.slice(at, end - at)
                flat, starts, lens = flat_bytes(piece.column(1), 0)
                flat = np.insert(flat, np.cumsum(lens), 10)
                starts = starts + np.arange(len(lens))
                pos, h = word_hashes(flat)
                doc = np.searchsorted(starts, pos, "right") - 1
                n_words = np.bincount(doc, minlength=len(lens))
                held.append((piece.column(0).to_pylist(), np.insert(h, np.cumsum(n_words), END_HASH), n_words + 1))
                size += len(flat)
                at = end
                if size >= BLOCK_BYTES:
                    yield flush()
        if held:
            yield flush()

    blocks = materialise(rows.mapInArrow(lean(encode), "block long, ids binary, flags binary, lens binary, vocab binary, counts binary, codes binary"), "katz-blocks", "zstd")

    def ask(batches):
        for batch in batches:
            for block, v, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                v, c = unplanes([v], "<u8"), unplanes([c], "<u4")
                home = (v % _U(buckets)).astype(np.int64)
                out = [(b, block, 0, planes(v[m]), planes(c[m])) for b in np.unique(home).tolist() for m in [np.flatnonzero(home == b)]]
                yield from _rows(out, 2).to_batches()

    def number(t: pa.Table) -> pa.Table:
        b = t["bucket"][0].as_py()
        parts = [(k, unplanes([v], "<u8"), unplanes([c], "<u4")) for k, v, c in zip(t["block"].to_pylist(), t["p1"].to_pylist(), t["p2"].to_pylist())]
        words, at = np.unique(np.concatenate([x[1] for x in parts]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([x[2] for x in parts]), minlength=len(words)).astype(np.uint64)
        if len(words) * buckets >= BOS:
            raise ValueError("too many distinct words for 32-bit numbers")
        seen = total[total > 0]
        stats = np.array([total.sum(), len(seen), *np.bincount(np.minimum(seen, KATZ + 2).astype(np.int64), minlength=KATZ + 3)[1 : KATZ + 2]], np.int64)
        out, a = [(b, -1, 2, planes(words), planes(total), stats.tobytes())], 0
        for block, v, _ in parts:
            mine = at[a : a + len(v)]
            a += len(v)
            out.append((b, block, 1, planes((mine * buckets + b).astype(np.uint32)), planes(total[mine]), None))
        return _rows(out, 3)

    words = materialise(blocks.select("block", "vocab", "counts").mapInArrow(lean(ask), _schema(2)).groupBy("bucket").applyInArrow(number, _schema(3)), "katz-words", "zstd")

    release(spark)

    def sums(t: DataFrame, column: str) -> list[int]:
        """Sums over the buckets' statistics, a few numbers in one row per bucket."""
        got = [np.frombuffer(r[0], np.int64) for r in t.filter("kind = 2").select(column).collect()]
        return np.sum(got, axis=0).tolist() if got else [0] * (KATZ + 3)

    total, types, *n = sums(words, "p3")
    uni = Unigrams(total, types, n)
    answers = words.filter("kind = 1").select("block", "bucket", "p1", "p2")

    def numbered(b: pa.Table, a: pa.Table) -> pa.Table:
        """A block's words with their numbers and training counts."""
        vocab = unplanes(b["vocab"], "<u8")
        home = (vocab % _U(buckets)).astype(np.int64)
        number, count = np.zeros(len(vocab), np.uint32), np.zeros(len(vocab), np.uint64)
        for k, x, y in zip(a["bucket"].to_pylist(), a["p1"].to_pylist(), a["p2"].to_pylist()):
            m = home == k
            number[m], count[m] = unplanes([x], "<u4"), unplanes([y], "<u8")
        return b.select(["block", "ids", "flags", "lens", "codes"]).append_column("number", pa.array([planes(number)])).append_column("count", pa.array([planes(count)]))

    columns = ["block long", *(f"{x} binary" for x in ("ids", "flags", "lens", "codes", "number", "count"))]
    state = materialise(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(numbered, ", ".join(columns)), "katz-state", "zstd")
    discard(blocks)
    del blocks, answers
    release(spark)
    model = Model(total, types, buckets, uni, {}, {}, SPLIT)

    def ask_level(level: int, turn: int, m: Model):
        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    yield from _rows(Block(batch, row, level, m, False).requests(batch.column(0)[row].as_py(), turn), 7).to_batches()

        return lean(run)

    def tally_level(level: int, m: Model):
        return lambda t: tally(t, level, m)

    def next_state(level: int, m: Model):
        def run(b: pa.Table, a: pa.Table) -> pa.Table:
            g, weights = Block(b, 0, level, m, False).answered(a)
            return b.append_column(f"g{level}", pa.array([planes(g)])).append_column(f"a{level}", pa.array([weights.tobytes()]))

        return run

    def finish(m: Model):
        def run(b: pa.Table, a: pa.Table) -> pa.Table:
            x = Block(b, 0, order, m, True)
            x.advance(order, *x.answered(a))
            per_doc = lambda v: np.bincount(x.doc, weights=v, minlength=len(x.lens))
            base = per_doc(np.log10((x.c.astype(np.float64) + 1) / (total + types + 1)))
            known = per_doc(x.c > 0).astype(np.int64)
            return pa.table({"doc_id": pa.array(x.ids, mask=x.flags >= 2), "held_out": (x.flags & 1) == 1, "n_tokens": x.lens, "n_known": known, "base_score": base, "score": per_doc(np.log10(x.p))})

        return run

    for level in range(2, order + 1):
        rounds = []
        for turn in range(rounds_of(level)):
            asked = state.mapInArrow(ask_level(level, turn, model), _schema(7))
            rounds.append(materialise(asked.groupBy("bucket").applyInArrow(tally_level(level, model), _schema(8)), f"katz-{level}-grams", "zstd"))
            del asked
            release(spark)
        grams = reduce(DataFrame.unionByName, rounds)
        model = replace(model, d=model.d | {level: discounts(sums(grams, "p5"))}, hot=model.hot | {level: hot_sums(grams)})
        both = state.groupBy("block").cogroup(grams.filter("kind = 1").select("block", "bucket", "p1", "p2", "p3").groupBy("block"))
        if level == order:
            break
        columns += [f"g{level} binary", f"a{level} binary"]
        new = materialise(both.applyInArrow(next_state(level, model), ", ".join(columns)), "katz-state", "zstd")
        for x in (state, *rounds):  # the new state has what later levels need of them
            discard(x)
        state = new
        del both, grams, rounds
        release(spark)
    out = both.applyInArrow(finish(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(total)).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Quality classification by co-training of two views.

The text view has character and repetition rates, line layout and the presence of selected hashed words; the metadata
view has what is known without the text: source, language and the recorded number of characters. Each view's logistic regression labels the pool documents it is most
sure of for the other view, over rounds; both are then calibrated (Platt scaling) and combined on labelled
documents that neither was trained on.

The regressions are fitted on a bounded, seeded sample of labelled documents: at most max_labelled, by hash order of
doc_id. The words of the text view are counted over all labelled documents, and each round scores all unlabelled
documents and takes the surest of them; only those and the sample are gathered. Features and scores run where the
documents are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, flat_bytes, lean, materialise, slices, table
from .minhash import word_hashes

WORD_BITS, WORDS = 20, 300
SHAPE = ["symbols", "capitals", "digits", "spaces", "beyond_ascii", "word_length", "distinct_words", "same_as_last", "repeated_lines", "punctuation",
         "log_chars", "log_lines", "line_length", "short_lines"]
LAYOUT = ["log_n_chars", "no_n_chars"]
META_BITS = 6
#: Word numbers are stored as their low 16 bits in ascending order, and how many have each value of the high bits.
HIGH = 1 << (WORD_BITS - 16)


def shape_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text rates and line layout (SHAPE), and each distinct (document, word number) pair of the batch."""
    flat, starts, lens = flat_bytes(column, 0)
    n = len(lens)
    flat = np.insert(flat, np.cumsum(lens), 10)
    starts, size = starts + np.arange(n), lens + 1
    ends = starts + size
    rate = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate((starts, ends[-1:]))]) / np.maximum(lens, 1)
    symbol, punct = np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(b"#*$%&|<>@^~=+{}[]\\")] = True
    punct[list(b".,;:!?")] = True
    upper, digit = (flat >= 65) & (flat <= 90), (flat >= 48) & (flat <= 57)
    at, h = word_hashes(flat)
    doc = np.searchsorted(starts, at, "right") - 1
    words = np.bincount(doc, minlength=n)
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))) if len(h) else np.zeros(0, bool)
    number = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair = np.unique((doc.astype(np.int64) << WORD_BITS) | number)
    distinct = np.bincount(pair >> WORD_BITS, minlength=n)
    breaks = np.flatnonzero(flat == 10)
    begin = np.concatenate(([0], breaks[:-1] + 1))
    line_doc = np.searchsorted(starts, begin, "right") - 1
    length = breaks - begin
    word_of_line = np.searchsorted(at, begin)
    key = length.astype(np.int64) << 32
    key ^= np.where(word_of_line < len(h), (h[np.minimum(word_of_line, max(len(h) - 1, 0))] >> np.uint64(33)).astype(np.int64), 0) if len(h) else 0
    lines = np.bincount(line_doc, minlength=n)
    order = np.lexsort((key, line_doc))
    again = np.zeros(len(key))
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (line_doc[order[1:]] == line_doc[order[:-1]]) & (length[order[1:]] > 0)
    text = np.stack([
        rate(symbol[flat]), rate(upper), rate(digit), rate(flat == 32), rate(flat >= 128), lens / np.maximum(words, 1) / 10, distinct / np.maximum(words, 1) ** 0.9,
        np.bincount(doc, weights=same, minlength=n) / np.maximum(words, 1), np.bincount(line_doc, weights=again, minlength=n) / lines, rate(punct[flat]),
    ], axis=1)
    layout = np.stack([np.log1p(lens), np.log1p(lines), lens / lines / 100, np.bincount(line_doc, weights=length < 20, minlength=n) / lines], axis=1)
    return np.column_stack((np.minimum(text, 10), layout)), pair >> WORD_BITS, pair & ((1 << WORD_BITS) - 1)


def size_columns(n_chars: list) -> np.ndarray:
    """The recorded size (LAYOUT); null is a value of its own."""
    return np.array([[0.0 if n is None else np.log1p(max(float(n), 0.0)), float(n is None)] for n in n_chars]).reshape(-1, len(LAYOUT))


def meta_codes(source: list, lang: list) -> np.ndarray:
    """Hashes of source and language (null is a value of its own)."""
    import zlib

    return np.array([[zlib.crc32(repr(v).encode()) % (1 << META_BITS) for v in pair] for pair in zip(source, lang)], np.int64).reshape(-1, 2)


def meta_columns(codes: np.ndarray) -> np.ndarray:
    """One-hot columns of meta_codes."""
    out = np.zeros((len(codes), 2 << META_BITS), np.float32)
    out[np.arange(len(codes)), codes[:, 0]] = 1
    out[np.arange(len(codes)), (1 << META_BITS) + codes[:, 1]] = 1
    return out


def binaries(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Binary values of lens bytes each, one after the other in data."""
    ends = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def joined_bytes(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def packed_words(word_doc: np.ndarray, words: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """The (document, word number) pairs of shape_features as columns low and high."""
    high = np.bincount(word_doc * HIGH + (words >> 16), minlength=n * HIGH).astype(np.uint32)
    return binaries((words & 0xFFFF).astype(np.uint16), 2 * np.bincount(word_doc, minlength=n)), binaries(high, np.full(n, 4 * HIGH))


def unpacked_words(low: pa.Array, high: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = joined_bytes(high, np.uint32).astype(np.int64)
    at = np.repeat(np.arange(len(counts)), counts)
    return at // HIGH, (at % HIGH << 16) | joined_bytes(low, np.uint16)


class Logistic:
    """L2-regularised logistic regression on standardised columns, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 3.0, steps: int = 12) -> "Logistic":
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
        z = np.empty((len(x), x.shape[1] + 1))
        np.subtract(x, self.mean, out=z[:, :-1])
        z[:, :-1] /= self.scale
        z[:, -1] = 1
        weight = np.ones(len(x)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        reg = np.full(z.shape[1], ridge)
        reg[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + reg * self.w
            h = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(reg)
            step = np.linalg.solve(h, grad)
            self.w -= step
            if np.abs(step).max() < 1e-4:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


def text_columns(shape: np.ndarray, presence: np.ndarray) -> np.ndarray:
    return np.column_stack((shape, shape**2, presence)).astype(np.float32)


class CoTrained:
    """Both views' models, their calibration and the words the text view looks at."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.at = np.full(1 << WORD_BITS, -1, np.int16)
        self.at[self.words] = np.arange(len(self.words))

    def fit(self, a, b, y, held, surest, rounds: int = 3) -> "CoTrained | None":
        """Views a and b of labelled rows, y 1 or 0, held for calibration. None where a class is missing.

        surest(model, n, gone) gives (doc_id, a, b, label of view a) of the unlabelled documents view a is surest of,
        n at most, and the same by view b without those; none of either in gone."""
        train = ~held
        if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
            return None
        each, self.picked = max(1, int(train.sum()) // 10), []
        xa, ya, xb, yb = [a[train]], [y[train]], [b[train]], [y[train]]
        for turn in range(rounds + 1):
            self.a = Logistic().fit(np.concatenate(xa), np.concatenate(ya))
            self.b = Logistic().fit(np.concatenate(xb), np.concatenate(yb))
            if turn == rounds:
                break
            gone = np.array([k for ids in self.picked for k in ids], np.int64)
            by_a, by_b = surest(self, each, gone)
            self.picked += [by_a[0].tolist(), by_b[0].tolist()]
            xb.append(by_a[2])
            yb.append(by_a[3])
            xa.append(by_b[1])
            ya.append(by_b[3])
            if not len(by_a[0]) + len(by_b[0]):
                break
        self.cal_a = Logistic().fit(self.a.logit(a[held])[:, None], y[held], ridge=0.1)
        self.cal_b = Logistic().fit(self.b.logit(b[held])[:, None], y[held], ridge=0.1)
        self.both = Logistic().fit(self.views(a[held], b[held]), y[held], ridge=0.1)
        return self

    def presence(self, word_doc, words, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.words)), np.uint8)
        col = self.at[words]
        out[word_doc[col >= 0], col[col >= 0]] = 1
        return out

    def views(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.column_stack((self.cal_a.logit(self.a.logit(a)[:, None]), self.cal_b.logit(self.b.logit(b)[:, None])))

    def score(self, shape, layout, word_doc, words, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self.views(text_columns(shape, self.presence(word_doc, words, len(shape))), np.column_stack((layout, meta)))
        p = lambda z: 1 / (1 + np.exp(-z))
        return p(v[:, 0]), p(v[:, 1]), p(self.both.logit(v))


NEW = ["q_text", "q_meta", "q_score", "q_kept"]
_SCORES = "q_text double, q_meta double, q_score double"


_FEATURES = "doc_id long, shape binary, layout binary, meta binary, low binary, high binary"
_ROWS = "doc_id long, y int, held boolean, draw long, shape binary, layout binary, meta binary, bits binary"
_SURE = _ROWS + ", view string, label int, sure double"


def matrices(rows: pa.Table | pa.RecordBatch, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of both views of _ROWS."""
    part = lambda c, kind, width: joined_bytes(rows.column(c), kind).reshape(rows.num_rows, width)
    presence = np.unpackbits(part("bits", np.uint8, (n_words + 7) // 8), axis=1, count=n_words)
    meta = meta_columns(part("meta", np.uint8, 2).astype(np.int64))
    return text_columns(part("shape", np.float32, len(SHAPE)), presence), np.column_stack((part("layout", np.float32, len(LAYOUT)), meta))


def once(rows: pa.Table) -> pa.Table:
    """Rows by ascending doc_id, each document once."""
    return rows.take(np.unique(np.asarray(rows["doc_id"], np.int64), return_index=True)[1]).combine_chunks()


def n_chars_of(docs: DataFrame):
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("n_chars")


def features(docs: DataFrame) -> DataFrame:
    """_FEATURES of every document with an id: what both views can look at, in few bytes."""

    def extract(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            shape, word_doc, words = shape_features(batch.column(1))
            layout = size_columns(batch.column(4).to_pylist())
            n = batch.num_rows
            fixed = lambda x: binaries(x, np.full(n, x.shape[1] * x.itemsize))
            codes = meta_codes(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), fixed(shape.astype(np.float32)), fixed(layout.astype(np.float32)), fixed(codes.astype(np.uint8)), *packed_words(word_doc, words, n)],
                names=["doc_id", "shape", "layout", "meta", "low", "high"],
            )

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"), n_chars_of(docs))
    return rows.mapInArrow(lean(extract), _FEATURES)


def telling_words(rows: DataFrame, n0: int, n1: int) -> np.ndarray:
    """The words whose share of documents differs most between the classes, over all labelled rows given."""

    def count(batches):
        seen = np.zeros((2, 1 << WORD_BITS), np.int32)
        for batch in batches:
            doc, words = unpacked_words(batch.column(1), batch.column(2))
            y = np.asarray(batch.column(0))[doc]
            for k in (0, 1):
                seen[k] += np.bincount(words[y == k], minlength=1 << WORD_BITS).astype(np.int32)
        word = np.flatnonzero(seen.any(axis=0))
        for k in range(0, len(word), 10_000):
            w = word[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(seen[0, w].astype(np.int64)), pa.array(seen[1, w].astype(np.int64))], names=["word", "df0", "df1"])

    by_word = rows.select("y", "low", "high").mapInArrow(lean(count), "word int, df0 long, df1 long").groupBy("word").agg(F.sum("df0").alias("df0"), F.sum("df1").alias("df1")).filter("df0 + df1 >= 8")
    p = (F.col("df0") + F.col("df1")) / F.lit(float(n0 + n1))
    gap = F.col("df1") / F.lit(float(n1)) - F.col("df0") / F.lit(float(n0))
    best = by_word.select("word", (gap * gap / F.greatest(p * (1 - p), F.lit(1e-9))).alias("gain")).orderBy(F.desc("gain"), "word").limit(WORDS)
    return np.array([r.word for r in best.collect()], np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, seed: int = 11, rounds: int = 3, sure: float = 0.97) -> CoTrained | None:
    """Train on labels(doc_id, good boolean) of docs(doc_id, text, source, lang). Repeated labels: the least counts."""
    marked = labels.filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("y"))
    # merge: labels grow with the documents, so the plan is the same at every size
    every = features(docs).join(marked.hint("merge"), "doc_id", "left")
    held = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0
    every = materialise(every.withColumns({"held": held, "draw": F.xxhash64("doc_id", F.lit(seed))}), "features")
    sizes = {(r.y, r.held): r.n for r in every.filter("y is not null").groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 4:  # a class is missing in either part
        discard(every)
        return None
    model = CoTrained(telling_words(every.filter("y is not null and not held"), sizes[0, False], sizes[1, False]))

    def narrow(batches):
        for batch in batches:
            bits = np.packbits(model.presence(*unpacked_words(batch.column(7), batch.column(8)), batch.num_rows), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], binaries(bits, np.full(batch.num_rows, bits.shape[1]))], names=[*(x.split()[0] for x in _ROWS.split(", "))])

    fixed = ["doc_id", "y", "held", "draw", "shape", "layout", "meta"]
    rows = materialise(every.select(*fixed, "low", "high").mapInArrow(lean(narrow), _ROWS), "views")
    discard(every)
    known, n = rows.filter("y is not null"), sum(sizes.values())
    if n > 2 * max_labelled:  # draws are even: a part of their range that surely has enough, so that one task does not sort all
        known = known.filter(F.col("draw") < int(-(2**63) + 2**64 * (1.2 * max_labelled + 100) / n))
    got = once(known.orderBy("draw", "doc_id").limit(max_labelled).toArrow())
    a, b = matrices(got, len(model.words))
    pool = rows.filter("y is null")

    def surest(at: CoTrained, each: int, gone: np.ndarray):
        def score(batches):
            best: dict[str, pa.RecordBatch] = {}
            for batch in batches:
                batch = batch.filter(pa.array(~np.isin(np.asarray(batch.column(0), np.int64), gone)))
                if not batch.num_rows:
                    continue
                xa, xb = matrices(batch, len(at.words))
                for view, take, z in (("a", each, at.a.logit(xa)), ("b", 2 * each, at.b.logit(xb))):
                    mine = pa.RecordBatch.from_arrays([*batch.columns, pa.array([view] * len(z)), pa.array((z > 0).astype(np.int32)), pa.array(np.round(np.abs(z), 6))], names=[*batch.schema.names, "view", "label", "sure"])
                    mine = mine.filter(pa.array(1 / (1 + np.exp(-np.abs(z))) >= sure))
                    both = pa.Table.from_batches([x for x in (best.get(view), mine) if x is not None])
                    order = np.lexsort((np.asarray(both["doc_id"]), np.asarray(both["draw"]), -np.asarray(both["sure"])))[:take]
                    best[view] = (both.take(order).combine_chunks().to_batches() or [mine])[0]
            yield from best.values()

        found = materialise(pool.mapInArrow(lean(score), _SURE), "surest")
        top = lambda view, n: found.filter(F.col("view") == view).orderBy(F.desc("sure"), "draw", "doc_id").limit(n).toArrow()
        by_a = once(top("a", each))
        by_b = top("b", 2 * each)
        by_b = once(by_b.filter(pa.array(~np.isin(np.asarray(by_b["doc_id"], np.int64), np.asarray(by_a["doc_id"], np.int64)))).slice(0, each))
        discard(found)
        return [(np.asarray(t["doc_id"], np.int64), *matrices(t, len(at.words)), np.asarray(t["label"], np.int64)) for t in (by_a, by_b)]

    out = model.fit(a, b, np.asarray(got["y"], np.int64), np.asarray(got["held"]).astype(bool), surest, rounds)
    discard(rows)
    return out


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5, **fit_with) -> DataFrame:
    """docs(doc_id, text, source, lang, n_chars where there is one) with q_text, q_meta, q_score (probabilities of good)
    and q_kept (q_score >= keep_at).

    Null text is empty; null source, language or size is a value of its own; repeated rows and ties are judged alike. Without labels of both classes every score is
    0.5 and all are kept. All rows and columns pass through (columns named q_* as here are replaced); an empty table
    gives no rows.
    """
    docs = docs.drop(*NEW)
    model = fit(docs, labels, **fit_with)
    names = docs.columns
    size_at = names.index("n_chars") if "n_chars" in names else None
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", " + _SCORES
    text_at, source_at, lang_at = (names.index(n) for n in ("text", "source", "lang"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_at):
                if model is None:
                    scores = [np.full(batch.num_rows, 0.5)] * 3
                else:
                    text = batch.column(text_at).fill_null("")
                    shape, word_doc, words = shape_features(text)
                    layout = size_columns([None] * batch.num_rows if size_at is None else batch.column(size_at).to_pylist())
                    scores = model.score(shape, layout, word_doc, words, meta_columns(meta_codes(*([None if v is None else str(v) for v in batch.column(c).to_pylist()] for c in (source_at, lang_at)))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores)], names=[*names, "q_text", "q_meta", "q_score"])

    out = docs.mapInArrow(lean(run), schema)
    return out.withColumn("q_kept", F.col("q_score") >= keep_at)


def good_labels(labels: DataFrame) -> DataFrame:
    """Documents of quality 1 that are not toxic are good; rows with a null mark are left out."""
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def op7_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars"), good_labels(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "q_text", "q_meta", "q_score", F.col("q_kept").alias("kept"))

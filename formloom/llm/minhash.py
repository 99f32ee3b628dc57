"""Near-duplicate groups by b-bit MinHash.

1. Every document's set of word shingles (64-bit hashes) gives PERMS minima; BANDS bands of them are the candidate
   keys and the low B bits of each minimum, packed, are its signature. Documents of equal sets form a class and only
   the class's least doc_id goes on, so copies never meet each other.
2. In a band's run of equal keys, pairs whose collision-corrected similarity (equal B-bit values by bit counts) is
   above a low bar are joined; a run gives at most one edge per member.
3. The edges' components are groups that can hold links. Their full shingle sets are compared exactly, as products of
   incidence matrices; a group gives at most one edge per member, pairs are never written out.
4. The exact links' components are the result.

Runs and groups of more than BLOCK members are hot. All their members first meet their least member, wherever they lie;
who links with it is settled. Only the others then meet all members, dealt as pairs of blocks, so near copies of one text
cost one comparison each and every pair is still covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, flat_bytes, give_back, lean, materialise, mix64, release, shuffle_width, slices, table
from .graph import components

PERMS, BANDS, B = 80, 20, 4
#: A candidate pair's estimate must reach the threshold less this (5 standard deviations).
SLACK = 0.22
BLOCK = 1024
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MULT = mix64(np.arange(1, PERMS + 1, dtype=np.uint64) * _U(_BASE)) | _U(1)


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of lower-cased flat text (A-Z only; gaps are zero bytes)."""
    low = flat + ((flat >= 65) & (flat <= 90)).astype(np.uint8) * np.uint8(32)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = np.full((2, len(low) + 1), [[_BASE], [pow(_BASE, -1, 2**64)]], np.uint64)
    powers[:, 0] = 1
    power, inverse = np.cumprod(powers, axis=1, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + _U(1)) * power[:-1])))
    return start, mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their numbers."""
    rows = column.to_pylist() if not isinstance(column, pa.Array) else column
    flat, starts, lens = flat_bytes(pa.array(rows) if isinstance(rows, list) else rows, 0)
    # texts are joined by a line end, so words never cross texts
    flat = np.insert(flat, np.cumsum(lens), 10)
    starts = starts + np.arange(len(lens))
    at, h = word_hashes(flat)
    doc = np.searchsorted(starts, at, "right") - 1
    n_words = np.bincount(doc, minlength=len(lens))
    first = np.concatenate(([0], np.cumsum(n_words)))
    width = np.minimum(n_words, size)
    n = np.where(n_words > 0, n_words - width + 1, 0)
    begin = np.concatenate(([0], np.cumsum(n)))
    pos = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], n)
    w = np.repeat(width, n)
    out = np.full(len(pos), 7, np.uint64) + w.astype(np.uint64)
    for k in range(size):
        more = w > k
        out[more] = mix64(out[more] * _U(_BASE) + h[pos[more] + k])
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][n > 0]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], total[begin[1:]] - total[begin[:-1]]


def minima(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """PERMS minima (uint32) of every non-empty set."""
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))[counts > 0]
    out = np.empty((len(first), PERMS), np.uint32)
    if len(first):
        for p in range(PERMS):
            out[:, p] = np.minimum.reduceat(((sets * _MULT[p]) >> _U(32)).astype(np.uint32), first)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """The low B bits of minima, 64 // B of them in each uint64."""
    each = 64 // B
    bits = (low & np.uint32((1 << B) - 1)).astype(np.uint64).reshape(len(low), -1, each)
    return np.bitwise_or.reduce(bits << (np.arange(each, dtype=np.uint64) * _U(B)), axis=2)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures: equal values less those equal by chance."""
    d = x ^ y
    for s in (1, 2) if B == 4 else range(1, B):
        d = d | (d >> _U(s))
    ones = _U(sum(1 << (k * B) for k in range(64 // B)))
    same = 1 - np.bitwise_count(d & ones).sum(axis=-1) / PERMS
    chance = 1 / (1 << B)
    return (same - chance) / (1 - chance)


def estimate_column(x, y):
    """estimate() of two columns array<long> of packed signatures."""
    ones = sum(1 << (k * B) for k in range(64 // B))

    def unequal(p, q):
        d = p.bitwiseXOR(q)
        for k in (1, 2) if B == 4 else range(1, B):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    same = 1 - F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda a, n: a + n) / PERMS
    return (same - 1 / (1 << B)) / (1 - 1 / (1 << B))


def spread_labels(link: np.ndarray) -> np.ndarray:
    """Least index in each index's component of a boolean link matrix."""
    label = np.arange(len(link))
    link = link | np.eye(len(link), dtype=bool)
    while True:
        new = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def run_edges(keys: np.ndarray, docs: np.ndarray, sigs: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join, in each run of equal keys, the members connected by pairs of estimate >= bar."""
    order = np.lexsort((docs, keys))
    keys, docs, sigs = keys[order], docs[order], sigs[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(keys)))
    a, b = [], []
    two = first[size == 2]
    ok = estimate(sigs[two], sigs[two + 1]) >= bar
    a.append(docs[two[ok]]), b.append(docs[two[ok] + 1])
    for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        d, s = docs[f : f + n], sigs[f : f + n]
        label = spread_labels(estimate(s[:, None], s[None, :]) >= bar)
        moved = np.flatnonzero(label != np.arange(n))
        a.append(d[label[moved]]), b.append(d[moved])
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def exact_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Least index of each set's component under links of at least percent similarity, all pairs compared exactly."""
    n = np.array([len(s) for s in sets])
    if len(sets) <= 12:
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if label[i] != label[j] and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        x, y = sorted((label[i], label[j]))
                        label = [x if v == y else v for v in label]
        return np.array(label)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    ids, code, freq = np.unique(flat, return_inverse=True, return_counts=True)
    shared = freq[code] > 1
    dense = np.cumsum(freq > 1) - 1
    code, owner = dense[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    width = 4096
    for c in range(0, int((freq > 1).sum()), width):
        x, y = np.searchsorted(code, (c, c + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[x:y], code[x:y] - c] = 1
        both += (part @ part.T).astype(np.int64)  # at most `width` each, exact in single precision
    return spread_labels(100 * both >= percent * (n[:, None] + n[None, :] - both))


def dealt(marked: DataFrame, key: str) -> DataFrame:
    """Members of hot groups marked(key, members, near, ...) as pairs of blocks: each that isn't near its group's least
    member (left is true) with all members. Groups without such members are done."""
    others = marked.filter("not near").groupBy(key).agg(F.count("*").alias("others"))
    m = marked.join(others, key).withColumns({"lb": F.ceil(F.col("others") / BLOCK).cast("int"), "ab": F.ceil(F.col("members") / BLOCK).cast("int"), "h": F.xxhash64("doc_id")})
    rest = [c for c in marked.columns if c not in ("near", "members")]
    of = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = m.select(*rest, every("lb").alias("l"), of("ab").alias("a"), F.lit(False).alias("left"))
    return m.filter("not near").select(*rest, of("lb").alias("l"), every("ab").alias("a"), F.lit(True).alias("left")).unionByName(right)


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    give_back()
    return pa.table({n: np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k, n in enumerate("ab")})


def _signatures(column) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).view(np.uint64).reshape(len(column), -1)


def candidate_edges(keyed: DataFrame, bar: float, width: int) -> DataFrame:
    """(a, b) such that all documents whose signatures reach the bar under an equal key are connected."""

    def meet(t: pa.Table) -> pa.Table:
        return _edges([run_edges(np.asarray(t["key"]), np.asarray(t["doc_id"]), _signatures(t["sig"]), bar)])

    def meet_blocks(t: pa.Table) -> pa.Table:
        doc, sig, left = np.asarray(t["doc_id"]), _signatures(t["sig"]), np.asarray(t["left"]).astype(bool)
        link = np.zeros((len(doc), len(doc)), bool)
        link[np.ix_(left, ~left)] = estimate(sig[left][:, None], sig[~left][None, :]) >= bar
        label = spread_labels(link | link.T)
        moved = np.flatnonzero(label != np.arange(len(doc)))
        return _edges([(doc[label[moved]], doc[moved])])

    hot = materialise(keyed.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK), "hot-keys")
    cold = keyed.join(hot, "key", "left_anti").withColumn("bucket", F.pmod("key", F.lit(2 * width)))
    edges = cold.groupBy("bucket").applyInArrow(meet, "a long, b long")
    if hot.isEmpty():
        return edges
    warm = keyed.join(hot, "key")
    least = warm.groupBy("key").agg(F.min(F.struct("doc_id", "sig")).alias("p"))
    marked = materialise(warm.join(least, "key").select("key", "members", "doc_id", "sig", F.col("p.doc_id").alias("first"), (estimate_column("sig", F.col("p.sig")) >= bar).alias("near")), "hot-runs")
    rest = dealt(marked.drop("first"), "key").groupBy("key", "l", "a").applyInArrow(meet_blocks, "a long, b long")
    return edges.unionByName(marked.filter("near and doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))).unionByName(rest)


def exact_edges(members: DataFrame, percent: int, size: int, width: int) -> DataFrame:
    """(a, b) such that all texts of members(doc_id, label, members, text) that link within a label are connected."""

    def full_sets(batches):
        for whole in batches:
            for part in slices(whole, 3):
                sets, counts = shingle_sets(part.column(3), size)
                ends = np.cumsum(counts)
                held = [sets[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(held, pa.binary())], names=["doc_id", "label", "members", "shingles"])

    def confirm(t: pa.Table) -> pa.Table:
        """Rows of whole groups; of a hot group one pair of blocks (a document can be in both). A document of several
        texts is there with each of them."""
        label, doc = np.asarray(t["label"]), np.asarray(t["doc_id"])
        order = np.lexsort((doc, label))
        repeated = np.zeros(len(order), bool)
        repeated[1:] = (label[order][1:] == label[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        if repeated.any():
            near = repeated | np.append(repeated[1:], False)
            seen, keep = set(), []
            for k, again in zip(order.tolist(), near.tolist()):
                own = (label[k], doc[k], t["shingles"][k].as_py()) if again else None
                if own is None or own not in seen:
                    keep.append(k)
                    seen.add(own)
            order = np.array(keep)
        first = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))
        found = []
        for x, y in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
            mine = order[x:y]
            got = exact_labels([np.frombuffer(t["shingles"][k].as_py(), np.uint64) for k in mine.tolist()], percent)
            moved = np.flatnonzero(got != np.arange(len(got)))
            found.append((doc[mine[got[moved]]], doc[mine[moved]]))
        return _edges(found)

    def against_first(batches):
        for batch in batches:
            near = []
            for own, first in zip(batch.column(3), batch.column(5)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (own, first))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near, pa.bool_())], names=[*batch.schema.names[:5], "near"])

    shingled = members.select("doc_id", "label", "members", "text").mapInArrow(lean(full_sets), "doc_id long, label long, members long, shingles binary")
    few = shingled.filter(F.col("members") <= BLOCK).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(2 * width)))
    edges = few.select("bucket", "doc_id", "label", "shingles").groupBy("bucket").applyInArrow(confirm, "a long, b long")
    hot = shingled.filter(F.col("members") > BLOCK)
    if members.filter(F.col("members") > BLOCK).select("label").isEmpty():
        return edges
    hot = materialise(hot, "hot-groups")
    # a component's label is its least document
    least = hot.filter("doc_id = label").groupBy("label").agg(F.min("shingles").alias("first_shingles"))
    row = "doc_id long, label long, members long, shingles binary, first long"
    marked = hot.join(least, "label").select("doc_id", "label", "members", "shingles", F.col("label").alias("first"), "first_shingles").mapInArrow(lean(against_first), row + ", near boolean")
    marked = materialise(marked, "hot-marked")
    rest = dealt(marked.drop("first"), "label").drop("left").groupBy("label", "l", "a").applyInArrow(confirm, "a long, b long")
    return edges.unionByName(marked.filter("near and doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))).unionByName(rest)


def groups(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, mh_key (of the text), n_shingles, component_id, kept.

    Texts link when their shingle sets share at least percent of 100 of their union; a text of fewer words is one
    shingle, one without words (or null) links with nothing. component_id is the smallest doc_id reachable; a null
    doc_id links with nothing and is kept. Rows of one doc_id count as one document that links by each of its texts; its
    rows without words alone stay for themselves.
    """
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").alias("n"))

    def sign(batches):
        for batch in batches:
            at, total = 0, np.cumsum(np.asarray(batch.column(2).fill_null(0), np.int64))
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 3_000_000)))
                part = batch.slice(at, end - at)
                at = end
                sets, counts = shingle_sets(part.column(1), size)
                low = minima(sets, counts)
                keys = low.reshape(len(low), BANDS, -1).astype(np.uint64)
                mixed = np.tile(np.arange(BANDS, dtype=np.uint64), (len(low), 1))
                for k in range(keys.shape[2]):
                    mixed = mix64(mixed * _U(_BASE) + keys[:, :, k])
                full = counts > 0
                first = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
                sums = [np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)]
                if len(first):
                    sums[0][full] = np.add.reduceat(mix64(sets), first)
                    sums[1][full] = np.add.reduceat(mix64(sets ^ _U(_BASE)), first)
                lists = lambda x: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(full * x.shape[1]))).astype(np.int32), pa.array(x.view(np.int64).ravel()))  # noqa: E731  empty for a text without words
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists(mixed), lists(pack(low))],
                    names=["doc_id", "n", "k1", "k2", "bands", "sig"],
                )

    signed = materialise(rows.mapInArrow(lean(sign), "doc_id long, n long, k1 long, k2 long, bands array<long>, sig array<long>"), "signatures")
    classes = materialise(signed.filter("doc_id is not null and n > 0").groupBy("n", "k1", "k2").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r")).select("n", "k1", "k2", "r.*"), "classes")

    keyed = classes.select(F.explode("bands").alias("key"), "doc_id", "sig")
    maybe = materialise(components(candidate_edges(keyed, percent / 100 - SLACK, width)), "maybe")
    sizes = maybe.groupBy("label").agg(F.count("*").alias("members"))
    asked = materialise(maybe.join(sizes, "label").select(F.col("node").alias("doc_id"), "label", "members"), "asked")
    members = rows.filter("doc_id is not null").join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "label", "members", "text")
    # a document of several texts joins the classes of all of them
    reps = classes.select("n", "k1", "k2", F.col("doc_id").alias("rep"))
    several = signed.filter("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(F.struct("n", "k1", "k2")).alias("x"), F.max(F.struct("n", "k1", "k2")).alias("y")).filter("x <> y").select("doc_id")
    own = signed.filter("n > 0").join(several, "doc_id").join(reps, ["n", "k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    links = materialise(exact_edges(members, percent, size, width).unionByName(own), "links")
    release(docs.sparkSession)
    found = components(links)
    discard(maybe)
    discard(asked)
    ids = signed.select("doc_id", "n", "k1", "k2").join(reps, ["n", "k1", "k2"], "left").join(found.select(F.col("node").alias("rep"), "label"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("label", "rep", "doc_id"))
    return ids.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)

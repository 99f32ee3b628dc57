"""Removing repeated passages with longest-previous-factor arrays over suffix order.

A byte goes when a string of min_bytes bytes that covers it also starts in a document with a smaller doc_id. A
suffix array of all texts does not fit one machine, so the texts are cut into places first, losing no match:

1. Anchors only route: in every min_bytes window the k-gram of the least hash is an anchor, so equal windows share an
   anchor at the same place. An anchor's segment is every window that can hold it: the bytes up to min_bytes - k to
   its sides. Anchors that one document alone has can't match and are dropped.
2. Copies are thinned: among segments of equal hash only the least doc_id's goes into suffix order; the others claim its
   bytes as their earlier match. Within a task the claim is settled by comparing the bytes; beyond, neighbouring claims
   on one source are joined, the source's bytes are sent to the claimant, and what differs is not removed.
3. The remaining segments of anchors with several contents are fetched and suffix-sorted, bucket by bucket. Previous and
   next smaller doc_ids in suffix order, found by pointer jumping, with the common prefix up to them, give each position's
   longest previous factor; a window goes where that reaches min_bytes.
4. All spans of a document meet its text and are cut out.

Buckets are four times spark.sql.shuffle.partitions, fewer where BUCKET_BYTES of text don't fill one (a bucket sends a row to
each other one, so more would only be more rows); the largest holds the texts or segments of one group at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, flat_bytes, give_back, lean, materialise, mix64, ranges, release, shuffle_width, table

K = 20  #: bytes of an anchor's k-gram
CHUNK_BYTES, FLUSH_ANCHORS, BUCKET_BYTES = 2_000_000, 800_000, 1_000_000
#: Packed rows of a document bucket. lpf_kind 0: spans to cut (doc, th, x, y). 1: segments to fetch (doc, th, x the
#: anchor's place, y the anchor). 2: claims on a source (doc, th, x of the source, y of the claimant, c and d its doc and
#: th; db is the source's). 3: claimed spans with the source's bytes in c.
_FOUND = "lpf_db int, lpf_kind int, lpf_doc binary, lpf_th binary, lpf_x binary, lpf_y binary, lpf_c binary, lpf_d binary"
_U = np.uint64


def planes(x: np.ndarray) -> bytes:
    """An integer array with its bytes regrouped by significance, which compresses well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(column: pa.ChunkedArray | list, kind: str) -> np.ndarray:
    """The integers of all cells of a column (or list) of planes(), in order."""
    size = np.dtype(kind).itemsize
    parts = [np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(kind).ravel() for b in (column if isinstance(column, list) else column.to_pylist()) if b]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over every run of width entries."""
    out, have = x, 1
    while 2 * have <= width:
        out, have = op(out[:-have], out[have:]), 2 * have
    return op(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def words_at(flat: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as uint64."""
    return np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))


def anchors(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, position in it and hash of every anchor; flat has min_bytes zero bytes around each text."""
    u = words_at(flat)
    n = len(flat) - K + 1
    h = u[:n] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h += u[8 : n + 8] * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(31)
    h += u[12 : n + 12] * _U(0x165667B19E3779F9)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    width = min_bytes - K + 1
    low = sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate((pad, low, pad)), width, np.maximum) == h)
    doc = np.searchsorted(starts, at, "right") - 1
    pos = at - starts[np.maximum(doc, 0)]
    inside = (doc >= 0) & (pos + K <= lens[np.maximum(doc, 0)])
    return doc[inside], pos[inside], h[at[inside]]


def segment_hashes(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, doc: np.ndarray, pos: np.ndarray, min_bytes: int) -> np.ndarray:
    """A 64-bit hash of each anchor's segment and of how the text's ends clip it."""
    u, side = words_at(flat), min_bytes - K
    left = np.maximum(0, side - pos)
    right = np.maximum(0, pos + min_bytes - lens[doc])
    out = mix64((left * 1000 + right).astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    at, size = starts[doc] + pos - side, min_bytes + side
    for k in [*range(0, size - 7, 8), size - 8]:
        out = mix64(out * _U(0x9E3779B97F4A7C15) + u[at + k])
    return out


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of sorted key columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def settle(a: np.ndarray, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by (anchor, segment hash, doc); whether each sorted row's segment occurs in a smaller doc; and the
    sorted place of that segment's first row, its source."""
    order = np.lexsort((doc, s, a))
    first = runs(a[order], s[order])
    source = np.repeat(first, np.diff(np.append(first, len(order))))
    return order, doc[order] > doc[order][source], source


def same_bytes(flat: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Whether the size (8 or more) bytes at each x equal those at y."""
    u = words_at(flat)
    out = np.ones(len(x), bool)
    for k in [*range(0, size - 7, 8), size - 8]:
        out &= u[x + k] == u[y + k]
    return out


def suffix_ranks(text: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, .. bytes up to depth at least (zeros after the end), by doubling."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key, h, out = words_at(padded)[: len(text)].byteswap(), 8, {}
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(len(text), np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        new[:1] = 0
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(new)
        out[h] = rank
        if h >= depth:
            return out
        after = np.concatenate((rank[h:] + 1, np.zeros(min(h, len(text)), np.int64)))[: len(text)]
        key, h = (rank.astype(np.uint64) << _U(32)) | after.astype(np.uint64), 2 * h


def factor_lengths(owner: np.ndarray, lcp: np.ndarray, enough: int) -> np.ndarray:
    """Longest previous factor of each entry of a suffix order, where it reaches `enough`, else 0.

    owner: of each entry; lcp: the prefix it shares with the entry before it (0 for the first). The nearest entry with a
    smaller owner is found to either side by pointer jumping: entries passed on the way have no smaller owner, so the
    pointer of an entry that doesn't serve can be taken over, with the least common prefix on the way."""
    n = len(owner)
    out = np.zeros(n, np.int64)
    for turn in (1, -1):
        who, shared = owner[::turn], lcp if turn == 1 else np.append(lcp[1:], 0)[::-1]
        near, reach = np.arange(n) - 1, shared.copy()
        todo = np.flatnonzero(reach >= enough)
        found = np.zeros(n, np.int64)
        while len(todo):
            smaller = who[near[todo]] < who[todo]
            found[todo[smaller]] = reach[todo[smaller]]
            todo = todo[~smaller]
            via = near[todo]
            near[todo], reach[todo] = near[via], np.minimum(reach[todo], reach[via])
            todo = todo[reach[todo] >= enough]
        out = np.maximum(out, found[::turn])
    return out


def repeated_windows(text: np.ndarray, owner: np.ndarray, left: np.ndarray, min_bytes: int) -> np.ndarray:
    """Positions whose longest previous factor, by owner, reaches min_bytes.

    owner: of each position; left: bytes left in its segment. Suffixes are ordered by their first min_bytes bytes, as
    what lies beyond can't change which windows go; common prefixes are told to the ranks' steps (0, full, min_bytes).
    """
    full = 8
    while 2 * full <= min_bytes:
        full *= 2
    rank = suffix_ranks(text, full)[full]
    at = np.flatnonzero(left >= min_bytes)
    key = (rank[at].astype(np.uint64) << _U(32)) | rank[at + min_bytes - full].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = np.where(key[1:] == key[:-1], min_bytes, np.where(key[1:] >> _U(32) == key[:-1] >> _U(32), full, 0))
    return np.sort(at[factor_lengths(owner[at], lcp, min_bytes) >= min_bytes])


def _spread(db: np.ndarray, columns: list[np.ndarray], kind: int) -> list[tuple]:
    """Packed rows, one per bucket db."""
    order = np.argsort(db, kind="stable")
    first = runs(db[order])
    out = []
    for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
        mine = order[a:b]
        cells = [planes(c[mine]) for c in columns]
        out.append((int(db[mine[0]]), kind, *cells, *[None] * (6 - len(cells))))
    return out


def _found(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))})


def find_repeats(docs: DataFrame, buckets: int, min_bytes: int) -> DataFrame:
    """Packed spans of repeated bytes of docs(doc_id, lpf_th, text, lpf_db), by document bucket."""
    side = min_bytes - K
    bucket_of = lambda doc, th: ((doc % buckets) + th.astype(np.int64)) % buckets  # noqa: E731  as in remove_repeats()
    begin_of = lambda pos: np.maximum(0, pos.astype(np.int64) - side)

    def mark(batches):
        held: list[list[np.ndarray]] = []
        texts: list[np.ndarray] = []
        count = size_held = 0

        def flush():
            nonlocal held, texts, count, size_held
            a, s, doc, th, pos, at = (np.concatenate(x) for x in zip(*held))
            flat = np.concatenate(texts)
            held, texts, count, size_held = [], [], 0, 0
            order, repeat, source = settle(a, s, doc)
            a, s, doc, th, pos, at = (x[order] for x in (a, s, doc, th, pos, at))
            repeat[repeat] = same_bytes(flat, at[repeat] - side, at[source[repeat]] - side, min_bytes + side)
            done = _spread(bucket_of(doc[repeat], th[repeat]), [doc[repeat], th[repeat], begin_of(pos[repeat]).astype(np.uint32), pos[repeat] + np.uint32(min_bytes)], 0)
            rows = [(r[0], *r[2:4], None, *r[4:6], True) for r in done]
            a, s, doc, th, pos = (x[~repeat] for x in (a, s, doc, th, pos))
            home = (a % _U(buckets)).astype(np.int64)
            by = np.argsort(home, kind="stable")
            first = runs(home[by])
            for x, y in zip(first.tolist(), np.append(first[1:], len(by)).tolist()):
                m = by[x:y]
                rows.append((int(home[m[0]]), planes(doc[m]), planes(th[m]), planes(s[m]), planes(pos[m]), planes((a[m] // _U(buckets)).astype(np.uint32)), False))
            kinds = (pa.int32(), *[pa.binary()] * 5, pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["bucket", "doc", "th", "seg", "x", "y", "settled"])

        for batch in batches:
            size = np.cumsum(np.asarray(batch.column(3)))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES)))
                part = batch.slice(at, end - at)
                at = end
                flat, starts, lens = flat_bytes(part.column(2), min_bytes + 8)
                d, pos, h = anchors(flat, starts, lens, min_bytes)
                s = segment_hashes(flat, starts, lens, d, pos, min_bytes)
                ids, ths = np.asarray(part.column(0), np.int64), np.asarray(part.column(1)).astype(np.uint32)
                held.append([h, s, ids[d], ths[d], pos.astype(np.uint32), starts[d] + pos + size_held])
                texts.append(flat)
                size_held += len(flat)
                count += len(d)
                if count >= FLUSH_ANCHORS:
                    yield flush()
        if count:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        rows = [(int(b), 0, *c, None, None) for b, *c in zip(*(t.filter(t["settled"])[n].to_pylist() for n in ("bucket", "doc", "th", "x", "y")))]
        t = t.filter(pa.compute.invert(t["settled"]))
        doc, th, s, pos, a = (unplanes(t[n], k) for n, k in (("doc", "<i8"), ("th", "<u4"), ("seg", "<u8"), ("x", "<u4"), ("y", "<u4")))
        if len(doc):
            order, repeat, source = settle(a, s, doc)
            a, doc, th, pos = a[order], doc[order], th[order], pos[order]
            lead, mine = source[repeat], np.flatnonzero(repeat)
            rows += _spread(bucket_of(doc[lead], th[lead]), [doc[lead], th[lead], pos[lead], pos[mine], doc[mine], th[mine]], 2)
            first = runs(a)
            width = np.diff(np.append(first, len(a)))
            several = np.maximum.reduceat(source, first) > np.minimum.reduceat(source, first)
            several &= np.maximum.reduceat(doc, first) > np.minimum.reduceat(doc, first)
            open_ = np.repeat(several, width) & ~repeat
            rows += _spread(bucket_of(doc[open_], th[open_]), [doc[open_], th[open_], pos[open_], a[open_]], 1)
        give_back()
        return _found(rows)

    def documents(d: pa.Table):
        """Flat bytes of a bucket's texts, starts, lengths, and the index of each (doc, th) asked for."""
        flat, starts, lens = flat_bytes(d["text"].combine_chunks(), min_bytes)
        place = {x: k for k, x in enumerate(zip(d["doc_id"].to_pylist(), d["lpf_th"].to_pylist()))}

        def index(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
            order = np.lexsort((th, doc))
            first = runs(doc[order], th[order])
            k = np.empty(len(doc), np.int64)
            for x, y in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
                k[order[x:y]] = place[int(doc[order[x]]), int(th[order[x]])]
            return k

        return flat, starts, lens, index

    def claims(f: pa.Table, flat, starts, lens, index) -> list[tuple]:
        """The source's bytes of all claims, joined where they follow each other on one source and claimant."""
        doc, th, pos, y, c, d = (unplanes(f[n], k) for n, k in (("lpf_doc", "<i8"), ("lpf_th", "<u4"), ("lpf_x", "<u4"), ("lpf_y", "<u4"), ("lpf_c", "<i8"), ("lpf_d", "<u4")))
        k = index(doc, th)
        begin, to = begin_of(pos), begin_of(y)
        end = np.minimum(lens[k], pos.astype(np.int64) + min_bytes)
        order = np.lexsort((begin, to - begin, k, d, c))
        k, begin, to, end, c, d = (v[order] for v in (k, begin, to, end, c, d))
        lead = runs(c, d, k, to - begin)
        of = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(k))))
        far = int(end.max()) + 1
        last = np.maximum.accumulate(end + of * far) - of * far  # the farthest end so far, run by run
        new = np.ones(len(k), bool)
        new[1:] = (of[1:] != of[:-1]) | (begin[1:] > last[:-1])
        first = np.flatnonzero(new)
        tail = np.append(first[1:], len(k)) - 1
        size = last[tail] - begin[first]
        k, begin, to, c, d = (v[first] for v in (k, begin, to, c, d))
        db, out = bucket_of(c, d), []
        by = np.argsort(db, kind="stable")
        at = runs(db[by])
        for x, y in zip(at.tolist(), np.append(at[1:], len(by)).tolist()):
            m = by[x:y]
            out.append((int(db[m[0]]), 3, planes(c[m]), planes(d[m]), planes(to[m].astype(np.uint32)), planes((to[m] + size[m]).astype(np.uint32)), flat[ranges(starts[k[m]] + begin[m], size[m])].tobytes(), None))
        return out

    def fetch(d: pa.Table, f: pa.Table) -> pa.Table:
        out = []
        if f.num_rows and d.num_rows:
            flat, starts, lens, index = documents(d)
            kind = np.asarray(f["lpf_kind"])
            if (kind == 2).any():
                out += [(r[0], True, *r[2:7]) for r in claims(f.filter(pa.array(kind == 2)), flat, starts, lens, index)]
            f = f.filter(pa.array(kind == 1))
            doc, th, pos, a = (unplanes(f[n], k) for n, k in (("lpf_doc", "<i8"), ("lpf_th", "<u4"), ("lpf_x", "<u4"), ("lpf_y", "<u4")))
            k = index(doc, th)
            lo = begin_of(pos)
            size = np.minimum(lens[k], pos.astype(np.int64) + min_bytes) - lo
            home = a % np.uint32(3 * buckets)  # more and smaller buckets: suffix sorting needs most memory
            by = np.argsort(home, kind="stable")
            first = runs(home[by])
            for x, y in zip(first.tolist(), np.append(first[1:], len(by)).tolist()):
                m = by[x:y]
                out.append((int(home[m[0]]), False, planes(doc[m]), planes(th[m]), planes(lo[m].astype(np.uint32)), planes(size[m].astype(np.uint16)), flat[ranges(starts[k[m]] + lo[m], size[m])].tobytes()))
        names, kinds = ("bucket", "claim", "doc", "th", "lo", "size", "bytes"), (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
        give_back()
        return pa.table({n: pa.array([r[j] for r in out], t) for j, (n, t) in enumerate(zip(names, kinds))})

    def sort_suffixes(t: pa.Table) -> pa.Table:
        doc, th, lo, size = (unplanes(t[n], k) for n, k in (("doc", "<i8"), ("th", "<u4"), ("lo", "<u4"), ("size", "<u2")))
        text = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint8)
        seg = np.repeat(np.arange(len(doc)), size)
        begin = np.concatenate(([0], np.cumsum(size.astype(np.int64))))
        left = begin[seg + 1] - np.arange(len(text))
        hit = repeated_windows(text, doc[seg], left, min_bytes)
        k = seg[hit]
        start = lo[k].astype(np.int64) + hit - begin[k]
        lead = runs(k, hit - np.arange(len(hit)))  # windows that follow each other make one span
        last = np.append(lead[1:], len(hit)) - 1
        k, x, y = k[lead], start[lead].astype(np.uint32), (start[last] + min_bytes).astype(np.uint32) if len(lead) else np.zeros(0, np.uint32)
        give_back()
        return _found(_spread(bucket_of(doc[k], th[k]), [doc[k], th[k], x, y], 0))

    usable = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= min_bytes))
    marked = usable.select("doc_id", "lpf_th", "text", F.octet_length("text").alias("n")).mapInArrow(lean(mark), "bucket int, doc binary, th binary, seg binary, x binary, y binary, settled boolean")
    found = materialise(marked.groupBy("bucket").applyInArrow(meet, _FOUND), "lpf-found")
    del marked
    release(docs.sparkSession)
    cut = usable.select("doc_id", "lpf_th", "text", "lpf_db").groupBy("lpf_db").cogroup(found.filter("lpf_kind in (1, 2)").groupBy("lpf_db"))
    fetched = materialise(cut.applyInArrow(fetch, "bucket int, claim boolean, doc binary, th binary, lo binary, size binary, bytes binary"), "lpf-fetched")
    release(docs.sparkSession)
    edges = materialise(fetched.filter("not claim").groupBy("bucket").applyInArrow(sort_suffixes, _FOUND), "lpf-edges")
    release(docs.sparkSession)
    claimed = fetched.filter("claim").selectExpr("bucket lpf_db", "3 lpf_kind", "doc lpf_doc", "th lpf_th", "lo lpf_x", "size lpf_y", "bytes lpf_c", "cast(null as binary) lpf_d")
    return found.filter("lpf_kind = 0").unionByName(edges).unionByName(claimed)


def remove_repeats(docs: DataFrame, min_bytes: int = 50) -> DataFrame:
    """docs(doc_id, text, ...) with lpf_bytes, lpf_removed, lpf_spans, lpf_sha256 and the text without repeats.

    The counts and the hash are of exact bytes; the returned text also drops the remains of a character cut in two.
    Null text is empty and comes back empty. Rows with a null doc_id neither match nor lose bytes. Rows of equal
    doc_id do not match each other. min_bytes is at least K + 8 (28). Other columns pass through, whatever their names; columns named as the new ones are
    replaced.
    """
    if min_bytes < K + 8:
        raise ValueError(f"min_bytes must be at least {K + 8}")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(4 * shuffle_width(docs.sparkSession), -(-size // BUCKET_BYTES)))
    docs = docs.drop("lpf_th", "lpf_db", "lpf_bytes", "lpf_removed", "lpf_spans", "lpf_sha256")
    keyed = docs.withColumns({"lpf_th": F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")})
    keyed = keyed.withColumn("lpf_db", F.pmod(F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(buckets).cast("long")), F.lit(0)) + F.col("lpf_th"), F.lit(buckets)).cast("int"))
    spans = find_repeats(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "lpf_th", "text", "lpf_db"), buckets, min_bytes)
    names = docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lpf_bytes long, lpf_removed long, lpf_spans long, lpf_sha256 string"
    id_at, text_at = names.index("doc_id"), names.index("text")

    def cut(d: pa.Table, f: pa.Table) -> pa.Table:
        kind = np.asarray(f["lpf_kind"])
        texts_of = byte_rows(d.column(text_at))
        spans = [[unplanes(g[n], t) for n, t in (("lpf_doc", "<i8"), ("lpf_th", "<u4"), ("lpf_x", "<u4"), ("lpf_y", "<u4"))] for g in (f.filter(pa.array(kind == 0)), f.filter(pa.array(kind == 3)))]
        if len(spans[1][0]):
            row_of = {key: row for key, row in zip(zip(d.column(id_at).to_pylist(), d["lpf_th"].to_pylist()), texts_of)}
            said, at, true = b"".join(f.filter(pa.array(kind == 3))["lpf_c"].to_pylist()), 0, []
            for i, h, p, q in zip(*(v.tolist() for v in spans[1])):
                true.append(row_of[i, h][p:q] == said[at : at + q - p])  # a claim whose bytes differ (equal hashes) is void
                at += q - p
            spans[1] = [v[np.array(true, bool)] for v in spans[1]]
        doc, th, x, y = (np.concatenate(v) for v in zip(*spans))
        order = np.lexsort((x, th, doc))
        doc, th, x, y = doc[order], th[order], x[order].astype(np.int64), y[order].astype(np.int64)
        first = runs(doc, th)
        place = {(int(doc[a]), int(th[a])): (a, b) for a, b in zip(first.tolist(), np.append(first[1:], len(doc)).tolist())}
        texts, removed, counts, hashes, sizes = [], [], [], [], []
        for i, h, row in zip(d.column(id_at).to_pylist(), d["lpf_th"].to_pylist(), texts_of):
            kept, at, gone = [], 0, 0
            a, b = place.get((i, h), (0, 0))
            n_spans = 0
            if b > a:
                reach = np.maximum.accumulate(np.minimum(y[a:b], len(row)))
                new = np.flatnonzero(np.concatenate(([True], x[a + 1 : b] > reach[:-1])))
                for p, q in zip(x[a:b][new].tolist(), reach[np.append(new[1:] - 1, b - a - 1)].tolist()):
                    kept.append(row[at:p])
                    gone, at, n_spans = gone + q - p, q, n_spans + 1
            kept.append(row[at:])
            exact = b"".join(kept)
            texts.append(exact.decode() if not n_spans else b"".join(k.decode("utf-8", "ignore").encode() for k in kept).decode())
            removed.append(gone), counts.append(n_spans), sizes.append(len(row))
            hashes.append(hashlib.sha256(exact).hexdigest())
        out = d.select(names).set_column(text_at, "text", pa.array(texts, pa.string()))
        for n, v, t in (("lpf_bytes", sizes, pa.int64()), ("lpf_removed", removed, pa.int64()), ("lpf_spans", counts, pa.int64()), ("lpf_sha256", hashes, pa.string())):
            out = out.append_column(n, pa.array(v, t))
        give_back()
        return out

    return keyed.groupBy("lpf_db").cogroup(spans.groupBy("lpf_db")).applyInArrow(cut, schema)


def op10_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lpf_bytes").alias("n_bytes"), F.col("lpf_removed").alias("n_removed"), F.col("lpf_spans").alias("n_spans"), F.col("lpf_sha256").alias("kept_sha256"))

"""Corpus operators against brute force on small tables with nulls, empties, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import graph, katz, minhash, mixing, packing, reply_trees, suffix_dedup, token_files, topk_search
from formloom.llm import tokenise
from formloom.llm.tokenise import encoder

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """(doc_id, text, extra) with copies, near copies, shared passages, odd white space, nulls and empties."""
    rng = random.Random(seed)
    words = [rng.choice(["the", "of", "ar", "éon", "ung", "st", "zz"]) + rng.choice(["", "in", "er", "ü"]) + rng.choice(["", "a", "ment"]) for _ in range(90)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = text(30)
    rows = [(0, None, "x"), (1, "", "x"), (2, "  \n\t ", "y"), (3, "One", "y"), (4, "aaaa" * 60, "z"), (5, "aaaa" * 50, "z"), (6, "Tab\tand  two\n\nlines \r\n end\n\n", None)]
    for i in range(7, n):
        kind = rng.random()
        if kind < 0.15 and i > 8:
            rows.append((i, rows[rng.randrange(7, i)][1], "x"))
        elif kind < 0.4 and i > 8:
            old = (rows[rng.randrange(7, i)][1] or "a b c d e f").split(" ")
            old[rng.randrange(len(old))] = rng.choice(words)
            rows.append((i, " ".join(old), "x"))
        elif kind < 0.55:
            rows.append((i, text(rng.randrange(40)) + " " + shared + "\n" + text(rng.randrange(40)), "y"))
        else:
            rows.append((i, text(rng.randrange(1, 120)).capitalize(), "z"))
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens_equal_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    texts = [t or "" for _, t, _ in corpus()] + ["a  b", "a \n b", " a", "a ", "\n", "x\n\n\ny", "it's I'LL", "a b  c", "<|endoftext|> x", "x\n y", "x \ny", "é é"]
    rng = random.Random(8)
    texts += ["".join(rng.choice([*"ab éß'sΣς.,!# 12\n ", "<|endoftext|>", "\x01", "\u2003", "\t", " The"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.json"):
        whole = Tokenizer.from_file(P.path(name))
        whole.encode_special_tokens = True  # <|endoftext|> in a text is ordinary text
        got = encoder(P.path(name)).encode([t.encode() for t in texts])
        for t, ids in zip(texts, got):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t
        monkeypatch.setattr(tokenise, "CACHE_BYTES", 2_000)  # from now on the cache keeps shrinking


def test_unknown_tokenizer_rules_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    rules = json.load(open(P.path("byte_bpe_50k.json")))
    rules["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(rules))
    enc = encoder(str(tmp_path / "t.json"))
    whole = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert enc.rule == "other" and enc.encode([b"a bc", b"", b"x"])[0].tolist() == whole.encode("a bc").ids


def test_packing_covers_each_id_once(docs, none):
    path = P.path("word_bpe_49k.json")
    rows = packing.pack_tokens(docs, path, capacity=64, window_tokens=1500, with_ids=True).collect()
    enc = encoder(path)
    want = {d: enc.encode([(t or "").encode()])[0].tolist() + [2] for d, t, _ in corpus()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, ids in want.items():
        parts = sorted(by_doc[d], key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids) for r in parts)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == parts[0].sequence_tokens and (at == 64 or at & (at - 1) == 0)
    assert packing.pack_tokens(none, path).count() == 0


def test_packing_balances_cost():
    lengths = np.random.default_rng(0).integers(1, 3000, 400)
    pieces, sizes, costs = packing.assign(lengths, 4096)
    assert np.bincount(pieces[:, 0], weights=pieces[:, 2]).tolist() == lengths.tolist()
    full = costs[sizes == 4096]
    assert full.max() / full.min() < 3.2


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8 and int.from_bytes(packed, "big") >> (-1001 * bits % 8) == int("".join(f"{x:0{bits}b}" for x in ids.tolist()), 2)
    assert (token_files.unpack_bits(packed, 1001, bits) == ids).all()
    least = -(2**63)
    (tmp_path / "f").write_bytes(b"".join(token_files.image([least, None, 9], [ids[:500], ids[:0], ids[500:]], bits, block_ids=77)))
    path = f"file://{tmp_path}/f"
    for most in (10, 100, 4_000_000):
        with token_files.opened(path) as f:
            got = [(d, x.tolist()) for docs, lens, flat in token_files.documents_of(f, most) for d, x in zip(docs, np.split(flat, np.cumsum(lens)[:-1]))]
        assert got == [(least, ids[:500].tolist()), (None, []), (9, ids[500:].tolist())]
    assert [token_files.id_at(path, k) for k in (0, 76, 77, 1000)] == ids[[0, 76, 77, 1000]].tolist()
    with pytest.raises(IndexError):
        token_files.id_at(path, 1001)


def test_range_numbers(spark):
    for bounds in ([], [3], [3, 5, 9], list(range(0, 200, 2))):
        got = spark.range(-1, 210).select("id", token_files.range_number(F.col("id"), bounds).alias("k")).collect()
        assert all(r.k == sum(b <= r.id for b in bounds) for r in got)


def test_token_files(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    manifest = token_files.write_ids(docs.withColumns({"range_no": F.lit("x"), "path": F.lit(1)}), path, file_ids=300)
    got = {r.doc_id: r for r in token_files.read_ids(manifest).collect()}
    at, enc = 0, encoder(path)
    for d, t, _ in sorted(corpus()):
        ids = enc.encode([(t or "").encode()])[0].tolist() + [0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    first = manifest.orderBy("range_no", "file_no").first()
    assert manifest.count() > 3 and token_files.id_at(first.path, 0) == (enc.encode([(sorted(corpus())[0][1] or "").encode()])[0].tolist() + [0])[0]
    assert token_files.read_ids(token_files.write_ids(none, path)).count() == 0
    odd = spark.createDataFrame([(None, "b"), (None, "a"), (2, None), (2, "long " * 3000), (-(2**63), "x"), (1, "")], "doc_id long, text string")
    rows = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_files.read_ids(token_files.write_ids(odd, path, file_ids=2)).collect()))
    assert [r[1] for r in rows] == [None, None, -(2**63), 1, 2, 2] and [r[0] for r in rows] == np.cumsum([0, *(r[2] for r in rows[:-1])]).tolist()


def jaccard_groups(rows, percent, size=5):
    sets = {}
    for d, t, _ in rows:
        w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(both := sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and both]
    label, moved = {d: d for d in sets}, True
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return {d: (len(s), label[d], label[d] == d) for d, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block", [2, 1024])
def test_near_duplicates(spark, docs, none, percent, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.groups(docs, percent).collect()}
    assert got == jaccard_groups(corpus(), percent)
    if block == 2:
        assert minhash.groups(none).count() == 0
        odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
        assert sorted(map(str, (tuple(r) for r in minhash.groups(odd).collect()))) == sorted(map(str, [(None, 1, None, True)] * 2 + [(3, 1, 3, True)] * 2))


def near_copies(rng, n, base=200, changed=12):
    """n texts that differ from one text in up to `changed` words, so that many pairs are near the threshold."""
    words = [f"w{k}" for k in range(base)]
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(rng.randrange(changed)):
            w[rng.randrange(base)] = f"x{rng.randrange(40)}"
        out.append((i, " ".join(w), "s"))
    return out


def test_hot_groups_are_compared_whole(spark, monkeypatch):
    rows = near_copies(random.Random(7), 90) + [(200 + i, f"a b c d e f g h i j k l m n o p q r s t {i}", "s") for i in range(30)]
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.groups(spark.createDataFrame(rows, SCHEMA), 85).collect()}
    assert got == jaccard_groups(rows, 85) and len({c for _, c, _ in got.values()}) > 2


def test_recall_of_links_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.82, all of which must be found."""
    rng, rows = random.Random(9), []
    for i in range(300):
        w = [f"d{i}w{k}" for k in range(105)]
        v = list(w)
        v[rng.randrange(10, 90)] = "other"
        v[0:6] = [f"y{k}" for k in range(6)]
        rows += [(2 * i, " ".join(w), "s"), (2 * i + 1, " ".join(v), "s")]
    want = sum(k % 2 == 1 and not kept for k, (_, _, kept) in jaccard_pairs(rows, 80).items())
    got = minhash.groups(spark.createDataFrame(rows, SCHEMA), 80).filter("doc_id % 2 = 1 and not kept").count()
    assert want == 300 and got == want


def jaccard_pairs(rows, percent):
    """As jaccard_groups, for rows that can only link in pairs (2i, 2i + 1)."""
    out = {}
    for a, b in zip(rows[::2], rows[1::2]):
        got = jaccard_groups([a, b], percent)
        out |= got
    return out


def test_estimate_columns_equal_arrays(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63, (50, 2, 80 * minhash.B // 64))
    x[:25, 1] ^= x[:25, 0] ^ (x[:25, 1] & 0xFFFF)
    got = [r.e for r in spark.createDataFrame([(k, *v.tolist()) for k, v in enumerate(x)], "k long, x array<long>, y array<long>").orderBy("k").select(minhash.estimate_column("x", "y").alias("e")).collect()]
    assert got == pytest.approx(minhash.estimate(x[:, 0].view(np.uint64), x[:, 1].view(np.uint64)).tolist())


def test_exact_labels_of_very_long_sets():
    """1,837,838 or 1,837,837 shared of two times 2,000,000: on either side of a threshold that single precision can't tell."""
    a = np.arange(2_000_000, dtype=np.uint64)
    many = [np.arange(10**9 + 100 * k, 10**9 + 100 * k + 50, dtype=np.uint64) for k in range(14)]
    for shared, linked in ((1_837_838, True), (1_837_837, False)):
        b = np.concatenate((a[:shared], np.arange(3 * 10**9, 3 * 10**9 + 2_000_000 - shared, dtype=np.uint64)))
        assert (100 * shared >= 85 * (4_000_000 - shared)) == linked
        assert (minhash.exact_labels([a, b, *many], 85)[1] == 0) == linked


def test_exact_labels_agree_with_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = []
    for k in range(40):
        s = base.copy()
        s[rng.integers(0, 100, rng.integers(0, 14))] = rng.integers(0, 2**63, 1)[0] + k
        sets.append(np.unique(s))
    link = np.array([[100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for a in sets] for b in sets])
    assert (minhash.exact_labels(sets, 85) == minhash.spread_labels(link)).all()


def test_estimate_is_close():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:3000], rng.integers(0, 2**63, 600).astype(np.uint64))))
    low = minhash.minima(np.concatenate((a, b)), np.array([len(a), len(b)]))
    est = minhash.estimate(*minhash.pack(low))
    assert abs(est - 3000 / 4600) < 0.2


def removed_bytes(rows, n=50):
    least = {}
    raw = {d: (t or "").encode() for d, t, _ in rows}
    for d in sorted(raw):
        for i in range(len(raw[d]) - n + 1):
            least.setdefault(raw[d][i : i + n], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [150, 3_000_000])
def test_repeated_passages(spark, docs, none, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "FLUSH_ANCHORS", chunk // 3)  # many small flushes: copies meet across them
    got = {r.doc_id: (r.lpf_bytes, r.lpf_removed, r.lpf_spans, r.lpf_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    want = removed_bytes(corpus())
    assert got == want and sum(x[2] for x in want.values()) > 20
    if chunk == 150:
        assert suffix_dedup.remove_repeats(none).count() == 0
        long = "abcdefghij" * 9
        odd = spark.createDataFrame([(None, long, 1), (None, long, 2), (3, long, 3), (3, long, 4), (4, "é" + long, 5)], "doc_id long, text string, bucket int")
        rows = {r.bucket: r for r in suffix_dedup.remove_repeats(odd).collect()}
        assert [rows[k].lpf_removed for k in range(1, 6)] == [0, 0, 0, 0, 90] and rows[5].text == "é"


def test_claims_of_equal_hashes_are_compared_by_bytes(spark, docs, monkeypatch):
    """All segments of an anchor hash alike: what is removed must still be right, less what only the claims would find."""
    monkeypatch.setattr(suffix_dedup, "mix64", lambda x: x * np.uint64(0))
    got = {r.doc_id: r.lpf_removed for r in suffix_dedup.remove_repeats(docs.coalesce(1)).collect()}
    want = removed_bytes(corpus())
    assert all(got[d] <= want[d][1] for d in want) and sum(got.values()) > 0


def test_longest_previous_factors_equal_brute_force():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 300):
        owner, lcp = rng.integers(0, 12, n), rng.integers(0, 9, n)
        lcp[:1] = 0
        want = []
        for i in range(n):
            best, low = 0, 99
            for j in range(i - 1, -1, -1):
                low = min(low, lcp[j + 1])
                if owner[j] < owner[i]:
                    best = max(best, low)
                    break
            low = 99
            for j in range(i + 1, n):
                low = min(low, lcp[j])
                if owner[j] < owner[i]:
                    best = max(best, low)
                    break
            want.append(best if best >= 3 else 0)
        assert suffix_dedup.factor_lengths(owner, lcp, 3).tolist() == want


def test_repeated_windows_in_suffix_order():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 900).astype(np.uint8)
    owner, left = np.repeat(np.arange(9), 100), 100 - np.arange(900) % 100
    got = set(suffix_dedup.repeated_windows(text, owner, left, 12).tolist())
    least = {}
    for i in range(900):
        if left[i] >= 12:
            least.setdefault(text[i : i + 12].tobytes(), owner[i])
    assert got == {i for i in range(900) if left[i] >= 12 and least[text[i : i + 12].tobytes()] < owner[i]} and got


def katz_scores(rows, order):
    """Scores by dictionaries of tuples; every history's probabilities are held to sum to 1."""

    def toks(t):
        return [x.translate({k: k + 32 for k in range(65, 91)}) for x in WORD.findall(t or "")] + [None]

    def grams(w, k):
        padded = ["<s>"] * (k - 1) + w
        return [tuple(padded[i : i + k]) for i in range(len(w))]

    out_of = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _, _ in rows}
    counts = {k: Counter(g for d, t, _ in rows if not out_of[d] for g in grams(toks(t), k)) for k in range(1, order + 1)}
    n, v = sum(counts[1].values()), len(counts[1])
    d = {k: katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.KATZ + 2)]) for k, c in counts.items()}
    kept = lambda k, c: c * (d[k][c - 1] if c <= katz.KATZ else 1.0)
    rest = 1 - sum(kept(1, c) / n for c in counts[1].values())
    p1 = {w: kept(1, c) / n for (w,), c in counts[1].items()}
    seen, alpha = {}, {}

    def p(h, w):
        if not h:
            return p1.get(w, rest)
        return seen[h][w] if w in seen.get(h, {}) else alpha.get(h, 1.0) * p(h[1:], w)

    for k in range(2, order + 1):
        after = defaultdict(dict)
        for g, c in counts[k].items():
            after[g[:-1]][g[-1]] = c
        for h, ws in after.items():
            total = sum(ws.values())
            whole = min(ws.values()) > katz.KATZ  # nothing to discount
            mine = {w: c / (total + 1) if whole else kept(k, c) / total for w, c in ws.items()}
            alpha[h] = (1 - sum(mine.values())) / (1 - sum(p(h[1:], w) for w in ws))
            seen[h] = mine
            assert abs(p(h, "never seen") + sum(p(h, w) for w in p1) - 1) < 1e-9
    out = {}
    for i, t, _ in rows:
        w = toks(t)
        base = sum(math.log10((counts[1][(x,)] + 1) / (n + v + 1)) for x in w)
        out[i] = (out_of[i], len(w), sum((x,) in counts[1] for x in w), n, base, sum(math.log10(p(g[:-1], g[-1])) for g in grams(w, order)))
    return out


@pytest.mark.parametrize("order, split", [(2, 4), (3, 1000), (4, 0)])
def test_katz(docs, spark, order, split, monkeypatch):
    monkeypatch.setattr(katz, "SPLIT", split)  # 0: by history alone; 1000: nearly all histories by their words
    monkeypatch.setattr(katz, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(katz, "CHUNK_BYTES", 1500)
    rows = [*corpus(), *((i, "so it ends " * 9, "x") for i in range(100, 112))]
    want = katz_scores(rows, order)
    data = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in rows[-12:]], "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in katz.score(data, order=order).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert got[d][4:] == pytest.approx(want[d][4:], abs=1e-6), d


def test_katz_odd_tables(none, spark):
    assert katz.score(none).count() == 0
    only_out = spark.createDataFrame([(d, "a b") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r.score == 0 and r.n_known == 0 for r in katz.score(only_out).collect())
    odd = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in katz.score(odd).collect())
    assert got == [(0, 3, 10), (7, 3, 10), (7, 3, 10), (8, 1, 10)]


@pytest.mark.parametrize("k", [1, 5, 300])
def test_topk(spark, k, monkeypatch):
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 64)
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(0, 0.1, 8).round(1).tolist()) for i in range(200)] + [(200, None), (201, [float("nan")] * 8), (202, [None] * 8), (203, [float("inf")] * 8), (None, [1.0] * 8)]
    v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in topk_search.search(v.filter(F.col("vec_id") % 50 == 0), v, k).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = np.floor(256 * np.array([np.float32(r[1]) for r in rows[:200]]).astype(np.float64)).astype(np.int64)
    for q in (0, 50, 100, 150):
        s = x @ x[q]
        best = sorted((i for i in range(200) if i != q), key=lambda i: (-s[i], i))[:k]
        assert got[q] == [(n + 1, i, s[i]) for n, i in enumerate(best)]
    assert topk_search.search(v.limit(0), v.limit(0), k).count() == 0


def test_topk_reads_less_of_skewed_lists():
    rng = np.random.default_rng(2)
    rows = (rng.pareto(1.5, (2000, 24)) * 20).astype(np.int64)
    queries, ids = rows[:40], np.arange(2000)
    got = topk_search.nra(queries, ids[:40], rows, ids, 5)
    for k, (mine, score, depth) in enumerate(got):
        s = rows @ queries[k]
        best = sorted((i for i in range(2000) if i != k), key=lambda i: (-s[i], i))[:5]
        assert mine.tolist() == best and score.tolist() == s[best].tolist()
    assert np.mean([x[2] for x in got]) < 1000  # of 2,000 entries a list
    huge = np.minimum(rows, 2000) * 2**14  # sums beyond 2**53
    for k, (mine, score, _) in enumerate(topk_search.nra(huge[:5], ids[:5], huge, ids, 5)):
        s = huge @ huge[k]
        best = sorted((i for i in range(2000) if i != k), key=lambda i: (-s[i], i))[:5]
        assert mine.tolist() == best and score.tolist() == s[best].tolist()


def test_topk_repeated_ids_and_uneven_lengths(spark):
    rows = [(0, [1, 2]), (0, [3]), (1, [1, 1, 9]), (1, [1, 1, 9]), (2, [0, 0]), (3, [])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk_search.search(v.filter("vec_id = 0"), v, 9).orderBy("rank").collect()]
    assert got == [(1, 1, 3), (2, 1, 3), (3, 2, 0), (4, 3, 0)]  # the least vector of id 0 asks, repeated rows are listed


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a#<", 1.0), (1, 3, 1, "assistant", "b", 1.0), (1, 4, 3, "user", "t", 5.0), (1, 5, 4, None, None, None),
            (2, 1, 9, "sys:x", "\\### Assistant: </turn>\n", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0)]
    trees = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = reply_trees.conversations_of(trees, per_tree=2).select("tree", "leaf", "path_score", reply_trees.parse(F.col("formatted")).alias("turns"), "formatted", "loss_mask").orderBy("tree", F.desc("path_score")).collect()
    assert [(r.tree, r.leaf, r.path_score) for r in got] == [(1, 5, 6.0), (1, 2, 1.0), (2, 1, 0.0)]
    assert [tuple(t) for t in got[0].turns] == [("user", "q"), ("assistant", "b"), ("user", "t"), ("", "")]
    assert [tuple(t) for t in got[2].turns] == [("sys:x", "\\### Assistant: </turn>\n")]
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_mask] == ["a\\h\\l"]
    assert reply_trees.conversations_of(trees.limit(0)).count() == 0
    # a null tree is a tree; repeated nodes count once; columns may be named as the operator's own
    odd = [(None, 1, None, "user", "x", 1.0), (None, 2, 1, "assistant", "y", 1.0), (5, 1, None, "user", "p", 1.0), (5, 1, None, "user", "p", 1.0), (5, 2, 1, "assistant", "b", 2.0), (5, 2, 1, "assistant", "a", 9.0)]
    odd = spark.createDataFrame(odd, trees.schema).withColumns({c: F.lit(0) for c in ("t", "n", "top", "leaf", "pos", "r", "path_score")})
    got = reply_trees.conversations_of(odd).orderBy("tree").collect()
    assert [(r.tree, r.leaf, r.path_score, r.formatted) for r in got] == [(None, 2, 2.0, "### user: x</turn>\n### assistant: y</turn>\n"), (5, 2, 10.0, "### user: p</turn>\n### assistant: a</turn>\n")]


def test_random_reply_trees(spark):
    rng, rows = random.Random(3), []
    for tree in range(6):
        rows += [(tree, n, rng.choice([None, *range(max(0, n - 4), n)]) if n else None, rng.choice(["user", "assistant"]), f"{tree}.{n}", float(rng.randrange(5))) for n in range(rng.choice([1, 2, 9, 70]))]
    up = {(t, n): (p, s) for t, n, p, _, _, s in rows}
    want = []
    for tree in range(6):
        inner = {p for (t, _), (p, _) in up.items() if t == tree}
        paths = []
        for (t, n), _ in up.items():
            if t == tree and n not in inner:
                path, at = [], n
                while at is not None:
                    path.append(at)
                    at = up[t, at][0]
                paths.append((-sum(up[t, x][1] for x in path), n, [f"{t}.{x}" for x in reversed(path)]))
        want += [(tree, n, -s, texts) for s, n, texts in sorted(paths)[:3]]
    got = reply_trees.conversations_of(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), per_tree=3)
    got = got.select("tree", "leaf", "path_score", F.transform(reply_trees.parse(F.col("formatted")), lambda t: t["text"]).alias("texts")).collect()
    assert sorted((r.tree, r.leaf, r.path_score, r.texts) for r in got) == sorted(want)


def test_fill_and_route():
    t = mixing.fill([1, 2, 3], [600, 300, 10], 3)
    assert sum(t) == 910 and t[2] == 30 and t[1] == 2 * t[0]
    flows = mixing.route([((0,), 100), ((0, 1), 50), ((1,), 10)], [100, 60], 3)
    assert flows == [{0: 100}, {1: 50}, {1: 10}]
    assert sum(sum(f.values()) for f in mixing.route([((0,), 10)], [100], 3)) == 30


def flows_by_trial(patterns, quotas, most):
    """(largest flow, its least cost) over all integer flows."""
    edges = [(k, s) for k, (sources, _) in enumerate(patterns) for s in sources]
    best = (0, 0)

    def go(i, given, got):
        nonlocal best
        if i == len(edges):
            cost = sum(n * min(size, max(0, given[k] - (n - 1) * size)) for k, (_, size) in enumerate(patterns) for n in range(1, most + 1))
            best = max(best, (sum(given), -cost))
            return
        k, s = edges[i]
        for f in range(min(most * patterns[k][1] - given[k], quotas[s] - got[s]) + 1):
            given[k] += f
            got[s] += f
            go(i + 1, given, got)
            given[k] -= f
            got[s] -= f

    go(0, [0] * len(patterns), [0] * len(quotas))
    return best[0], -best[1]


def test_route_equals_all_flows_tried():
    rng = random.Random(6)
    for _ in range(120):
        n_s = rng.randrange(1, 4)
        patterns = [(tuple(sorted(rng.sample(range(n_s), rng.randrange(1, n_s + 1)))), rng.randrange(0, 3)) for _ in range(rng.randrange(1, 4))]
        quotas, most = [rng.randrange(0, 6) for _ in range(n_s)], rng.randrange(1, 4)
        flows = mixing.route(patterns, quotas, most)
        assert all(set(f) <= set(p[0]) and sum(f.values()) <= most * p[1] for f, p in zip(flows, patterns))
        assert all(sum(f.get(s, 0) for f in flows) <= q for s, q in enumerate(quotas))
        cost = sum(n * min(size, max(0, sum(f.values()) - (n - 1) * size)) for f, (_, size) in zip(flows, patterns) for n in range(1, most + 1))
        assert (sum(sum(f.values()) for f in flows), cost) == flows_by_trial(patterns, quotas, most), (patterns, quotas, most)
    many = [(tuple(sorted(rng.sample(range(40), rng.randrange(1, 5)))), rng.randrange(1, 1000)) for _ in range(20_000)]
    quotas = [sum(n for _, n in many) // 40] * 40
    assert sum(sum(f.values()) for f in mixing.route(many, quotas, 3)) == sum(quotas)


def fair_targets(sizes, weights, most):
    """Targets found by stepping a common level up until all tokens are dealt: independent of fill()."""
    low, high, total = 0.0, 1e12, sum(sizes)
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(level * w, most * n) for n, w in zip(sizes, weights)) < total:
            low = level
        else:
            high = level
    return [min(high * w, most * n) for n, w in zip(sizes, weights)]


def test_mixing(spark, docs, none):
    size = mixing.word_count(F.col("text"))
    run = lambda d: {r.doc_id: r for r in mixing.mix(d, F.array("source"), size, F.col("doc_id")).collect()}
    got = run(docs)
    assert got == run(docs.repartition(5)) and len(got) == len(corpus())
    by = defaultdict(list)
    for d, t, s in corpus():
        assert got[d].mix_size == len(WORD.findall(t or "")) and got[d].mix_taken <= 3 * got[d].mix_size
        by[s].append(got[d])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = fair_targets([sum(r.mix_size for r in by[s]) for s in names], [k % 3 + 1 for k in range(len(names))], 3)
    for s, t in zip(names, want):
        assert len({r.mix_target for r in by[s]}) == 1 and by[s][0].mix_target == pytest.approx(t, rel=1e-9)
        assert abs(sum(r.mix_taken for r in by[s]) - t) <= max(r.mix_size for r in by[s]) + 1
    assert run(none) == {}
    clash = docs.withColumns({c: F.lit(-5) for c in ("mix_rest", "mix_cut", "mix_target", "mix_key", "mix_at", "m", "row", "n")})
    assert {d: r.mix_taken for d, r in run(clash).items()} == {d: r.mix_taken for d, r in got.items()}
    odd = spark.createDataFrame([(None, "a b", None), (1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s")], SCHEMA)
    assert sorted((r.mix_size, r.mix_taken % max(1, r.mix_size)) for r in mixing.mix(odd, F.array("source"), size, F.col("doc_id")).collect()) == [(0, 0), (2, 0), (3, 0), (3, 0)]


def test_mixing_of_overlapping_sources(spark):
    """Equal texts of two sources are claimed by both: the flow gives them to the source that is short."""
    rows = [(i, ["a"], 10) for i in range(60)] + [(100 + i, ["b"], 10) for i in range(10)] + [(200 + i, ["a", "b"], 10) for i in range(30)] + [(300, [], 10), (301, None, 10)]
    d = spark.createDataFrame(rows, "doc_id long, claims array<string>, n long")
    got = mixing.mix(d, F.col("claims"), F.col("n"), F.col("doc_id"), weight_of=lambda k: 1).collect()
    taken = lambda lo, hi: sum(r.mix_taken for r in got if lo <= r.doc_id < hi)
    # 1,000 tokens, half each: a has 600 of its own and needs 500; b takes its own, all shared ones and 100 tokens again
    assert (taken(0, 100), taken(100, 300), taken(300, 400)) == (500, 500, 0)
    assert max(r.mix_taken for r in got) == 20 and taken(100, 200) >= 100 and taken(200, 300) >= 300


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


@pytest.mark.parametrize("block", [1024, 2])
def test_minhash_links_by_every_text_of_a_document(spark, monkeypatch, block):
    """A doc_id with rows of different texts links by each of them, in any order of rows."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    words = [f"w{k}" for k in range(120)]
    a, b, c = " ".join(words[:40]), " ".join(words[40:80]), " ".join(words[80:])
    rows = [(3, a, "x"), (3, b, "x"), (5, b + " more", "x"), (7, a + " more", "x"), (9, c, "x"), (8, c, "x"), (8, b + " other", "x"), (4, c + " end", "x"), (11, "alone here", "x")]
    for given in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = {(r.doc_id, r.component_id) for r in minhash.groups(spark.createDataFrame(given, SCHEMA).coalesce(1), 80).collect()}
        assert got == {(3, 3), (5, 3), (7, 3), (9, 3), (8, 3), (4, 3), (11, 11)}


def test_topk_refuses_scores_beyond_64_bits(spark):
    """Never a wrapped score: components that could reach one are an error, those just below are ranked right."""
    frame = lambda rows: topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        topk_search.search(frame([(1, [256.0, 256.0])]), frame([(2, [1e30, 1.0]), (3, [1.0, 1.0])]), 1).collect()
    big = 2.0**21  # 2 * (2^29)^2 is 2^59
    got = topk_search.search(frame([(1, [big, big])]), frame([(2, [big, 1.0]), (3, [big, -big]), (4, [big, big])]), 3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(4, 2**59), (2, 2**58 + 2**37), (3, 0)]

"""Audit of how far the sources of a language differ in their vocabulary, by inclusion and exclusion over supports.

A group is a (lang, source). With p and q the smoothed shares of a term in two groups (integers, in thousand millionths), the
divergence of a pair is the sum of (p - q)^2 / q over all terms the language keeps. Most terms are missing from most
groups, and a missing term's share is one number per group, so the sum is never taken term by term:

* constants price the terms that neither group has,
* a histogram of counts per group prices the terms that one group has, as if the other never had them,
* a join of the postings by term corrects the terms that both have.

All arithmetic is on whole numbers: shares by decimals, values as 64-bit integers, where Spark raises an error rather
than wrap (a pair's sum is below (10^9 + V)^2).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, materialise, shuffle_width, table, translated

#: A language keeps the terms in at least so many of its documents; a group reports so many terms.
MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Keys that a task holds before it hands its counts on, and bytes of a text that are cut into terms at once.
HELD, PIECE = 400_000, 4_000_000
#: Bytes of terms stay (A-Z in lower case), all others become a space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


@lean
def _count(batches):
    """Rows (lang, source, term, n, docs) of a task's documents, combined as far as HELD keys go."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in counts.items():
            k = len(n)
            yield pa.record_batch([
                pa.array([lang], pa.string()).take(pa.array([0] * k, pa.int32())), pa.array([source], pa.string()).take(pa.array([0] * k, pa.int32())),
                pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary())))):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for part in translated(text or b"", _TERM_BYTES, PIECE):
                words = part.split()
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - before
            if held > HELD:
                yield from rows()
                held = 0
    yield from rows()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)); null where there is nothing to divide by."""
    return F.expr("1L") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), F.nullif((total + kept).cast("decimal(20,0)"), F.lit(0)))


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms each language keeps; first marks one row per (lang, term)."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # a task's rows are combined already; dealt by (lang, term) they need no other exchange
    parts = texts.mapInArrow(_count, _COUNTS).repartition(shuffle_width(docs.sparkSession), "lang", "term")
    parts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    out = parts.withColumns({"all_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "least": F.min("source").over(term)})
    return out.filter(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("first"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs(lang, source, text): how far each group is from the others of its language.

    Part `pair`: every other source of the language by divergence. Part `term`: the group's terms that are over-represented
    against the whole language, at most top_terms. Null lang, source and text count as empty; a repeated row is a document
    of its own; ties go to the smaller item by UTF-8 bytes; texts of any length are read whole; other columns are ignored; a
    group without kept terms takes part with its constant share, and a language that keeps none has pairs of value 0. An
    empty table gives no rows. Pairs are the result itself (sources squared per language); terms meet by posting.
    """
    post = materialise(postings(docs, min_docs), "postings")
    langs = post.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("kept"))
    sums = post.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    every = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "support", "lang_total", "kept"])
    groups = materialise(groups.withColumn("z", share(zero, F.col("total"), F.col("kept"))), "groups")

    priced = post.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    priced = materialise(priced.select("lang", "source", "term", "p", "z", F.when((q := share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))) < F.col("p"), q).alias("q")), "priced")

    a, b = groups.alias("a"), groups.select("lang", *[F.col(c).alias(f"o_{c}") for c in ("source", "z", "support")])
    pairs = a.join(b, "lang").filter("source <> o_source")
    neither = (F.col("kept") - F.col("support") - F.col("o_support")) * excess(F.col("z"), F.col("o_z"))
    constants = pairs.select("lang", "source", "o_source", F.coalesce(neither, zero).alias("value"))

    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    one = histogram.join(b, "lang").filter("source <> o_source")
    one = one.groupBy("lang", "source", "o_source").agg(F.sum(F.col("m") * excess(F.col("p"), F.col("o_z"))).alias("there"), F.sum(F.col("m") * excess(F.col("o_z"), F.col("p"))).alias("back"))
    here = one.select("lang", "source", "o_source", F.col("there").alias("value"))
    back = one.select("lang", F.col("o_source").alias("source"), F.col("source").alias("o_source"), F.col("back").alias("value"))

    left, right = priced.drop("q"), priced.select("lang", "term", *[F.col(c).alias(f"o_{c}") for c in ("source", "p", "z")])
    change = lambda x, u, y, v: excess(F.col(x), F.col(y)) - excess(F.col(x), F.col(v)) - excess(F.col(u), F.col(y)) + excess(F.col(u), F.col(v))
    both = left.join(right, ["lang", "term"]).filter("source < o_source").groupBy("lang", "source", "o_source")
    both = both.agg(F.sum(change("p", "z", "o_p", "o_z")).alias("there"), F.sum(change("o_p", "o_z", "p", "z")).alias("back"))
    both = both.select("lang", F.explode(F.array(F.struct("source", F.col("o_source"), F.col("there").alias("value")), F.struct(F.col("o_source").alias("source"), F.col("source").alias("o_source"), F.col("back").alias("value")))).alias("x")).select("lang", "x.*")

    summed = constants.unionByName(here).unionByName(back).unionByName(both).groupBy("lang", "source", F.col("o_source").alias("item"))
    pair = summed.agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value")).withColumn("part", F.lit("pair"))
    term = priced.filter("q is not null").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value")).withColumn("part", F.lit("term"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pair.withColumn("rank", F.row_number().over(order)).unionByName(term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d), l AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS lt FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v) AS p, 1 + ({UNIT}::HUGEINT * (k.ln + 1)) // (l.lt + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::HUGEINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM o WHERE part = 'pair' OR rank <= {TOP_TERMS}"""

"""Quality rules from distribution divergence, in DataFrame functions only.

Each document's histograms of character classes and of common function words are compared with the references of the
languages by Jensen-Shannon distance (base 2, so 0 to 1). A language's reference is the mean histogram of all documents
declared to be in it that pass the length guards. A document is kept when some language is near in both histograms;
a histogram of a text under its guard isn't judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

# Frequent function words of the four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "as"],
    "fr": ["le", "la", "de", "et", "les", "des", "en", "un", "une", "que"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "se", "del", "las"],
}
CLASSES = ["lower", "upper", "digit", "space", "punctuation", "symbol", "beyond_ascii", "other"]
#: Guards (characters, words) and the largest distances that still count as the language. Short texts stray further
#: by chance, so SHORT / sqrt(characters) is added to the distance of characters.
MIN_CHARS, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, SHORT = 300, 60, 0.12, 0.4, 2.0

_SPACES = " \t\n\x0b\f\r"


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, also where body's lambdas use it for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - 2)
        gram = lambda i, f: f(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
        hashes = F.transform(starts, lambda i: gram(i, F.xxhash64))
        placed = F.sort_array(F.transform(starts, lambda i: F.struct(gram(i, lambda *x: F.concat_ws(" ", *x)).alias("g"), i.alias("p"))))
        twice = bind(placed, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))))
        covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
        # equal windows have equal hashes, so distinct hashes settle most texts
        return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered))

    return bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w)))


def features(docs: DataFrame, languages: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """doc_id, lang, the base counts, chars array (CLASSES) and commons array (all common words, then other words)."""
    vocabulary = sorted({w for ws in languages.values() for w in ws})
    size = F.length
    out = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    out = out.withColumn("r1", F.regexp_replace("t", "[a-z]+", "")).withColumn("words", words_of(F.col("t")))
    out = out.withColumn("r2", F.translate("r1", _SPACES, "")).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("r3", F.translate("r2", "#*$%&|<>", "")).withColumn("commons", F.filter("words", lambda w: w.isin(vocabulary)))
    out = out.withColumn("r4", F.regexp_replace("r3", "[A-Z]+", "")).withColumn("joined", F.concat(F.lit(" "), F.array_join("commons", "  "), F.lit(" ")))
    out = out.withColumn("r5", F.regexp_replace("r4", "[0-9]+", ""))
    out = out.withColumn("r6", F.regexp_replace("r5", r"[.,;:!?'\"()\-]+", ""))
    out = out.withColumn("r7", F.regexp_replace("r6", r"[^\x00-\x7F]+", ""))
    gone = lambda a, b: (size(a) - size(b)).cast("double")
    chars = F.array(gone("t", "r1"), gone("r3", "r4"), gone("r4", "r5"), gone("r1", "r2"), gone("r5", "r6"), gone("r2", "r3"), gone("r6", "r7"), size("r7").cast("double"))
    times = [((size("joined") - size(F.replace("joined", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("double") for w in vocabulary]
    return out.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), (size("t") - size("r1") + size("r2")).cast("long").alias("word_chars"),
        (size("r2") - size("r3")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"), chars.alias("chars"), F.array(*times, (F.size("words") - F.size("commons")).cast("double")).alias("commons"),
    )


def normalised(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return bind(total, lambda s: F.transform(counts, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0))))


def distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram column from a fixed one."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (part(a) + part(b)) / 2

    terms = F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def judge(docs: DataFrame, languages: dict[str, list[str]] = COMMON_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Per row of docs(doc_id, text, lang): the base counts, base_failed, char_distance, word_distance and kept.

    The guards leave the words of texts under MIN_WORDS, and the characters of texts under MIN_CHARS, unjudged. Null text
    is empty (and fails the base); repeated rows are judged alike, texts of any length whole; extra columns, whatever their
    names, are left out; an empty table gives no rows. A text in an undeclared or unknown language is compared with every
    reference all the same; languages no document declares have none, and without any reference the verdict is the
    base's. The distances are those of the nearest language (least sum).
    """
    f = materialise(features(docs, languages), "features").withColumns({"p": normalised(F.col("chars")), "q": normalised(F.col("commons"))})
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    f = f.withColumn("base_failed", base_failed)
    guarded = f.filter(F.col("lang").isin(list(languages)) & ~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS) & (F.aggregate("chars", F.lit(0.0), lambda a, x: a + x) >= MIN_CHARS))
    n_p, n_q = len(CLASSES), len({w for ws in languages.values() for w in ws}) + 1
    # one row per configured language
    refs = guarded.groupBy("lang").agg(*[F.avg(F.col("p")[k]).alias(f"p{k}") for k in range(n_p)], *[F.avg(F.col("q")[k]).alias(f"q{k}") for k in range(n_q)]).collect()
    near = [F.struct((cd + wd).alias("sum"), cd.alias("c"), wd.alias("w")) for r in sorted(refs, key=lambda r: r.lang) for cd, wd in [(distance(F.col("p"), [r[f"p{k}"] for k in range(n_p)]), distance(F.col("q"), [r[f"q{k}"] for k in range(n_q)]))]]
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("c"), F.lit(0.0).alias("w"))
    f = f.withColumn("near", F.array_min(F.array(*near)) if near else none)
    n_chars = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    good = ((n_chars < MIN_CHARS) | (F.col("near.c") <= max_char + SHORT / F.sqrt(n_chars))) & ((F.col("n_words") < MIN_WORDS) | (F.col("near.w") <= max_word))
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & good).alias("kept"), F.col("near.c").alias("char_distance"), F.col("near.w").alias("word_distance"))


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("char_distance", "word_distance")

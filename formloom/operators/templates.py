"""Matching labels with templates of known questions.

The catalogue is data: rows (key, question, label, type, aliases, options), read from JSON lines with catalogue(path) or
the built-in starter list. Exact aliases are an equi-join; only distinct labels left over meet the whole catalogue,
which is broadcast after a check of its size.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.geometry import has_box
from ..functions.normalise import BARE, match_label
from ..shared import materialise

MAX_ALIASES = 20_000
#: So many distinct labels are broadcast to the rows that have them; more meet them by sorted keys.
MAX_MATCHES = 100_000

# A starter catalogue of key | question | label | type | aliases | options.
STARTER = """
full_name | What is the applicant's full name? | Full Name | text | name; full name; applicant name; नाम; nombre; nom; 姓名; 氏名 |
date_of_birth | What is the applicant's date of birth? | Date of Birth | date | date of birth; dob; birth date; जन्म तिथि; fecha de nacimiento; 出生日期; تاريخ الميلاد |
gender | What is the applicant's gender? | Gender | multiple-choice | gender; sex; लिंग; género; 性别; пол | Male; Female; Other
address | What is the applicant's address? | Address | text | address; home address; पता; dirección; adresse; 地址 |
city | Which city does the applicant live in? | City | text | city; town; शहर; ciudad; ville; 城市 |
postal_code | What is the postal / ZIP code? | Postal Code | number | zip; zip code; postal code; pin; pin code; पिन कोड |
country | Which country? | Country | text | country; देश; país; 国家 |
phone | What is the applicant's phone number? | Phone Number | number | phone; phone number; telephone; contact number; फोन |
mobile | What is the applicant's mobile number? | Mobile Number | number | mobile; mobile number; mobile no; मोबाइल; 手机 |
email | What is the applicant's email address? | Email | text | email; e-mail; email address; ईमेल; correo |
employer | What is the name of the employer / company? | Company | text | company; company name; employer; empresa |
account_number | What is the bank account number? | Account Number | number | account number; account no; a/c no; खाता संख्या; kontonummer |
date | What is the date? | Date | date | date; दिनांक; fecha; datum; 日期 |
signature | Signature of the applicant | Signature | signature | signature; sign; signature of applicant; हस्ताक्षर; firma; unterschrift; 签名 |
amount | What is the amount? | Amount | number | amount; amt; राशि; betrag; 金额 |
total | What is the total amount? | Total | number | total; total amount; grand total; कुल; gesamt |
quantity | What is the quantity? | Quantity | number | quantity; qty; मात्रा; menge |
price | What is the price? | Price | number | price; unit price; rate; मूल्य; preis |
invoice_number | What is the invoice number? | Invoice Number | text | invoice no; invoice number; bill no; factura |
order_number | What is the order number? | Order Number | text | order no; order number; po number |
reference | What is the reference number? | Reference Number | text | ref no; reference; reference number; application no |
description | What is the description? | Description | text | description; particulars; details; विवरण |
remarks | Any remarks? | Remarks | text | remarks; comments; notes; टिप्पणी |
yes_no | Yes or no? | Yes / No | checkbox | yes; no; yes/no; हाँ; नहीं |
"""


def starter_rows() -> list[tuple]:
    split = lambda s: [x.strip() for x in s.split(";") if x.strip()]
    rows = [[c.strip() for c in line.split("|")] for line in STARTER.strip().splitlines()]
    return [(k, r[0], r[1], r[2], r[3], split(r[4]), split(r[5])) for k, r in enumerate(rows)]


def catalogue(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Templates: ordinal, key, question, label, type, aliases, options."""
    schema = "ordinal int, key string, question string, label string, type string, aliases array<string>, options array<string>"
    return spark.read.schema(schema).json(path) if path else spark.createDataFrame(starter_rows(), schema)


def alias_index(templates: DataFrame) -> DataFrame:
    """(alias, place, key): each normalised alias with the first template that lists it; place orders all aliases."""
    listed = templates.select("ordinal", "key", F.posexplode(F.concat(F.array("label"), "aliases")).alias("n", "a"))
    named = listed.select((F.col("ordinal") * 1000 + F.col("n")).alias("place"), "key", match_label(F.col("a")).alias("alias"))
    return named.groupBy("alias").agg(F.min("place").alias("place"), F.min_by("key", "place").alias("key"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[\s/]+"), lambda w: (w != "") & ((F.length(w) > 1) | ~w.rlike(r"^[\x00-\x7F]$"))))


def _holds(whole: Column, part: Column) -> Column:
    """part stands in whole between other characters than letters, digits, _ and -; spaceless scripts: anywhere."""
    plain = part.rlike(r"^[\x{3000}-\x{9fff}\x{ac00}-\x{d7af}\x{ff00}-\x{ffef}]+$")
    gap = r"[^\p{L}\p{N}_\-]"
    padded = F.regexp_replace(F.concat(F.lit(" "), whole, F.lit(" ")), gap, "  ")
    return F.contains(whole, part) & (plain | F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(part, gap, "  "), F.lit(" "))))


def containment_score(label: Column, bare: Column, alias: Column) -> Column:
    """How far one of label and alias stands in the other, else how many words they share; null if not at all."""
    n, m = F.length(label), F.length(alias)
    inside = 0.6 + 0.35 * m / F.greatest(n, F.lit(1))
    inside = F.when(n > 3 * m + 6, F.least(inside, F.lit(0.3))).otherwise(inside)
    a, b = _words(alias), _words(bare)
    both = F.size(F.array_intersect(a, b))
    shared = F.when(both > 0, 0.45 * both / F.size(F.array_union(a, b)) + 0.3 * both / F.size(a))
    return F.when(_holds(label, alias), inside).when((n >= 4) & _holds(alias, label), 0.5 + 0.3 * n / m).otherwise(shared)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


_CJK = r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7af}\x{ff00}-\x{ffef}]"


def candidate_pairs(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(norm, alias, place, key) of all pairs whose containment_score can be above zero: they share a word, as holding a
    text and overlapping with it both need, or both have characters of scripts without spaces and one holds the other."""
    words = lambda x: F.filter(F.array_union(F.split(x, r"[\s/]+"), F.split(x, r"[^\p{L}\p{N}_]+")), lambda w: w != "")
    norms = labels.select("norm").distinct()
    shared = norms.withColumn("word", F.explode(words(F.col("norm")))).join(index.withColumn("word", F.explode(words(F.col("alias")))), "word").drop("word")
    held = norms.filter(F.col("norm").rlike(_CJK)).join(F.broadcast(index.filter(F.col("alias").rlike(_CJK))), F.contains("norm", "alias") | F.contains("alias", "norm"))
    return shared.unionByName(held).distinct()


def _alike(norm: Column, digits: bool) -> Column:
    """One normalised label for all that differ in digits only: no alias holds a digit, so none tells them apart. Labels of
    several words with digits stay as they are, since their words are counted; so do all if aliases hold digits."""
    if digits:
        return norm
    numbers = F.size(F.filter(F.split(norm, r"[\s/]+"), lambda w: w.rlike("[0-9]")))
    return F.when(norm.rlike("[1-9]") & (numbers == 1), F.translate(norm, "123456789", "0" * 9)).otherwise(norm)


def digits_counted(norm: Column) -> Column:
    """Whether normalised labels that differ from norm, of a print (see layouts.prints), in digits only may be matched otherwise:
    words with digits that are equal here count once, elsewhere twice, beside a word that an alias may share."""
    words = F.split(F.regexp_replace(norm, r"\(.*?\)", ""), r"[\s/]+")
    own = F.filter(words, lambda w: F.contains(w, F.lit("0")))
    return (F.size(F.array_distinct(own)) < F.size(own)) & (F.size(own) < F.size(F.filter(words, lambda w: w != "")))


def _sized(templates: DataFrame) -> tuple[DataFrame, bool]:
    """The index of aliases after a check of its size, and whether any holds a digit."""
    index = alias_index(templates)
    n, digits = index.limit(MAX_ALIASES + 1).agg(F.count("*"), F.count_if(F.col("alias").rlike("[0-9]"))).first()
    if n > MAX_ALIASES:
        raise ValueError(f"the catalogue has more than {MAX_ALIASES} aliases")
    return index, digits > 0


def has_digits(templates: DataFrame) -> bool:
    """Whether any alias holds a digit, so that labels which differ in digits only may have different templates."""
    return _sized(templates)[1]


def match(labels: DataFrame, templates: DataFrame, compose: bool = True) -> DataFrame:
    """labels(label) with template key (null below 0.45) and strength.

    1 for an alias, 0.95 for one without its bracketed hints, else the best of containment and, under 0.75, of near
    spelling; equal scores go to the earlier alias.
    """
    index, digits = _sized(templates)
    u = labels.select("label").distinct().withColumn("norm", match_label(F.col("label"), compose)).withColumn("norm", _alike(F.col("norm"), digits))
    return _with_match(u, index).select("label", "key", "strength")


def _with_match(labels: DataFrame, index: DataFrame) -> DataFrame:
    """labels(norm, ...) with key and strength, which follow from norm; what is matched is the distinct ones."""
    found = materialise(match_norms(labels.select("norm").distinct(), index), "matches")
    return labels.join(F.broadcast(found) if found.count() <= MAX_MATCHES else found.hint("merge"), "norm", "left")


def match_norms(norms: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct normalised labels (norm) with key and strength; see match()."""
    index = F.broadcast(index)  # at most MAX_ALIASES rows, checked above
    u = norms.withColumn("bare", F.trim(F.regexp_replace("norm", r"\(.*?\)", "")))
    exact = index.select(F.col("alias").alias("norm"), F.col("key").alias("k1"))
    hinted = index.select(F.col("alias").alias("bare"), F.col("key").alias("k2"))
    u = materialise(u.join(exact, "norm", "left").join(hinted, "bare", "left"), "labels")  # five branches read it
    done = u.filter("norm = '' or k1 is not null or (bare <> '' and k2 is not null)").select("norm", F.when(F.col("norm") == "", None).otherwise(F.coalesce("k1", "k2")).alias("key"), F.when(F.col("norm") == "", 0.0).when(F.col("k1").isNotNull(), 1.0).otherwise(0.95).alias("strength"))
    rest = u.filter("norm <> '' and k1 is null and (bare = '' or k2 is null)").select("norm", F.when(F.col("bare") != "", F.col("bare")).otherwise(F.col("norm")).alias("bare"))
    pairs = rest.join(candidate_pairs(rest, index.filter("length(alias) >= 3")), "norm", "left")
    best = F.max(F.struct(F.coalesce(containment_score(F.col("norm"), F.col("bare"), F.col("alias")), F.lit(0.0)).alias("s"), (-F.col("place")).alias("p"), "key")).alias("best")
    held = pairs.groupBy("norm", "bare").agg(best)
    # of two texts of ratio 0.75 or more the shorter differs by 3 at most, and 3/8 of all characters occur in the other
    sized = index.filter("length(alias) >= 4").withColumn("size", F.length("alias"))
    low = held.filter(F.col("best.s") < 0.75).filter(F.length("bare").between(3, 30)).withColumn("size", F.explode(F.sequence(F.length("bare") - 3, F.length("bare") + 3)))
    common = F.col("size") - F.length(F.expr("translate(alias, bare, '')"))
    near = low.join(sized, "size").filter(common >= 0.375 * (F.col("size") + F.length("bare"))).withColumn("r", _ratio("alias", "bare")).filter("r >= 0.75")
    near = near.groupBy("norm").agg(F.max(F.struct(F.round(0.45 + 0.4 * (F.col("r") - 0.75) / 0.25, 3).alias("s"), (-F.col("place")).alias("p"), "key")).alias("near"))
    both = held.join(near, "norm", "left").withColumn("b", F.when(F.coalesce(F.col("near.s"), F.lit(-1.0)) > F.col("best.s"), F.col("near")).otherwise(F.col("best")))
    found = both.select("norm", F.when(F.col("b.s") >= 0.45, F.col("b.key")).alias("key"), F.when(F.col("b.s") >= 0.45, F.round("b.s", 3)).otherwise(F.col("b.s")).alias("strength"))
    return done.unionByName(found)


def _word_or_part(text: Column, words: list[str], parts: list[str]) -> Column:
    return text.rlike(P.any_word(words)) | text.rlike("|".join(parts))


def infer_type(label: Column, value: Column, box: Column, compose: bool = True, low: Column | None = None) -> Column:
    """low: the normalised label, where it is known already."""
    low = match_label(label, compose) if low is None else low
    numeric = value.rlike(r"^[\p{Nd}\s,./-]+$") & value.rlike(r"\p{Nd}")
    return (
        F.when(box | has_box(label) | has_box(value), "checkbox")
        .when(label.rlike(P.DATE_HINT) | _word_or_part(low, P.DATE_WORDS, P.DATE_PARTS), "date")
        .when(_word_or_part(low, P.NUMBER_WORDS, P.NUMBER_PARTS), "number")
        .when(_word_or_part(low, P.SIGN_WORDS, P.SIGN_PARTS), "signature")
        .when(numeric & value.rlike(r"\p{Nd}{1,4}[/.-]\p{Nd}{1,2}[/.-]\p{Nd}{1,4}"), "date")
        .when(numeric, "number")
        .otherwise("text")
    )


def known(candidates: DataFrame, templates: DataFrame, compose: bool = True) -> DataFrame:
    """candidates(label, value, has_box, ...) with what phrased() reads: clean (the normalised label), kind (the type their words
    tell), key and strength of the template, and its question, label, type and options as tq, tl, tt and to."""
    index, digits = _sized(templates)
    matched = _with_match(candidates.withColumn("clean", match_label(F.col("label"), compose)).withColumn("norm", _alike(F.col("clean"), digits)), index)
    c = matched.join(F.broadcast(templates.select("key", F.col("question").alias("tq"), F.col("label").alias("tl"), F.col("type").alias("tt"), F.col("options").alias("to"))), "key", "left")
    return c.withColumn("kind", infer_type(F.col("label"), F.col("value"), F.col("has_box"), compose, F.col("clean")))


def phrased(c: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of known() candidates with question, label_en, type, template_key, strength and options."""
    clean, kind = F.col("clean"), F.col("kind")
    capital = lambda w: F.when(w.rlike(r"^[\x00-\x7F]*$"), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))).otherwise(w)
    pretty = F.array_join(F.transform(F.filter(F.split(clean, " "), lambda w: w != ""), capital), " ")
    pretty = F.when(clean.rlike(BARE + r"+\z"), clean).otherwise(pretty)  # nothing to part or to capitalise
    pretty = F.when(pretty != "", pretty).otherwise(F.trim("label"))
    asked = F.when(kind == "checkbox", F.concat(F.lit("Is '"), pretty, F.lit("' checked?"))).when(kind == "signature", F.concat(pretty, F.lit(" (signature)"))).otherwise(F.concat(F.lit("What is the value for '"), pretty, F.lit("'?")))
    known = F.col("key").isNotNull()
    boxed = F.when(F.col("has_box") & ~F.col("tt").isin("checkbox", "multiple-choice"), "checkbox").otherwise(F.col("tt"))
    return c.select(
        *columns, F.when(known, F.col("tq")).otherwise(asked).alias("question"), F.when(known, F.col("tl")).otherwise(pretty).alias("label_en"),
        F.when(known, boxed).otherwise(kind).alias("type"), F.col("key").alias("template_key"), "strength", F.coalesce("to", F.array().cast("array<string>")).alias("options"),
    )


def questions(candidates: DataFrame, templates: DataFrame, compose: bool = True) -> DataFrame:
    """candidates(label, value, has_box, ...) with question, label_en, type, template_key, strength and options."""
    return phrased(known(candidates, templates, compose), candidates.columns)

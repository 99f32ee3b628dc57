"""Label and value normalisation as column expressions.

Compatibility composition (NFKC) has no built-in; composed() hands texts beyond ASCII to an Arrow function, which gets a null
for every other row.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+"

#: The start of a text of ASCII digits and marks, which has neither letters nor spaces.
BARE = r"^[!-@\[-`{-~]"


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFKC")


def composed(text: Column) -> Column:
    """NFKC form. Every row visits the Arrow function, as Spark doesn't skip it by row, but texts of ASCII do so as nulls."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(F.when(plain, text), _nfkc(F.when(~plain, text)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_each(texts: pa.Array) -> pa.Array:
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(texts), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, pc.utf8_normalize(texts.flatten(), form="NFKC"), mask=texts.is_null())


def composed_each(texts: Column) -> Column:
    """composed() of an array's texts, in one visit."""
    plain = F.forall(texts, lambda t: t.rlike(r"^[\x00-\x7F]*$"))
    return F.when(plain, texts).otherwise(_nfkc_each(F.when(~plain, texts)))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "".join(chr(b + k) for b in P.DIGIT_BLOCKS for k in range(10)), "0123456789" * len(P.DIGIT_BLOCKS))


def clean_text(text: Column, compose: bool = True) -> Column:
    """Composed, without zero-width marks, single spaces, trimmed; null is empty. compose=False for text that is so."""
    text = F.coalesce(text, F.lit(""))
    text = composed(text) if compose else text
    return F.trim(F.regexp_replace(F.translate(text, "​‌‍", ""), SPACES, " "))


def match_label(label: Column, compose: bool = True) -> Column:
    """The label as templates know it: no numbering, no trailing separators, lower case."""
    s = F.trim(composed(label) if compose else label)
    s = F.lower(F.regexp_replace(F.regexp_replace(s, P.NUMBERED, ""), P.TRAILING, ""))
    return F.regexp_replace(F.replace(F.regexp_replace(s, SPACES, " "), F.lit("’"), F.lit("'")), r"^[ :\-_.]+|[ :\-_.]+$", "")


def show_label(label: Column, compose: bool = True) -> Column:
    """The label for output: as match_label() but in its own case, numbering only before a space, no empty brackets."""
    s = F.regexp_replace(F.regexp_replace(clean_text(label, compose), P.NUMBERED_SPACED, ""), P.TRAILING_SEPARATORS, "")
    return F.trim(F.regexp_replace(s, r"\s*\(\s*\)\s*$", ""))


def is_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike(P.BLANK_VALUE)


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _iso(y: Column, m: Column, d: Column) -> Column:
    """yyyy-mm-dd by range checks alone (31 February passes), else null."""
    ok = m.between(1, 12) & d.between(1, 31) & y.between(1000, 2999)
    return F.when(ok, F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))


_YMD = r"^[0-9]{4}[./\-][0-9]{1,2}[./\-][0-9]{1,2}$"
_DMY = r"^[0-9]{1,2}[./\-\s][0-9]{1,2}[./\-\s][0-9]{2,4}$"
_DAY_NAME = r"(?i)^([0-9]{1,2})\s*(?:st|nd|rd|th)?[\s,.\-]+([^0-9\s,.]+)[\s,.\-]+([0-9]{4})$"
_NAME_DAY = r"(?i)^([^0-9\s,.]+)[\s,.\-]+([0-9]{1,2})\s*(?:st|nd|rd|th)?[\s,.\-]+([0-9]{4})$"


def normalise_date(value: Column, compose: bool = True) -> Column:
    """ISO date of the known notations, day first; other text comes back cleaned. A notation is told by one test, and
    only its own parts are cut out."""
    months = F.create_map(*[F.lit(x) for pair in P.MONTHS.items() for x in pair])
    whole = lambda p, k: F.get(p, F.lit(k)).cast("int")
    month = lambda p, k: F.try_element_at(months, F.lower(F.get(p, F.lit(k))))

    def day_first(p: Column) -> Column:
        a, b, y = whole(p, 0), whole(p, 1), whole(p, 2)
        y = F.when(y < 30, y + 2000).when(y < 100, y + 1900).otherwise(y)
        swap = (b > 12) & (a <= 12)
        return _iso(y, F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a))

    def read(v: Column) -> Column:
        found = (
            F.when(v.rlike(_YMD), bind(F.split(v, r"[./\-]"), lambda p: _iso(whole(p, 0), whole(p, 1), whole(p, 2))))
            .when(v.rlike(_DMY), bind(F.split(v, r"[./\-\s]"), day_first))
            .when(v.rlike(_DAY_NAME), bind(F.split(F.regexp_replace(v, _DAY_NAME, "$1 $2 $3"), " "), lambda p: _iso(whole(p, 2), month(p, 1), whole(p, 0))))
            .when(v.rlike(_NAME_DAY), bind(F.split(F.regexp_replace(v, _NAME_DAY, "$1 $2 $3"), " "), lambda p: _iso(whole(p, 2), month(p, 0), whole(p, 1))))
        )
        return F.coalesce(found, v)

    return bind(ascii_digits(clean_text(value, compose)), read)


def normalise_number(value: Column, label: Column, compose: bool = True) -> Column:
    """Digits with one decimal point; phone-like labels keep digits and a leading plus; other text comes back."""
    v = ascii_digits(clean_text(value, compose))
    phone = F.regexp_replace(v, r"[^0-9+]", "")
    pluses = F.length(phone) - F.length(F.replace(phone, F.lit("+"), F.lit("")))
    phone = F.when((pluses > 1) | ((pluses == 1) & ~phone.startswith("+")), F.concat(F.lit("+"), F.replace(phone, F.lit("+"), F.lit("")))).otherwise(phone)
    n = F.regexp_replace(v, r"[^0-9.,\-]", "")
    dots, commas = (F.length(n) - F.length(F.replace(n, F.lit(c), F.lit(""))) for c in ".,")
    no_commas = F.replace(n, F.lit(","), F.lit(""))
    european = F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    last = lambda c: F.length(n) - F.instr(F.reverse(n), c)
    short_tail = F.length(F.substring_index(n, ",", -1)).isin(1, 2)
    plain = (
        F.when((commas > 0) & (dots > 0), F.when(last(".") > last(","), no_commas).otherwise(european))
        .when((commas == 1) & short_tail, F.replace(n, F.lit(","), F.lit(".")))
        .otherwise(no_commas)
    )
    number = F.when(n.rlike("[0-9]") & plain.rlike(r"^-?[0-9]+(\.[0-9]+)?\.?$"), F.regexp_replace(plain, r"\.$", "")).otherwise(v)
    is_phone = F.lower(F.coalesce(label, F.lit(""))).rlike(P.PHONE_PARTS)
    return F.when(is_phone, F.when(phone != "", phone).otherwise(v)).otherwise(number)


def normalise_checkbox(value: Column, compose: bool = True) -> Column:
    v = F.lower(clean_text(value, compose))
    return F.when(v.isin(P.TRUE_WORDS) | v.rlike("[☑☒✓]"), "true").when(v.isin(P.FALSE_WORDS) | is_blank(v), "false").otherwise(v)


def normalise_choice(value: Column, options: Column, compose: bool = True) -> Column:
    """The option equal to the value in any case, else the first that holds it or is held by it, else the value."""
    v = F.trim(F.regexp_replace(clean_text(value, compose), "[☐☑☒□■✓✔]", ""))
    low = F.lower(v)
    clean = lambda o: F.lower(clean_text(o, False))
    same = F.filter(options, lambda o: clean(o) == low)
    near = F.filter(options, lambda o: F.contains(clean(o), low) | F.contains(low, clean(o)))
    return F.when(v == "", "").otherwise(F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0)), v))


def normalise_value(value: Column, kind: Column, label: Column, options: Column, compose: bool = True) -> Column:
    text = clean_text(value, compose)
    return (
        F.when(kind == "checkbox", normalise_checkbox(value, compose))
        .when(is_blank(value), "")
        .when(kind == "date", normalise_date(value, compose))
        .when(kind == "number", normalise_number(value, label, compose))
        .when(kind == "multiple-choice", normalise_choice(value, options, compose))
        .when(kind == "signature", "")
        .when(text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lower(text))
        .otherwise(text)
    )


def title_case(label: Column) -> Column:
    """Capitals for lower-case words of an ASCII label (each part of a hyphenated one), small words but the first low."""
    first_up = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    cap = lambda w: F.array_join(F.transform(F.split(w, "-"), first_up), "-")
    word = lambda w, k: F.when((k > 0) & F.lower(w).isin(P.SMALL_WORDS), F.lower(w)).when(w == F.lower(w), cap(w)).otherwise(w)
    words = F.filter(F.split(label, r"\s+"), lambda w: w != "")
    return F.when(label.rlike(BARE + r"*\z"), label).when(label.rlike(r"^[\x00-\x7F]*$"), F.array_join(F.transform(words, word), " ")).otherwise(label)


def normalise_fields(fields, compose: bool = True):
    """Fields (label, original_label, question, type, value, options) normalised: raw_value kept, unread dates marked."""
    f = fields.withColumn("raw_value", F.col("value"))
    if compose:
        f = f.withColumns({c: composed(F.col(c)) for c in ("label", "original_label", "question", "value")})
        compose = False
    keep = lambda c: F.coalesce(F.when(show_label(F.col(c), compose) != "", show_label(F.col(c), compose)), F.col(c))
    f = f.withColumns({"label": title_case(keep("label")), "original_label": keep("original_label"), "question": clean_text(F.col("question"), compose)})
    f = f.withColumn("options", F.filter(F.transform("options", lambda o: clean_text(o, False)), lambda o: o != ""))
    f = f.withColumn("value", normalise_value(F.col("value"), F.col("type"), F.col("label"), F.col("options"), compose))
    unread = (F.col("type") == "date") & (F.col("value") != "") & ~F.col("value").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return f.withColumn("needs_review", F.coalesce(F.col("needs_review"), F.lit(False)) | unread)

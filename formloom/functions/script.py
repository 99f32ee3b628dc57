"""The script of a text, by its first letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag and Java character class, in order of precedence.
SCRIPTS = {
    "devanagari": r"\p{IsDevanagari}", "arabic": r"\p{IsArabic}", "cjk": r"\p{IsHan}", "hiragana": r"\p{IsHiragana}", "katakana": r"\p{IsKatakana}",
    "hangul": r"\p{IsHangul}", "cyrillic": r"\p{IsCyrillic}", "bengali": r"\p{IsBengali}", "tamil": r"\p{IsTamil}", "telugu": r"\p{IsTelugu}",
    "gujarati": r"\p{IsGujarati}", "gurmukhi": r"\p{IsGurmukhi}", "kannada": r"\p{IsKannada}", "malayalam": r"\p{IsMalayalam}", "thai": r"\p{IsThai}",
    "hebrew": r"\p{IsHebrew}", "greek": r"\p{IsGreek}",
}


def detect_script(text: Column) -> Column:
    letter = F.regexp_extract(text, r"(\p{L})", 1)
    out = F.when(letter == "", "unknown")
    for tag, pattern in SCRIPTS.items():
        out = out.when(letter.rlike(pattern), tag)
    return out.otherwise("latin")

"""Turkish string functions as column expressions.

Turkish has a dotted and a dotless i; the pairs are translated before Spark's own case mapping,
which does not know them. No pattern here uses ``\\w``, which is ASCII in Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from berrak.functions.arrays import let

#: Fixed values of the language.
VOWELS = "aeıioöuüâîû"
FRONT, BACK = "eiöü", "aıou"
CIRCUMFLEX = ("âîûÂÎÛ", "aiuAİU")
LETTER_SYLLABLES = {"ğ": 3, "w": 2}
MONTHS = ["ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık"]
WEEKDAYS = ["Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi", "Pazar"]
#: Characters that normalisation maps: double quotes, single quotes, dashes, spaces, and those it removes.
DOUBLE_QUOTES = "“”„‟«»″"
SINGLE_QUOTES = "‘’‚‛′`"
DASHES = "‐‑‒–—―−"
SPACES = "\t               　"
REMOVED = "​‌‍⁠﻿­"


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def turkish_upper(text: Column) -> Column:
    return F.upper(F.translate(text, "iı", "İI"))


def turkish_capitalize(text: Column) -> Column:
    return F.concat(turkish_upper(F.substring(text, 1, 1)), turkish_lower(F.substr(text, F.lit(2))))


def fold_circumflex(text: Column) -> Column:
    return F.translate(text, *CIRCUMFLEX)


def is_latin(text: Column) -> Column:
    """No letter of another script; true where there are no letters."""
    return ~F.rlike(text, F.lit("[\\p{L}&&[^\\p{IsLatin}]]"))


def is_upper_word(text: Column) -> Column:
    return (text == turkish_upper(text)) & (text != turkish_lower(text))


def count_vowels(text: Column) -> Column:
    low = turkish_lower(text)
    return F.length(low) - F.length(F.translate(low, VOWELS, ""))


def spell_letters(text: Column) -> Column:
    """Syllables of a text read letter by letter."""
    low = turkish_lower(text)
    out = F.length(F.regexp_replace(low, "[^\\p{L}]", ""))
    for letter, n in LETTER_SYLLABLES.items():
        out = out + (n - 1) * (F.length(low) - F.length(F.replace(low, F.lit(letter), F.lit(""))))
    return out


#: Each character that is mapped, the removed ones last, and what stands for them.
MAPPED = DOUBLE_QUOTES + SINGLE_QUOTES + DASHES + SPACES + REMOVED
MAPPED_TO = '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "-" * len(DASHES) + " " * len(SPACES)
#: A few ranges that hold all of them, and others: a short class is looked for several times faster.
WHERE_MAPPED = "\t`\u00a0-\u00bb\u1680-\u180e\u2000-\u303f\ufeff"
#: The steps of normalisation. Translating costs far more a character than looking, so that a text without any of them is only looked at.
STEPS = (
    lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, "\\r\\n?", "\n")).otherwise(t),
    lambda t: F.when(F.rlike(t, F.lit(f"[{WHERE_MAPPED}]")), F.translate(t, MAPPED, MAPPED_TO)).otherwise(t),
    lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t),
)


def normalize(text: Column) -> Column:
    """Line ends to a line feed, quotes, dashes and spaces to their ASCII forms, runs of spaces to one."""
    return reduce(let, STEPS, text)


def soften_final(stem: Column) -> Column:
    hard = F.translate(F.right(stem, F.lit(1)), "bcdğg", "pçtkk")
    return F.when(F.length(stem) > 2, F.concat(F.substr(stem, F.lit(1), F.length(stem) - 1), hard)).otherwise(stem)


def quote(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def join_quoted(items: Column, most: int = 4) -> Column:
    """The distinct items in order, quoted; after ``most`` an ellipsis."""
    one = F.array_distinct(items)
    return F.concat(F.array_join(F.transform(F.slice(one, 1, most), quote), ", "), F.when(F.size(one) > most, " …").otherwise(""))


def safe_filename(name: Column, default: str = "belge") -> Column:
    base = F.regexp_replace(F.regexp_replace(name, "^.*[/\\\\]", ""), "[^\\p{L}\\p{Nd}._ -]", "")
    cut = F.substring(F.trim(base), 1, 120)
    return F.when(F.length(cut) > 0, cut).otherwise(default)


def utf16_offset(text: Column, at: Column) -> Column:
    """The UTF-16 offset of a code-point offset."""
    return F.octet_length(F.encode(F.substr(text, F.lit(1), at), "UTF-16LE")) / 2

"""Numerals in words: what is one, its value, and how a number is written and inflected.

A numeral is read group by group: thousands of millions, millions, thousands and the rest, each at most once and
in this order. A group is hundreds, tens and units, in this order too. That grammar is regular,
so that one pattern over the words, which stays in generated code, tells numerals from mere rows of number words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words.
UNITS = ["bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
TENS = ["on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
SCALES = ["bin", "milyon", "milyar"]
NUMBER_WORDS = {w: k for k, w in enumerate(UNITS, 1)} | {w: 10 * k for k, w in enumerate(TENS, 1)} | {"yüz": 100} | {w: 1000**k for k, w in enumerate(SCALES, 1)}

_UNIT, _TEN = f"(?:{'|'.join(UNITS)}) ", f"(?:{'|'.join(TENS)}) "
_GROUP = f"(?:(?:{_UNIT})?yüz )?(?:{_TEN})?(?:{_UNIT})?"
#: A numeral, each word with a space after it. Only a thousand needs no group before it.
NUMERAL = "^" + "".join(f"(?:(?!{s} ){_GROUP}{s} )?" for s in reversed(SCALES[1:])) + f"(?:{_GROUP}bin )?{_GROUP}$"
#: The largest number written in words.
LARGEST = 10**12 - 1


def is_numeral(words: Column) -> Column:
    """Whether words, in small letters, are one numeral: "yirmi beş" is, "yirmi otuz" and "üç dört yüz" are two. No words are none; null stays null."""
    return (F.size(words) > 0) & F.rlike(F.concat(F.array_join(words, " "), F.lit(" ")), F.lit(NUMERAL))


def numeral_value(words: Column) -> Column:
    """The value of a sequence of number words."""
    table = F.create_map(*[x for k, v in NUMBER_WORDS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(a: Column, w: Column) -> Column:
        v, many = table[w], F.greatest(a["now"], F.lit(1).cast("long"))
        return F.when(v >= 1000, F.struct((a["total"] + many * v).alias("total"), F.lit(0).cast("long").alias("now"))).when(v == 100, F.struct(a["total"].alias("total"), (many * 100).alias("now"))).otherwise(F.struct(a["total"].alias("total"), (a["now"] + v).alias("now")))

    return F.aggregate(words, start, step, lambda a: a["total"] + a["now"])


def number_words(n: Column) -> Column:
    """A whole number as an array of words; "sıfır" for zero, null for null, negative numbers and those above ``LARGEST``."""
    n = n.cast("long")
    units, tens = (F.array(F.lit(""), *map(F.lit, words)) for words in (UNITS, TENS))

    def group(k: int) -> list[Column]:
        g = (F.floor(n / F.lit(1000**k)) % 1000).cast("int") if k else (n % 1000).cast("int")
        hundreds = F.floor(g / 100).cast("int")
        last = F.get(units, g % 10)
        return [
            F.when(hundreds > 1, F.get(units, hundreds)).otherwise(""), F.when(hundreds > 0, "yüz").otherwise(""), F.get(tens, F.floor(g / 10).cast("int") % 10),
            F.when(g == 1, "").otherwise(last) if k == 1 else last, *([F.when(g > 0, SCALES[k - 1]).otherwise("")] if k else []),
        ]

    words = F.filter(F.array(*[w for k in (3, 2, 1, 0) for w in group(k)]), lambda w: w != "")
    return F.when(n.between(0, LARGEST), F.when(n == 0, F.array(F.lit("sıfır"))).otherwise(words))


def possessive(n: Column) -> Column:
    """A whole number with the possessive ending of its reading: 35'i, 20'si, 6'sı, 100'ü. Null where the number has no reading."""
    last = F.element_at(number_words(n), -1)
    vowel = F.translate(F.regexp_extract(last, "([aeıioöuü])[^aeıioöuü]*$", 1), "aeoö", "ıiuü")
    return F.concat(n.cast("long").cast("string"), F.lit("'"), F.when(F.rlike(last, F.lit("[aeıioöuü]$")), "s").otherwise(""), vowel)

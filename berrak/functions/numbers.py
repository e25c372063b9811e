"""Numerals: reading lengths, Roman numerals, grouping, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from berrak.functions.turkish import MONTHS, WEEKDAYS, count_vowels, turkish_capitalize

#: Syllables of the names of 0-9 within a number, of the tens, and of the powers of 1000.
ONES = [0, 1, 2, 1, 1, 1, 2, 2, 2, 2]
TENS = [0, 1, 2, 2, 1, 2, 2, 2, 2, 2]
POWERS = [0, 1, 2, 2, 2, 3]
DIGITS = [2, 1, 2, 1, 1, 1, 2, 2, 2, 2]
COMMA = 2
PERCENT = 2
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ROMAN_PATTERN = "^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"


def _below_thousand() -> Column:
    """Syllables of every number below 1000, as a constant array that the optimizer folds."""
    sizes = [(n >= 100) * (1 + (ONES[n // 100] if n >= 200 else 0)) + TENS[n // 10 % 10] + ONES[n % 10] for n in range(1000)]
    return F.split(F.lit(",".join(map(str, sizes))), ",")


def integer_syllables(digits: Column) -> Column:
    """Syllables of an integer of up to 18 digits read aloud; of a longer one, digit by digit."""
    groups = F.regexp_extract_all(F.lpad(digits, 18, "0"), F.lit("[0-9]{3}"), F.lit(0))
    table, powers = _below_thousand(), F.array(*map(F.lit, reversed(POWERS)))

    def one(g: Column, i: Column) -> Column:
        thousand = F.when((g == "001") & (i == 4), 1).otherwise(0)
        return F.when(g == "000", 0).otherwise(table[g.cast("int")].cast("int") + powers[i] - thousand)

    read = F.aggregate(F.transform(groups, one), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits) > 18, digit_syllables(digits)).when(F.rlike(digits, F.lit("^0*$")), DIGITS[0]).otherwise(read)


def digit_syllables(digits: Column) -> Column:
    two = "".join(str(d) for d, n in enumerate(DIGITS) if n == 2)
    return F.length(digits) + F.length(F.regexp_replace(digits, f"[^{two}]", ""))


def date_parts(text: Column) -> Column:
    """A struct of day, month and year; the year is first where it has four digits."""
    p = F.transform(F.split(text, "[./-]"), lambda x: x.try_cast("int"))
    at = lambda k: F.get(p, F.lit(k))
    first = F.length(F.split(text, "[./-]")[0]) == 4
    year = F.when(first, at(0)).otherwise(at(2))
    return F.struct(F.when(first, at(2)).otherwise(at(0)).alias("day"), at(1).alias("month"), F.when(year < 100, year + 2000).otherwise(year).alias("year"))


def reading_syllables(text: Column, kind: Column) -> Column:
    """Syllables of a number (15.000, 3,5, 1996, 1.2.3), percentage, date or time read aloud.

    Each kind is first taken apart into integers, so that the reading of an integer stands once
    in the generated code.
    """
    plain = F.regexp_replace(F.regexp_replace(text, "[%\\s]", ""), "[/:-]", ".")
    comma, grouped = F.contains(plain, F.lit(",")), F.rlike(plain, F.lit("^[0-9]{1,3}(\\.[0-9]{3})+$"))
    d = date_parts(text)
    minute = F.get(F.split(text, "[.:]"), F.lit(1))
    months = F.array(*[F.lit(sum(c in "aeıioöuü" for c in m)) for m in MONTHS])
    parts = (
        F.when(kind == "date", F.array(d["day"].cast("string"), d["year"].cast("string"), F.when(~d["month"].between(1, 12), d["month"].cast("string"))))
        .when(kind == "time", F.array(F.split(text, "[.:]")[0], F.when(minute.try_cast("int") != 0, minute)))
        .when(comma, F.array(F.replace(F.substring_index(plain, ",", 1), F.lit("."), F.lit(""))))
        .when(grouped, F.array(F.replace(plain, F.lit("."), F.lit(""))))
        .otherwise(F.filter(F.split(plain, "\\."), lambda x: x != ""))
    )
    more = F.when((kind == "date") & d["month"].between(1, 12), F.get(months, d["month"] - 1)).when(kind.isin("date", "time"), 0).when(comma, COMMA + digit_syllables(F.regexp_replace(F.substring_index(plain, ",", -1), "[^0-9]", ""))).otherwise(0)
    return F.aggregate(F.array_compact(parts), F.lit(0), lambda a, x: a + integer_syllables(x)) + more + F.when(kind == "percent", PERCENT).otherwise(0)


def roman_to_int(text: Column) -> Column:
    """The value of a Roman numeral, right to left with subtraction."""
    value = lambda c: F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])[c]
    letters = F.filter(F.reverse(F.split(text, "")), lambda c: c != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    step = lambda a, c: F.struct((a["total"] + F.when(value(c) < a["top"], -value(c)).otherwise(value(c))).alias("total"), F.greatest(a["top"], value(c)).alias("top"))
    return F.aggregate(letters, start, step, lambda a: a["total"])


def format_thousands(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), ",", ".")


def readable_date(date: Column) -> Column:
    """1 Aralık 2026 Salı."""
    month = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month(date) - 1)
    return F.concat_ws(" ", F.day(date).cast("string"), turkish_capitalize(month), F.year(date).cast("string"), F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(date)))


def suffix_syllables(text: Column) -> Column:
    """Syllables of what follows the first apostrophe."""
    return F.when(F.contains(text, F.lit("'")), count_vowels(F.substr(text, F.instr(text, "'") + 1))).otherwise(0)

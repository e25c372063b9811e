"""Facts that a rewriting must keep: addresses, dates, years, times and numbers.

One pass over the text takes out everything that can be a fact, and each piece is told by its form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from berrak.functions.turkish import MONTHS, turkish_lower
from berrak.operators.segment import AMOUNT, MAIL, NET

#: A day and a month's name, maybe with a year.
SAID_DATE = f"[0-9]{{1,2}} +(?:{'|'.join(MONTHS)})(?: +[0-9]{{4}})?"
PIECE = "|".join([NET, MAIL, SAID_DATE, AMOUNT])
WRITTEN_DATE = "^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})$"
CLOCK = "^([0-9]{1,2})[.:]([0-9]{2})$"
YEAR = "^(?:19[0-9]{2}|20[0-9]{2}|2100)$"


def _two(digits: Column) -> Column:
    return F.lpad(digits.try_cast("int").cast("string"), 2, "0")


def _labelled(kind: str, *value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), *value)


def _number(n: Column) -> Column:
    plain = F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(F.rlike(n, F.lit(YEAR)), _labelled("yıl", n)).otherwise(_labelled("sayı", plain))


def _amount(piece: Column) -> Column:
    """A time, or numbers: what stands between dashes and slashes, and, if it is no time, between colons."""
    one = lambda p: F.when(
        F.rlike(p, F.lit(CLOCK)), F.array(_labelled("saat", _two(F.regexp_extract(p, CLOCK, 1)), F.lit("."), F.regexp_extract(p, CLOCK, 2)))
    ).otherwise(F.transform(F.split(p, ":"), _number))
    return F.flatten(F.transform(F.split(piece, "[-/]"), one))


def _said(piece: Column) -> Column:
    words = F.split(piece, " +")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.get(words, F.lit(1)))
    day = _labelled("tarih", _two(month), F.lit("-"), _two(F.get(words, F.lit(0))))
    return F.array(F.when(F.size(words) > 2, _labelled("yıl", F.get(words, F.lit(2)))), day)


def _written(piece: Column) -> Column:
    part = lambda k: F.regexp_extract(piece, WRITTEN_DATE, k)
    return F.array(_labelled("yıl", part(3)), _labelled("tarih", _two(part(2)), F.lit("-"), _two(part(1))))


def _told(piece: Column) -> Column:
    return (
        F.when(~F.rlike(piece, F.lit("^[0-9]")) | F.contains(piece, F.lit("@")), F.array(_labelled("adres", F.regexp_replace(piece, "[.,;:)]+$", ""))))
        .when(F.contains(piece, F.lit(" ")), _said(piece))
        .when(F.rlike(piece, F.lit(WRITTEN_DATE)), _written(piece))
        .otherwise(_amount(piece))
    )


def facts(text: Column) -> Column:
    """The distinct facts of a text, sorted, as ``kind:value``. A date is its day and, apart from it, its year."""
    pieces = F.regexp_extract_all(turkish_lower(F.coalesce(text, F.lit(""))), F.lit(PIECE), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(pieces, _told)), lambda x: x.isNotNull())))


def uncovered(these: Column, those: Column) -> Column:
    """Facts of the one that the other has neither as such nor as another kind with the same value."""
    value = lambda f: F.substr(f, F.instr(f, ":") + 1)
    values = F.transform(those, value)
    return F.filter(these, lambda f: ~F.array_contains(values, value(f)))


def fact_diff(original: Column, suggestion: Column) -> tuple[Column, Column]:
    """Facts missing from a suggestion, and facts that it adds."""
    a, b = facts(original), facts(suggestion)
    return uncovered(a, b), uncovered(b, a)

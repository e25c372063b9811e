"""Functions, segmentation and tokens."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from berrak.functions import numbers, turkish
from berrak.operators import segment


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.mark.parametrize(("upper", "lower"), [("SIĞINAK", "sığınak"), ("İZMİR", "izmir"), ("ÇÖP", "çöp")])
def test_case_pairs(spark, upper, lower):
    assert values(spark, [upper], "string", turkish.turkish_lower(F.col("x"))) == [lower]
    assert values(spark, [lower], "string", turkish.turkish_upper(F.col("x"))) == [upper]


def test_letters(spark):
    x = F.col("x")
    assert values(spark, ["istanbul"], "string", turkish.turkish_capitalize(x)) == ["İstanbul"]
    assert values(spark, ["dükkân"], "string", turkish.fold_circumflex(x)) == ["dükkan"]
    assert values(spark, ["abc", "да", "12"], "string", turkish.is_latin(x)) == [True, False, True]
    assert values(spark, ["TBMM", "Tbmm", "12"], "string", turkish.is_upper_word(x)) == [True, False, False]
    assert values(spark, ["kilometre", "İSTANBUL"], "string", turkish.count_vowels(x)) == [4, 3]
    assert values(spark, ["TBMM", "DĞW"], "string", turkish.spell_letters(x)) == [4, 6]
    assert values(spark, ["a/b/çay?.txt", ""], "string", turkish.safe_filename(x)) == ["çay.txt", "belge"]
    assert values(spark, ["a😊b"], "string", turkish.utf16_offset(x, F.lit(2))) == [3]


def test_normalize(spark):
    assert values(spark, ["a\r\nb\rc", "“a” ‘b’ — c", "a​­b", "a   b"], "string", turkish.normalize(F.col("x"))) == ["a\nb\nc", "\"a\" 'b' - c", "ab", "a b"]


ONES = ["", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
TENS = ["", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]


def spoken(n):
    if n == 0:
        return "sıfır"
    out = ""
    for size, name in ((10**9, "milyar"), (10**6, "milyon"), (1000, "bin"), (1, "")):
        g, n = divmod(n, size)
        if g:
            h, r = divmod(g, 100)
            said = ("" if not h else "yüz" if h == 1 else ONES[h] + "yüz") + TENS[r // 10] + ONES[r % 10]
            out += ("" if size == 1000 and g == 1 else said) + name
    return out


def test_integers_read_aloud(spark):
    ns = [0, 1, 7, 10, 21, 99, 100, 101, 205, 999, 1000, 1001, 2000, 15000, 100000, 123456, 1000000, 987654321]
    got = values(spark, list(map(str, ns)), "string", numbers.integer_syllables(F.col("x")))
    assert got == [sum(c in "aeıioöuü" for c in spoken(n)) for n in ns]


@pytest.mark.parametrize(("text", "kind", "n"), [("15.000", "number", 3), ("3,5", "number", 4), ("%10", "percent", 3), ("10.30", "time", 3), ("10.00", "time", 1), ("1.12.2026", "date", 11)])
def test_readings(spark, text, kind, n):
    assert values(spark, [text], "string", numbers.reading_syllables(F.col("x"), F.lit(kind))) == [n]


def test_roman_thousands_and_dates(spark):
    assert values(spark, ["IV", "XIX", "MCMXCIV"], "string", numbers.roman_to_int(F.col("x"))) == [4, 19, 1994]
    assert values(spark, [1234567, 999], "long", numbers.format_thousands(F.col("x"))) == ["1.234.567", "999"]
    assert values(spark, ["2026-12-01"], "string", numbers.readable_date(F.to_date("x"))) == ["1 Aralık 2026 Salı"]


def split(spark, text):
    rows = segment.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("para_idx", "sent_no").collect()
    return rows


@pytest.mark.parametrize(("text", "n"), [("Bir. İki! Üç?", 3), ("Av. Suna aradı. Kapattı.", 2), ("A. Yılmaz geldi.", 1), ("XV. Oturum kapandı.", 1), ("15. madde uygulanır. Bitti.", 2), ("Saat 10.30 oldu.", 1), ("Bitti.\n\nBaşladı.", 2), ("", 0), ("...", 0), ("- Bir\n- İki", 2)])
def test_sentence_counts(spark, text, n):
    assert len(split(spark, text)) == n


def test_headings_items_and_places(spark):
    rows = split(spark, "Su Kesintisi\n\nYarın su yok. Bekleyin.\n\n- Su alın.\n- Bekleyin.")
    assert [(r.is_heading, r.is_list_item) for r in rows] == [(True, False), (False, False), (False, False), (False, True), (False, True)]
    paragraph = "Yarın su yok. Bekleyin."
    assert [paragraph[r.start : r.start + len(r.text)] for r in rows[1:3]] == [r.text for r in rows[1:3]]


def test_suppression_and_markup(spark):
    rows = split(spark, "<!-- berrak: ignore KD-C01 kd-k03 --> Bir <b>iki</b> [üç](http://x).\n\n<!-- berrak: ignore -->Dört.\n\nBeş.")
    assert [sorted(r.suppressed) for r in rows] == [["KD-C01", "KD-K03"], ["*"], []]
    assert rows[0].text.split() == ["Bir", "iki", "üç", "."] and rows[0].start + len(rows[0].text) == len("<!-- berrak: ignore KD-C01 kd-k03 --> Bir <b>iki</b> [üç](http://x).")


def test_token_kinds(spark):
    text = "Saat 10.30'da 15.09.2026 günü %5 (3,5) TBMM a@b.com www.x.com/y. 12-34 Ali'nin"
    rows = segment.tokens(segment.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("sent_no", "tok_idx").collect()
    assert [(r.token, r.kind) for r in rows if r.kind != "punct"] == [("Saat", "word"), ("10.30'da", "time"), ("15.09.2026", "date"), ("günü", "word"), ("%5", "percent"), ("3,5", "number"), ("TBMM", "word"), ("a@b.com", "email"), ("www.x.com/y", "url"), ("12-34", "number"), ("Ali'nin", "word")]
    assert [r.token for r in rows if r.is_abbreviation] == ["TBMM"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab İıĞ.!?\n-1\t“x", max_size=80))
def test_no_letter_is_lost(spark, text):
    rows = split(spark, text)
    keep = lambda x: re.sub(r"[^\w]", "", x)
    assert keep("".join(r.text for r in rows)) == keep(text)

"""Counts, readability formulas, statistics and the language gate, by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berrak.operators.segment import COUNTED, WORD_LIKE

#: Fixed values of the formulas.
ATESMAN = (198.825, 40.175, 2.610)
ATESMAN_LEVELS = [(90, "çok kolay"), (70, "kolay"), (50, "orta güçlükte"), (30, "zor")]
CETINKAYA_UZUN = (118.823, 25.987, 0.971)
BEZIRCI_YILMAZ = (0.84, 1.5, 3.5, 26.25)
#: English function words of the language gate; none of them is a Turkish word as well, as "on", "an", "is" or "as" may be.
ENGLISH = ["the", "and", "of", "to", "that", "for", "with", "are", "this", "be", "by", "from", "it", "was", "were", "or", "which", "have", "they", "you"]


def counts(sents: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """words, sentences, syllables and words of 3, 4, 5, and 6 or more syllables, outside headings.

    ``sents``: sentences with ``toks``. Each is counted where it lies, so that only sums are shuffled.
    """
    own = F.transform(F.filter("toks", lambda x: x["kind"].isin(*COUNTED)), lambda x: F.greatest(F.lit(1), x["syllables"]))
    used = sents.where(~F.col("is_heading")).withColumn("syl", own)
    size = lambda n: F.sum(F.size(F.filter("syl", lambda x: x == n if n < 6 else x >= 6)))
    sums = F.sum(F.size("syl")).alias("words"), F.count_if(F.size("syl") > 0).alias("sentences"), F.sum(F.aggregate("syl", F.lit(0), lambda a, x: a + x)).alias("syllables")
    return used.groupBy(*key).agg(*sums, *[size(n).alias(f"h{n}") for n in (3, 4, 5, 6)]).where("words > 0")


def atesman(syllables_per_word: Column, words_per_sentence: Column) -> Column:
    a, b, c = ATESMAN
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), a - b * syllables_per_word - c * words_per_sentence))


def atesman_level(value: Column) -> Column:
    out = F.lit("çok zor")
    for least, name in reversed(ATESMAN_LEVELS):
        out = F.when(value >= least, name).otherwise(out)
    return out


def cetinkaya_uzun(syllables_per_word: Column, words_per_sentence: Column) -> Column:
    a, b, c = CETINKAYA_UZUN
    return a - b * syllables_per_word - c * words_per_sentence


def cetinkaya_uzun_level(raw: Column) -> Column:
    return F.when(raw >= 51, "bağımsız okuma düzeyi").when(raw >= 35, "eğitsel okuma düzeyi").when(raw >= 0, "engellenmiş okuma düzeyi (zor)").otherwise("engellenmiş okuma düzeyi (ölçeğin altında, çok zor)")


def bezirci_yilmaz(words_per_sentence: Column, *per_sentence: Column) -> Column:
    return F.sqrt(words_per_sentence * sum((w * h for w, h in zip(BEZIRCI_YILMAZ[1:], per_sentence[1:], strict=True)), BEZIRCI_YILMAZ[0] * per_sentence[0]))


def bezirci_yilmaz_level(value: Column) -> Column:
    return F.when(value <= 8, "ilköğretim düzeyi").when(value <= 12, "lise düzeyi").when(value <= 16, "lisans düzeyi").otherwise("akademik düzey")


def scores(counted: DataFrame) -> DataFrame:
    """The three formulas and their levels; the values are not rounded. Documents without words have no row."""
    spw, wps = F.col("syllables") / F.col("words"), F.col("words") / F.col("sentences")
    raw = cetinkaya_uzun(spw, wps)
    years = bezirci_yilmaz(wps, *[F.col(f"h{n}") / F.col("sentences") for n in (3, 4, 5, 6)])
    return counted.withColumns({
        "atesman": atesman(spw, wps), "atesman_level": atesman_level(atesman(spw, wps)),
        "cetinkaya_uzun": F.greatest(F.lit(0.0), raw), "cetinkaya_uzun_level": cetinkaya_uzun_level(raw),
        "bezirci_yilmaz": years, "bezirci_yilmaz_level": bezirci_yilmaz_level(years), "grade": F.greatest(F.lit(1), F.bround(years).cast("int")),
    })


def statistics(sents: DataFrame) -> DataFrame:
    """Words of all sentences (with ``toks``), and of the body: sentences, paragraphs, the longest sentence (the
    first of equals; -1 where there is none) and its words."""
    of = sents.select("doc_id", "para_idx", "sent_no", "is_heading", F.size(F.filter("toks", lambda x: x["kind"].isin(*WORD_LIKE))).alias("n"))
    body, some = ~F.col("is_heading"), F.col("n") > 0
    order = F.struct("n", -F.col("para_idx"), -F.col("sent_no"))
    return of.groupBy("doc_id").agg(
        F.sum("n").alias("word_count"), F.count_if(body & some).alias("sentence_count"), F.count_distinct(F.when(some, F.col("para_idx"))).alias("paragraph_count"),
        F.coalesce(F.max(F.when(body, F.col("n"))), F.lit(0)).cast("long").alias("longest_words"),
        *[F.coalesce(F.max_by(F.when(body & some, F.col(c)), F.when(body & some, order)), F.lit(-1)).alias(n) for c, n in (("para_idx", "longest_para"), ("sent_no", "longest_sent"))],
    ).where("word_count > 0")


def language_gate(sents: DataFrame) -> DataFrame:
    """Whether each document may be Turkish: few words, or mostly Latin letters and few English function words."""
    words = F.transform(F.filter("toks", lambda x: x["kind"] == "word"), lambda x: x["token"])
    rows = sents.select("doc_id", words.alias("words")).withColumn("line", F.array_join("words", ""))
    letters = F.length(F.regexp_replace("line", "[^\\p{L}]", ""))
    english = F.size(F.filter("words", lambda x: F.lower(x).isin(*ENGLISH)))
    return gate(rows.select("doc_id", F.size("words").alias("n_plain"), letters.alias("letters"), F.length(F.regexp_replace("line", LATIN, "")).alias("foreign"), english.alias("english")))


#: What is no letter, or a Latin one.
LATIN = "[\\P{L}\\p{IsLatin}]"


def foreign(text: Column, toks: Column) -> Column:
    """How many letters of the words of a sentence are of another script; its words are looked at where the text has any."""
    line = F.array_join(F.transform(F.filter(toks, lambda x: x["kind"] == "word"), lambda x: x["token"]), "")
    return F.when(F.rlike(text, F.lit("[\\p{L}&&[^\\p{IsLatin}]]")), F.length(F.regexp_replace(line, LATIN, ""))).otherwise(0)


def gate(counted: DataFrame) -> DataFrame:
    """``language_gate`` by the counts of sentences: n_plain, letters, foreign and english."""
    by = counted.groupBy("doc_id").agg(F.sum("n_plain").alias("n_words"), *[F.sum(c).alias(c) for c in ("letters", "foreign", "english")]).where("n_words > 0")
    other = (F.col("foreign") > 0.5 * F.col("letters")) | ((F.col("english") >= 3) & (F.col("english") >= 0.2 * F.col("n_words")))
    return by.withColumn("looks_turkish", (F.col("n_words") < 3) | ~other)

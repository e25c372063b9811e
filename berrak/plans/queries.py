"""The library's operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from berrak.functions.arrays import let
from berrak.functions.numerals import is_numeral, number_words, numeral_value, possessive
from berrak.operators import facts as facts_
from berrak.operators import findings as findings_
from berrak.operators import asides as asides_
from berrak.operators import matching, morphology, names, offsets, readability, rewriting, rules, segment
from berrak.plans.auditor import Audit
from berrak.plans.config import load_profile
from berrak.plans.turkish_view import BENT, turkish_documents
from berrak.sources import readers, sinks
from berrak.sources.storage import table, written
from berrak.streaming import stream

#: A lexicon of words that occur in the test documents, as a user would bring one.
LEXICON = {
    "jargon": [{"ifade": "of the", "oneri": "of", "ek": False}, "the", "in the and", "que la"],
    "yabanci": [{"kelime": "und", "oneri": "ve", "ek": False}, {"kelime": "that", "sabit": True, "ek": False}],
    "es_anlamlilar": [{"grup": ["the", "der", "la"], "ek": False}, {"grup": ["and", "und", "et", "y"], "ek": False}],
}
SENT = ["doc_id", "para_idx", "sent_no"]
#: What phrases read of a token.
MET = ("k", "kind", "low")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(_docs(spark, sf_dir))


def _toks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.tokens(_sents(spark, sf_dir).select(*SENT, "text", "is_heading", "is_list_item")).drop("text")


def _told(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Sentences with some fields of their tokens."""
    return segment.with_tokens(_sents(spark, sf_dir).select(*SENT, "text", "is_heading", "is_list_item"), fields=fields)


def _audit(spark: SparkSession, sf_dir: str) -> Audit:
    return Audit(_docs(spark, sf_dir), lexicon=LEXICON)


def _found(rule: str, written: Callable[[Column], Column] = lambda text: text) -> Callable[[SparkSession, str], DataFrame]:
    """Findings of one rule; ``written`` puts into the documents what the rule looks for and they lack."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _docs(spark, sf_dir).withColumn("text", written(F.col("text")))
        t = rules.tables(docs, load_profile("kolay-dil"), {"kisaltmalar": [], "jargon": [], "es_anlamlilar": [], "dolayli_hitap": []}, [rule], once=True)
        r = rules.audit(t, [rule])
        # -1 stands for a finding about a whole paragraph or document.
        return r.select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("para_idx", "sent_no")], F.md5("text").alias("text_md5"), "severity")

    query.__doc__ = f"Findings of {rule}."
    return query


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.with_normal_text(_docs(spark, sf_dir))
    return rows.select("doc_id", F.length("norm").alias("n_chars"), F.md5("norm").alias("norm_md5"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.paragraphs(_docs(spark, sf_dir)).select("doc_id", "para_idx", F.md5("text").alias("text_md5"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sents(spark, sf_dir).select(*SENT, F.md5("text").alias("text_md5"), "is_heading", "is_list_item")


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toks(spark, sf_dir).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("syllables").alias("syllables"), F.count_if("is_abbreviation").alias("n_abbreviations"))


def readability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readability.scores(readability.counts(_told(spark, sf_dir, "kind", "syllables")))
    return rows.select("doc_id", "words", "sentences", "syllables", "h3", "h4", "h5", "h6", *[F.round(c, 6).alias(c) for c in ("atesman", "cetinkaya_uzun", "bezirci_yilmaz")], "atesman_level", "cetinkaya_uzun_level", "bezirci_yilmaz_level")


def readability_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the first formula by language and source, by language, and over all."""
    counted = readability.counts(_told(spark, sf_dir, "kind", "syllables"))
    rows = counted.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    by = rows.rollup("lang", "source").agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in ("words", "sentences", "syllables")])
    return by.withColumn("atesman", F.round(readability.atesman(F.col("syllables") / F.col("words"), F.col("words") / F.col("sentences")), 6))


def syllable_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = _toks(spark, sf_dir).where(F.col("kind").isin(*segment.COUNTED) & ~F.col("is_heading"))
    return toks.groupBy(F.least(F.greatest(F.lit(1), "syllables"), F.lit(6)).alias("syllables")).agg(F.count("*").alias("n"))


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.statistics(_told(spark, sf_dir, "kind"))


def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.language_gate(_told(spark, sf_dir, "token", "kind"))


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matches(_told(spark, sf_dir, *MET), matching.lexicon_entries(spark, LEXICON)).where("list not like 'es:%'").select(*SENT, "list", "phrase", "first_tok", "last_tok")


def term_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once, as counts and places are read apart
    matched = written(matching.matches(_told(spark, sf_dir, *MET).where("not is_heading"), matching.lexicon_entries(spark, LEXICON)), "terms")
    found = matching.term_consistency(matched)
    return found.groupBy("doc_id", F.col("group").alias("group_id"), "term", "dominant").agg(F.count("*").alias("n"))


def markup_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = segment.mask_markup(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(masked).alias("n_chars"), F.md5(masked).alias("masked_md5"))


def fact_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that each answer leaves out of the question before it, and facts that it adds."""
    rows = table(spark, sf_dir, "conversations").withColumn("said", F.coalesce("text", F.lit("")))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "said").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("role") == "user", F.col("said")), ignorenulls=True).over(so_far)
    answers = rows.withColumn("asked", asked).where("role = 'assistant'")
    missing, added = facts_.fact_diff(F.col("asked"), F.col("said"))
    return answers.select("conv_id", "turn", F.array_join(missing, ";").alias("missing"), F.array_join(added, ";").alias("added"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of lines, every third spread out by letters, with spaces before commas, as extraction gives them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    spread = F.regexp_replace("line", "(\\p{L})", "$1 ")
    return rows.withColumn("line", F.replace(F.when(F.col("line_no") % 3 == 1, spread).otherwise(F.col("line")), F.lit(","), F.lit(" ,")))


def tidy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with whole words, paragraphs and no spaces before signs."""
    return readers.tidy_pages(_lines(spark, sf_dir)).select("doc_id", "n_breaks", F.md5("text").alias("text_md5"))


def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its headings and items without their marks."""
    clean = rewriting.clean_text(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.length(clean).alias("n_chars"), F.md5(clean).alias("clean_md5"))


def punctuated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a full stop at the lines that lack one."""
    done = rewriting.punctuate(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.length(done).alias("n_chars"), F.md5(done).alias("done_md5"))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", facts_.facts(F.col("text")).alias("found"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_facts"), F.md5(F.array_join("found", ";")).alias("facts_md5"))


def proper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many forms every document uses as names, and which. Some capitals are planted, with and without an apostrophe."""
    text = F.replace(F.replace(F.col("text"), F.lit(" queque "), F.lit(" Queque'nin ")), F.lit(". The "), F.lit(". Theo "))
    found = _docs(spark, sf_dir).select("doc_id", names.proper_forms(names.plain_text(text)).alias("names"))
    return found.select("doc_id", F.size("names").alias("n_names"), F.md5(F.array_join("names", ",")).alias("names_md5"))


def original_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every line of the normalised documents stands in documents with letters in two code points, line ends of two, and wider gaps."""
    loose = F.coalesce("text", F.lit(""))
    for tight, wide in (("é", "e\u0301"), ("ö", "o\u0308"), ("\n", "\r\n"), (". ", ". \u200b ")):
        loose = F.replace(loose, F.lit(tight), F.lit(wide))
    docs = _docs(spark, sf_dir).withColumn("text", loose)
    found = offsets.located_lines(docs).select("doc_id", F.posexplode_outer("lines").alias("line_no", "p")).where("p.end > p.start")
    return found.select("doc_id", "line_no", "p.start", "p.end", "p.orig_start", "p.orig_end", F.md5("p.original").alias("original_md5"))


def recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur at the edges of several documents of a source, as a header or footer would."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return readers.recurring_lines(rows, share=0.0).select(F.col("doc_id").alias("source"), F.md5("key").alias("key_md5"), "n")


def compliance_c01_m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by two rules alone, long sentences and long texts, as its SQL works them out. ``compliance_all_rules`` has all rules."""
    audit = Audit(_docs(spark, sf_dir), only=["KD-C01", "KD-M05"])
    rows = findings_.compliance(audit.findings, audit.sentence_counts, audit.profile)
    return rows.select("doc_id", F.col("sentence_count").cast("long").alias("sentence_count"), F.round("penalty", 4).alias("penalty"), F.col("finding_count").cast("long").alias("finding_count"), F.coalesce("score", F.lit(-1)).alias("score"), "reliable")


def compliance_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by all enabled rules; -1 stands for no score: no sentences, or a text that isn't Turkish."""
    rows = _audit(spark, sf_dir).compliance
    return rows.select("doc_id", F.col("sentence_count").cast("long").alias("sentence_count"), F.round("penalty", 4).alias("penalty"), F.col("finding_count").cast("long").alias("finding_count"), F.coalesce("score", F.lit(-1)).alias("score"), "reliable", "looks_turkish")


def morphology_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct words of the documents each ending marks."""
    marked = segment.distinct_words(_docs(spark, sf_dir)).select(F.explode_outer(morphology.flags(F.col("low"))).alias("flag"))
    return marked.where("flag is not null").groupBy("flag").agg(F.count("*").alias("n"))


def _turkish(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Sentences with tokens of the Turkish documents."""
    return segment.with_tokens(segment.sentences(turkish_documents(_docs(spark, sf_dir))).select(*SENT, "text", "is_heading", "is_list_item"), fields=fields)


def _turkish_found(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    """Findings of one rule in the Turkish documents, with what it suggests."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = rules.tables(turkish_documents(_docs(spark, sf_dir)), load_profile("kolay-dil"), {"kisaltmalar": [], "jargon": [], "es_anlamlilar": [], "dolayli_hitap": []}, [rule], once=True)
        return rules.audit(t, [rule]).select(*SENT, "start", "text", F.coalesce("suggestion", F.lit("")).alias("suggestion"), F.coalesce("fix", F.lit("")).alias("fix"), "severity")

    query.__doc__ = f"Findings of {rule} in Turkish documents."
    return query


def bent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of the lexicon whose last word takes endings, as they stand in the Turkish documents."""
    found = matching.matches(_turkish(spark, sf_dir, *MET), matching.lexicon_entries(spark, BENT))
    return found.select(*SENT, "list", "phrase", "said", "start", "first_tok", "last_tok")


def aside_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every sentence of the Turkish documents stand in brackets and in quotation marks, and how deep brackets go."""
    rows = _turkish(spark, sf_dir, "token", "kind").withColumn("b", asides_.brackets(F.col("toks")))
    inside = lambda own: F.size(F.filter("toks", lambda x, i: (x["kind"] == "word") & asides_.within(own, i)))
    return rows.select(*SENT, F.col("b.deepest").alias("deepest"), let(F.col("b.done"), inside).alias("n_bracketed"), let(asides_.quotations(F.col("toks")), inside).alias("n_quoted"))


def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of every order in words, read back, with its ending; and whether its words from the last to the first are a numeral too."""
    n = F.col("o_orderkey") * 7919 + F.coalesce(F.floor("o_totalprice"), F.lit(0)) * 1000
    said = table(spark, sf_dir, "orders").select("o_orderkey", n.cast("long").alias("n")).withColumn("words", number_words(F.col("n")))
    return said.select("o_orderkey", "n", F.array_join("words", " ").alias("words"), numeral_value("words").alias("back"), is_numeral(F.col("words")).alias("is_one"), is_numeral(F.reverse("words")).alias("reversed_is_one"), possessive(F.col("n")).alias("possessive"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a limit of 3 a day and user lets through."""
    return stream.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", 3, 86_400.0)


def fixed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with the fixes of its findings, by all enabled rules, applied."""
    audit = _audit(spark, sf_dir)
    one = F.struct("start", (F.col("start") + F.length("text")).alias("end"), F.col("fix").alias("text"))
    fixes = audit.findings.where("fix is not null").groupBy(*SENT).agg(F.collect_list(one).alias("fixes"))
    every = audit.tables.sents.select(*SENT, F.col("text").alias("sentence")).join(fixes, SENT, "left")
    chosen = every.withColumn("taken", findings_.applicable_fixes(F.coalesce("fixes", F.array()), F.length("sentence")))
    return chosen.select(*SENT, F.size("taken").alias("n_fixes"), findings_.apply_fixes(F.col("sentence"), F.col("taken")).alias("fixed"))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all rules."""
    return _audit(spark, sf_dir).findings


def audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report of every document, over all enabled rules."""
    audit = _audit(spark, sf_dir)
    return sinks.reports(audit.findings, audit.compliance)


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by category, over all enabled rules."""
    return _audit(spark, sf_dir).categories.withColumn("penalty", F.round("penalty", 4))


#: The documents in other spellings: bracketed asides, semicolons, a first part in capitals, Roman numerals.
ASIDE = ", ([^,.;()\n]{5,60}),"
SPELLINGS: dict[str, Callable[[Column], Column]] = {
    "KD-C09": lambda text: F.regexp_replace(text, ASIDE, " ($1)"),
    "KD-B06": lambda text: F.replace(text, F.lit(", "), F.lit("; ")),
    "KD-B07": lambda text: F.concat(F.translate(F.substring(text, 1, 200), ascii_lowercase, ascii_uppercase), F.substr(text, F.lit(201))),
    "KD-B02": lambda text: F.replace(F.replace(text, F.lit(" the "), F.lit(" XIV ")), F.lit(" die "), F.lit(" I. ")),
}

QUERIES = {
    f.__name__: f
    for f in (normalized_text, paragraphs, sentences, token_kinds, readability_scores, readability_by_source, syllable_histogram, document_statistics, language_gate, phrase_match, term_consistency, markup_mask, tidy_pages, cleaned_text, punctuated_text, fact_diff, document_facts, proper_names, original_places, recurring_lines, compliance_c01_m05, compliance_all_rules, morphology_flags, numerals, bent_phrases, aside_words, rate_limit, fixed_text, audit_findings, audit_reports, category_scores)
} | {
    "long_sentences_c01": _found("KD-C01"), "parenthesis_c09": _found("KD-C09", SPELLINGS["KD-C09"]), "first_abbreviation_k03": _found("KD-K03"), "roman_b02": _found("KD-B02", SPELLINGS["KD-B02"]), "semicolons_b06": _found("KD-B06", SPELLINGS["KD-B06"]),
    "caps_runs_b07": _found("KD-B07", SPELLINGS["KD-B07"]), "quotes_b08": _found("KD-B08"), "long_paragraph_m01": _found("KD-M01"), "no_heading_m02": _found("KD-M02"), "list_opportunity_m03": _found("KD-M03"), "long_text_m05": _found("KD-M05"),
    "number_words_b01": _turkish_found("KD-B01"), "percentages_b03": _turkish_found("KD-B03"), "times_b05": _turkish_found("KD-B05"),
}

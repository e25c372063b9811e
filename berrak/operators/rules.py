"""The rules: what each finds in a sentence, as array expressions, and in documents, as plans.

A sentence carries its tokens as an array. Most rules are a column over one sentence row: an array of
what they find there. All of them stand in one projection, so that an audit passes once over the
sentences, nothing is shuffled, and Catalyst never sees rules that are off. Rules about a word's
first use, or about whole documents, are plans over the sentences; they shuffle only what they count.

A finding has the token where it begins (or the start itself, within the sentence), text, message,
suggestion, fix, confidence and severity. A null severity means the profile's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from berrak.functions import numbers
from berrak.functions.arrays import let
from berrak.functions.numerals import NUMBER_WORDS, is_numeral, numeral_value, possessive
from berrak.functions.turkish import MONTHS, WEEKDAYS, is_upper_word, quote, turkish_capitalize, turkish_lower
from berrak.operators import asides, matching, morphology, names, readability
from berrak.operators.segment import CLOSE, FIELDS, OPEN, WORD_LIKE, _placed, sentences, with_tokens
from berrak.operators.words import COUNTS, DENYING, marked, told
from berrak.plans.config import Profile
from berrak.sources.storage import written

SENT = ["doc_id", "para_idx", "sent_no"]
FINDING = [*SENT, "tok_idx", "start", "text", "message", "suggestion", "fix", "confidence", "severity"]
FOUND = "struct<tok:int,start:int,text:string,message:string,suggestion:string,fix:string,confidence:double,severity:string>"


@dataclass
class Tables:
    """What rules read: sentences with their tokens, phrases of the lexicon in them, and settings."""

    sents: DataFrame
    matched: DataFrame | None
    lexicon: Mapping[str, Any]
    profile: Profile

    @property
    def body(self) -> DataFrame:
        return self.sents.where(~F.col("is_heading"))

    def param(self, rule: str, name: str, default: Any) -> Any:
        return self.profile.param(rule, name, default)


@dataclass(frozen=True)
class Rule:
    """``each``: what it finds in a sentence row, an array column; ``plan``: rows of ``FINDING``. One of them is given."""

    id: str
    name: str
    category: str
    severity: str
    each: Callable[[Tables], Column] | None = None
    plan: Callable[[Tables], DataFrame] | None = None


RULES: dict[str, Rule] = {}


def rule(id_: str, name: str, category: str, severity: str = "uyarı", plan: bool = False) -> Callable[[Callable], Callable]:
    """Registers a rule under its id: a function of ``Tables`` to a column, or with ``plan`` to rows."""

    def add(make: Callable) -> Callable:
        RULES[id_] = Rule(id_, name, category, severity, **{"plan" if plan else "each": make})
        return make

    return add


def _lit(x: Column | str | float | None, kind: str) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(kind)


def _fields(text: Column, message: Column | str, tok: Column | None, start: Column | None, suggestion: Column | None, fix: Column | None, confidence: Column | float, severity: Column | str | None) -> dict[str, Column]:
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _lit(confidence, "double"))), 2)
    return {
        "tok": _lit(tok, "int"), "start": _lit(start, "int") if start is not None else F.lit(None if tok is not None else 0).cast("int"), "text": text, "message": _lit(message, "string"),
        "suggestion": _lit(suggestion, "string"), "fix": F.nullif(fix, text) if fix is not None else F.lit(None).cast("string"), "confidence": score, "severity": _lit(severity, "string"),
    }


def hit(text: Column, message: Column | str, tok: Column | None = None, start: Column | None = None, suggestion: Column | None = None, fix: Column | None = None, confidence: Column | float = 1.0, severity: Column | str | None = None) -> Column:
    """One finding as a struct. ``tok``: the token where it begins; else ``start`` says where, by default 0."""
    return F.struct(*[v.alias(k) for k, v in _fields(text, message, tok, start, suggestion, fix, confidence, severity).items()])


def finding(rows: DataFrame, text: Column, message: Column | str, **more: Any) -> DataFrame:
    """Finding rows of a plan; ``tok``, or a column tok_idx, is the token where a finding begins."""
    place = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("int")
    if "tok" not in more and "tok_idx" in rows.columns:
        more["tok"] = F.col("tok_idx")
    own = _fields(text, message, *(more.get(k) for k in ("tok", "start", "suggestion", "fix")), more.get("confidence", 1.0), more.get("severity"))
    return rows.select("doc_id", place("para_idx").alias("para_idx"), place("sent_no").alias("sent_no"), *[v.alias("tok_idx" if k == "tok" else k) for k, v in own.items()])


TOKS = "toks"


def empty() -> Column:
    return F.array().cast(f"array<{FOUND}>")


def one(when: Column, found: Column) -> Column:
    """An array of one finding where a condition holds."""
    return F.when(when, F.array(found.cast(FOUND))).otherwise(empty())


def each(of: Column, when: Callable[[Column, Column], Column], found: Callable[[Column, Column], Column]) -> Column:
    """A finding for each token (with its number among the tokens) that meets a condition."""
    chosen = F.filter(F.transform(of, lambda x, i: F.when(when(x, i), F.struct(x.alias("t"), i.alias("i")))), lambda x: x.isNotNull())
    return F.transform(chosen, lambda x: found(x["t"], x["i"]).cast(FOUND))


def tok(i: Column) -> Column:
    """The token of a number; null where there is none."""
    return F.get(F.col(TOKS), i)


def numbered(when: Callable[[Column], Column], of: Column | str = TOKS) -> Column:
    """Tokens that meet a condition, as structs of t and i."""
    return F.filter(F.transform(of, lambda x, i: F.when(when(x), F.struct(x.alias("t"), i.alias("i")))), lambda x: x.isNotNull())


def texts(of: Column) -> Column:
    """The tokens of numbered tokens, with a space between."""
    return F.array_join(F.transform(of, lambda x: x["t"]["token"]), " ")


def islands(of: Column, apart: Callable[[Column, Column], Column]) -> Column:
    """Numbered tokens as arrays, cut where two neighbours are apart; none without tokens."""

    def cut(own: Column) -> Column:
        n = F.size(own)
        new = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | F.coalesce(apart(F.get(own, k - 1), F.get(own, k)), F.lit(True)))
        return let(new, lambda cuts: F.transform(cuts, lambda a, k: F.slice(own, a + 1, F.coalesce(F.get(cuts, k + 1), n) - a)))

    return let(of, lambda own: F.when(F.size(own) > 0, cut(own)))


def flagged(name: str) -> Callable[[Column], Column]:
    return lambda x: marked(x["m"], name) & (x["kind"] == "word")


def placed_matches(text: Column, pattern: str) -> Column:
    """Every match of a pattern as at and piece, empty ones left out.

    Starts are counted from the pieces between matches, which are cut at the matches.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(_placed(pieces), lambda x, k: (k % 2 == 1) & (x["piece"] != ""))).otherwise(F.array().cast("array<struct<at:int,piece:string>>"))


def spans(rows: DataFrame, pattern: str) -> DataFrame:
    """A row per match of a pattern in ``text``, with the match and where it starts."""
    found = rows.select("*", F.explode(placed_matches(F.col("text"), pattern)).alias("m"))
    return found.select(*rows.columns, F.col("m.piece").alias("hit"), F.col("m.at").alias("at"))


BODY = lambda: ~F.col("is_heading")
#: Words that join clauses.
JOINING = ["ve", "veya", "ama", "fakat", "ancak", "çünkü", "yoksa", "oysa", "ki", "hem", "ya", "yahut", "sonra"]
STOPS = [".", "!", "?", "…", ";"]


# sentences


@rule("KD-C01", "Uzun cümle", "cümle")
def long_sentence(t: Tables) -> Column:
    warn, error = (t.param("KD-C01", n, v) for n, v in (("warn_above", 10), ("error_above", 15)))
    found = lambda n: one(n > warn, hit(F.col("text"), F.concat(F.lit("Cümle "), n.cast("string"), F.lit(" kelime.")), severity=F.when(n > error, "hata").otherwise("uyarı")))
    return F.when(BODY(), let(n_words(t), found))


@rule("KD-C02", "Birden çok yargı", "cümle")
def many_clauses(t: Tables) -> Column:
    """Finite verbs where a clause may end: before punctuation, a joining word or the sentence's end. An order
    counts at the sentence's end, or before a comma and a joining word. A condition tells nothing yet, and
    before a joining word a bare -Ar or -Ir may be a noun's; so may any plural that no tense stands before. Asides in brackets or quotation marks don't count."""
    most = t.param("KD-C02", "max_predicates", 1)

    def ends(x: Column, i: Column) -> Column:
        after, further = tok(i + 1), tok(i + 2)
        stop = after.isNull() | after["token"].isin(*STOPS)
        joins = after["low"].isin(*JOINING)
        order = marked(x["m"], "order") & (stop | ((after["token"] == ",") & further["low"].isin(*JOINING)))
        sure = ~F.rlike(x["low"], F.lit(morphology.CONDITION)) & (~joins | ~F.rlike(x["low"], F.lit(morphology.BARE)))
        sure = sure & (~F.rlike(x["low"], F.lit(morphology.PLURAL)) | F.rlike(x["low"], F.lit(morphology.VERBAL_PLURAL)))
        return marked(x["m"], "finite_form", "order") & (x["kind"] == "word") & ((marked(x["m"], "finite_form") & sure & (stop | joins | (after["token"] == ","))) | order)

    count = lambda own: F.size(F.filter(F.transform(own, lambda x, i: F.coalesce(ends(x, i), F.lit(False))), lambda x: x))
    n = let(asides.outside(F.col(TOKS)), count)
    return F.when(BODY(), let(n, lambda n: one(n > most, hit(F.col("text"), F.concat(F.lit("Cümlede "), n.cast("string"), F.lit(" yargı var.")), confidence=0.6))))


@rule("KD-C03", "Edilgen çatı", "cümle")
def passive(t: Tables) -> Column:
    return F.when(BODY(), each(F.col(TOKS), lambda x, i: flagged("passive")(x) & ~_named_word(x), lambda x, i: hit(x["token"], F.concat(quote(x["token"]), F.lit(" edilgen.")), tok=i, confidence=0.6, severity=F.when(marked(x["m"], "reflexive"), "bilgi"))))


def _negative(x: Column) -> Column:
    return (x["kind"] == "word") & (marked(x["m"], "negative") | x["low"].isin(*DENYING))


def _first(words: Column, message: str) -> Column:
    """A finding for the first of numbered tokens."""
    return let(F.get(words, F.lit(0)), lambda x: one(x.isNotNull(), hit(x["t"]["token"], message, tok=x["i"], confidence=0.6)))


@rule("KD-C04", "Olumsuzluk", "cümle")
def negation(t: Tables) -> Column:
    """The first negation outside of asides: a negative verb, "değil", or a negative pronoun. "yok" alone has no plainer positive."""
    found = let(asides.outside(F.col(TOKS)), lambda own: numbered(_negative, own))
    return F.when(BODY(), _first(found, "Cümleyi olumlu kurun."))


@rule("KD-C05", "Çift olumsuzluk", "cümle", "hata")
def double_negation(t: Tables) -> Column:
    """A negation within the clause, and one that tells it at most six tokens later."""
    inner = numbered(lambda x: flagged("inner_negative")(x) & ~marked(x["m"], "negative"))
    outer = lambda x: (x["kind"] == "word") & (marked(x["m"], "negative") | F.rlike(x["low"], F.lit("^(?:değil|yok)")))
    both = F.filter(inner, lambda x: F.exists(F.slice(F.col(TOKS), x["i"] + 2, F.lit(6)), lambda y: F.coalesce(outer(y), F.lit(False))))
    return F.when(BODY(), _first(both, "İki olumsuzluk birbirini götürüyor."))


def _stack(words: Column, least: int, message: str) -> Column:
    return one(F.size(words) >= least, hit(texts(words), message, tok=F.get(words, F.lit(0))["i"], confidence=0.6))


@rule("KD-C06", "Ulaç yığılması", "cümle")
def converb_stack(t: Tables) -> Column:
    words = numbered(lambda x: flagged("converb")(x) | (flagged("participle")(x) & ~marked(x["m"], "finite_form")))
    return F.when(BODY(), let(words, lambda w: _stack(w, t.param("KD-C06", "threshold", 2), "Yan cümleleri ayırın.")))


@rule("KD-C07", "Ad-fiil yığılması", "cümle")
def nominal_stack(t: Tables) -> Column:
    """Sentences with ``threshold`` nominals, and others with a verbal noun right before a word that tells it (``morphology.TOLD_BY``)."""
    message = "Ad-fiilleri çekimli fiile çevirin."
    least = t.param("KD-C07", "threshold", 2)

    def told(x: Column, i: Column) -> Column:
        after = tok(i + 1)["low"]
        return reduce(lambda a, b: a | b, [F.rlike(x["low"], F.lit(noun)) & F.rlike(after, F.lit(by)) for noun, by in morphology.TOLD_BY])

    pairs = numbered(lambda x: (x["kind"] == "word") & F.rlike(x["low"], F.lit("m[ae]")))
    first = F.get(F.filter(pairs, lambda x: F.coalesce(told(x["t"], x["i"]), F.lit(False))), F.lit(0))
    alone = let(first, lambda x: one(x.isNotNull(), hit(F.concat_ws(" ", x["t"]["token"], tok(x["i"] + 1)["token"]), message, tok=x["i"])))
    return F.when(BODY(), let(numbered(flagged("nominal")), lambda w: F.when(F.size(w) >= least, _stack(w, least, message)).otherwise(alone)))


@rule("KD-C08", "Tamlama zinciri", "cümle")
def genitive_chain(t: Tables) -> Column:
    """Genitives at most three tokens apart."""
    least = t.param("KD-C08", "chain", 3)
    runs = F.filter(F.coalesce(islands(numbered(flagged("genitive")), lambda a, b: b["i"] - a["i"] > 3), F.array()), lambda w: F.size(w) >= least)
    return F.when(BODY(), F.transform(runs, lambda w: hit(texts(w), "Tamlamayı bölün.", tok=F.get(w, F.lit(0))["i"], confidence=0.6).cast(FOUND)))


@rule("KD-C09", "Parantez içi bilgi", "cümle")
def parenthesis(t: Tables) -> Column:
    found = F.filter(placed_matches(F.col("text"), "\\([^()]*\\p{L}[^()]*\\)"), lambda x: ~F.rlike(x["piece"], F.lit("^\\((?:\\p{Lu}{2,6}|[0-9 +()-]+)\\)$")))
    return F.when(BODY(), F.transform(found, lambda x: hit(x["piece"], "Parantez içindeki bilgiyi ayrı cümle yapın.", start=x["at"]).cast(FOUND)))


@rule("KD-C10", "Geç gelen yüklem", "cümle", "bilgi")
def late_predicate(t: Tables) -> Column:
    """Sentences with a side clause before a predicate that comes after more than ``max_gap`` words."""
    gap = t.param("KD-C10", "max_gap", 6)

    def late(words: Column) -> Column:
        places = lambda when: F.transform(words, lambda m, i: F.when(when(m), i))
        last, side = F.array_max(places(lambda m: marked(m, "finite_form"))), F.array_min(places(lambda m: marked(m, "converb", "participle", "nominal")))
        return let(F.struct(last.alias("last"), side.alias("side")), lambda x: one((x["last"] - 1 > gap) & (x["side"] < x["last"]), hit(F.col("text"), "Yüklemi öne alın.", confidence=0.6)))

    return F.when(BODY() & ~F.col("is_list_item"), let(F.transform(F.filter(TOKS, lambda x: x["kind"] == "word"), lambda x: x["m"]), late))


def _caseless(text: Column) -> Column:
    """Letters of Turkish that patterns without case take for the same are the same; to them all four of i, ı, I and İ are, and the long s is an s."""
    return F.lower(F.translate(text, "İıſ", "iis"))


@rule("KD-C11", "Dolaylı hitap", "cümle")
def indirect_address(t: Tables) -> Column:
    """Every match of every pattern; of overlapping ones, the one of the earlier pattern. A pattern is looked for where the text holds one of the letters that
    its matches hold, as the lexicon says (``iz``): looking for letters is far cheaper."""
    patterns = [x if isinstance(x, Mapping) else {"desen": x} for x in t.lexicon["dolayli_hitap"]]
    none = F.array().cast("array<struct<at:int,piece:string>>")

    def holding(plain: Column, x: Mapping[str, Any]) -> Column:
        found = placed_matches(F.col("text"), f"(?iuU){x['desen']}")
        return F.when(reduce(lambda a, b: a | b, [F.contains(plain, _caseless(F.lit(z))) for z in x["iz"]]), found).otherwise(none) if x.get("iz") else found

    every = let(_caseless(F.col("text")), lambda plain: F.concat(none, *[holding(plain, x) for x in patterns]))
    over = lambda x, y: (x["at"] < y["at"] + F.length(y["piece"])) & (y["at"] < x["at"] + F.length(x["piece"]))
    step = lambda a, x: F.when(F.exists(a, lambda y: over(x, y)), a).otherwise(F.concat(a, F.array(x)))
    return F.when(BODY(), F.transform(F.aggregate(every, none, step), lambda x: hit(x["piece"], "Okura doğrudan seslenin.", start=x["at"]).cast(FOUND)))


# words


def _phrases(t: Tables, section: str, message: str) -> DataFrame:
    rows = t.matched.where(F.col("list") == section)
    return finding(rows, F.col("said"), F.concat(quote(F.col("phrase")), F.lit(message)), start=F.col("start"), suggestion=F.col("suggestion"))


@rule("KD-K01", "Resmî dil", "kelime", plan=True)
def jargon(t: Tables) -> DataFrame:
    """Phrases of the lexicon, and formal imperatives: bare stems with -(y)InIz that end a sentence and belong to no phrase.

    Without a dictionary a possessive looks alike, so that only the place of a predicate counts, and a tense with a person never does.
    """
    phrases = _phrases(t, "jargon", " yerine bilinen bir kelime kullanın.")
    verbs = t.body.select(*SENT, F.explode_outer(fact(t, "orders")).alias("f")).where("f is not null")
    verbs = verbs.select(*SENT, F.col("f.tok").alias("tok_idx"), *[f"f.{c}" for c in FINDING[4:]])
    covered = t.matched.where("list = 'jargon'").select(*SENT, F.explode(F.sequence("first_tok", "last_tok")).alias("tok_idx"))
    return phrases.unionByName(verbs.join(covered, [*SENT, "tok_idx"], "left_anti").select(*FINDING))


def formal_orders(t: Tables) -> Column:
    """The formal imperatives that end a sentence."""
    formal = lambda x, i: (x["kind"] == "word") & F.coalesce(tok(i + 1)["token"].isin(*STOPS), F.lit(True)) & morphology.formal_order(x["low"]) & (x["low"] == x["lower"])
    plain = lambda x: F.substr(x["token"], F.lit(1), F.length(x["token"]) - 2)
    return each(F.col(TOKS), formal, lambda x, i: hit(x["token"], F.concat(quote(x["token"]), F.lit(" resmî bir emir.")), tok=i, start=start_at(t, x), suggestion=plain(x), fix=plain(x), confidence=0.6))


@rule("KD-K02", "Yabancı kelime", "kelime", plan=True)
def foreign(t: Tables) -> DataFrame:
    return _phrases(t, "yabanci", " yerine Türkçesini kullanın.")


@rule("KD-K03", "Kısaltma", "kelime", plan=True)
def abbreviation(t: Tables) -> DataFrame:
    """The first use of an abbreviation that is not a Roman numeral, well known, or explained in parentheses beside it."""
    spelled = {x["kisaltma"]: x["acilim"] for x in t.lexicon["kisaltmalar"] if x.get("acilim")}
    rows = t.sents.select(*SENT, F.explode_outer(fact(t, "shorts")).alias("x")).where("x is not null").select(*SENT, "x.*").where(~F.rlike(F.coalesce("after", F.lit("")), F.lit("^[0-9]")))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("para_idx", "sent_no", "tok_idx"))).where("nth = 1").where("coalesce(before, '') <> '(' and coalesce(after, '') <> '('")
    long = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])[F.col("base")] if spelled else F.lit(None).cast("string")
    return finding(first, F.col("base"), F.concat(quote(F.col("base")), F.lit(" kısaltmasını açıklayın.")), start=F.col("at"), suggestion=long, fix=F.concat(long, F.lit(" ("), F.col("base"), F.lit(")")))


def short_words(t: Tables) -> Column:
    """The abbreviations that have to be explained, with what stands beside them."""
    known = [x["kisaltma"] for x in t.lexicon["kisaltmalar"] if x.get("bilinir")]
    short = numbered(lambda x: x["is_abbreviation"] & ~F.rlike(x["base"], F.lit(numbers.ROMAN_PATTERN)) & ~x["base"].isin(known))
    return F.transform(short, lambda x: F.struct(x["i"].alias("tok_idx"), x["t"]["base"].alias("base"), tok(x["i"] - 1)["token"].alias("before"), tok(x["i"] + 1)["token"].alias("after"), start_at(t, x["t"]).alias("at")))


def _plain_word(x: Column, i: Column) -> Column:
    """A word that is neither an abbreviation nor, by a capital within the sentence or by its document, a name."""
    return (x["kind"] == "word") & ~x["is_abbreviation"] & ((i == 0) | ~F.rlike(x["token"], F.lit("^\\p{Lu}"))) & ~_named_word(x)


def _named_word(x: Column) -> Column:
    """A word with a capital whose form the document uses as a name."""
    return F.rlike(x["token"], F.lit("^\\p{Lu}")) & names.is_name(F.col("names"), x["low"])


@rule("KD-K04", "Uzun kelime", "kelime")
def long_word(t: Tables) -> Column:
    """Words of many syllables; of somewhat fewer, where they have many endings."""
    most, suffixes = t.param("KD-K04", "max_syllables", 4), t.param("KD-K04", "max_suffixes", 3)

    def long(x: Column, i: Column) -> Column:
        n = morphology.stem(x["lower"])[1]
        return (x["syllables"] > most + 1) & _plain_word(x, i) & ((x["syllables"] >= most + 3) | (n > suffixes))

    return F.when(BODY(), each(F.col(TOKS), long, lambda x, i: hit(x["token"], F.concat(quote(x["token"]), F.lit(" uzun bir kelime.")), tok=i, confidence=0.6)))


@rule("KD-K05", "Deyim", "kelime", plan=True)
def idiom(t: Tables) -> DataFrame:
    return _phrases(t, "deyimler", " bir deyim.")


@rule("KD-K06", "Seyrek kelime", "kelime", "bilgi", plan=True)
def rare_word(t: Tables) -> DataFrame:
    """Words of no vocabulary. Without a vocabulary in the lexicon nothing is rare."""
    known = [*t.lexicon["sik_kelimeler"], *t.lexicon["bilinen"]]
    none = t.sents.select(*SENT, F.lit(0).alias("tok_idx"), "text")
    if not known:
        return finding(none.where("false"), F.col("text"), "")
    rows = t.sents.select(*SENT, F.explode_outer(fact(t, "unnamed")).alias("x")).where("x is not null").select(*SENT, "x.tok_idx", "x.token", "x.lower", "x.at")
    first = rows.groupBy("doc_id", "lower").agg(F.min_by(F.struct("para_idx", "sent_no", "tok_idx", "token", "at"), F.struct("para_idx", "sent_no", "tok_idx")).alias("x"))
    vocabulary = t.sents.sparkSession.createDataFrame([(k,) for k in known], "word string").select(turkish_lower(F.col("word")).alias("key"))
    forms = first.select("lower").distinct()
    met = forms.select("lower", F.explode(F.array_distinct(F.array(F.col("lower"), morphology.stem(F.col("lower"))[0]))).alias("key")).join(vocabulary, "key", "left_semi").select("lower").distinct()
    rare = first.join(met, "lower", "left_anti").select("doc_id", "x.*")
    return finding(rare, F.col("token"), F.concat(quote(F.col("token")), F.lit(" seyrek bir kelime.")), start=F.col("at"), confidence=0.6)


def unnamed_words(t: Tables) -> Column:
    """The words of a sentence that may be rare: no names, no abbreviations, three characters or more."""
    plain = F.filter(F.transform(TOKS, lambda x, i: F.when(_plain_word(x, i) & (F.length(x["token"]) > 2), F.struct(x.alias("t"), i.alias("i")))), lambda x: x.isNotNull())
    return F.transform(plain, lambda x: F.struct(x["i"].alias("tok_idx"), x["t"]["token"].alias("token"), x["t"]["lower"].alias("lower"), start_at(t, x["t"]).alias("at")))


@rule("KD-K07", "Belirsiz ifade", "kelime", plan=True)
def vague(t: Tables) -> DataFrame:
    return _phrases(t, "belirsiz", " belirsiz; kesin bilgi verin.")


@rule("KD-K08", "Terim tutarlılığı", "kelime", plan=True)
def terms(t: Tables) -> DataFrame:
    found = matching.term_consistency(t.matched.where(~F.col("is_heading")))
    return finding(found.drop("tok_idx"), F.col("said"), F.concat(F.lit("Aynı şey için "), quote(F.col("dominant")), F.lit(" deyin.")), start=F.col("start"), suggestion=F.col("dominant"))


# numbers and form

#: Of single number words, those that are nothing else.
ALONE = ["on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan", "milyon", "milyar"]


#: What is measured and counted, by kind; our own choice.
MEASURES = {
    "money": ["lira", "tl", "kuruş", "avro", "euro", "dolar", "sterlin"],
    "length": ["mm", "cm", "m", "km", "milimetre", "santimetre", "metre", "kilometre"],
    "weight": ["g", "gr", "kg", "gram", "kilo", "kilogram", "ton"],
    "volume": ["ml", "l", "lt", "mililitre", "litre"],
    "heat and power": ["derece", "watt", "kilovat"],
    "share": ["%"],
}
COUNTED_THINGS = {
    "people": ["kişi", "insan", "aile", "çocuk", "öğrenci", "öğretmen", "işçi", "çalışan", "üye", "yolcu", "hasta", "abone", "vatandaş"],
    "things": ["adet", "tane", "kitap", "ağaç", "fidan", "araç", "ev", "konut", "daire", "hane", "oy", "bilet", "sayfa"],
    "land": ["metrekare", "dönüm", "dekar", "hektar"],
}
UNITS = [u for kind in MEASURES.values() for u in kind]
COUNT_NOUNS = [u for kind in COUNTED_THINGS.values() for u in kind]
DECIMAL_UNITS = [*UNITS, "bin", "milyon", "milyar", "saat", "gün", "ay", "yıl", "kat"]


#: Verbs that say something; what stands before them in quotation marks is said.
SAYING = ["dedi", "diyor", "der", "diye", "derken", "diyerek", "söyledi", "sordu", "yazdı", "yazıyor", "bağırdı", "seslendi"]


@rule("KD-B01", "Yazıyla yazılmış sayı", "biçim")
def numbers_in_words(t: Tables) -> Column:
    """Runs of number words that are one numeral of at least ``min_value``; a run ends at any other token. "yirmi otuz" is no numeral.
    Besides, numbers of 5 to 12 digits before a unit."""
    least = t.param("KD-B01", "min_value", 10)
    runs = F.coalesce(islands(numbered(lambda x: x["lower"].isin(*NUMBER_WORDS)), lambda a, b: b["i"] - a["i"] > 1), F.array())
    runs = F.filter(runs, lambda w: is_numeral(F.transform(w, lambda x: x["t"]["lower"])))
    told = F.transform(runs, lambda w: F.struct(w.alias("w"), F.get(w, F.lit(0))["t"]["lower"].alias("first"), F.size(w).alias("n"), numeral_value(F.transform(w, lambda x: x["t"]["lower"])).alias("value")))
    told = F.filter(told, lambda x: (x["value"] >= least) & ((x["n"] > 1) | x["first"].isin(*ALONE)))

    def said(x: Column) -> Column:
        digits = numbers.format_thousands(x["value"])
        return hit(texts(x["w"]), F.concat(F.lit("Rakamla yazın: "), digits), tok=F.get(x["w"], F.lit(0))["i"], suggestion=digits, fix=F.when(~((x["n"] == 1) & x["first"].isin("milyon", "milyar")), digits)).cast(FOUND)

    shown = lambda x: numbers.format_thousands(x["base"].try_cast("long"))
    long = each(F.col(TOKS), lambda x, i: (x["kind"] == "number") & F.rlike(x["base"], F.lit("^[1-9][0-9]{4,11}$")) & tok(i + 1)["low"].isin(*UNITS, *COUNT_NOUNS), lambda x, i: hit(x["base"], F.concat(F.lit("Binlik ayırıcıyla yazın: "), shown(x)), tok=i, suggestion=shown(x), fix=shown(x)))
    return F.when(BODY(), F.concat(F.transform(told, said), long))


@rule("KD-B02", "Roma rakamı", "biçim")
def roman(t: Tables) -> Column:
    def is_roman(x: Column, i: Column) -> Column:
        dot = F.coalesce(tok(i + 1)["token"] == ".", F.lit(False))
        return (x["kind"] == "word") & (x["token"] != x["lower"]) & F.rlike(x["base"], F.lit(numbers.ROMAN_PATTERN)) & (((F.length(x["base"]) > 1) & (dot | F.rlike(x["base"], F.lit("^[IVX]+$")))) | (x["base"].isin("I", "V", "X") & dot))

    value = lambda x: numbers.roman_to_int(x["base"]).cast("string")
    return each(F.col(TOKS), is_roman, lambda x, i: hit(x["base"], F.concat(F.lit("Rakamla yazın: "), value(x)), tok=i, suggestion=value(x), fix=value(x)))


#: What money is spoken of with, besides its units; our own choice.
OF_MONEY = ["para", "ücret", "fiyat", "maaş", "kira", "vergi", "borç", "zam", "indirim", "fatura", "aidat", "gelir", "gider", "faiz", "ceza", "taksit", "bütçe", "ödeme"]
CUES = {"people": [*COUNTED_THINGS["people"], "kadın", "erkek", "genç", "yaşlı", "halk", "nüfus", "seçmen"], "money": [*MEASURES["money"], *OF_MONEY]}


def _bent(words: list[str]) -> str:
    """A pattern of nouns with their endings; a last k, t, p or ç may be soft."""
    soft = [w[:-1] + {"k": "ğ", "t": "d", "p": "b", "ç": "c"}[w[-1]] for w in words if w[-1] in "ktpç" and len(w) > 2]
    return f"^(?:{'|'.join([*words, *soft])})(?:{matching.NOUN_ENDINGS[1:-1]})$"


def nearest_cue(toks: Column, i: Column) -> Column:
    """What the word nearest to the i-th token speaks of, people or money; of two equally near, the earlier. Null without any."""
    kind = lambda x: F.when(F.rlike(x["low"], F.lit(_bent(CUES["people"]))), "people").when(F.rlike(x["low"], F.lit(_bent(CUES["money"]))), "money")
    near = F.transform(toks, lambda x, j: F.struct(F.abs(j - i).alias("far"), j.alias("j"), F.when((x["kind"] == "word") & (j != i), kind(x)).alias("cue")))
    return F.array_min(F.filter(near, lambda x: x["cue"].isNotNull()))["cue"]


@rule("KD-B03", "Yüzde ve kesir", "biçim", "bilgi")
def percent(t: Tables) -> Column:
    """Percentages, ``yüzde`` before a number, fractions, and, as a warning, decimals with a point before a unit.

    A whole percentage up to 100 is suggested as so many of a hundred people or liras, if a word of the sentence speaks of such.
    """
    said = lambda x, i: F.coalesce((x["low"] == "yüzde") & (tok(i + 1)["kind"] == "number"), F.lit(False))
    text = lambda x, i: F.when(said(x, i), F.concat_ws(" ", x["token"], tok(i + 1)["token"])).otherwise(x["token"])
    whole = lambda x, i: F.regexp_extract(F.when(said(x, i), tok(i + 1)["base"]).otherwise(x["base"]), "^%? ?([0-9]{1,3}) ?%?$", 1).try_cast("int")
    instead = lambda n, cue: F.when(n.between(1, 100), F.when(cue == "people", F.concat(F.lit("her 100 kişiden "), possessive(n))).when(cue == "money", F.concat_ws(" ", F.lit("her 100 liranın"), n.cast("string"), F.lit("lirası"))))
    share = lambda x, i: (x["kind"] == "percent") | said(x, i)
    shown = lambda x, i: F.when(share(x, i), let(F.struct(whole(x, i).alias("n"), nearest_cue(F.col(TOKS), i).alias("cue")), lambda s: instead(s["n"], s["cue"])))

    def explained(x: Column, i: Column) -> Column:
        return let(shown(x, i), lambda s: hit(text(x, i), F.when(s.isNotNull(), F.concat(F.lit("Şöyle anlatın: "), s)).otherwise(F.concat(quote(text(x, i)), F.lit(" sayısını örnekle anlatın."))), tok=i, suggestion=s))

    abstract = each(F.col(TOKS), lambda x, i: share(x, i) | ((x["kind"] == "number") & F.rlike(x["token"], F.lit("^[1-9]/(?:[2-9]|10)$"))), explained)
    comma = lambda x: F.replace(x["base"], F.lit("."), F.lit(","))
    wrong = each(F.col(TOKS), lambda x, i: (x["kind"] == "number") & F.rlike(x["base"], F.lit("^[0-9]+\\.[0-9]{1,2}$")) & tok(i + 1)["low"].isin(*DECIMAL_UNITS), lambda x, i: hit(x["base"], F.concat(F.lit("Küsuratı virgülle yazın: "), comma(x)), tok=i, suggestion=comma(x), fix=comma(x), severity="uyarı"))
    return F.when(BODY(), F.concat(abstract, wrong))


def _is_day(word: Column) -> Column:
    days = F.array(*[turkish_lower(F.lit(d)) for d in WEEKDAYS])
    return F.coalesce(F.array_contains(days, word), F.lit(False))


@rule("KD-B04", "Tarih biçimi", "biçim")
def date_format(t: Tables) -> Column:
    """Numeric dates: an error where the calendar has no such day or the weekday after it is another, else the
    readable form. Dates with the month's name: the same errors, and a hint where no weekday is near.

    ``suggest_weekday`` says whether a missing weekday is asked for.
    """
    weekday = F.lit(bool(t.param("KD-B04", "suggest_weekday", True)))
    days = F.array(*[turkish_lower(F.lit(d)) for d in WEEKDAYS])
    date = lambda d, m, y: F.try_to_date(F.concat_ws(".", d.cast("string"), m.cast("string"), y.cast("string")), "d.M.yyyy")

    def after(i: Column) -> Column:
        """The weekday beside a date whose last token is the i-th: the first word of the next three, with only brackets, commas and dashes before it."""
        out = F.lit(None).cast("string")
        for j in (3, 2, 1):
            x = tok(i + j)
            out = F.when(x["kind"] == "word", F.when(_is_day(x["low"]), x["low"])).when(x["token"].isin("(", ",", "-"), out)
        return out

    def numeric(x: Column, i: Column) -> Column:
        p = numbers.date_parts(x["base"])
        return F.struct(i.alias("i"), x["base"].alias("text"), date(p["day"], p["month"], p["year"]).alias("date"), after(i).alias("said"), F.lit(True).alias("numeric"), F.lit(True).alias("dated"), F.lit(True).alias("near"), F.lit(True).alias("whole"))

    def spoken(x: Column, i: Column) -> Column:
        m, y = tok(i + 1), tok(i + 2)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), m["low"]).cast("int")
        dated = F.coalesce((y["kind"] == "number") & F.rlike(y["base"], F.lit("^[0-9]{4}$")), F.lit(False))
        text = F.when(dated, F.concat_ws(" ", x["token"], m["token"], y["token"])).otherwise(F.concat_ws(" ", x["token"], m["token"]))
        near = F.exists(F.slice(F.col(TOKS), F.greatest(i - 2, F.lit(1)), F.least(i + 1, F.lit(4)) + 4), lambda z: _is_day(z["low"]))
        day = date(x["base"].try_cast("int"), month, F.when(dated, y["base"].try_cast("int")).otherwise(2024))
        return F.struct(i.alias("i"), text.alias("text"), day.alias("date"), F.when(dated, after(i + 2)).alias("said"), F.lit(False).alias("numeric"), dated.alias("dated"), near.alias("near"), F.coalesce(y["token"] == y["base"], F.lit(False)).alias("whole"))

    def is_spoken(x: Column, i: Column) -> Column:
        m, y = tok(i + 1), tok(i + 2)
        named = F.coalesce((y["kind"] == "word") & F.rlike(y["token"], F.lit("^\\p{Lu}")) & ~_is_day(y["low"]) & ~y["low"].isin(*MONTHS), F.lit(False))
        return (x["kind"] == "number") & F.rlike(x["base"], F.lit("^[0-9]{1,2}$")) & x["base"].try_cast("int").between(1, 31) & (m["kind"] == "word") & m["low"].isin(*MONTHS) & ~named

    of = numbered(lambda x: x["kind"].isin("date", "number"))
    dates = F.transform(F.filter(of, lambda x: F.coalesce((x["t"]["kind"] == "date") | is_spoken(x["t"], x["i"]), F.lit(False))), lambda x: F.when(x["t"]["kind"] == "date", numeric(x["t"], x["i"])).otherwise(spoken(x["t"], x["i"])))
    wrong = lambda x: F.coalesce(x["said"] != F.get(days, F.weekday(x["date"])), F.lit(False))
    told = F.filter(dates, lambda x: x["numeric"] | x["date"].isNull() | wrong(x) | (weekday & ~x["near"]))

    def found(x: Column) -> Column:
        return let(numbers.readable_date(x["date"]), lambda full: told_date(x, full))

    def told_date(x: Column, full: Column) -> Column:
        bare = F.regexp_replace(full, " [^ ]+$", "")
        good = F.when(x["numeric"], F.when(weekday & x["said"].isNull(), full).otherwise(bare)).when(x["dated"], full)
        bad = x["date"].isNull() | wrong(x)
        message = F.when(x["date"].isNull(), "Böyle bir gün yok.").when(wrong(x), F.concat(F.lit("Haftanın günü yanlış: "), full)).when(x["numeric"], F.concat(F.lit("Şöyle yazın: "), good)).otherwise("Haftanın gününü de yazın.")
        return hit(x["text"], message, tok=x["i"], suggestion=F.when(wrong(x) & x["dated"], full).otherwise(good), fix=F.when(~wrong(x) & x["whole"], good), severity=F.when(bad, "hata").when(~x["numeric"], "bilgi")).cast(FOUND)

    return F.when(BODY(), F.transform(told, found))


@rule("KD-B05", "Saat biçimi", "biçim")
def time_format(t: Tables) -> Column:
    """Times, and ranges of them, without ``saat`` a few tokens before or just after. What stands before a unit is no time."""
    span = F.lit("^(?:[01]?[0-9]|2[0-3])[:.][0-5][0-9](?:-(?:[01]?[0-9]|2[0-3])[:.][0-5][0-9])?$")

    def bare(x: Column, i: Column) -> Column:
        near = F.slice(F.col(TOKS), F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5)) + 3)
        time = (x["kind"] == "time") | ((x["kind"] == "number") & F.contains(x["base"], F.lit("-")) & F.rlike(x["base"], span))
        return time & ~F.exists(near, lambda y: F.startswith(y["lower"], F.lit("saat"))) & ~F.coalesce(tok(i + 1)["low"].isin(*DECIMAL_UNITS), F.lit(False))

    new = lambda x: F.concat(F.lit("saat "), F.replace(x["base"], F.lit(":"), F.lit(".")))
    return F.when(BODY(), each(F.col(TOKS), bare, lambda x, i: hit(x["token"], "Saat olduğunu yazın.", tok=i, suggestion=new(x), fix=new(x))))


@rule("KD-B06", "Noktalı virgül ve iki nokta", "biçim")
def semicolons(t: Tables) -> Column:
    """Semicolons, for which a full stop and a capital are suggested, and sentences of more than ``max_colons`` colons."""
    most = t.param("KD-B06", "max_colons", 1)
    new = lambda i: F.concat(F.lit(". "), turkish_capitalize(tok(i + 1)["token"]))
    semi = each(F.col(TOKS), lambda x, i: x["token"] == ";", lambda x, i: hit(x["token"], "Noktalı virgül yerine nokta koyun.", tok=i, suggestion=new(i)))
    n = F.size(F.filter(TOKS, lambda x: x["token"] == ":"))
    return F.when(BODY(), F.concat(semi, one(n > most, hit(F.lit(":"), "Cümlede birden çok iki nokta var."))))


@rule("KD-B07", "Büyük harfli yazım", "biçim")
def all_caps(t: Tables) -> Column:
    """Runs of more than ``max_words`` words in capitals; punctuation does not end a run. Where only spaces lie
    between, the fix has small letters, with a capital at the sentence's start."""
    most = t.param("KD-B07", "max_words", 3)
    words = F.filter(F.transform(TOKS, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda x: x["t"]["kind"] == "word")
    upper = F.filter(F.transform(words, lambda x, k: F.struct(x["t"].alias("t"), x["i"].alias("i"), k.alias("k"))), lambda x: (x["t"]["token"] != x["t"]["lower"]) & is_upper_word(x["t"]["token"]))
    runs = F.filter(F.coalesce(islands(upper, lambda a, b: b["k"] - a["k"] > 1), F.array()), lambda w: F.size(w) > most)

    def found(w: Column) -> Column:
        low = F.array_join(F.transform(w, lambda x: x["t"]["lower"]), " ")
        first = F.get(w, F.lit(0))["i"]
        close = F.element_at(w, -1)["i"] - first == F.size(w) - 1
        return hit(texts(w), "Küçük harfle yazın.", tok=first, fix=F.when(close & F.contains(F.col("text"), texts(w)), F.when(first == 0, turkish_capitalize(low)).otherwise(low))).cast(FOUND)

    return F.transform(runs, found)


@rule("KD-B08", "Tırnak içinde vurgu", "biçim", "bilgi")
def scare_quotes(t: Tables) -> Column:
    """Up to three quoted words that are no name and that nobody says."""
    said = F.concat(F.lit("^\\s*,?\\s*(?:"), F.lit("|".join(SAYING)), F.lit(")(?![\\p{L}])"))

    def emphasis(x: Column) -> Column:
        after = F.substr(F.col("text"), x["at"] + F.length(x["piece"]) + 1)
        return (F.size(F.split(x["piece"], "\\s+")) <= 3) & ~F.rlike(x["piece"], F.lit('^"(?:\\p{Lu}[^ "]*[ "])+$')) & ~F.rlike(after, said)

    found = F.filter(placed_matches(F.col("text"), '"[^"\n]{1,60}"'), emphasis)
    return F.when(BODY(), F.transform(found, lambda x: hit(x["piece"], "Tırnağı kaldırın ya da açıklayın.", start=x["at"]).cast(FOUND)))


# whole texts


@rule("KD-M01", "Uzun paragraf", "metin", plan=True)
def long_paragraph(t: Tables) -> DataFrame:
    most = t.param("KD-M01", "max_sentences", 5)
    rows = t.body.where(~F.col("is_list_item")).groupBy("doc_id", "para_idx").agg(F.count("*").alias("n"), F.min_by("text", "sent_no").alias("text")).where(F.col("n") > most)
    return finding(rows, F.col("text"), F.concat(F.lit("Paragraf "), F.col("n").cast("string"), F.lit(" cümle.")))


def _document_words(t: Tables) -> DataFrame:
    return t.sents.select("doc_id", "is_heading", n_words(t).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.max(F.col("is_heading") & (F.col("n") > 0)).alias("headed"))


@rule("KD-M02", "Başlık yok", "metin", "bilgi", plan=True)
def no_heading(t: Tables) -> DataFrame:
    rows = _document_words(t).where((F.col("n") > t.param("KD-M02", "min_words", 150)) & ~F.col("headed"))
    return finding(rows, F.lit(""), "Metni başlıklarla bölün.")


@rule("KD-M03", "Liste fırsatı", "metin")
def list_opportunity(t: Tables) -> Column:
    least = t.param("KD-M03", "min_items", 4)
    parts = F.split("text", ",")
    short = F.filter(parts, lambda x: F.size(F.split(F.trim(x), "\\s+")).between(1, 5))
    more = F.when(F.rlike("text", F.lit("(?i) (?:ve|veya|ile|ya|yahut) ")), 1).otherwise(0)
    return one(BODY() & ~F.col("is_list_item") & (F.size(parts) + more >= least) & (F.size(short) >= least - 1), hit(F.col("text"), "Sayılanları liste yapın."))


@rule("KD-M04", "Önemli bilgi geç", "metin", "bilgi", plan=True)
def key_info_late(t: Tables) -> DataFrame:
    """Texts whose first date, address on the net or telephone number comes late. Places are counted by sums over
    paragraphs, so that no document's sentences are sorted in one task."""
    part = t.param("KD-M04", "first_fraction", 0.3)
    rows = t.body.select("doc_id", "para_idx", "sent_no", fact(t, "telling").alias("told"))
    first = rows.where("told").groupBy("doc_id").agg(F.min(F.struct("para_idx", "sent_no")).alias("first"))
    by = rows.join(first, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.struct("para_idx", "sent_no") < F.col("first")).alias("before"))
    return finding(by.where((F.col("n") >= 3) & (F.col("before") >= part * F.col("n"))), F.lit(""), "Önemli bilgiyi başa alın.")


def telling(t: Tables) -> Column:
    """Whether a sentence has a date, an address on the net or a telephone number."""
    kinds = ("date", "url", "email")
    said = marked(F.col("seen"), *kinds) if "seen" in t.sents.columns else F.exists(TOKS, lambda x: x["kind"].isin(*kinds))
    # three digits in a row are looked for first, which is far cheaper
    return said | F.rlike("text", F.lit("[2-5][0-9]{2}")) & F.rlike("text", F.lit("(?<![0-9])0?[ (]*[2-5][0-9]{2}\\)?[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}(?![0-9])"))


@rule("KD-M05", "Uzun metin", "metin", "bilgi", plan=True)
def long_text(t: Tables) -> DataFrame:
    rows = _document_words(t).where(F.col("n") > t.param("KD-M05", "max_words", 400))
    return finding(rows, F.lit(""), F.concat(F.lit("Metin "), F.col("n").cast("string"), F.lit(" kelime.")))


#: Rules that spare the names of a document.
SPARING = {"KD-C03", "KD-K04", "KD-K06"}
#: Rules that read phrases of the lexicon.
PHRASED = {*matching.PHRASE_RULES.values(), "KD-K08"}
#: Rules that read the analysis of words.
ANALYSED = {"KD-C02", "KD-C03", "KD-C04", "KD-C05", "KD-C06", "KD-C07", "KD-C08", "KD-C10"}


#: What rules read of tokens; the others read all of it. Those without any read the sentence's text alone.
READ: dict[str, tuple[str, ...]] = {
    "KD-C09": (), "KD-C11": (), "KD-B08": (), "KD-M01": (), "KD-M03": (), "KD-C01": ("kind",), "KD-M02": ("kind",), "KD-M05": ("kind",),
    "KD-B06": ("k", "token"), "KD-B02": ("k", "token", "kind", "lower", "base"), "KD-B07": ("k", "token", "kind", "lower"), "KD-K03": ("k", "token", "base", "is_abbreviation"),
    **dict.fromkeys(("KD-B01", "KD-B03", "KD-B05"), ("k", "token", "kind", "lower", "base", "low")),
}
#: What rules about documents read of a sentence, and the rule that reads it: worked out where the sentence's tokens are.
FACTS: dict[str, tuple[str, Callable[[Tables], Column]]] = {"orders": ("KD-K01", formal_orders), "shorts": ("KD-K03", short_words), "unnamed": ("KD-K06", unnamed_words), "telling": ("KD-M04", telling)}


def _seen(*marks: str) -> Callable[[Tables], Column]:
    return lambda t: marked(F.col("seen"), *marks)


#: Without which a rule finds nothing in a sentence; its tokens are not gone over then. By what is told of a sentence as a whole.
LOOKS: dict[str, Callable[[Tables], Column]] = {
    "KD-C02": _seen("finite_form", "order"), "KD-C03": _seen("passive"), "KD-C04": _seen("negative", "denying"), "KD-C05": _seen("inner_negative"), "KD-C06": _seen("converb", "participle"),
    "KD-C07": _seen("nominal", "teller"), "KD-C08": _seen("genitive"), "KD-C10": lambda t: marked(F.col("seen"), "finite_form") & marked(F.col("seen"), "converb", "participle", "nominal") & (F.col("n_plain") > t.param("KD-C10", "max_gap", 6)),
    "KD-K04": lambda t: F.col("longest") > t.param("KD-K04", "max_syllables", 4) + 1, "KD-B01": _seen("number word", "number"), "KD-B02": _seen("roman"), "KD-B03": _seen("percent", "number"), "KD-B04": _seen("date", "number"),
    "KD-B05": _seen("time", "number"), "KD-B06": lambda t: F.contains("text", F.lit(";")) | F.contains("text", F.lit(":")), "KD-B07": lambda t: F.col("n_loud") > t.param("KD-B07", "max_words", 3),
    "orders": _seen("formal"), "shorts": _seen("abbreviation"),
}


def looked(t: Tables, name: str, found: Column) -> Column:
    return F.when(LOOKS[name](t), found) if name in LOOKS and "seen" in t.sents.columns else found


def fact(t: Tables, name: str) -> Column:
    """What a rule reads of a sentence; where all rules are asked for it stands in the table already."""
    return F.col(name) if name in t.sents.columns else looked(t, name, FACTS[name][1](t))


def n_words(t: Tables) -> Column:
    """The words of a sentence, of any kind."""
    return F.col("n_words") if "n_words" in t.sents.columns else F.size(F.filter(TOKS, lambda x: x["kind"].isin(*WORD_LIKE)))


def start_at(t: Tables, x: Column) -> Column:
    """Where a token starts."""
    return x["at"] if "seen" in t.sents.columns else start_of("pieces", x["k"])


def tables(docs: DataFrame, profile: Profile, lexicon: Mapping[str, Any], only: list[str] | None = None, once: bool = False) -> Tables:
    """The shared tables: sentences with what the rules (of ``only``, if given) read of their tokens, and phrase matches.

    Sentences are written to the shared folder once as several plans read them, unless they are read ``once``. Where all rules are asked for, what
    they find in a sentence, and what those about documents read of it, is worked out in that one pass and stands in its row, so that tokens are not written.
    Words are analysed, and names worked out, if a rule asks for it."""
    own = [r for r in RULES if profile.config(r).enabled and (only is None or r in only)]
    known = [*lexicon.get("sik_kelimeler", ()), *lexicon.get("bilinen", ())]
    analysed = any(r in own for r in ANALYSED) or (bool(known) and "KD-K06" in own)
    read = {c for r in own for c in READ.get(r, FIELDS)}
    spared = any(r in own for r in SPARING)
    carry = ("names",) if spared else ()
    named = docs.withColumn("names", names.proper_forms(names.plain_text(F.col("text")), known)) if spared else docs
    sents = sentences(named, carry)
    phrases = any(r in own for r in PHRASED)
    entries = matching.lexicon_entries(docs.sparkSession, lexicon) if phrases else None
    few = [] if entries is None else matching.few(entries) if only is None and analysed and not once else None
    if analysed:
        sents = told(sents, matching.beginnings(few or []))
    elif read:
        sents = with_tokens(sents, fields=tuple(c for c in FIELDS if c in read))
    if only is None and analysed and not once:
        return _whole(Tables(sents, None, lexicon, profile), own, entries, few, known)
    sents = sents if once else written(sents, "sentences")
    matched = matching.matches(sents, entries) if phrases else None
    return Tables(sents, written(matched, "matches") if only is None and phrases else matched, lexicon, profile)


def _whole(t: Tables, own: list[str], entries: DataFrame | None, few: list[Row] | None, known: list[str]) -> Tables:
    """The tables of a full audit: every sentence with what is found in it, without its tokens (unless the lexicon is to be joined)."""
    facts = {name: fact(t, name) for name, (r, _) in FACTS.items() if r in own and (name != "unnamed" or known)}
    more = [matching.phrases(few).alias("phrases")] if few is not None else [F.col(c) for c in ("pieces", TOKS, "keys")]
    rows = t.sents.select(*SENT, "start", "text", "is_heading", "is_list_item", "suppressed", *COUNTS, readability.foreign(F.col("text"), F.col(TOKS)).alias("foreign"), *[v.alias(k) for k, v in facts.items()], *more, _found(t, [RULES[r] for r in own if RULES[r].each]).alias("found"))
    sents = written(rows, "sentences")
    if few is None:
        matched = written(matching.matches(sents, entries), "matches")
    else:
        matched = sents.select(*SENT, "is_heading", F.explode_outer("phrases").alias("m")).where("m is not null").select(*SENT, "is_heading", "m.*")
    return Tables(sents, matched if entries is not None else None, t.lexicon, t.profile)


def _severity(t: Tables, r: Rule) -> Column:
    return F.lit(t.profile.config(r.id).severity or r.severity)


def _named(t: Tables, r: Rule) -> Column:
    """What a rule finds in a sentence, with its name and place, in the order in which findings of one place are chosen."""

    def one(x: Column) -> Column:
        if "at" in _token_fields(t):
            start = F.when(x["tok"].isNull(), x["start"]).otherwise(tok(x["tok"])["at"])
        else:
            start = F.when(x["tok"].isNull(), x["start"]).otherwise(start_of("pieces", tok(x["tok"])["k"])) if "pieces" in t.sents.columns else x["start"]
        return F.struct(F.lit(r.id).alias("rule_id"), start.alias("start"), x["text"].alias("text"), (-x["confidence"]).alias("doubt"), *[x[c].alias(c) for c in ("message", "suggestion", "fix")], F.coalesce(x["severity"], _severity(t, r)).alias("severity"), F.lit(r.category).alias("category"), x["tok"].alias("tok_idx"))

    return F.transform(F.coalesce(looked(t, r.id, r.each(t)), empty()), one)


def _token_fields(t: Tables) -> list[str]:
    return t.sents.schema[TOKS].dataType.elementType.names if TOKS in t.sents.columns else []


def _found(t: Tables, own: list[Rule]) -> Column:
    """What rules find in a sentence: of several findings of one rule and place the most certain, then the first by message."""
    kept = lambda x, before: ~F.coalesce((x["rule_id"] == before["rule_id"]) & x["start"].eqNullSafe(before["start"]) & x["text"].eqNullSafe(before["text"]), F.lit(False))
    single = lambda every: F.when(F.size(every) > 1, let(F.array_sort(every), lambda o: F.filter(o, lambda x, i: (i == 0) | kept(x, F.get(o, i - 1))))).otherwise(every)
    return let(F.concat(*[_named(t, r) for r in own]), single)


def of_sentences(t: Tables, only: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame | None:
    """The findings of the rules that look at one sentence, one for each rule and place, with rule_id, category and final severity, and the columns ``keep`` of the sentence."""
    own = [r for r in _enabled(t, only) if r.each]
    if not own:
        return None
    found = F.col("found") if "found" in t.sents.columns else _found(t, own)
    rows = t.sents.select(*SENT, *keep, F.explode_outer(found).alias("x")).where("x is not null")
    return rows.select(*SENT, "x.tok_idx", *[f"x.{c}" for c in ("start", "text", "message", "suggestion", "fix")], (-F.col("x.doubt")).alias("confidence"), "x.severity", "x.rule_id", "x.category", *keep)


def of_plans(t: Tables, only: list[str] | None = None) -> DataFrame | None:
    """The findings of the other rules."""
    plans = [r.plan(t).select(*FINDING).withColumns({"rule_id": F.lit(r.id), "category": F.lit(r.category), "severity": F.coalesce("severity", _severity(t, r))}) for r in _enabled(t, only) if r.plan]
    return reduce(DataFrame.unionByName, plans) if plans else None


def _enabled(t: Tables, only: list[str] | None) -> list[Rule]:
    return [r for r in RULES.values() if t.profile.config(r.id).enabled and (only is None or r.id in only)]


def audit(t: Tables, only: list[str] | None = None) -> DataFrame:
    """The findings of every enabled rule, or of ``only`` some, with rule_id, category and final severity.

    All rules that look at one sentence are one projection.
    """
    return reduce(DataFrame.unionByName, [x for x in (of_sentences(t, only), of_plans(t, only)) if x is not None])


def start_of(pieces: str, k: Column) -> Column:
    """Where a token, the k-th piece, starts: the lengths of all pieces before it."""
    return F.aggregate(F.slice(F.col(pieces), F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x))


def rules_table(spark: SparkSession, profile: Profile) -> DataFrame:
    """The registry as rows: rule_id, name, category, enabled and severity."""
    rows = [(r.id, r.name, r.category, profile.config(r.id).enabled, profile.config(r.id).severity or r.severity) for r in RULES.values()]
    return spark.createDataFrame(rows, "rule_id string, name string, category string, enabled boolean, severity string")

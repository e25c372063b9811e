"""Phrases of a lexicon in sentences: an equi-join on first words, then the leftmost longest.

The lexicon is a table. Tokens meet phrases by the first letters of their first word; all words are
compared with the tokens that follow in the same sentence. Overlaps are resolved by a fold over each
sentence's candidates, so that no sentence's tokens are sorted globally. A small lexicon meets each sentence
where it lies; a larger one is joined, and what matches is shuffled, without the sentence around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from berrak.functions.turkish import fold_circumflex

#: Sections that hold phrases, and the rule that reports each.
PHRASE_RULES = {"jargon": "KD-K01", "yabanci": "KD-K02", "deyimler": "KD-K05", "belirsiz": "KD-K07"}
#: Words meet phrases by so many letters.
FIRST = 3
#: A lexicon of at most this many entries is broadcast.
MOST_BROADCAST = 50_000
#: The phrases of a lexicon of at most this many entries stand in the plan, and sentences meet them without a join or a shuffle.
MOST_IN_PLAN = 1_000


def lexicon_entries(spark: SparkSession, lexicon: Mapping[str, Iterable[Any]]) -> DataFrame:
    """list, phrase, suggestion, exempt and words of every phrase of a lexicon; synonyms are lists of their own, ``es:`` and a number.

    A phrase's last word may take endings, unless its ``ek`` says no: those of a noun, or, where it
    is given in -mak or -mek, any that a verb takes. Its final k, t, p or ç may then be soft.
    """
    rows = []
    for section in PHRASE_RULES:
        for item in lexicon.get(section, ()):
            item = {"ifade": item, "ek": False} if isinstance(item, str) else item
            rows.append((section, item.get("ifade") or item["kelime"], item.get("oneri"), bool(item.get("sabit", False)), bool(item.get("ek", True))))
    for k, group in enumerate(lexicon.get("es_anlamlilar", ())):
        item = group if isinstance(group, Mapping) else {"grup": group, "ek": False}
        rows += [(f"es:{k}", word, None, False, bool(item.get("ek", True))) for word in item["grup"]]
    df = spark.createDataFrame(rows, "list string, phrase string, suggestion string, exempt boolean, bends boolean")
    df = df.withColumn("words", F.split(_key(F.col("phrase")), "\\s+"))
    last = F.element_at("words", -1)
    verb = F.rlike(last, F.lit("^.{2,}m[ae]k$")) & (F.size("words") > 1)
    root = F.when(verb, F.substr(last, F.lit(1), F.length(last) - 3)).otherwise(last)
    body, final = F.substr(root, F.lit(1), F.length(root) - 1), F.right(root, F.lit(1))
    soft = F.concat(body, F.translate(final, "çpt", "cbd"))
    soft = F.when(final == "k", F.concat(body, F.lit("ğ"))).otherwise(soft)
    return df.withColumns({"verb": verb, "root": F.when(F.col("bends"), root), "soft": F.when(F.col("bends"), soft)})


def _key(text: Column) -> Column:
    return fold_circumflex(F.lower(F.translate(text, "Iİ", "ıi")))


#: What a noun takes: the plural, a possessive, cases and the copula; and no more letters than this after a verb.
NOUN_ENDINGS = "^(?:l[ae]r)?(?:[ıiuü]m[ıiuü]z|[ıiuü]n[ıiuü]z|[ıiuü]m|[ıiuü]n|m[ıiuü]z|n[ıiuü]z|s?[ıiuü])?(?:n?[dt][ae]n?(?:ki)?|[ny]?[ae]|[ny]?[ıiuü]|n?[ıiuü]n|y?l[ae])?(?:[dt][ıiuü]r?)?$"
MOST_AFTER_VERB = 12


def matches(sents: DataFrame, entries: DataFrame) -> DataFrame:
    """list, phrase, suggestion, said (the text as it stands), start, first and last token of each match in sentences with ``toks`` (k, kind and low), the longest from the left by list.

    A phrase's words must follow one another without punctuation between them. Exempt entries
    take part and win, but are left out of the result. Words meet phrases by their first three
    letters; of a lexicon small enough to be broadcast, only words with such a beginning are looked at.
    """
    key = ["doc_id", "para_idx", "sent_no", *[c for c in ("is_heading",) if c in sents.columns]]
    keys = F.col("keys") if "keys" in sents.columns else F.transform("toks", lambda x: F.when(x["kind"] == "word", fold_circumflex(x["low"])).otherwise(x["low"]))
    entries = entries.withColumn("block", F.substring(F.col("words")[0], 1, FIRST))
    blocks = sorted({r.block for r in entries.limit(MOST_BROADCAST + 1).select("block").collect()})
    rows = sents.select(*key, "pieces", F.transform("toks", lambda x: x["k"]).alias("ks"), keys.alias("keys"))
    own = few(entries)
    if own is not None:
        chosen = _met_in_place(rows, key, own)
    else:
        chosen = _joined(rows, key, entries, blocks if entries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else None)
    return chosen.where(~F.col("m.exempt")).select(*key, "list", "m.phrase", "m.suggestion", "said", "start", F.col("m.at").alias("first_tok"), (F.col("m.end") - 1).alias("last_tok"))


def few(entries: DataFrame) -> list[Row] | None:
    """The entries of a lexicon small enough to stand in the plan."""
    rows = entries.withColumn("block", F.substring(F.col("words")[0], 1, FIRST)).limit(MOST_IN_PLAN + 1).collect()
    return rows if len(rows) <= MOST_IN_PLAN else None


def _begun(blocks: list[str] | None) -> Column:
    """Words of a sentence that begin as a phrase may, as at and block; all words without ``blocks``."""
    begun = F.transform("keys", lambda k, i: F.struct(i.alias("at"), F.substring(k, 1, FIRST).alias("block")))
    return begun if blocks is None else F.filter(begun, lambda x: x["block"].isin(*blocks))


def _same(e: Callable[[str], Column], at: Column) -> Column:
    """Whether the words of an entry stand at a place of ``keys``."""
    n = F.size(e("words"))
    last = F.get(F.col("keys"), at + n - 1)
    rest = F.substr(last, F.length(e("root")) + 1)
    bent = (F.startswith(last, e("root")) | F.startswith(last, e("soft"))) & F.when(e("verb"), F.length(rest) <= MOST_AFTER_VERB).otherwise(F.rlike(rest, F.lit(NOUN_ENDINGS)))
    whole = (F.slice("keys", at + 1, n - 1) == F.slice(e("words"), F.lit(1), n - 1)) & ((last == F.element_at(e("words"), -1)) | F.coalesce(bent, F.lit(False)))
    return (F.size("keys") >= at + n) & whole


def _one(e: Callable[[str], Column], at: Column) -> list[Column]:
    """A candidate, in the order in which the fold takes them."""
    n = F.size(e("words"))
    return [at.alias("at"), (-n).alias("longer"), (at + n).alias("end"), e("phrase").alias("phrase"), e("suggestion").alias("suggestion"), e("exempt").alias("exempt")]


def _place(at: Column, end: Column) -> tuple[Column, Column]:
    """The text of the tokens from ``at`` to before ``end``, and where it starts."""
    first_piece, last_piece = F.get(F.col("ks"), at), F.get(F.col("ks"), end - 1)
    said = F.array_join(F.slice("pieces", first_piece + 1, last_piece - first_piece + 1), "")
    return said, F.aggregate(F.slice("pieces", F.lit(1), first_piece), F.lit(0), lambda a, x: a + F.length(x))


ENTRY = "struct<list:string,phrase:string,suggestion:string,exempt:boolean,words:array<string>,verb:boolean,root:string,soft:string>"


MET = "array<struct<list:string,at:int,longer:int,end:int,phrase:string,suggestion:string,exempt:boolean>>"


def beginnings(entries: list[Row]) -> list[str]:
    """The beginnings of phrases, in order."""
    return sorted({r.block for r in entries})


def _taken(entries: list[Row], begun: Column | None = None) -> Column:
    """What is taken of a sentence's candidates, as an array; from ``keys``. ``begun``: the words (at) that begin as phrases do and
    the numbers of their beginnings (of), where they are known."""
    blocks = beginnings(entries)
    written = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    one = lambda r: F.struct(*[written(r[c]).alias(c) for c in ("list", "phrase", "suggestion", "exempt", "words", "verb", "root", "soft")]).cast(ENTRY)
    by = {b: F.array(*[one(r) for r in entries if r.block == b]) for b in blocks}
    if not by:
        by = {"": F.array().cast(f"array<{ENTRY}>")}
    # a place in an array is found at once, a key of a map by looking at one after the other
    table = F.array(*by.values()) if begun is not None else F.create_map(*[x for b, own in by.items() for x in (F.lit(b), own)])

    def at_word(b: Column) -> Column:
        good = F.filter(F.get(table, b["of"]) if begun is not None else F.element_at(table, b["block"]), lambda e: F.coalesce(_same(lambda c: e[c], b["at"]), F.lit(False)))
        return F.transform(good, lambda e: F.struct(e["list"].alias("list"), *_one(lambda c: e[c], b["at"])))

    # most words begin like no phrase, and nothing is made for them
    words = begun if begun is not None else F.filter(F.transform("keys", lambda k, i: F.when(F.substring(k, 1, FIRST).isin(*blocks), F.struct(i.alias("at"), F.substring(k, 1, FIRST).alias("block")))), lambda x: x.isNotNull())
    found = F.array_sort(F.flatten(F.transform(words, at_word))).cast(MET)
    # one after another by list: where the list changes, every place is free again
    start = F.struct(F.lit("").alias("list"), F.lit(0).alias("free"), F.array().cast(MET).alias("taken"))
    step = lambda a, x: F.when((x["list"] != a["list"]) | (x["at"] >= a["free"]), F.struct(x["list"].alias("list"), x["end"].alias("free"), F.concat(a["taken"], F.array(x)).alias("taken"))).otherwise(a)
    taken = F.aggregate(found, start, step, lambda a: a["taken"])
    return taken if begun is None else F.when(F.size(begun) > 0, taken).otherwise(F.array().cast(MET))


def phrases(entries: list[Row]) -> Column:
    """The matches of a small lexicon in one sentence as an array, from its ``text``, ``toks`` (with at), ``keys`` and ``begun``; as ``matches`` gives them."""
    tok = lambda i: F.get(F.col("toks"), i)

    def one(m: Column) -> Column:
        begin, last = tok(m["at"])["at"], tok(m["end"] - 1)
        said = F.substr("text", begin + 1, last["at"] + F.length(last["token"]) - begin)
        return F.struct(m["list"].alias("list"), m["phrase"].alias("phrase"), m["suggestion"].alias("suggestion"), said.alias("said"), begin.alias("start"), m["at"].alias("first_tok"), (m["end"] - 1).alias("last_tok"))

    return F.transform(F.filter(_taken(entries, F.col("begun")), lambda m: ~m["exempt"]), one)


def _met_in_place(rows: DataFrame, key: list[str], entries: list[Row]) -> DataFrame:
    """list, m, said and start of what is taken; each sentence's candidates are an array of its own."""
    taken = rows.select(*key, "pieces", "ks", F.explode_outer(_taken(entries)).alias("m")).where("m is not null")
    said, begin = _place(F.col("m.at"), F.col("m.end"))
    return taken.select(*key, F.col("m.list").alias("list"), "m", said.alias("said"), begin.alias("start"))


def _joined(rows: DataFrame, key: list[str], entries: DataFrame, blocks: list[str] | None) -> DataFrame:
    """The same by a join of words and entries, broadcast where their beginnings are given."""
    starts = rows.select(*key, "pieces", "ks", "keys", F.explode_outer(_begun(blocks)).alias("b")).where("b is not null").select(*key, "pieces", "ks", "keys", "b.at", "b.block")
    met = starts.join(entries if blocks is None else F.broadcast(entries), "block").where(_same(F.col, F.col("at")))
    said, begin = _place(F.col("at"), F.col("at") + F.size("words"))
    one = F.struct(*_one(F.col, F.col("at")), said.alias("said"), begin.alias("start"))
    # a generator of one element: without it the grouping would take in the sentence, and sort it for every match
    lists = met.select(*key, "list", F.explode_outer(F.array(one)).alias("m")).groupBy(*key, "list").agg(F.array_sort(F.collect_list("m")).alias("found"))
    kind = lists.schema["found"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("taken"))
    step = lambda a, x: F.when(x["at"] >= a["free"], F.struct(x["end"].alias("free"), F.concat(a["taken"], F.array(x)).alias("taken"))).otherwise(a)
    chosen = lists.select(*key, "list", F.explode(F.aggregate("found", start, step, lambda a: a["taken"])).alias("m"))
    return chosen.select(*key, "list", "m", "m.said", "m.start")


def term_consistency(matched: DataFrame) -> DataFrame:
    """Occurrences of synonyms (group, term) other than the most frequent of their group in a document
    that uses two or more of the group; of equally frequent ones the earliest counts."""
    used = matched.where(F.startswith("list", F.lit("es:"))).select("doc_id", "para_idx", "sent_no", F.col("first_tok").alias("tok_idx"), "last_tok", F.substring_index("list", ":", -1).cast("int").alias("group"), F.col("phrase").alias("term"), "said", "start")
    by = used.groupBy("doc_id", "group", "term").agg(F.count("*").alias("n"), F.min(F.struct("para_idx", "sent_no", "tok_idx")).alias("seen"))
    best = by.groupBy("doc_id", "group").agg(F.min_by("term", F.struct(-F.col("n"), F.col("seen"))).alias("dominant"), F.count("*").alias("members")).where("members > 1")
    return used.join(best, ["doc_id", "group"]).where("term <> dominant").select("doc_id", "para_idx", "sent_no", "tok_idx", "last_tok", "group", "term", "dominant", "said", "start")

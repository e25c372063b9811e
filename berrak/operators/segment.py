"""Documents to paragraphs, sentences and tokens, as expressions over whole texts.

Boundaries are marked in a paragraph before it is cut; nothing leaves the JVM and nothing is
shuffled, as every row generator works within its row. Full stops that end no sentence (abbreviations, initials, ordinals) are
replaced by a placeholder of equal length while a paragraph is cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berrak.functions import numbers
from berrak.functions.arrays import let
from berrak.functions.turkish import VOWELS, count_vowels, is_upper_word, normalize, spell_letters, turkish_lower
from berrak.operators import morphology

#: Characters of the private use area that mark cuts and protected full stops.
CUT, STOP = "\ue000", "\ue001"
#: Abbreviations whose full stop ends no sentence, and nouns before which a numbered full stop is an ordinal's.
ABBREVIATIONS = ["Alb", "Apt", "Av", "Bkz", "bkz", "Cad", "Doç", "Dr", "Fak", "Gen", "Hz", "Mah", "Müd", "No", "Op", "Prof", "Sn", "Sok", "St", "Tel", "Uzm", "Yrd"]
ORDINAL_NOUNS = ["madde", "fıkra", "bent", "bölüm", "sınıf", "kat", "yüzyıl", "cadde", "sokak", "hafta", "dönem", "gün", "yıl", "cilt", "sayı", "sayfa", "bölge", "grup"]
_NOUNS = "|".join(f"[{n[0]}{n[0].upper()}]{n[1:]}" for n in ORDINAL_NOUNS)
#: What opens a list item: a bullet, a number, or a letter with a bracket.
BULLETS = "-*+•‣◦▪·●○■"
MARKER = f"(?:[{BULLETS}]|[0-9]{{1,3}}[.)]|\\p{{Ll}}\\)) +"
#: Fixed value: at least one empty line between paragraphs.
PARAGRAPH = "(?:\n *){2,}"
#: Forms of tokens, put together from characters. A net address does not end in a closing sign.
CLOSING = ".,;:!?)\\]}"
NET = f"(?:https?://|www\\.)[^\\s<>\"']*[^\\s<>\"'{CLOSING}]"
MAIL = "[\\p{L}0-9][\\p{L}0-9._+-]*+@(?:[\\p{L}0-9-]+\\.)+[\\p{L}0-9]+"
#: Groups of digits, and the signs that join them.
AMOUNT = "(?:[0-9]+[.,:/-])*[0-9]+"
DECIMAL = "(?:[0-9]+[.,])?[0-9]+"
INITIALS = "\\p{Lu}\\.(?:\\p{Lu}\\.)+"
WORD = "\\p{L}++(?:[-']\\p{L}++)*+"
#: A suffix after an apostrophe.
SUFFIX = "(?:'\\p{L}+)?"
_WITH_DIGITS = [f"% ?{DECIMAL}{SUFFIX}", f"{DECIMAL} ?%", AMOUNT + SUFFIX]
TOKEN = "|".join([NET, MAIL, *_WITH_DIGITS, INITIALS + SUFFIX, WORD, "\\s+", "\\S"])
#: The same tokens where there are no addresses of nets and mail: words come first.
PLAIN_TOKEN = "|".join([INITIALS + SUFFIX, WORD, *_WITH_DIGITS, "\\s+", "\\S"])
DATE = "^(?:[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})$"
TIME = "^(?:[01]?[0-9]|2[0-3])[:.][0-5][0-9]$"
COUNTED = ("word", "number", "date", "time", "percent")
WORD_LIKE = (*COUNTED, "url", "email")


def with_normal_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``norm``; null text counts as empty."""
    return docs.withColumn("norm", normalize(F.coalesce(F.col(text), F.lit(""))))


#: Comments, tags by their names, and links with what they show; a target may hold one pair of brackets.
COMMENT = "(?s)<!--(.*?)-->"
TAG_NAME = "[A-Za-z][-A-Za-z0-9]*"
TAG = f"<(?:/{TAG_NAME}\\s*|{TAG_NAME}(?:\\s[^<>]*)?)/?>"
LINK = "(!?\\[)([^\\[\\]]*)(\\]\\([^\\s()]*(?:\\([^\\s()]*\\)[^\\s()]*)?\\))"


#: Characters of the private use area around what is blanked.
OPEN, CLOSE = "\ue002", "\ue003"


def blanked(text: Column, pattern: str, around: str = f"{OPEN}$0{CLOSE}") -> Column:
    """Spaces instead of every match of a pattern, as many as it has characters. ``around`` marks what of a match goes."""
    pieces = F.split(F.regexp_replace(text, pattern, around), f"[{OPEN}{CLOSE}]")
    spaces = F.transform(pieces, lambda x, k: F.when(k % 2 == 1, F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(spaces, "")).otherwise(text)


#: What is blanked, one after another.
MASKS = (
    lambda t: F.when(F.contains(t, F.lit("<!--")), blanked(t, COMMENT)).otherwise(t),
    lambda t: F.when(F.contains(t, F.lit("](")), blanked(t, LINK, f"{OPEN}$1{CLOSE}$2{OPEN}$3{CLOSE}")).otherwise(t),
    lambda t: F.when(F.contains(t, F.lit("<")), blanked(t, TAG)).otherwise(t),
)


def mask_markup(text: Column) -> Column:
    """Comments, tags and the syntax of links become spaces; every other character keeps its place."""
    return reduce(let, MASKS, text)


def suppressed_ids(paragraph: Column) -> Column:
    """Rule ids that a paragraph's comments switch off; ``*`` stands for all."""
    ours = F.filter(F.regexp_extract_all(paragraph, F.lit(COMMENT), F.lit(1)), lambda c: F.rlike(c, F.lit("(?i)^\\s*berrak\\s*:\\s*ignore")))
    named = F.transform(ours, lambda c: F.regexp_extract_all(F.upper(c), F.lit("KD-[CKBM][0-9]{2}"), F.lit(0)))
    return F.array_distinct(F.flatten(F.transform(named, lambda ids: F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit("*"))))))


SWITCHES = "struct<pending: array<string>, done: array<array<string>>>"


def switched_off(parts: Column) -> Column:
    """The suppressed ids of each paragraph: its own, and those of paragraphs without any text just before it."""

    def step(a: Column, x: Column) -> Column:
        ids = F.array_distinct(F.concat(a["pending"], suppressed_ids(x)))
        empty = ~F.rlike(mask_markup(x), F.lit("[\\p{L}\\p{Nd}]"))
        return F.struct(F.when(empty, ids).otherwise(F.array().cast("array<string>")).alias("pending"), F.concat(a["done"], F.array(ids)).alias("done")).cast(SWITCHES)

    start = F.struct(F.array().alias("pending"), F.array().alias("done")).cast(SWITCHES)
    return F.aggregate(parts, start, step, lambda a: a["done"])


def paragraphs(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, para_idx, text and suppressed of every paragraph with a letter or digit, and the columns ``carry`` of its document."""
    parts = with_normal_text(docs).select("doc_id", *carry, F.split("norm", PARAGRAPH).alias("parts"), (F.contains("norm", F.lit("<!--")) & F.rlike("norm", F.lit("(?i)<!--\\s*berrak\\s*:"))).alias("switched"))
    parts = parts.select("doc_id", *carry, "parts", F.when(F.col("switched"), switched_off(F.col("parts"))).alias("ids"))
    # Outer generators throughout: for the others Spark asks first whether the array is empty, and works it out twice.
    split = parts.select("doc_id", *carry, "ids", F.posexplode_outer("parts").alias("para_idx", "text")).where(F.rlike("text", F.lit("[\\p{L}\\p{Nd}]")))
    off = F.coalesce(F.get("ids", F.col("para_idx")), F.array().cast("array<string>"))
    return split.select("doc_id", *carry, "para_idx", mask_markup(F.col("text")).alias("text"), off.alias("suppressed"))


def marked_sentences(text: Column) -> Column:
    """The text with a mark at each sentence end and list item, and harmless full stops replaced."""
    # what begins here is looked at first; two in a row without a character between them are not both taken
    begins = "(?:^|(?<=[^\\p{L}])(?!\\G))"
    out = F.regexp_replace(text, f"(?=[{''.join(sorted({a[0] for a in ABBREVIATIONS}))}]){begins}({'|'.join(ABBREVIATIONS)})\\.", f"$1{STOP}")
    out = F.regexp_replace(out, f"(?=\\p{{Lu}}){begins}(\\p{{Lu}}|[IVX]{{2,5}})\\.", f"$1{STOP}")
    out = F.regexp_replace(out, f"([0-9])\\.(\\s+(?:{_NOUNS}))", f"$1{STOP}$2")
    out = F.regexp_replace(out, "([.!?…]+[\"')\\]]*)(\\s+)([\"'(\\[]*[\\p{Lu}0-9])", f"$1{CUT}$2$3")
    return let(F.regexp_replace(out, f"(\n[ ]*{MARKER})", f"{CUT}$1"), cut_lines)


#: Words after which a sentence goes on in the next line, and words that begin an address; our own choice.
CONNECTING = ["ve", "veya", "ya", "ile", "ama", "fakat", "ancak", "çünkü", "için", "gibi", "kadar", "ki", "hem", "bu", "şu", "o", "bir", "en", "çok", "daha", "olan", "olarak", "göre", "her", "ise"]
ADDRESSING = ["sayın", "değerli", "sevgili", "saygıdeğer", "merhaba", "selam"]
MOST_WORDS_A_LINE, MOST_WORDS_A_HEADING = 15, 12


def cut_lines(marked: Column) -> Column:
    """Marked text with a mark, where there is none, at the ends of lines that are sentences of their own.

    Lines of text that was wrapped go on in the next one and are left as they are. Not so in three kinds of paragraphs:
    an address with a comma before a line that begins with a capital; lines that all begin with a capital, hold at most 15 words
    and end neither in a sign that goes on nor in a connecting word, one before the last without a full stop and no item; and three lines or more of which two or more end
    as sentences do, at most half as many as these don't and are no headings or items, and none goes on in small letters. Of the last kind, lines that
    end in a comma, semicolon or colon stay with the next. Lines without letters and digits are not looked at.
    """
    opens = lambda x: F.rlike(x, F.lit("^[\"'(\\[]*[\\p{Lu}0-9]"))
    words = lambda y: F.size(F.split(y["x"], " +"))
    joins = lambda y: F.rlike(y["x"], F.lit("-$")) | turkish_lower(F.regexp_extract(y["x"], "([^ ]+)$", 1)).isin(*CONNECTING)
    count = lambda of, when: F.size(F.filter(of, when))

    def told(x: Column) -> Column:
        kinds = {"opens": opens(x), "item": F.rlike(x, F.lit("^" + MARKER)), "ends": F.rlike(x, F.lit("[.!?…][\"')\\]]*$")), "waits": F.rlike(x, F.lit("[,;:]$"))}
        return F.struct(x.alias("x"), *[v.alias(k) for k, v in kinds.items()])

    def single(own: Column) -> Column:
        alone = lambda y: y["item"] | (y["opens"] & ~y["waits"] & ~joins(y) & (words(y) <= MOST_WORDS_A_LINE))
        unended = F.exists(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), lambda y: ~y["item"] & ~y["ends"])
        return (F.size(own) > 1) & unended & F.forall(own, alone)

    def pasted(own: Column) -> Column:
        begins = lambda y: y["opens"] | y["item"]
        done = F.transform(own, lambda y, k: F.struct(y.alias("y"), F.coalesce(begins(F.get(own, k + 1)), F.lit(True)).alias("done")))
        open_ = lambda y: ~y["ends"] & ~y["waits"] & ~y["item"]
        plain = count(own, lambda y: open_(y) & ~(y["opens"] & (words(y) <= MOST_WORDS_A_HEADING)))
        full = count(own, lambda y: y["ends"])
        return (F.size(own) > 2) & let(full, lambda n: (n > 1) & (plain * 2 <= n)) & F.forall(done, lambda z: ~open_(z["y"]) | z["done"])

    def address(own: Column) -> Column:
        first = F.get(own, F.lit(0))
        named = (words(first) <= 3) & F.rlike(first["x"], F.lit("^\\p{Lu}[^ ]*(?: \\p{Lu}[^ ]*)*,$"))
        known = (words(first) <= 5) & turkish_lower(F.regexp_extract(first["x"], "^(\\p{Lu}\\p{L}*)", 1)).isin(*ADDRESSING)
        return F.endswith(first["x"], F.lit(",")) & (named | known) & F.coalesce(F.get(own, F.lit(1))["opens"], F.lit(False))

    def cut(lines: Column, verdict: Column) -> Column:
        # -1: the last line has no end to be marked
        last = F.size(lines) - 1
        here = lambda x, k: (k < last) & ~F.endswith(x, F.lit(CUT)) & ((verdict["every"] & ~F.rlike(x, F.lit("[,;:] *$"))) | (verdict["greeted"] & (k == 0)))
        every = F.array_join(F.transform(lines, lambda x, k: F.when(here(x, k), F.concat(x, F.lit(CUT))).otherwise(x)), "\n")
        return F.when(verdict["every"] | verdict["greeted"], every).otherwise(marked)

    def judged(lines: Column) -> Column:
        bare = F.filter(F.transform(lines, lambda x: F.trim(F.replace(x, F.lit(CUT), F.lit("")))), lambda x: F.rlike(x, F.lit("[\\p{L}\\p{Nd}]")))
        verdict = lambda own: F.struct((single(own) | pasted(own)).alias("every"), F.coalesce(address(own), F.lit(False)).alias("greeted"))
        return let(let(F.transform(bare, told), verdict), lambda v: cut(lines, v))

    return F.when(F.contains(marked, F.lit("\n")), let(F.split(marked, "\n"), judged)).otherwise(marked)


PLACED_AT_ONCE = 64


def _placed(pieces: Column) -> Column:
    """The pieces with the place where each starts: the lengths before it.

    Each step of a fold copies what is done, so that long arrays are folded in blocks: starts within each block, then
    those of the blocks, blocks of blocks for short.
    """

    def starts(sizes: Column) -> Column:
        # the last one is the sum of all
        return F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def blocks(own: Column) -> Column:
        n = F.size(own)
        each = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PLACED_AT_ONCE).cast("int")), lambda b: F.slice(own, b * PLACED_AT_ONCE + 1, F.lit(PLACED_AT_ONCE)))
        return F.transform(each, lambda x: F.struct(x.alias("x"), starts(F.transform(x, F.length)).alias("at")))

    def joined(of: Column) -> Column:
        first = starts(F.transform(of, lambda b: F.element_at(b["at"], -1)))
        return let(first, lambda own: F.flatten(F.transform(of, lambda b, k: F.transform(b["x"], lambda p, i: F.struct((F.get(own, k) + F.get(b["at"], i)).alias("at"), p.alias("piece"))))))

    return let(pieces, lambda own: F.when(F.size(own) > 0, let(blocks(own), joined)).when(F.size(own) == 0, F.array().cast("array<struct<at:int,piece:string>>")))


def paragraph_starts(docs: DataFrame) -> DataFrame:
    """doc_id, para_idx and where each paragraph starts in the normalised text."""
    pieces = F.split(F.regexp_replace("norm", PARAGRAPH, f"{CUT}$0{CUT}"), CUT)
    placed = with_normal_text(docs).select("doc_id", F.filter(_placed(pieces), lambda x, k: k % 2 == 0).alias("p"))
    return placed.select("doc_id", F.posexplode("p").alias("para_idx", "p")).select("doc_id", "para_idx", F.col("p.at").alias("at"))


def sentences(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, para_idx, sent_no and start (within the paragraph's text), text, is_heading, is_list_item, suppressed, and ``carry``.

    A paragraph of one line without an end, of at most 12 words and 100 characters and with a
    capital first letter, is a heading.
    """
    pieces = F.split(marked_sentences(F.col("text")), CUT)
    marked = paragraphs(docs, carry).select("doc_id", *carry, "para_idx", "suppressed", _placed(pieces).alias("pieces"), F.contains("text", F.lit("\n")).alias("many"))
    cut = marked.select("doc_id", *carry, "para_idx", "suppressed", "many", F.posexplode_outer("pieces").alias("sent_no", "p"))
    cut = cut.select("*", F.col("p.piece").alias("piece"), (F.col("p.at") + F.length(F.regexp_extract("p.piece", "^\\s*", 0))).alias("start")).drop("p")
    plain = cut.withColumn("text", F.regexp_replace(F.replace("piece", F.lit(STOP), F.lit(".")), "^\\s+|\\s+$", "")).where(F.rlike("text", F.lit("[\\p{L}\\p{Nd}]")))
    item = F.rlike("text", F.lit("^" + MARKER))
    short = (F.size(F.split("text", "\\s+")) <= 12) & (F.length("text") <= 100)
    heading = (F.col("sent_no") == 0) & ~F.col("many") & ~item & short & F.rlike("text", F.lit("^[\"'(]*\\p{Lu}")) & ~F.rlike("text", F.lit("[.!?…:;,][\"')\\]]*$")) & ~F.rlike("text", F.lit("@|://"))
    return plain.select("doc_id", "para_idx", "sent_no", "start", "text", heading.alias("is_heading"), item.alias("is_list_item"), "suppressed", *carry)


def token_kind(token: Column) -> Column:
    """The kind of a token. Words are told by their first letter, so that most tokens need one pattern only."""
    base = F.substring_index(token, "'", 1)
    net = F.startswith(token, F.lit("http")) & (F.startswith(token, F.lit("http://")) | F.startswith(token, F.lit("https://"))) | F.startswith(token, F.lit("www."))
    mail = F.contains(token, F.lit("@")) & F.rlike(token, F.lit(".@."))
    # small ASCII letters first, without a pattern
    letter = ((token >= "a") & (token < "{")) | F.rlike(token, F.lit("^\\p{L}"))
    return (
        F.when(letter, F.when(net, "url").when(mail, "email").otherwise("word"))
        .when(token.isin(*".,;:!?…\"'()[]{}/-"), "punct")
        .when(mail, "email")
        .when(F.contains(token, F.lit("%")) & F.rlike(token, F.lit("%[^\\s]|[0-9]\\s?%|%\\s[0-9]")), "percent")
        .when(F.rlike(base, F.lit(DATE)), "date")
        .when(F.rlike(base, F.lit(TIME)), "time")
        .when(F.rlike(token, F.lit("^[0-9]")), "number")
        .otherwise("symbol")
    )


def syllables(token: Column, kind: Column, is_abbreviation: Column, vowels: Column | None = None) -> Column:
    """The syllables of a token; ``vowels``: how many it has, where that is known already."""
    base, suffix = F.substring_index(token, "'", 1), numbers.suffix_syllables(token)
    vowels = count_vowels(token) if vowels is None else vowels
    return (
        F.when(kind == "word", F.when(is_abbreviation, spell_letters(base) + suffix).when(vowels == 0, spell_letters(token)).otherwise(vowels))
        .when(kind.isin("punct", "symbol"), 0)
        .when(kind.isin("number", "percent", "date", "time"), numbers.reading_syllables(base, kind) + suffix)
        .otherwise(F.greatest(F.lit(1), count_vowels(base)))
    )


#: What a token has, in this order.
FIELDS = ("k", "token", "kind", "lower", "base", "low", "is_abbreviation", "syllables")


def _cut(text: Column, white: bool) -> Column:
    """The tokens of a text, with white space or without. Addresses are looked for where there may be some."""
    of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern if white else pattern.replace("|\\s+", "")), F.lit(0))
    addresses = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in ("@", "://", "www.")])
    return F.when(addresses, of(TOKEN)).otherwise(of(PLAIN_TOKEN))


def with_tokens(sents: DataFrame, analyse: bool = False, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Sentences with ``pieces``, which put together are the text, and ``toks``: those that aren't white space.

    A token has k (its place among the pieces), token, kind, lower, base and low (without what
    follows an apostrophe), is_abbreviation and syllables; with ``analyse``, m: the flags of a word.
    A word of two to six capitals is an abbreviation unless most of its sentence is in capitals.
    ``fields``: those of them that are asked for; without k there are no ``pieces``.
    """
    has = set(fields)
    if "k" in has:
        cut = sents.withColumn("pieces", _cut(F.col("text"), True))
        # white space is what lies below "!", or nearly so
        solid = F.filter(F.transform("pieces", lambda x, k: F.struct(k.alias("k"), x.alias("token"))), lambda x: (x["token"] >= "!") | ((x["token"] != " ") & ~F.rlike(x["token"], F.lit("^\\s"))))
    else:
        cut = sents
        solid = F.transform(_cut(F.col("text"), False), lambda x: F.struct(x.alias("token")))
    asked = "is_abbreviation" in has or "syllables" in has
    own = ["k"] * ("k" in has) + ["token"]
    dotted = lambda x: F.contains(x["token"], F.lit("I")) | F.contains(x["token"], F.lit("İ"))
    # most tokens hold no I to be translated
    first = {"kind": lambda x: token_kind(x["token"]), "lower": lambda x: F.when(dotted(x), turkish_lower(x["token"])).otherwise(F.lower(x["token"])), "base": lambda x: F.substring_index(x["token"], "'", 1)}
    first = {c: make for c, make in first.items() if c in has or asked or (c == "kind" and analyse) or (c == "lower" and (analyse or "low" in has))}
    toks = F.transform(solid, lambda x: F.struct(*[x[c].alias(c) for c in own], *[make(x).alias(c) for c, make in first.items()])) if first else solid
    own += [*first]

    def shouting(of: Column) -> Column:
        words = F.filter(of, lambda x: x["kind"] == "word")
        loud = lambda w: F.size(F.filter(w, lambda x: (x["token"] != x["lower"]) & is_upper_word(x["token"])))
        # without two capitals in a row no word is an abbreviation by its capitals, and nobody asks
        return F.rlike("text", F.lit("\\p{Lu}[^\\p{L}]*\\p{Lu}")) & let(words, lambda w: loud(w) >= F.greatest(F.lit(3), F.floor(F.size(w) * 0.6 + 0.5).cast("int")))

    def told(x: Column, loud: Column) -> Column:
        more = [F.substring_index(x["lower"], "'", 1).alias("low")] if "lower" in own else []
        if asked:
            letters = F.length(F.regexp_replace(x["base"], "[^\\p{L}]", ""))
            short = (x["token"] != x["lower"]) & is_upper_word(x["base"]) & letters.between(2, 6) & ~loud
            more.append(((x["kind"] == "word") & (F.contains(x["base"], F.lit(".")) | short)).alias("is_abbreviation"))
        if "syllables" in has:
            more.append(F.when(x["kind"] == "word", F.length(x["lower"]) - F.length(F.translate(x["lower"], VOWELS, ""))).otherwise(count_vowels(x["token"])).alias("vowels"))
        return F.struct(*[x[c].alias(c) for c in own], *more)

    if asked:
        toks = let(toks, lambda of: let(shouting(of), lambda loud: F.transform(of, lambda x: told(x, loud))))
    elif "lower" in own:
        toks = F.transform(toks, lambda x: told(x, F.lit(False)))

    def whole(x: Column) -> Column:
        return F.struct(*[(syllables(x["token"], x["kind"], x["is_abbreviation"], x["vowels"]) if c == "syllables" else x[c]).alias(c) for c in FIELDS if c in has])

    if not analyse:
        return cut.withColumn("toks", F.transform(toks, whole))
    # the analysis is worked out for an array of words; a column of its own, so that it meets the tokens once
    told_ = cut.withColumn("toks", F.transform(toks, lambda x: F.struct(whole(x).alias("t"), F.when(x["kind"] == "word", x["low"]).otherwise("").alias("w"))))
    seen = told_.withColumn("marks", morphology.marks(F.transform("toks", lambda x: x["w"])))
    both = F.zip_with("toks", "marks", lambda x, m: F.struct(*[x["t"][c].alias(c) for c in FIELDS if c in has], morphology.unpacked(m).alias("m")))
    return seen.withColumn("toks", both).drop("marks")


def distinct_words(docs: DataFrame) -> DataFrame:
    """``low`` of every distinct word of the documents.

    No token crosses a sentence's end, so that paragraphs are cut into tokens as they are. Tokens are told apart by their kind, and put in small letters, once
    for the distinct ones; before the shuffle a task keeps one of each.
    """
    cut = paragraphs(docs).select(F.explode_outer(F.array_distinct(_cut(F.col("text"), False))).alias("token")).where("token is not null").distinct()
    return cut.where(token_kind(F.col("token")) == "word").select(F.substring_index(turkish_lower(F.col("token")), "'", 1).alias("low")).distinct()


def tokens(sents: DataFrame) -> DataFrame:
    """The sentences' tokens as rows, in order: tok_idx, token, kind, is_abbreviation, syllables, lower."""
    told = with_tokens(sents, fields=("token", "kind", "lower", "is_abbreviation", "syllables"))
    rows = told.select(*sents.columns, F.posexplode_outer("toks").alias("tok_idx", "t")).where("tok_idx is not null")
    return rows.select(*sents.columns, "tok_idx", *[F.col(f"t.{c}").alias(c) for c in ("token", "kind", "is_abbreviation", "syllables", "lower")])

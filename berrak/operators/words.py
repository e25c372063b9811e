"""Sentences with all that the full audit reads of their tokens, and what each sentence holds at all.

Most of what a token is depends on the token alone, and most tokens of a text are the same few: a batch's distinct
ones are looked at, and the last ones remembered. A token's marks are bits; the bits of a sentence's tokens together say which rules
have anything to look for there, so that the others don't go over its tokens.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berrak.functions.numbers import ROMAN_PATTERN
from berrak.functions.numerals import NUMBER_WORDS
from berrak.functions.turkish import LETTER_SYLLABLES, VOWELS
from berrak.operators import morphology
from berrak.operators.matching import FIRST
from berrak.operators.readability import ENGLISH
from berrak.operators.segment import DATE, TIME, WORD_LIKE, _cut

KINDS = ("word", "number", "date", "time", "percent", "url", "email", "punct", "symbol")
#: Words that deny by themselves.
DENYING = ("hiç", "hiçbir", "kimse")
#: A bit for each mark of a word, each kind, and what some rules look for.
BITS = {name: 1 << k for k, name in enumerate((*morphology.MARKS, *KINDS, "abbreviation", "number word", "denying", "teller", "formal", "roman"))}
#: k and at: its place among the pieces, and where it starts in the sentence. Syllables are those of a word that is no abbreviation; other tokens have none.
TOKEN = "struct<k:int,at:int,token:string,kind:string,lower:string,base:string,low:string,is_abbreviation:boolean,syllables:int,m:int>"
#: Of a sentence: its tokens; their small letters as phrases are held against; the bits of all; words of any kind, words, those in capitals, the most syllables of a word, the letters of words and English function words.
COUNTS = ("seen", "n_words", "n_plain", "n_loud", "longest", "letters", "english")
#: begun: the tokens, by their number, that begin as phrases do, and the number of that beginning.
TOLD = f"struct<toks:array<{TOKEN}>,keys:array<string>,begun:array<struct<at:int,of:int>>,{','.join(f'{c}:int' for c in COUNTS)}>"

_DOTTED, _UNDOTTED = str.maketrans("Iİ", "ıi"), str.maketrans("iı", "İI")
_CIRCUMFLEX = str.maketrans(*morphology.CIRCUMFLEX)
_PERCENT = re.compile(r"%[^\s]|[0-9]\s?%|%\s[0-9]", re.A)
_DATE, _TIME, _ROMAN = (re.compile(p) for p in (DATE, TIME, ROMAN_PATTERN))
_VOWEL, FORMAL = re.compile(f"[{VOWELS}]"), ("ınız", "iniz", "unuz", "ünüz")
_TELLER = re.compile("|".join(by for _, by in morphology.TOLD_BY))


class Facts(NamedTuple):
    lower: str
    base: str
    low: str
    key: str
    kind: int
    solid: bool
    short: bool
    loud: bool
    syllables: int | None
    letters: int
    english: bool
    bits: int
    size: int


def _kind(token: str, base: str) -> str:
    """As ``segment.token_kind``."""
    mail = "@" in token and re.search(".@.", token)
    if token[0].isalpha():
        if token.startswith(("http://", "https://", "www.")):
            return "url"
        return "email" if mail else "word"
    if token in ".,;:!?…\"'()[]{}/-":
        return "punct"
    if mail:
        return "email"
    if "%" in token and _PERCENT.search(token):
        return "percent"
    if _DATE.search(base):
        return "date"
    if _TIME.search(base):
        return "time"
    return "number" if "0" <= token[0] <= "9" else "symbol"


def _lower(text: str) -> str:
    return text.translate(_DOTTED).lower() if "I" in text or "İ" in text else text.lower()


def _is_upper(text: str) -> bool:
    return text == text.translate(_UNDOTTED).upper() and text != _lower(text)


def _letters(text: str) -> int:
    return len(text) if text.isalpha() else sum(map(str.isalpha, text))


def _spelled(lower: str) -> int:
    return _letters(lower) + sum((n - 1) * lower.count(c) for c, n in LETTER_SYLLABLES.items())


@functools.lru_cache(morphology.MOST_REMEMBERED)
def facts(token: str) -> Facts:
    """What a piece is by itself; a word may be an abbreviation by its capitals (``short``) if its sentence isn't in capitals."""
    if token[0] in " \t\n\x0b\f\r":
        return Facts("", "", "", "", 0, False, False, False, None, 0, False, 0, len(token))
    lower = _lower(token)
    base, low = (token.split("'", 1)[0], lower.split("'", 1)[0]) if "'" in token else (token, lower)
    kind = _kind(token, base)
    bits = BITS[kind] | (BITS["number word"] if lower in NUMBER_WORDS else 0)
    if kind != "word":
        return Facts(lower, base, low, low, KINDS.index(kind), True, False, False, None, 0, False, bits, len(token))
    short = loud = False
    bits |= morphology.word_marks(low)
    if token != lower:
        short = _is_upper(base) and 2 <= _letters(base) <= 6
        loud = _is_upper(token)
        bits |= BITS["roman"] if _ROMAN.search(base) else 0
    bits |= (BITS["abbreviation"] if "." in base else 0) | (BITS["denying"] if low in DENYING else 0) | (BITS["teller"] if _TELLER.search(low) else 0) | (BITS["formal"] if low.endswith(FORMAL) else 0)
    vowels = len(_VOWEL.findall(lower))
    return Facts(lower, base, low, low.translate(_CIRCUMFLEX) if not low.isascii() else low, 0, True, short, loud, vowels or _spelled(lower), _letters(token), token.lower() in ENGLISH, bits, len(token))


def _capitals_in_a_row(pieces: list[str]) -> bool:
    """Whether two letters, one after the other, are capitals."""
    import unicodedata

    letters = [unicodedata.category(c) == "Lu" for c in "".join(pieces) if c.isalpha()]
    return any(a and b for a, b in zip(letters, letters[1:], strict=False))


def _told(batches: Iterator[pa.Array], beginnings: list[str]) -> Iterator[pa.Array]:
    number = {x: k for k, x in enumerate(beginnings)}
    for pieces in batches:
        coded = pieces.flatten().dictionary_encode()
        own = [facts(w) for w in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        by = dict(zip(Facts._fields, zip(*own, strict=True) if own else [()] * len(Facts._fields), strict=True))
        column = lambda name, kind: np.array(by[name], kind)  # noqa: B023, E731
        offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        n, counts = len(pieces), np.diff(offsets)
        row = np.repeat(np.arange(n), counts)
        ends = np.concatenate([[0], np.cumsum(column("size", np.int64)[codes])])
        solid = column("solid", bool)[codes]
        at, k = ends[:-1] - ends[offsets[row]], np.arange(len(codes)) - offsets[row]
        firsts = np.concatenate([[0], np.cumsum(solid)])[offsets]
        at, k, row, codes = (x[solid].astype(np.int32) for x in (at, k, row, codes))
        bits = column("bits", np.int32)[codes]
        total = lambda of: np.bincount(row, of.astype(np.int64), n).astype(np.int32)  # noqa: B023, E731
        word, loud = (bits & BITS["word"]) != 0, column("loud", bool)[codes]
        n_plain, n_loud = total(word), total(loud)
        # most of the sentence is in capitals
        shouting = n_loud >= np.maximum(3, np.floor(n_plain * 0.6 + 0.5))
        for i in np.flatnonzero(shouting):
            shouting[i] = _capitals_in_a_row(pieces[int(i)].as_py())
        bits[column("short", bool)[codes] & ~shouting[row]] |= BITS["abbreviation"]
        syllables = np.array([x or 0 for x in by["syllables"]], np.int32)[codes]
        longest, seen = np.zeros(n, np.int32), np.zeros(n, np.int32)
        np.maximum.at(longest, row, syllables)
        np.bitwise_or.at(seen, row, bits)
        of = pa.array(codes)
        text = lambda name: pa.array(by[name], pa.string()).take(of)  # noqa: B023, E731
        kinds = pa.array(KINDS).take(pa.array(column("kind", np.int32)[codes]))
        columns = [pa.array(k), pa.array(at), coded.dictionary.cast(pa.string()).take(of), kinds, text("lower"), text("base"), text("low"), pa.array((bits & BITS["abbreviation"]) != 0), pa.array(syllables, mask=~word), pa.array(bits)]
        names = [x.split(":")[0] for x in TOKEN.removeprefix("struct<").removesuffix(">").split(",")]
        lists = lambda values: pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), values)  # noqa: B023, E731
        like = (bits & sum(BITS[x] for x in WORD_LIKE)) != 0
        of_begun = np.array([number.get(x[:FIRST], -1) for x in by["key"]], np.int32)[codes]
        begun = np.flatnonzero(of_begun >= 0)
        starts = pa.StructArray.from_arrays([pa.array((begun - firsts[row[begun]]).astype(np.int32)), pa.array(of_begun[begun])], ["at", "of"])
        begun = pa.ListArray.from_arrays(pa.array(np.searchsorted(begun, firsts).astype(np.int32)), starts)
        whole = [seen, total(like), n_plain, n_loud, longest, total(column("letters", np.int64)[codes]), total(column("english", bool)[codes])]
        yield pa.StructArray.from_arrays([lists(pa.StructArray.from_arrays(columns, names)), lists(text("key")), begun, *map(pa.array, whole)], ["toks", "keys", "begun", *COUNTS])


def told(sents: DataFrame, beginnings: list[str] | None = None) -> DataFrame:
    """Sentences with ``pieces``, ``toks``, ``keys`` and ``begun``, and the counts of each sentence. ``beginnings``: the first letters of phrases, as many as ``FIRST``."""

    def own(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _told(batches, beginnings or [])

    cut = sents.withColumn("pieces", _cut(F.col("text"), True))
    rows = cut.withColumn("told", F.arrow_udf(own, TOLD)(F.col("pieces")))
    return rows.select(*cut.columns, *[F.col(f"told.{c}").alias(c) for c in ("toks", "keys", "begun", *COUNTS)])


def marked(x: Column, *names: str) -> Column:
    """Whether a token (or a sentence, by ``seen``) has one of some marks."""
    return x.bitwiseAND(F.lit(sum(BITS[n] for n in names))) != 0

"""Forms that a document uses as proper names, told by the whole document, without a shuffle.

A capital within a sentence tells a name where it stands. At a sentence's start every word has one, so that
the document tells: a form with a capital and an apostrophe before its ending is a name, and so is one that
has a capital twice or more and is never written without, if it is no word that sentences like to
begin with. All of it is array expressions over one document; sorting finds what comes twice, and hashed
set operations what is never in small letters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from berrak.functions.arrays import let
from berrak.functions.turkish import fold_circumflex, is_upper_word, normalize, turkish_lower
from berrak.operators.segment import MASKS

#: Words that begin sentences and are no names; our own choice.
BEGINNINGS = [
    "bu", "şu", "o", "bir", "her", "hiç", "ben", "sen", "biz", "siz", "onlar", "bunlar", "şunlar", "ve", "ama", "fakat", "ancak", "çünkü", "eğer", "ayrıca", "bunun", "onun", "böyle", "şöyle", "öyle", "sonra", "önce", "şimdi",
    "bugün", "yarın", "dün", "burada", "orada", "şurada", "evet", "hayır", "peki", "tamam", "lütfen", "nasıl", "neden", "niçin", "nerede", "kim", "ne", "hangi", "kaç", "daha", "en", "çok", "az", "bütün", "tüm", "bazı",
    "birçok", "hem", "ya", "yani", "örneğin", "mesela", "madde", "bölüm", "sayın",
]


#: A word; its parts are never given back once matched.
WORD = "\\p{L}++(?:[-']\\p{L}++)*+"


def plain_text(text: Column) -> Column:
    """The normalised text without markup, each step worked out once."""
    return reduce(let, MASKS, normalize(F.coalesce(text, F.lit(""))))


def proper_forms(text: Column, known: list[str] | None = None) -> Column:
    """The forms (small letters, without circumflexes and endings after an apostrophe) used as names, sorted.

    ``known``: words that are no names however they are written. Words in capitals throughout are not
    looked at. Null and empty texts have none.
    """
    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda words: _forms(words, known))


def _forms(words: Column, known: list[str] | None) -> Column:
    base = lambda w: F.substring_index(w, "'", 1)
    form = lambda w: fold_circumflex(turkish_lower(base(w)))
    # small ASCII letters first, without a pattern
    ascii_small = lambda w: (w >= "a") & (w < "{")
    begun = F.filter(words, lambda w: ~ascii_small(w) & F.rlike(w, F.lit("^\\p{Lu}")) & ((F.length(base(w)) == 1) | ~is_upper_word(base(w))))
    small = F.transform(F.array_distinct(F.filter(words, lambda w: ascii_small(w) | F.rlike(w, F.lit("^\\p{Ll}")))), form)
    marked = F.transform(F.filter(begun, lambda w: F.contains(w, F.lit("'"))), form)
    # sorted once, as the only element of an array
    again = lambda ordered: F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1) == x, F.lit(False)))
    twice = F.get(F.transform(F.array(F.array_sort(F.transform(begun, form))), again), F.lit(0))
    common = F.array(*[F.lit(w) for w in sorted({*BEGINNINGS, *(known or [])})])
    # small letters are asked for only where a form comes twice
    alone = let(F.array_except(twice, common), lambda own: F.when(F.size(own) > 0, F.array_except(own, small)).otherwise(own))
    return F.array_sort(F.array_union(marked, alone))


def is_name(names: Column, low: Column) -> Column:
    return F.coalesce(F.array_contains(names, fold_circumflex(low)), F.lit(False))

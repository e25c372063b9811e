"""A heuristic analysis of Turkish words by their endings.

No dictionary is at hand, so flags come from the endings of the lower-cased word, and their
confidence is fixed. Endings are put together from a table of suffixes, written with the
letters that stand for what vowel harmony and neighbours make of them. All of it is column
expressions over the word itself: nothing is shuffled or joined.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from berrak.functions.turkish import CIRCUMFLEX, fold_circumflex, soften_final, turkish_lower

CONFIDENCE = 0.6
MOST_CHARACTERS = 80
#: A task's Python remembers the marks of so many words.
MOST_REMEMBERED = 200_000
_CIRCUMFLEX = str.maketrans(*CIRCUMFLEX)
#: What a letter of a suffix may become: a low vowel, a high vowel, and consonants that change with their neighbours.
SOUNDS = {"A": "[ae]", "I": "[ıiuü]", "D": "[dt]", "K": "[kğ]", "Y": "y?", "N": "n?", "S": "s?"}


def ending(suffixes: Iterable[str]) -> str:
    """A pattern for any of some suffixes, longer ones first."""
    written = ["".join(SOUNDS.get(c, c) for c in x) for x in sorted(suffixes, key=len, reverse=True)]
    return f"(?:{'|'.join(written)})"


#: Persons after most tenses, and after the past and the conditional.
PERSONS, SHORT_PERSONS = ("Im", "sIn", "Iz", "sInIz", "lAr"), ("m", "n", "k", "nIz", "lAr")
#: Suffixes that make a verb finite, by what they tell.
WITH_PERSONS = {"present": "Iyor", "future": "YAcAK", "evidential": "mIş", "duty": "mAlI", "progress": "mAktA", "general": "Ir", "general after some": "Ar", "never": "mAz"}
WITH_SHORT_PERSONS = {"past": "DI", "condition": "sA"}
ORDERS = ("sIn", "sInlAr", "YIn", "YInIz", "YAlIm")
#: A tense, then a person, or the past or the conditional with its own, or the copula.
FINITE = f"(?:{ending(WITH_PERSONS.values())}(?:{ending(PERSONS)}|{ending(WITH_SHORT_PERSONS.values())}{ending(SHORT_PERSONS)}?|{ending(['DIr'])})?|{ending(WITH_SHORT_PERSONS.values())}{ending(SHORT_PERSONS)}?)"
CONVERBS = ("YArAk", "YIncA", "mAdAn", "YIp", "YAlI", "DIkçA", "DIğIndA", "DIğImIzdA", "ken", "mAksIzIn", "mAzdAn")
POSSESSIVES = ("Im", "In", "I", "ImIz", "InIz", "lArI")
CASES = ("nA", "nI", "nIn", "ndA", "ndAn", "YA", "YI", "dA", "dAn", "YlA")
PARTICIPLES = f"{ending(['DIğ', 'YAcAğ'])}{ending(POSSESSIVES)}{ending(CASES)}?"
VERBAL_NOUNS = (*("mA" + "sI" + c for c in ("", "nA", "nI", "nIn", "ndA", "ndAn", "YlA")), *("mA" + c for c in ("nIn", "YA", "lArI", "lArInI", "lArInA")), "mAk", "mAktAn", "mAklA", "mAğA", "mAYI")
#: The negation of a verb and what follows it; the general tense and "never" are one.
AFTER_NOT = f"(?:{ending(WITH_SHORT_PERSONS.values())}{ending(SHORT_PERSONS)}?|{ending(['yAcAK', 'mIş', 'mAlI'])}(?:{ending([*PERSONS, 'DIr'])})?|{ending(['sIn', 'sInlAr', 'yIn', 'yInIz', 'yAlIm', 'z', 'zlAr', 'zsInIz', 'zsA', 'yAbIlIr'])})"
NEGATIVE = f"(?:m[ae]{AFTER_NOT}|m[ıiuü]yor(?:{ending([*PERSONS, 'DI'])})?)"
#: A passive stem is never of one syllable, so that its general tense is -Ir; -Ar after it is a plural's.
PASSIVE_TENSES = f"(?:{ending(v for k, v in WITH_PERSONS.items() if k != 'general after some')}(?:{ending(PERSONS)}|{ending(WITH_SHORT_PERSONS.values())}{ending(SHORT_PERSONS)}?|{ending(['DIr'])})?|{ending(WITH_SHORT_PERSONS.values())}{ending(SHORT_PERSONS)}?)"
AFTER_PASSIVE = f"(?:{PASSIVE_TENSES}|{NEGATIVE}|{PARTICIPLES}|{ending([*VERBAL_NOUNS, *CONVERBS, 'YAn', 'YAnlAr', 'mA', 'DIk', 'YAbIlIr', 'YAbIlIyor', 'YAbIlAcAK', 'mAyAn', 'mAmAsI'])})"
#: The condition with its persons, and tenses without a person that nouns end in as well.
CONDITION = f"{ending(['sA'])}{ending(SHORT_PERSONS)}?$"
BARE = f"^.{{2,}}{ending(['Ar', 'Ir'])}$"
#: A plural, and those of them that a verb has: after a tense, or as the -Ar of a stem of one syllable in -l ("güler").
PLURAL = f"{ending(['lAr'])}$"
VERBAL_PLURAL = f"{ending([*WITH_PERSONS.values(), *WITH_SHORT_PERSONS.values()])}{PLURAL}|^[^aeıioöuü]*[aeıioöuü]{PLURAL}"
#: Verbs in -t whose t softens before a vowel; of our own choosing. Other stems in -d there are none.
SOFTENING = ["et", "git", "güt", "tat", "affet", "bahset", "devret", "emret", "fethet", "hallet", "hapset", "hisset", "kaydet", "keşfet", "naklet", "reddet", "sabret", "sarfet", "seyret", "şükret", "zannet"]
#: Negations that stand within a clause and leave it to a later word to tell.
INNER_NEGATIVE = ("mAmAk", "mAmAktA", "mAmAsI", "mAmAnIz", "mAyAn", "mAyAnlAr", "mAdIğI", "mAdIklArI", "mAyAcAğI")
#: Words of our own choosing that only look like what an ending tells.
NOT_PASSIVE = [
    "insan", "kullan", "kazan", "inan", "öğren", "düşün", "taşın", "bozul", "üzül", "sevin", "beğen", "güven", "evlen", "ilgilen", "yararlan", "faydalan", "dinlen", "beslen", "seslen", "uzan", "uyan", "utan", "tüken",
    "görün", "bulun", "geçin", "sakın", "barın", "ayrıl", "katıl", "sarıl", "yanıl", "çekil", "eğil", "yorul", "doğrul", "kurtul", "bayıl", "atıl", "dağıl", "toplan", "kadın", "yakın", "altın", "sorun", "ürün", "yalın", "derin", "serin", "kalın",
]
NOT_NEGATIVE = ["namaz", "yılmaz", "korkmaz", "çıkmaz", "tamam", "domates", "temmuz", "almaz"]
NOT_PARTICIPLE = [
    "insan", "zaman", "orman", "liman", "roman", "duman", "uzman", "düşman", "plan", "ilan", "yılan", "aslan", "vatan", "divan", "tavan", "kurban", "meydan", "kaptan", "başkan", "bakan", "vatandaş", "hemen", "zaten", "bazen", "aynen",
    "neden", "tamamen", "kısmen", "esasen", "kesinlikle", "rağmen", "öğretmen", "yönetmen", "eleman", "derman", "ferman", "harman", "keman", "kalan", "nisan", "ramazan", "bayan", "ekran", "oran", "kanun", "alan", "sultan", "iman", "yaman", "saman", "süleyman", "osman", "beden", "maden", "desen", "erken", "iken", "sen", "ben", "ten", "gün", "yen",
]
NOT_FINITE = ["yiyecek", "içecek", "giyecek", "yakacak", "insan", "bir", "her", "kadar", "yer", "karar", "zarar", "pazar", "tekrar", "hazır", "demir", "nehir", "şehir", "özür", "ömür", "kömür", "müdür", "satır", "bakır", "sınır", "sabır", "çadır", "diğer", "değer", "eğer", "haber", "beraber", "kader", "defter", "şeker", "asker", "kamer", "mermer", "rehber", "duvar", "pınar", "çınar", "bahar", "damar", "ihtar", "miktar", "dolar", "sonra", "masa", "kasa", "yasa", "kısa", "oysa", "yoksa", "mesela", "kendi", "şimdi", "hadi", "haydi", "ordu", "kutu", "adı", "katı", "batı", "altı", "yedi", "dır", "dir"]
PREDICATES = ["değil", "var", "yok", "gerek", "lazım", "yasak", "mümkün", "zorunlu", "şart"]
REFLEXIVE = ["giyin", "yıkan", "taran", "hazırlan", "süslen", "soyun", "kurulan", "tanın"]
FLAGS = {
    "finite_form": f"^.*{FINITE}$|^.{{2,}}[^dt]{SOUNDS['D']}{SOUNDS['I']}r$|^(?:{'|'.join(PREDICATES)})(?:[dt]{SOUNDS['I']}r?)?$",
    "order": f"^.{{2,}}{ending(ORDERS)}$",
    # not the l of "be able to"
    "passive": f"^.+(?:[^b]{SOUNDS['I']}l|[^ae]b{SOUNDS['I']}l|.{SOUNDS['I']}n|.[aeo]n){AFTER_PASSIVE}$",
    "negative": f"^değil|^.{{2,}}{NEGATIVE}$",
    "inner_negative": f"^.{{2,}}{ending(INNER_NEGATIVE)}$|^.{{3,}}s{SOUNDS['I']}z$",
    "converb": f"^.{{1,}}{ending(CONVERBS)}$",
    "participle": f"^.{{2,}}{PARTICIPLES}$|^.+[aeıioöuü]y[ae]n(?:l[ae]r.*)?$|^.*[^aeıioöuüdtm][ae]n(?:l[ae]r.*)?$|^(?:eden|giden|tutan|yatan|biten|artan)(?:l[ae]r.*)?$",
    "nominal": f"^.{{2,}}{ending(VERBAL_NOUNS)}$",
    "genitive": "^.{2,}(?:[aeıioöuü]n[ıiuü]n|[^aeıioöuü][ıiuü]n)$",
}
#: What a verbal noun is told by, with the case or possession that it has before it: that something must be done, what it is for, that it begins.
OWNED = ending(["mAsI", "mAlArI"])
TOLD_BY = [
    (f"{OWNED}$", "^(?:gerek|zorunlu|şart$|mecburi|beklen|isten)"),
    (f"{OWNED}$", "^(?:amacıyla|maksadıyla|için|halinde|hâlinde|durumunda)$"),
    (f"{OWNED}{ending(['nA'])}$", "^(?:yönelik|ilişkin|dair)$"),
    (f"{ending(['In', 'Il'])}{ending(['mAyA'])}$", "^başlan"),
]
#: Words of each flag that their endings deceive, by how they begin, or whole.
DECEIVE = {"passive": ("starts", NOT_PASSIVE), "negative": ("starts", NOT_NEGATIVE), "participle": ("is", NOT_PARTICIPLE), "finite_form": ("is", NOT_FINITE)}
#: Endings of nouns, verbs and copulas that are taken off a word one after the other.
INFLECTIONS = sorted({"lar", "ler", *(x.translate(str.maketrans({"I": i, "A": a})) for i, a in (("ı", "a"), ("i", "e"), ("u", "a"), ("ü", "e")) for x in ("ImIz", "InIz", "lArI", "lArIn", "nIn", "In", "sI", "I", "A", "nA", "yA", "yI", "dA", "tA", "ndA", "dAn", "tAn", "ndAn", "lA", "ylA", "dIr", "tIr", "nI", "m", "n"))} - {"m", "n"}, key=lambda x: (-len(x), x))


def flag(base: Column, name: str) -> Column:
    """Whether an ending of that name marks a word, given in lower case without circumflexes."""
    out = F.rlike(base, F.lit(FLAGS[name]))
    if name in DECEIVE:
        how, words = DECEIVE[name]
        out = out & ~F.rlike(base, F.lit(f"^(?:{'|'.join(words)})" + ("$" if how == "is" else "")))
    return out


def analysis(low: Column) -> Column:
    """The flags of a word as a struct; none for a word of more than 80 characters or with letters that Turkish has not."""
    base = fold_circumflex(low)
    known = (F.length(base) <= MOST_CHARACTERS) & F.rlike(base, F.lit("^[a-zçğıöşü]+$"))
    return F.struct(*[F.coalesce(known & flag(base, name), F.lit(False)).alias(name) for name in FLAGS], F.coalesce(known & F.rlike(base, F.lit(f"^(?:{'|'.join(REFLEXIVE)})")), F.lit(False)).alias("reflexive"))


def flags(low: Column) -> Column:
    """The names of a word's flags as an array, in the order of ``FLAGS``; empty for words that ``analysis`` does not know."""
    base = fold_circumflex(low)
    known = (F.length(base) <= MOST_CHARACTERS) & F.rlike(base, F.lit("^[a-zçğıöşü]+$"))
    return F.when(known, F.array_compact(F.array(*[F.when(flag(base, name), F.lit(name)) for name in FLAGS]))).otherwise(F.array().cast("array<string>"))


MARKS = (*FLAGS, "reflexive")


@functools.cache
def _patterns() -> tuple[re.Pattern[str], list[tuple[int, re.Pattern[str], re.Pattern[str] | None]]]:
    """What a known word looks like, and for each mark its bit, its pattern and the pattern of the words that deceive it."""
    spared = {name: re.compile(f"^(?:{'|'.join(words)})" + ("$" if how == "is" else "")) for name, (how, words) in DECEIVE.items()}
    patterns = {**FLAGS, "reflexive": f"^(?:{'|'.join(REFLEXIVE)})"}
    return re.compile("[a-zçğıöşü]+"), [(1 << k, re.compile(patterns[name]), spared.get(name)) for k, name in enumerate(MARKS)]


@functools.lru_cache(MOST_REMEMBERED)
def word_marks(low: str) -> int:
    """The marks of a word, a bit for each, as ``analysis`` gives them."""
    base = low if low.isascii() else low.translate(_CIRCUMFLEX)
    known, patterns = _patterns()
    if len(base) > MOST_CHARACTERS or not known.fullmatch(base):
        return 0
    marks = 0
    for bit, pattern, spared in patterns:
        if pattern.search(base) and not (spared and spared.search(base)):
            marks |= bit
    return marks


def _marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for words in batches:
        coded = words.flatten().dictionary_encode()
        marks = pa.array([word_marks(w) for w in coded.dictionary.to_pylist()], pa.int32())
        yield pa.ListArray.from_arrays(pa.compute.subtract(words.offsets, words.offsets[0]), marks.take(coded.indices))


def marks(words: Column) -> Column:
    """The marks of arrays of words, in bits. A batch's distinct words are analysed, and the last ones remembered: most of a text are the same few."""
    return F.arrow_udf(_marked, "array<int>")(words)


def unpacked(bits: Column) -> Column:
    """The marks of a word as a struct, as ``analysis`` gives it."""
    return F.struct(*[(bits.bitwiseAND(F.lit(1 << k)) != 0).alias(name) for k, name in enumerate(MARKS)])


def formal_order(low: Column) -> Column:
    """Whether a word is a bare stem with -(y)InIz.

    Not so: the person -sInIz of a tense (unless after a stem of one syllable that ends in s), the past -DInIz,
    and possessives of plurals and of softened stems.
    """
    you = "(?:ını|ini|unu|ünü)z$"
    soft = "|".join(x[:-1] + "d" for x in SOFTENING)
    vowels = "aeıioöuü"
    short = F.rlike(low, F.lit(f"^[^{vowels}]*[{vowels}]s{you}"))
    person = F.rlike(low, F.lit(f"s{you}")) & ~short
    past = F.rlike(low, F.lit(f"(?:d|[fstkçşhp]t){you}")) & ~F.rlike(low, F.lit(f"^(?:{soft}){you}"))
    return F.rlike(low, F.lit(f"^.{{2,}}{you}")) & ~person & ~past & ~F.rlike(low, F.lit(f"(?:l[ae]r|ğ){you}"))


def stem(word: Column, times: int = 5) -> tuple[Column, Column]:
    """The word without its inflections (at least three characters with a vowel stay), and how many there were."""
    base = F.replace(fold_circumflex(turkish_lower(word)), F.lit("'"), F.lit(""))
    strip = "^(?=.*[aeıioöuü].*)(.{3,}?)(?:" + "|".join(INFLECTIONS) + ")$"
    start = F.struct(base.alias("w"), F.lit(0).alias("n"))

    def step(a: Column, _: Column) -> Column:
        cut = F.regexp_replace(a["w"], strip, "$1")
        good = (cut != a["w"]) & F.rlike(cut, F.lit("[aeıioöuü]"))
        return F.struct(F.when(good, cut).otherwise(a["w"]).alias("w"), (a["n"] + good.cast("int")).alias("n"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, step)
    return soften_final(done["w"]), done["n"]

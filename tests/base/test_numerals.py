"""Numerals in words, asides and cues, against brute force."""

import itertools

from pyspark.sql import functions as F

from berrak.functions.numerals import NUMBER_WORDS, TENS, UNITS, is_numeral, number_words, numeral_value, possessive
from berrak.operators import asides, segment
from berrak.plans.auditor import Audit


def _groups():
    """Every way to write a number below 1000, as words, and the number."""
    hundreds = [((), 0), (("yüz",), 100)] + [((u, "yüz"), 100 * k) for k, u in enumerate(UNITS, 1)]
    tens = [((), 0)] + [((w,), 10 * k) for k, w in enumerate(TENS, 1)]
    ones = [((), 0)] + [((w,), k) for k, w in enumerate(UNITS, 1)]
    return {a + b + c: x + y + z for (a, x), (b, y), (c, z) in itertools.product(hundreds, tens, ones)}


def test_numbers_to_words_and_back(spark):
    n = spark.range(0, 1_000_001, 1, 8).select("id", number_words(F.col("id")).alias("w"))
    told = n.select("id", F.when(F.col("id") == 0, 0).otherwise(numeral_value("w")).alias("back"), (is_numeral(F.col("w")) | (F.col("id") == 0)).alias("one"))
    assert told.where("back <> id or not one").count() == 0
    assert n.select("w").distinct().count() == 1_000_001


def test_numerals_against_all_short_sequences(spark):
    groups = _groups()
    numerals = {}
    for scaled in ([()], [(s,) for s in ("bin", "milyon", "milyar")], [("milyar", "milyon"), ("milyar", "bin"), ("milyon", "bin")], [("milyar", "milyon", "bin")]):
        for scales in scaled:
            short = [g for g in groups if len(g) <= 3]
            for parts in itertools.product(short, repeat=len(scales) + 1) if len(scales) < 2 else itertools.product([g for g in short if len(g) <= 1], repeat=len(scales) + 1):
                words, value, right = [], groups[parts[-1]], True
                for s, g in zip(scales, parts):
                    right &= bool(g) or s == "bin"
                    words += [*g, s]
                    value += max(groups[g], 1) * NUMBER_WORDS[s]
                words += parts[-1]
                if right and 0 < len(words) <= 3:
                    numerals[tuple(words)] = value
    every = [list(w) for k in (1, 2, 3) for w in itertools.product(NUMBER_WORDS, repeat=k)]
    rows = spark.createDataFrame([(w,) for w in every], "w array<string>").select("w", is_numeral(F.col("w")).alias("one"), numeral_value("w").alias("value")).collect()
    assert len(rows) == len(every) and {tuple(r.w): r.value for r in rows if r.one} == numerals


def test_numerals_of_odd_input(spark):
    rows = spark.createDataFrame([(None, None), ([], -1), (["yirmi", "elma"], 10**12), (["bir", "bin"], 0)], "w array<string>, n long")
    got = rows.select(is_numeral(F.col("w")), number_words(F.col("n")), possessive(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (False, None, None), (False, None, None), (True, ["sıfır"], "0'ı")]


def test_possessive(spark):
    want = {1: "1'i", 2: "2'si", 3: "3'ü", 4: "4'ü", 6: "6'sı", 9: "9'u", 10: "10'u", 20: "20'si", 40: "40'ı", 70: "70'i", 100: "100'ü", 1000: "1000'i", 35: "35'i", 10**6: "1000000'u", 10**9: "1000000000'ı"}
    rows = spark.createDataFrame([(k,) for k in want], "n long").select("n", possessive(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in rows} == want


def _brute(tokens):
    """Words in brackets and between quotation marks, and the greatest depth."""
    depth = deepest = 0
    quotes, inside = [i for i, t in enumerate(tokens) if t == '"'], set()
    for i, t in enumerate(tokens):
        depth = depth + 1 if t == "(" else max(0, depth - 1) if t == ")" else depth
        deepest = max(deepest, depth)
        if depth and t not in "()":
            inside.add(i)
    word = [i for i, t in enumerate(tokens) if t.isalpha()]
    for a, b in zip(quotes[::2], quotes[1::2]):
        held = [i for i in word if a < i < b]
        if 0 < len(held) < len(word):
            inside |= set(held)
    return deepest, sorted(i for i in inside if i in set(word))


def test_asides_against_brute_force(spark):
    lines = ["".join(x) for k in (1, 3, 5) for x in itertools.product(["a ", "( ", ") ", '" '], repeat=k)]
    sents = spark.createDataFrame([(k, 0, 0, x.strip()) for k, x in enumerate(lines)], "doc_id long, para_idx int, sent_no int, text string")
    toks = segment.with_tokens(sents)
    held = F.filter(F.transform("toks", lambda x, i: F.when((x["kind"] == "word") & asides.within(F.concat(F.col("b.done"), F.col("q")), i), i)), lambda i: i.isNotNull())
    rows = toks.withColumns({"b": asides.brackets(F.col("toks")), "q": asides.quotations(F.col("toks"))}).select("text", "b.deepest", held.alias("held"), F.transform(asides.outside(F.col("toks")), lambda x: x["kind"] == "aside").alias("hidden")).collect()
    for r in rows:
        assert (r.deepest, r.held) == _brute(r.text.split()), r.text
        assert [i for i, x in enumerate(r.hidden) if x and r.text.split()[i].isalpha()] == r.held


def test_rules_use_them(spark):
    texts = [
        "Oraya yirmi otuz kişi geldi.", "Oraya iki yüz elli kişi geldi.", "Oraya üç dört yüz kişi geldi.",
        "Yüzde 35 oranında kadın geldi.", "Fiyatlar %20 arttı.", "Su %20 azaldı.", "Yolcuların %6'sı kirasını ödedi.", "Çocuğun maaşı %10 arttı.", "Üyeler, %250 dedi.",
        'Ali "buraya gelmeyin" dedi.', "Ali (dün gelmedi) burada.", "Ali buraya gelmedi.", '"Buraya gelmeyin."', "Ali geldi (Veli gitti, Can kaldı).",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = Audit(docs, only=["KD-B01", "KD-B03", "KD-C02", "KD-C04"]).findings.collect()
    by = lambda rule, field: {f.doc_id: f[field] for f in found if f.rule_id == rule}
    assert by("KD-B01", "fix") == {1: "250"}
    assert by("KD-B03", "suggestion") == {3: "her 100 kişiden 35'i", 4: "her 100 liranın 20 lirası", 5: None, 6: "her 100 kişiden 6'sı", 7: "her 100 liranın 10 lirası", 8: None}
    assert by("KD-C04", "text") == {11: "gelmedi", 12: "gelmeyin"}
    assert by("KD-C02", "text") == {}

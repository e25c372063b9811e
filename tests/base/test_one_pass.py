"""A full audit goes once over the tokens: they are neither written nor shuffled, and rules with nothing to look for don't go over them."""

import re

import pyspark.sql.functions as F

from berrak.operators import matching, morphology, readability, rules, segment, words
from berrak.plans import queries
from berrak.plans.auditor import Audit
from berrak.plans.config import load_lexicon, load_profile
from tests.base.test_audit import CASES
from tests.base.test_growth import plan

ODD = [
    "Dr. Ali a@b.cd yazdı; www.a.de ve %35'i, NATO'nun 3 évi (İZMİR).\tSon.Dr.Dr. x", "A.B.C. ve T.C.'nin 12.05.2024, 23:59 % 5 3,5 'x' … + ya'yı", "ABD DOLARI VE EURO İLE ÇOK BÜYÜK YAZI", "A日 B日 C日 Σας 日本 ﬁ ẞ kâr IŞIK İZ'in XIV I. ÇİĞ ğw", "hiç kimse gelmeyecek; okuyunuz.", "!", "",
]


def test_told_tokens_are_those_of_the_expressions(spark):
    texts = ODD + [t for _, t, _ in CASES]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(1)
    sents = segment.sentences(docs)
    want = {(r.doc_id, r.para_idx, r.sent_no): r for r in segment.with_tokens(sents).withColumn("marks", F.transform("toks", lambda x: F.when(x["kind"] == "word", morphology.analysis(x["low"])))).collect()}
    got = words.told(sents).collect()
    assert len(got) == len(want) > len(texts) - 5
    for r in got:
        w = want[r.doc_id, r.para_idx, r.sent_no]
        fields = ("k", "token", "kind", "lower", "base", "low", "is_abbreviation")
        assert r.pieces == w.pieces and [[t[f] for f in fields] for t in r.toks] == [[t[f] for f in fields] for t in w.toks]
        for t, old, marks in zip(r.toks, w.toks, w.marks, strict=True):
            assert r.text[t["at"] : t["at"] + len(t["token"])] == t["token"]
            assert {n for n in morphology.MARKS if t["m"] & words.BITS[n]} == {n for n in morphology.MARKS if marks and marks[n]}
            assert t["syllables"] == (old["syllables"] if t["kind"] == "word" else None) or t["is_abbreviation"]
            assert t["m"] & ~r.seen == 0
    told = readability.gate(words.told(sents).withColumn("foreign", readability.foreign(F.col("text"), F.col("toks"))))
    assert sorted(map(str, told.collect())) == sorted(map(str, readability.language_gate(segment.with_tokens(sents)).collect()))


def test_tokens_of_a_full_audit_are_not_written(spark):
    docs = spark.createDataFrame([(1, "Yapılan iş bitti. TBMM geldi; yirmi beş kişi okuyunuz.")], "doc_id long, text string")
    audit = Audit(docs, lexicon=queries.LEXICON)
    assert not {"toks", "pieces"} & set(audit.tables.sents.columns)
    # what is found in a sentence is read where it stands
    inside = rules.of_sentences(audit.tables)
    assert inside.count() and "Exchange" not in plan(inside)


def test_what_a_sentence_lacks_is_not_looked_for(spark):
    """The findings of all rules are the same with and without what says that there is something to look for."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD + [t for _, t, _ in CASES])], "doc_id long, text string")
    looks = dict(rules.LOOKS)
    key = lambda rows: sorted(str(r) for r in rows)
    with_looks = key(Audit(docs).findings.collect())
    rules.LOOKS.clear()
    try:
        assert key(Audit(docs).findings.collect()) == with_looks
    finally:
        rules.LOOKS.update(looks)
    assert len({re.search("KD-...", r)[0] for r in with_looks}) > 20


def test_of_equal_places_one_finding_stays(spark):
    """Two findings of one rule and place within a sentence: the more certain one."""
    twice = rules.Rule("KD-X01", "x", "cümle", "uyarı", each=lambda t: F.array(*[rules.hit(F.lit("a"), m, start=F.lit(0), confidence=c).cast(rules.FOUND) for m, c in (("b", 0.5), ("c", 0.9), ("a", 0.5))]))
    docs = spark.createDataFrame([(1, "Ev güzel."), (2, "<!-- berrak: ignore KD-X01 -->Ev güzel.")], "doc_id long, text string")
    rules.RULES["KD-X01"] = twice
    try:
        assert [(r.doc_id, r.message, r.confidence) for r in Audit(docs).findings.where("rule_id = 'KD-X01'").collect()] == [(1, "c", 0.9)]
    finally:
        del rules.RULES["KD-X01"]


def test_phrase_beginnings_are_told_with_the_tokens(spark):
    """Phrases found from the words that begin as they do are those found from all words."""
    lexicon = load_lexicon(queries.LEXICON)
    texts = ODD + [t for _, t, _ in CASES] + ["Müracaat, MÜRACAATINIZ ve ikâmet etmektedir; arz ederim of the, in the and y.", "the the of the und"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    few = matching.few(matching.lexicon_entries(spark, lexicon))
    told = words.told(segment.sentences(docs), matching.beginnings(few))
    for r in told.collect():
        assert [(b["at"], matching.beginnings(few)[b["of"]]) for b in r.begun] == [(i, k[:3]) for i, k in enumerate(r.keys) if k[:3] in matching.beginnings(few)]
    key = lambda rows: sorted(str(r) for r in rows)
    met = told.select("doc_id", "para_idx", "sent_no", F.explode(matching.phrases(few)).alias("m")).select("doc_id", "para_idx", "sent_no", "m.*").collect()
    assert len(met) > 10 and key(met) == key(matching.matches(told.drop("is_heading"), matching.lexicon_entries(spark, lexicon)).collect())


def test_what_patterns_hold_is_looked_for_first(spark):
    """Indirect address is the same with and without the letters that its matches hold, in any case."""
    own = load_lexicon(None)
    bare = {**own, "dolayli_hitap": [x["desen"] for x in own["dolayli_hitap"]]}
    said = [
        "İlgililere saygıyla duyurulur.", "Arz olunur ya da talep olunmaktadır.", "Gelmeniz gerekmektedir.", "Vatandaşlarımızın bilgisine.", "Tarafınızca yapılır.", "İlgililerin dikkatine.", "Bu zorunludur.", "O mecburidir.", "Onlar yükümlüdürler.",
        "Biz zorundadırlar dedik.", "Zorunluluğu vardır.", "Hak sahiplerinin yeri.", "Başvuru sahibinin adı.", "Vatandaşlarımız geldi.", "Müşterilerimizin sesi.", "Üyelerimiz ve yolcularımızın yolu.", "Öğrencilerimiz okudu.", "Telefon 0312 444 55 66.",
    ]
    upper = [x.replace("i", "İ").replace("ı", "I").upper() for x in said] + [x.upper() for x in said] + [x.replace("ı", "i") for x in said] + [x.replace("s", "ſ").replace("k", "\u212a") for x in said]
    docs = spark.createDataFrame(list(enumerate(said + upper)), "doc_id long, text string")
    found = lambda lexicon: sorted((r.doc_id, r.start, r.text) for r in rules.audit(rules.tables(docs, load_profile("kolay-dil"), lexicon, ["KD-C11"]), ["KD-C11"]).collect())
    assert all(x.get("iz") for x in own["dolayli_hitap"])
    assert found(own) == found(bare) and {i for i, *_ in found(own)} >= set(range(17))

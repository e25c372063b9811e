"""Work that grows with the text alone: nothing is copied at each step, shuffled around a match, or worked out for nobody."""

import pyspark.sql.functions as F

from berrak.operators import matching, morphology, rules, segment
from berrak.plans.config import load_profile
from berrak.plans.queries import LEXICON, QUERIES
from berrak.plans.turkish_view import SENTENCES, turkish_documents

NONE = {"kisaltmalar": [], "jargon": [], "es_anlamlilar": [], "dolayli_hitap": []}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_pieces_are_the_lengths_before_them(spark):
    sizes = [0, 1, 63, 64, 65, 129, 5000]
    rows = spark.createDataFrame([([f"a{k % 7}é" * (k % 3) for k in range(n)],) for n in sizes], "p array<string>").select("p", segment._placed(F.col("p")).alias("q"))
    for r in rows.collect():
        at = 0
        assert len(r.q) == len(r.p)
        for piece, got in zip(r.p, r.q, strict=True):
            assert (got["at"], got["piece"]) == (at, piece)
            at += len(piece)
    # no step of the fold copies more than a block: before, 200,000 pieces took 20,000,000,000 copies
    many = spark.range(1).select(F.element_at(segment._placed(F.array_repeat(F.lit("ab"), 200_000)), -1)["at"].alias("at"))
    assert many.first().at == 399_998


def test_tokens_have_the_fields_asked_for(spark):
    docs = spark.createDataFrame([(1, "Dr. Ali a@b.cd yazdı; www.a.de ve %35'i, NATO'nun 3 évi (İZMİR).\tSon.Dr.Dr. x")], "doc_id long, text string")
    sents = segment.sentences(docs)
    all_of = [r.toks for r in segment.with_tokens(sents).orderBy("sent_no").collect()]
    for fields in (("kind",), ("kind", "syllables"), ("token", "kind"), ("k", "token"), ("k", "kind", "low"), ("is_abbreviation",)):
        few = [r.toks for r in segment.with_tokens(sents, fields=fields).orderBy("sent_no").collect()]
        assert [[[t[c] for c in fields] for t in toks] for toks in few] == [[[t[c] for c in fields] for t in toks] for toks in all_of]


def test_marks_of_arrays_are_those_of_words(spark):
    words = ["yapılmaktadır", "gelmemesi", "insan", "okuyunuz", "giyinir", "kâr", "", "the", "değil", "evlerinizden", "x" * 81, "yapılan", "gidince", "öğren", "evin"]
    one = spark.createDataFrame([(w,) for w in words], "w string").select("w", morphology.analysis(F.col("w")).alias("m")).collect()
    rows = spark.createDataFrame([(words,), ([],), (words[:3] * 2,)], "w array<string>").repartition(1)
    got = rows.select("w", F.transform(morphology.marks(F.col("w")), morphology.unpacked).alias("m")).collect()
    want = {r.w: r.m for r in one}
    assert all([want[w] for w in r.w] == r.m for r in got) and len(got) == 3


def test_a_small_lexicon_needs_no_shuffle_and_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The end of the day and the night. In the and of the, la que la."), (2, "Und und der of the the."), (3, "")], "doc_id long, text string")
    told = segment.with_tokens(segment.sentences(docs))
    entries = matching.lexicon_entries(spark, LEXICON)
    here = matching.matches(told, entries)
    assert "Exchange hashpartitioning" not in plan(here) and "Join" not in plan(here)
    for limit in ("MOST_IN_PLAN", "MOST_BROADCAST"):
        monkeypatch.setattr(matching, limit, 3)
        joined = matching.matches(told, entries)
        assert sorted(map(str, joined.collect())) == sorted(map(str, here.collect()))
    assert here.count() > 5


def test_rules_about_text_alone_read_no_tokens(spark):
    docs = spark.createDataFrame([(1, "Elma, armut, kiraz, erik ve ceviz (taze) aldık. TBMM geldi.")], "doc_id long, text string")
    for rule in ("KD-M03", "KD-C09", "KD-B08", "KD-M01"):
        t = rules.tables(docs, load_profile("kolay-dil"), NONE, [rule], once=True)
        assert "toks" not in t.sents.columns
    # a start is known where a token is found, so that no sentence is joined for it
    t = rules.tables(docs, load_profile("kolay-dil"), NONE, ["KD-K03"], once=True)
    found = rules.audit(t, ["KD-K03"])
    assert "Join" not in plan(found)
    assert [(r.text, r.start) for r in found.collect()] == [("TBMM", 0)]


def test_matches_are_written_once_for_terms(spark, sf_dir):
    assert plan(QUERIES["term_consistency"](spark, sf_dir)).count("documents.parquet") == 0


def test_a_document_is_measured_once_for_its_turkish_text(spark):
    docs = spark.createDataFrame([(3, "x" * 150), (4, None)], "doc_id long, text string")
    got = turkish_documents(docs)
    lambdas = got._jdf.queryExecution().analyzed().toString()
    assert lambdas.count("length(coalesce(text") == 1
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[4] == SENTENCES[4 * 31 % len(SENTENCES)]
    assert texts[3] == " ".join(SENTENCES[(3 * 31 + 150 + k * 7) % len(SENTENCES)] for k in range(3))

"""Distinct words without sentences."""

import pyspark.sql.functions as F

from berrak.operators import morphology, segment
from tests.base.test_audit import CASES
from tests.base.test_one_pass import ODD


def test_words_of_paragraphs_are_those_of_sentences(spark):
    texts = [*ODD, *[t for _, t, _ in CASES], "Elma aldım.\n5 %\n%\n3 Dr. X\n- a@b.cd. Www\nwww.a.\nB. C. D.E.\n\n<!-- Ali -->Veli.[Can](x)", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, " ".join(filter(None, texts)), "\n".join(filter(None, texts))])], "doc_id long, text string")
    told = segment.with_tokens(segment.sentences(docs)).select(F.explode("toks").alias("t")).where("t.kind = 'word'").select("t.low").distinct()
    got = [r.low for r in segment.distinct_words(docs).collect()]
    assert sorted(got) == sorted(r.low for r in told.collect()) and len(got) > 100
    # no sentence is told apart for it
    assert segment.CUT not in segment.distinct_words(docs)._jdf.queryExecution().analyzed().toString()


def test_flags_are_those_of_the_analysis(spark):
    words = spark.createDataFrame([(w,) for w in ["yapılmaktadır", "gelmemesi", "insan", "okuyunuz", "giyinir", "kâr", "", "the", "değil", "evlerinizden", "x" * 81, "yapılan", "evin", None]], "w string")
    for r in words.select("w", morphology.flags(F.col("w")).alias("f"), morphology.analysis(F.col("w")).alias("m")).collect():
        assert (r.f or []) == [n for n in morphology.FLAGS if r.m[n]]

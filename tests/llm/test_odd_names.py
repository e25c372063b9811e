"""Columns with dots, spaces and backticks in their names, in every operator and the pipeline; and the gradient of the toxicity model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from berrak.llm import bag_minhash, compression_bands, decontaminate, importance_resampling, secret_scan, sharding, soft_mixing, toxicity_mil, warc_derive
from tests.llm.test_operators import words

ODD = ["a b", "a.b", "c`d", "text.x", "doc", "slot", "kept", "Score "]


@pytest.fixture
def docs(spark):
    rows = [(k, words(60 + k, k), "en", "s", 300) for k in range(12)] + [(20, None, None, None, None), (21, "", "en", "s", 0), (22, words(60, 1), "en", "s", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.select("*", *[F.lit(k).alias(c) for k, c in enumerate(ODD)])


def same(frame, names):
    got = frame.first()
    return set(names) <= set(frame.columns) and all(got[c] == ODD.index(c) for c in names if c in ODD)


def test_operators(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(12)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([("i", words(12, 3))], "item_id string, text string")
    rest = [c for c in ODD if c not in ("kept", "slot")]
    assert same(compression_bands.compression_bands(docs), rest)
    assert compression_bands.quality_stage(docs).columns == docs.columns and same(compression_bands.quality_stage(docs), ODD)
    assert same(sharding.place(docs), [c for c in ODD if c != "slot"])
    assert sharding.place(docs, key="slot").columns[-2:] == ["slot", "shard"] and "slot_key" in sharding.place(docs, key="slot").columns
    assert same(sharding.place(docs, key="a.b"), ["a.b", "a b"])
    plain = docs.drop("c`d")
    assert {"a.b", "a b"} <= set(decontaminate.scan(plain, benchmark).columns)
    assert decontaminate.decontaminate_stage(plain, benchmark).columns == plain.columns
    assert {"a.b", "a b"} <= set(toxicity_mil.score(plain, toxicity_mil.Model({}, -3.0, 0.1, (4,))).columns)
    assert {"a.b", "a b"} <= set(secret_scan.scan(plain, "source", "a.b").columns)
    assert bag_minhash.dedup_stage(plain).columns == plain.columns
    mixed = soft_mixing.mixing_stage(plain, soft_mixing.domains_of_labels(labels))
    assert mixed.columns == plain.columns and mixed.count() > 0
    assert importance_resampling.resample(plain, labels).count() >= 0


def test_warc_keeps_odd_names(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    made = warc_derive.responses(pages).select("*", F.lit(1).alias("a.b"), F.lit(2).alias("a b"))
    got = warc_derive.derive(made, ("a.b", "a b"))
    assert got.columns[:2] == ["a.b", "a b"] and {(r["a.b"], r["a b"]) for r in got.collect()} == {(1, 2)}


def test_pipeline_with_odd_names_and_nulls(spark, docs, tmp_path):
    plain = docs.drop("c`d", "Score ")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", words(12, 3)), ("j", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {*plain.columns, "slot", "shard"}
    kept = {r.doc_id for r in got.collect()}
    # the labels here are arbitrary, and so is which of the good texts the mix repeats or drops
    assert kept and kept <= set(range(12)) | {22}
    empty = docs.drop("c`d", "Score ").where("false")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def loss(theta, toxic, sentence_doc, word_sentence, word, times, ridge):
    """The plain noisy-or likelihood, sentence by sentence."""
    w, bias, leak = theta[:-2], theta[-2], 1 / (1 + np.exp(-theta[-1]))
    out = 0.5 * ridge * (w**2).sum()
    for d, label in enumerate(toxic):
        stay = 1 - leak
        for s in np.flatnonzero(sentence_doc == d):
            z = bias + sum(w[x] * n for x, n, at in zip(word, times, word_sentence, strict=True) if at == s)
            stay *= 1 - 1 / (1 + np.exp(-z))
        out -= np.log(1 - stay) if label else np.log(stay)
    return out


def test_fit_goes_down_the_plain_likelihood():
    """One step of Adam goes by the signs of the gradient: those of finite differences of the plain likelihood; many steps end where it is flat."""
    toxic, sentence_doc = np.array([1, 0, 1, 0]), np.array([0, 0, 1, 2, 3, 3])
    word_sentence, word, times = np.array([0, 0, 1, 2, 3, 4, 5]), np.array([0, 1, 1, 2, 0, 2, 1]), np.array([1, 2, 1, 3, 1, 1, 2])
    start = np.array([0.4, -0.2, 0.1])
    args = toxic, sentence_doc, word_sentence, word, times
    slope = lambda theta, ridge: np.array([(loss(theta + d, *args, ridge) - loss(theta - d, *args, ridge)) / 2e-6 for d in 1e-6 * np.eye(5)])
    s = toxicity_mil.Settings(steps=1, rate=0.01, ridge=0.1)
    w, bias, leak = toxicity_mil.fit(toxic, sentence_doc, word_sentence, word, start, s, times)
    moved = np.concatenate([w, [bias, np.log(leak / (1 - leak))]]) - np.concatenate([start, [-2.0, -3.5]])
    assert np.array_equal(np.sign(moved), -np.sign(slope(np.concatenate([start, [-2.0, -3.5]]), 0.1)))
    w, bias, leak = toxicity_mil.fit(toxic, sentence_doc, word_sentence, word, start, toxicity_mil.Settings(steps=6000, rate=0.01, ridge=0.1), times)
    assert np.abs(slope(np.concatenate([w, [bias, np.log(leak / (1 - leak))]]), 0.1))[:4].max() < 0.02

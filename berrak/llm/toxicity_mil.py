"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence is toxic with probability sigmoid(bias + weights of its words); a document is toxic
unless the label noise and every sentence with evidence say no (noisy-or):
``1 - (1 - leak) * prod(1 - p)``. Weights, bias and leak are fitted to document labels only, and
the sentence probabilities then locate what offends. A word's weight is the sum over itself and
its prefixes, of those that the labels single out.

Fitting uses at most ``max_train_docs`` labelled rows, taken in the order of a hash; their words
are counted by Spark, those that pass the tests are kept, and the sentences reduced to these
are small enough for the driver. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import packed_schema, written
from berrak.llm.textvec import U, chunks, span_hashes_of, words

#: A-Z to a-z, sentence ends to a line feed, other ASCII that is not a letter or digit to a space.
FOLD = bytes(0x0A if chr(b) in ".!?\n" else b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Settings:
    max_train_docs: int = 20_000
    least_docs: int = 4
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    steps: int = 400
    rate: float = 0.08
    ridge: float = 0.02


@dataclass(frozen=True)
class Model:
    """``weights``: by the hashes of features."""

    weights: dict[int, float]
    bias: float
    leak: float
    prefixes: tuple[int, ...]


FOLDED = np.frombuffer(FOLD, np.uint8)
IN_WORD = np.ones(256, bool)
IN_WORD[[0x0A, 0x20]] = False
WHOLE = U(0xA0761D6478BD642F)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which words have a feature, and its hash: the whole word, and its first bytes."""
    hashes = span_hashes_of(data)
    yield np.arange(len(start)), hashes(start, end) ^ WHOLE
    for n in prefixes:
        long = np.flatnonzero(end - start >= n)
        yield long, hashes(start[long], start[long] + n)


def places(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where hashes stand in a sorted table; -1 where they don't."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def _sentence(folded: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many sentence ends come before each word."""
    return np.searchsorted(np.flatnonzero(folded == 0x0A), start)


def _counts(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Documents of either label that have a feature, summed over some MB of text."""
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for row, _, data, offsets in chunks(batch.column("text")):
            folded = FOLDED[data]
            start, end, text = words(folded, offsets, IN_WORD)
            found = list(features(folded, start, end, s.prefixes))
            hashes, owner = np.concatenate([h for _, h in found]), np.concatenate([text[k] for k, _ in found])
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            once = np.ones(len(hashes), bool)
            once[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            hashes, toxic = hashes[once], label[owner[once] + row].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            both = np.diff(np.concatenate([first, [len(hashes)]]))
            bad = np.add.reduceat(toxic, first) if len(first) else both
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(both - bad), pa.array(bad)], names=["feature", "clean", "toxic"])


def _bags(batches: Iterator[pa.RecordBatch], table: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """Each document's features of a table: sentence, place in the table and how often, once for each sentence and feature."""
    for batch in batches:
        for row, until, data, offsets in chunks(batch.column("text")):
            folded = FOLDED[data]
            start, end, text = words(folded, offsets, IN_WORD)
            parts = [(k, places(table, h)) for k, h in features(folded, start, end, s.prefixes)]
            word, at = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
            word, at = word[at >= 0], at[at >= 0]
            keys = np.stack([text[word], _sentence(folded, start)[word], at])
            keys, times = np.unique(keys, axis=1, return_counts=True)
            edges = np.concatenate([[0], np.cumsum(np.bincount(keys[0], minlength=until - row))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (keys[1], keys[2], times)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(row, until - row), *lists], names=["toxic", "sentence", "feature", "times"])


def fit(toxic: np.ndarray, sentence_doc: np.ndarray, word_sentence: np.ndarray, word: np.ndarray, start: np.ndarray, s: Settings, times: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak of the noisy-or model by gradient descent with Adam.

    ``sentence_doc``: the document of every sentence; ``word_sentence`` and ``word``: sentence and number of every feature,
    which counts ``times``, or once.
    """
    times = np.ones(len(word)) if times is None else times.astype(float)
    n, v, m = len(toxic), len(start), len(sentence_doc)
    theta = np.concatenate([start, [-2.0, -3.5]])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, s.steps + 1):
        w, bias, a = theta[:v], theta[v], theta[v + 1]
        z = bias + np.bincount(word_sentence, w[word] * times, m)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.bincount(sentence_doc, np.logaddexp(0, z), n)
        leak = 1 / (1 + np.exp(-a))
        stay = np.exp(-total) * (1 - leak)
        d_total = np.where(toxic == 1, -stay / np.maximum(1 - stay, 1e-9), 1.0)
        d_leak = np.where(toxic == 1, -stay / (1 - leak) / np.maximum(1 - stay, 1e-9), 1 / (1 - leak)).sum() * leak * (1 - leak)
        d_z = d_total[sentence_doc] * p
        grad = np.concatenate([np.bincount(word, d_z[word_sentence] * times, v), [d_z.sum(), d_leak]])
        grad[:v] += s.ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta - s.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return theta[:v], float(theta[v]), float(1 / (1 + np.exp(-theta[v + 1])))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model from rows of ``labels`` (doc_id, toxic) and the texts they are about.

    Rows with a null id, or a label that is neither 0 nor 1, are left out; of several labels the
    larger holds; a repeated document counts each time. Null and empty texts have no features. All features that pass the
    tests of documents and odds are kept: the labelled sample bounds them.
    Without labels of both kinds nothing is toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_train_docs), "labelled")
    rows = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "training")
    n_clean, n_toxic = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n_clean or not n_toxic:
        return Model({}, -30.0, 0.0, s.prefixes)
    counts = rows.mapInArrow(lambda x: _counts(x, s), "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / n_toxic) - F.log((F.col("clean") + 0.5) / n_clean)
    chosen = counts.where(F.col("toxic") >= s.least_docs).withColumn("odds", odds).where("odds > 1").toPandas()
    if not len(chosen):
        return Model({}, -30.0, n_toxic / (n_clean + n_toxic), s.prefixes)
    table, order = np.unique(chosen["feature"].to_numpy(np.int64).view(U), return_index=True)
    found = rows.mapInArrow(lambda x: _bags(x, table, s), "toxic int, sentence array<int>, feature array<int>, times array<int>").toPandas()
    sizes = found["feature"].map(len).to_numpy(np.int64)
    sentence, word, times = (np.concatenate([np.asarray(x, np.int64) for x in found[c]]) for c in ("sentence", "feature", "times"))
    doc = np.repeat(np.arange(len(found)), sizes)
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
    weights, bias, leak = fit(found["toxic"].to_numpy(), doc[first], np.cumsum(first) - 1, word, 0.3 * chosen["odds"].to_numpy(float)[order], s, times)
    return Model(dict(zip(table.tolist(), weights.tolist(), strict=True)), bias, leak, s.prefixes)


OUT = "score double, n_sentences long, n_toxic_sentences long, toxic_spans array<struct<start:long,end:long,p:double>>"
class Lookup:
    """The weights of a model as a sorted table of hashes."""

    def __init__(self, model: Model):
        hashes = np.array(list(model.weights), U)
        order = np.argsort(hashes)
        self.prefixes, self.hashes, self.values = model.prefixes, hashes[order], np.array(list(model.weights.values()), float)[order]

    def weights(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The weight of every word: the sum over its features."""
        out = np.zeros(len(start))
        for word, hashes in features(data, start, end, self.prefixes):
            at = places(self.hashes, hashes)
            out[word[at >= 0]] += self.values[at[at >= 0]]
        return out


def _score_chunk(data: np.ndarray, offsets: np.ndarray, model: Model, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """Score, sentences, toxic sentences and their spans of the texts between ``offsets``."""
    n = len(offsets) - 1
    folded = FOLDED[data]
    start, end, text = words(folded, offsets, IN_WORD)
    spans: list[list[dict]] = [[] for _ in range(n)]
    if not len(start):
        return np.full(n, model.leak), np.zeros(n, np.int64), np.zeros(n, np.int64), spans
    breaks, line = np.flatnonzero(folded == 0x0A), _sentence(folded, start)
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])]))
    owner, weight = text[first], lookup.weights(folded, start, end)
    told = np.add.reduceat((weight != 0).astype(np.int64), first) > 0
    z = np.clip(model.bias + np.add.reduceat(weight, first), -30.0, 30.0)
    p = np.where(told, 1.0 / (1.0 + np.exp(-z)), 0.0)
    stay = np.bincount(owner, np.where(told, -np.logaddexp(0.0, z), 0.0), n)
    bad = np.flatnonzero(p >= 0.5)
    if len(bad):
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        k, own = line[first[bad]], owner[bad]
        edges = np.concatenate([[-1], breaks, [len(data)]])
        begin, until = np.maximum(edges[k] + 1, offsets[own]), np.minimum(edges[k + 1], offsets[own + 1])
        for t, a, b, x in zip(own.tolist(), points[begin] - points[offsets[own]], points[until] - points[offsets[own]], p[bad], strict=True):
            spans[t].append({"start": int(a), "end": int(b), "p": float(x)})
    return 1.0 - (1.0 - model.leak) * np.exp(stay), np.bincount(owner, minlength=n), np.bincount(owner[bad], minlength=n), spans


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(model)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    for batch in batches:
        for row, end, data, offsets in chunks(batch.column("text")):
            score, sentences, toxic, spans = _score_chunk(data, offsets, model, lookup)
            found = [pa.array(score), pa.array(sentences.astype(np.int64)), pa.array(toxic.astype(np.int64)), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").slice(row, end - row), *found], names=["doc", *RESULTS])


RESULTS = ["score", "n_sentences", "n_toxic_sentences", "toxic_spans"]


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, its score from 0 to 1, how many sentences
    have words, and where those are that offend (code points, with their probability).

    Null and empty texts have no sentences and the score of the label noise alone; repeated rows
    have equal scores. Columns named like a result are replaced. An empty table stays empty.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{text}`").alias("text"))
    scored = source.mapInArrow(lambda batches: _score(batches, model), packed_schema(source, OUT))
    return scored.select(*[F.col(f"doc.`{c}`").alias(c) for c in names], *RESULTS)

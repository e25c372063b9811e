"""Mixing to target weights with soft membership of domains.

A classifier fitted on a labelled table gives each document a posterior over domains; a document
of n tokens brings n times its posterior to each domain. Projected-gradient least squares then
finds non-negative rates for all documents, near 1, at which the expected token totals of the
domains are the targets' shares of all tokens.

The unknowns stay distributed: an iteration is one aggregation to as many sums as there are
domains, and a document's rate is a short expression of its posterior, as the gradient is the
posterior times a vector that all documents share. The gradient is taken in the metric in which
documents weigh their tokens, and scaled by the inverse of the domains' Gram matrix.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berrak.llm import ngram_models
from berrak.llm.tables import written

#: Shares of all tokens: low-quality text is brought down to 3 %, and toxic text held at that.
TARGETS = {"clean": 0.94, "low": 0.03, "toxic": 0.03}


@dataclass(frozen=True)
class Settings:
    targets: Mapping[str, float] = field(default_factory=lambda: dict(TARGETS))
    max_train_docs: int = 20_000
    words: float = 300.0
    buckets: int = ngram_models.BUCKETS
    rounds: int = 40
    tolerance: float = 1e-6

    @property
    def domains(self) -> list[str]:
        return sorted(self.targets)


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled table: toxic, low quality, or clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


def posteriors(docs: DataFrame, labelled: DataFrame, keep: list[str], s: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc``: a struct of ``keep`` of every row; n_tokens; and ``posterior``: an array in the order of the domains' names.

    The classifier is a hashed n-gram model per domain, fitted on at most ``max_train_docs``
    labelled rows in the order of a hash; an id with several labels has the last by name. Its
    evidence is the sum of logs over the n-grams, longer texts being scaled to ``words`` n-grams,
    so that they don't become certain. Null and empty texts get the prior, and so do all texts
    where nothing is labelled.
    """
    names = s.domains
    sample = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_train_docs)
    bit = F.lit(0)
    for k, name in enumerate(names):
        bit = F.when(F.col("domain") == name, F.lit(1 << k)).otherwise(bit)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "doc_id").select("text", bit.alias("classes"))
    table = ngram_models.logs(ngram_models.count(rows, len(names), s.buckets))
    had = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = [float(np.log((had.get(n, 0) + 1) / (sum(had.values()) + len(names)))) for n in names]
    scored = ngram_models.sums(docs, table, keep, text)
    logit = [F.when(F.col("n_grams") > 0, F.col("log_sums")[k] * F.least(F.lit(1.0), s.words / F.col("n_grams"))).otherwise(0.0) + prior[k] for k in range(len(names))]
    top = F.greatest(*logit) if len(logit) > 1 else logit[0]
    summed = scored.withColumn("parts", F.array(*[F.exp(x - top) for x in logit]))
    total = sum((F.col("parts")[k] for k in range(1, len(names))), F.col("parts")[0])
    return summed.select("doc", F.col("n_words").alias("n_tokens"), F.transform("parts", lambda x: x / total).alias("posterior"))


def solve(rows: DataFrame, s: Settings = Settings()) -> tuple[Column, dict[str, float]]:
    """The rate as a column of ``rows`` (n_tokens, posterior), and each domain's total less its target, as a share.

    The step's scale is the inverse Gram matrix of the documents whose rates are above zero, with
    which a few steps are enough; a step that brings no total nearer is halved. A target that no
    non-negative rates reach is approached as far as they do.
    """
    names = s.domains
    d = len(names)
    p = [F.col("posterior")[k] for k in range(d)]
    tokens = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    share = np.array([s.targets[n] for n in names])
    moved = lambda rate, step: F.greatest(F.lit(0.0), rate - sum((p[k] * float(step[k]) for k in range(1, d)), p[0] * float(step[0])))
    base: Column = F.lit(1.0)
    rate, step, left, best = base, np.zeros(d), np.zeros(d), np.inf
    for _ in range(s.rounds):
        live = [F.sum(F.when(rate > 0, tokens * p[i] * p[j]).otherwise(0.0)) for i, j in pairs]
        sums = rows.agg(F.sum(tokens), *[F.sum(tokens * p[k] * rate) for k in range(d)], *live).first()
        total = sums[0] or 0.0
        if not total:
            return F.lit(1.0), dict.fromkeys(names, 0.0)
        now = (np.array(sums[1 : d + 1], float) - share / share.sum() * total) / total
        if np.abs(now).max() < best:
            base, left, best = rate, now, np.abs(now).max()
            if best <= s.tolerance:
                break
            gram = np.zeros((d, d))
            for (i, j), v in zip(pairs, sums[d + 1 :], strict=True):
                gram[i, j] = gram[j, i] = v / total
            step = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ left
        else:
            step = step / 2
        rate = moved(base, step)
    return base, {n: float(x) for n, x in zip(names, left, strict=True)}


def mix(docs: DataFrame, labelled: DataFrame, keep: list[str] | None = None, s: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``keep`` (all by default) of every row with n_tokens, posterior, rate and copies; columns of these names are replaced.

    ``copies`` rounds the rate up or down by a hash of the id (of the text where the id is null),
    so that its expectation is the rate: 0 drops the document, 2 repeats it. Repeated rows fare
    alike. Documents without tokens change no total and keep the rate that their prior gives.
    """
    results = ("n_tokens", "posterior", "rate", "copies")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results]
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col(f"`{key}`"), F.when(F.col(f"`{key}`").isNull(), F.col(f"`{text}`"))), F.lit(1 << 30)) / float(1 << 30)
    packed = docs.select(F.struct(*([F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")])).alias("own"), draw.alias("draw"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("doc_id"))
    rows = written(posteriors(packed, labelled, ["own", "draw"], s), "posteriors")
    rate, _ = solve(rows, s)
    mixed = rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + F.col("doc.draw")).cast("int"))
    return mixed.select(*[F.col(f"doc.own.`{c}`").alias(c) for c in keep], *results)


def mixing_stage(docs: DataFrame, labelled: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents as often as their copies say, with their own columns.

    Null and empty texts go by the prior's rate, null ids by their text, repeated rows fare alike;
    an empty table stays empty.
    """
    packed = docs.select(F.struct("*").alias("doc"), "text", "doc_id")
    mixed = mix(packed, labelled, ["doc"], s)
    return mixed.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc.*")

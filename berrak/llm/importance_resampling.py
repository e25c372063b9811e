"""Quality by importance resampling: how much likelier a text is under a target than under the raw corpus.

Both are hashed n-gram models. The target model is fitted on at most ``max_target_docs`` rows
that the labels call good, in the order of a hash; the raw model counts every document. Each
document's log weight is the difference of the models' logs summed over its n-grams, longer texts
being scaled to ``words`` n-grams. Gumbel noise from a hash of the id is added, and the k
largest sums are kept: a draw of k documents without replacement in proportion to their weights.
How many are drawn follows from the labels too: the share of good ones among the labelled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm import ngram_models
from berrak.llm.tables import written


@dataclass(frozen=True)
class Settings:
    """``keep``: the share of all rows to draw; by default the share of good ones among the labelled."""

    keep: float | None = None
    max_target_docs: int = 20_000
    words: float = 200.0
    buckets: int = ngram_models.BUCKETS
    bins: int = 4_096
    few: int = 10_000


def kth_largest(df: DataFrame, column: str, k: int, s: Settings = Settings()) -> float | None:
    """The k-th largest value of a column, by counting in ever finer bins; null values don't count."""
    rows = df.where(F.col(column).isNotNull())
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while n > s.few and lo < hi:
        step = (hi - lo) / s.bins
        number = F.least(F.floor((F.col(column) - lo) / step), F.lit(s.bins - 1)).alias("bin")
        bins = sorted(rows.groupBy(number).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r.bin)
        for b in bins:
            if k <= b.n:
                break
            k -= b.n
        rows, lo, hi, n = rows.where(F.col(column).between(b.lo, b.hi)), b.lo, b.hi, b.n
    return lo if lo == hi else rows.select(column).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]


def good_share(labels: DataFrame) -> float:
    """The share of good ids among those labelled 0 or 1; 1 where none is labelled.

    An id with both labels counts as good.
    """
    by = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = by.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    return good / n if n else 1.0


def resample(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, log_weight, gumbel_key and kept of every row of ``docs`` (doc_id, text; other columns are not used).

    Null and empty texts have no n-grams: their weight is null, and they are not kept. Noise is a
    hash of the id, so that repeated rows have equal keys; rows with equal keys are kept or
    dropped together, and those that tie with the k-th are kept. Null ids share one noise. Without
    good labels all weights are 0, and the draw is one by noise alone. An empty table gives none.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_target_docs).withColumn("good", F.lit(2))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left")
    counts = ngram_models.count(marked.select("text", (F.lit(1) + F.coalesce("good", F.lit(0))).alias("classes")), 2, s.buckets)
    logs = ngram_models.logs(counts)
    ratio = (logs[1] - logs[0] if counts[1].any() else np.zeros(s.buckets))[np.newaxis]
    scored = ngram_models.sums(docs, ratio, ["doc_id"])
    uniform = (F.pmod(F.xxhash64(F.lit("gumbel"), "doc_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight = F.when(F.col("n_grams") > 0, F.col("log_sums")[0] * F.least(F.lit(1.0), s.words / F.col("n_grams")))
    weighed = scored.select("doc.doc_id", "n_words", weight.alias("log_weight"))
    keyed = written(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "gumbel")
    share = good_share(labels) if s.keep is None else s.keep
    limit = kth_largest(keyed, "gumbel_key", round(share * keyed.count()), s)
    return keyed.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(limit), F.lit(False)) if limit is not None else F.lit(False))

"""A training corpus from raw documents: five stages, each written and read again.

Quality rules, near-duplicates, benchmark decontamination, mixing to target weights, sharding.
All stages but the last return the columns of ``documents``; the last adds slot and shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from berrak.llm import bag_minhash, compression_bands, decontaminate, sharding, soft_mixing
from berrak.llm.tables import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return compression_bands.quality_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return bag_minhash.dedup_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out, and drops documents that are mostly such."""
    return decontaminate.decontaminate_stage(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as their rates say."""
    return soft_mixing.mixing_stage(docs, soft_mixing.domains_of_labels(table(spark, sf_dir, "labels")))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the slot and shard of every document."""
    return sharding.place(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("shards", shards),
]

#: Compression ratios, signatures and rates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, in turn."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

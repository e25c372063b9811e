"""Hashed n-gram models: counts of hashed words and word pairs by class, and sums of their logs.

Counting adds up dense vectors in each task, so that the shuffle has at most one row per class,
bucket and task; what reaches the driver has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import packed_schema
from berrak.llm.textvec import BASE, U, chunks, mix, span_hashes, words

BUCKETS = 1 << 14


def _buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of every word and every pair of words, and words by text."""
    start, end, text = words(data, offsets)
    one = span_hashes(data, start, end)
    n = np.bincount(text, minlength=len(offsets) - 1)
    if len(one) < 2:
        return (one % U(buckets)).astype(np.int64), text, n
    same = text[1:] == text[:-1]
    two = mix(one[:-1] * BASE + one[1:])[same]
    return (np.concatenate([one, two]) % U(buckets)).astype(np.int64), np.concatenate([text, text[1:][same]]), n


def _count(batches: Iterator[pa.RecordBatch], classes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((classes, buckets), np.int64)
    for batch in batches:
        of = batch.column("classes").to_numpy(zero_copy_only=False)
        for row, end, data, offsets in chunks(batch.column("text")):
            bucket, text, _ = _buckets(data, offsets, buckets)
            for k in range(classes):
                mine = (of[row:end] >> k & 1).astype(bool)
                if mine.all():
                    total[k] += np.bincount(bucket, minlength=buckets)
                elif mine.any():
                    total[k] += np.bincount(bucket[mine[text]], minlength=buckets)
    k, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, b])], names=["class", "bucket", "n"])


def count(docs: DataFrame, classes: int, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by class and bucket over ``docs`` (text, and classes: a bit for each it belongs to)."""
    rows = docs.select("text", F.col("classes").cast("int")).mapInArrow(lambda x: _count(x, classes, buckets), "class int, bucket int, n long")
    out = np.zeros((classes, buckets))
    for r in rows.groupBy("class", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r["class"], r["bucket"]] = r["n"]
    return out


def logs(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Logs of the smoothed probabilities of each class."""
    return np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1]))


def _sums(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums, counts, n_words = [np.zeros((0, len(table)))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in chunks(batch.column("text")):
            bucket, text, n = _buckets(data, offsets, table.shape[1])
            sums.append(np.stack([np.bincount(text, row[bucket], len(n)) for row in table], 1))
            counts.append(np.bincount(text, minlength=len(n)))
            n_words.append(n)
        every = np.concatenate(sums)
        lists = pa.ListArray.from_arrays(np.arange(0, every.size + 1, len(table), dtype=np.int32), every.ravel())
        columns = [batch.column("doc"), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(counts)), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_grams", "log_sums"])


def sums(docs: DataFrame, table: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``doc``: a struct of ``keep``, so that no name clashes with the results; the numbers of words and
    n-grams of every row, and the sum of each row of ``table`` over its n-grams."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(lambda x: _sums(x, table), packed_schema(source, "n_words long, n_grams long, log_sums array<double>"))

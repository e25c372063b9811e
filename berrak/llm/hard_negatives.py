"""Hard negatives by a secondary-sort shuffle.

The score of a pair is the integer inner product of its vectors, whose components are first
multiplied by ``SCALE`` and rounded down. An anchor's positives are its best rows of the same
label; each opens a window of scores, and the best rows of other labels within it are its
negatives.

Rows and anchors are packed into blocks. Every group of rows meets every block of anchors, and
emits pair scores packed into keys of 25 bytes: (anchor, descending score, kind, id). The shuffle
deals keys by anchor and sorts them within partitions, so that a task reads each anchor's pairs
best first, as a stream. It opens a window with each positive, emits the negatives that fall
into open windows, and holds no more of an anchor than its windows. There are two such
shuffles. The first finds the positives, of which a group of rows emits no more than its own
best of each anchor. The second sends the positives' windows along with the anchors: there a
group of rows emits, for each window, its own best negatives. What is best of all rows is best
in its group, so that nothing is lost, and an anchor brings a bounded number of pairs per
group, whatever the labels and copies are.

The work is anchors times rows, as the task is stated. Anchors are sent once to each group of
``GROUP_ROWS`` rows, never through the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, Row
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import written

SCALE = 256
BLOCK_ANCHORS = 1024
GROUP_ROWS = 65_536
#: Keys that one task of the sort takes, about.
TASK_KEYS = 500_000
LONGEST = np.iinfo(np.int64)


@dataclass(frozen=True)
class Mining:
    """``positives`` per anchor, ``negatives`` per positive; low * positive score <= 100 * negative score <= high * positive score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def window(self, score: int) -> tuple[int, int]:
        """The least and the greatest score of a negative; none where the first is greater."""
        return -(-self.low * score // 100), self.high * score // 100


# keys

KEY = struct.Struct(">QQBQ")
_SIGN = 1 << 63
POSITIVE, NEGATIVE = 0, 1


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """Bytes that sort as (anchor, descending score, positives first, id)."""
    return KEY.pack(anchor + _SIGN, _SIGN - 1 - score, kind, row + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, kind, row - _SIGN


def _deal(key: bytes) -> int:
    """A partition number by anchor only, spread by an odd multiplier."""
    return (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20


def _sorted_pairs(pairs: RDD, tasks: int) -> RDD:
    return pairs.repartitionAndSortWithinPartitions(tasks, _deal)


# blocks

BLOCK = "ids binary, labels binary, vectors binary, width int, kind string"


def quantised(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """id, label and components (whole numbers, as doubles) of the rows that take part, each id once."""
    as_double = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    finite = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), as_double.alias("q"))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & finite)
    first = F.min(F.struct("label", "q")).alias("r")
    # floor() of a large double would not fit a long: whole doubles stay as they are
    whole = F.transform("r.q", lambda x: F.when(F.abs(x) < 2.0**45, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return out.groupBy("id").agg(first).select("id", F.col("r.label").alias("label"), whole.alias("q"))


def _packed(ids: np.ndarray, labels: np.ndarray, q: pd.Series) -> dict:
    """One block: ids, labels and vectors as bytes, sorted by id; short vectors are filled up with zeros."""
    order = np.argsort(ids, kind="stable")
    width = max((len(x) for x in q), default=0)
    matrix = np.zeros((len(ids), width))
    for k, x in enumerate(q):
        matrix[k, : len(x)] = x
    most = np.abs(matrix).max(initial=0)
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "f8"
    return {"ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": matrix[order].astype(kind).tobytes(), "width": width, "kind": kind}


def _blocks(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Blocks of up to ``size`` rows of a partition."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        while len(frame):
            room = size - sum(map(len, held))
            held.append(frame.iloc[:room])
            frame = frame.iloc[room:]
            if sum(map(len, held)) == size:
                yield _one_block(held)
                held = []
    if held:
        yield _one_block(held)


def _one_block(held: list[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(held)
    return pd.DataFrame([_packed(rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), rows["q"])])


def blocks(rows: DataFrame, size: int) -> DataFrame:
    return rows.mapInPandas(lambda x: _blocks(x, size), BLOCK)


def _open(block: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    matrix = np.frombuffer(block["vectors"], block["kind"])
    ids = np.frombuffer(block["ids"], np.int64)
    return ids, np.frombuffer(block["labels"], np.int64), matrix.reshape(len(ids), block["width"])


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of all rows of ``a`` and ``b``, exact.

    By the inequality of Cauchy and Schwarz no partial sum exceeds the product of the norms; the
    narrowest type that holds it exactly is taken. Beyond all of them Python's numbers are, and
    a score outside a long's range counts as the nearest long.
    """
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a.astype(np.float64), b.astype(np.float64)))
    most = np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0))
    if most < 2**23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**52:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.array([[min(max(int(x), LONGEST.min + 1), LONGEST.max) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the places ``at`` (ascending) with the highest scores, of ties the first places."""
    if len(at) <= k:
        return at
    own = scores[at]
    least = np.partition(own, len(own) - k)[len(own) - k]
    above = at[own > least]
    return np.concatenate([above, at[own == least][: k - len(above)]])


# what a group of rows emits for a block of anchors


def _meetings(rows: Iterator[Row]) -> Iterator[tuple[Row, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every anchor of every meeting: the meeting, the anchor's number and label, the rows' ids, labels and scores."""
    for meeting in rows:
        ids, labels, matrix = _open(meeting["anchors"])
        row_ids, row_labels, row_matrix = _open(meeting["rows"])
        for at in range(0, len(ids), 64):
            scores = inner_products(matrix[at : at + 64], row_matrix)
            for k, own in enumerate(scores, at):
                yield meeting, k, int(labels[k]), row_ids, row_labels, own


def _positive_keys(rows: Iterator[Row], how: Mining) -> Iterator[tuple[bytes, int]]:
    for meeting, k, label, row_ids, row_labels, scores in _meetings(rows):
        anchor = int(np.frombuffer(meeting["anchors"]["ids"], np.int64, 1, 8 * k)[0])
        for at in best(scores, np.flatnonzero((row_labels == label) & (row_ids != anchor)), how.positives):
            yield pack(anchor, int(scores[at]), POSITIVE, int(row_ids[at])), meeting["block"]


def _negative_keys(rows: Iterator[Row], how: Mining) -> Iterator[tuple[bytes, None]]:
    opened: dict[int, list[int]] = {}
    last = None
    for meeting, k, label, row_ids, row_labels, scores in _meetings(rows):
        if meeting is not last:
            last, opened = meeting, {w["anchor"]: w["scores"] for w in meeting["windows"]}
        anchor = int(np.frombuffer(meeting["anchors"]["ids"], np.int64, 1, 8 * k)[0])
        others, found = row_labels != label, set()
        for score in set(opened.get(anchor, ())):
            low, high = how.window(score)
            if low <= high:
                found.update(best(scores, np.flatnonzero(others & (scores >= low) & (scores <= high)), how.negatives).tolist())
        for at in found:
            yield pack(anchor, int(scores[at]), NEGATIVE, int(row_ids[at])), None


# what the sorted streams give


def _first_positives(pairs: Iterator[tuple[bytes, int]], how: Mining) -> Iterator[tuple[int, int, int, int]]:
    """block, anchor, score and id of the first positives of every anchor."""
    anchor, seen = None, 0
    for key, block in pairs:
        of, score, _, row = unpack(key)
        if of != anchor:
            anchor, seen = of, 0
        seen += 1
        if seen <= how.positives:
            yield block, of, score, row


def _emit(pairs: Iterator[tuple[bytes, None]], how: Mining) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Opens a window with each positive, emits each negative into the windows that it falls into, and closes what is full or passed."""
    anchor: int | None = None
    windows: list[list[int]] = []
    for key, _ in pairs:
        of, score, kind, row = unpack(key)
        if of != anchor:
            anchor, windows = of, []
        if kind == POSITIVE:
            low, high = how.window(score)
            windows.append([row, score, low, high, 0])
            continue
        windows = [w for w in windows if w[4] < how.negatives and score >= w[2]]
        for w in windows:
            if score <= w[3]:
                w[4] += 1
                yield of, w[0], w[4], row, w[1], score


def _met(sent: DataFrame, packed: DataFrame, groups: int) -> DataFrame:
    """Blocks of anchors beside the rows of each group that they are sent to, dealt by group at every size."""
    return sent.repartition(groups, "group").hint("merge").join(packed.repartition(groups, "group"), "group")


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: str = "id % 50 = 0", how: Mining = Mining(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The columns of ``OUT``: for every anchor and positive the first negatives, ranked from 1.

    ``anchors`` is a condition on the columns id and label. Rows with a null id, label or vector, or
    with a null or non-finite component, take no part; of rows with one id only the first by label
    and components does. A vector shorter than another counts as filled up with zeros. Higher scores
    come first, ties by smaller id. An anchor without positives, and a positive without
    negatives, give no rows; so does an empty table. Other columns are not looked at.
    """
    spark = rows.sparkSession
    table = written(quantised(rows, vec_id, vector, label), "vectors")
    n_rows, n_anchors = table.agg(F.count("*"), F.count_if(F.expr(anchors))).first()
    tasks = spark.sparkContext.defaultParallelism
    groups = max(-(-n_rows // GROUP_ROWS), min(tasks, -(-n_rows // 512)), 1)
    n_blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    packed = written(blocks(table.repartition(groups), GROUP_ROWS).select(F.spark_partition_id().alias("group"), F.struct("*").alias("rows")), "row-blocks")
    asked = written(blocks(table.where(anchors).repartition(n_blocks), BLOCK_ANCHORS).select(F.monotonically_increasing_id().alias("block"), F.struct("*").alias("anchors")), "anchor-blocks")
    sent = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = n_anchors * groups * how.positives
    first = _sorted_pairs(_met(sent, packed, groups).rdd.mapPartitions(lambda x: _positive_keys(x, how)), max(tasks, keys // TASK_KEYS))
    positives = written(spark.createDataFrame(first.mapPartitions(lambda x: _first_positives(x, how)), "block long, anchor long, score long, id long", verifySchema=False), "positives")
    by_anchor = positives.groupBy("block", "anchor").agg(F.collect_list("score").alias("scores"))
    windows = by_anchor.groupBy("block").agg(F.collect_list(F.struct("anchor", "scores")).alias("windows"))
    negatives = _met(sent.join(windows, "block"), packed, groups).rdd.mapPartitions(lambda x: _negative_keys(x, how))
    opening = positives.rdd.map(lambda r: (pack(r["anchor"], r["score"], POSITIVE, r["id"]), None))
    pairs = _sorted_pairs(opening.union(negatives), max(tasks, how.negatives * keys // TASK_KEYS))
    return spark.createDataFrame(pairs.mapPartitions(lambda x: _emit(x, how)), OUT, verifySchema=False)

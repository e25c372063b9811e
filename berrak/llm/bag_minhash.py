"""Near-duplicates by BagMinHash: signatures of weighted sets whose weights are shingle counts.

Every shingle has a Poisson process over time and weight, cut into strips of weight [0, 1),
[1, 2), [2, 4), [4, 8) ...: a strip's process has its width as rate, and each of its points a
weight and a component of the signature. A document takes the points below its own counts; a
component is the earliest time among them. Two documents agree in a component with the
probability of their weighted Jaccard similarity. Strips make the cost of a count its logarithm,
and only points before a time limit are generated: the limit leaves a component empty once in
hundreds of documents, which are then done again with twice the limit.

Signatures are banded; documents that share a band are candidates, and candidates are verified
by the overlap of their multisets of shingles. Small buckets are compared pair by pair, large
ones with a leader each (another one for each band). Where that leaves several components in a
large bucket, these are a family, and all its texts but those of the largest component are held
against the whole family, in blocks of bounded size that give one link per text and component.
Copies of a text are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from berrak.llm.components import components
from berrak.llm.tables import written
from berrak.llm.textvec import BASE, U, chunks, mix, span_hashes, unit, windows, words


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 30
    rows: int = 5
    small_bucket: int = 6
    block: int = 256

    @property
    def size(self) -> int:
        return self.bands * self.rows


GOLD = U(0x9E3779B97F4A7C15)
SALT = U(0xD1B54A32D192ED03)
#: Points generated at a time; a strip's times must not depend on whose limit they are held against.
BLOCKS = (1, 1, 2, 2, 4, 4, 8, 8, 16, 16, 32, 32)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct shingles of each text; a text of fewer words is one shingle."""
    start, end, text = words(data, offsets)
    hashes = span_hashes(data, start, end)
    n = np.bincount(text, minlength=len(offsets) - 1)
    out, at = windows(hashes, text, size)
    owner = text[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(n)])[short]
        whole = np.zeros(len(short), U)
        for k in range(size - 1):
            here = k < n[short]
            whole[here] = mix(whole[here] * BASE + hashes[first[here] + k] + U(k))
        out, owner = np.concatenate([out, mix(whole + n[short].astype(U))]), np.concatenate([owner, short])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    place = np.flatnonzero(new)
    return owner[place], out[place], np.diff(np.concatenate([place, [len(out)]]))


def _strips(owner: np.ndarray, element: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Owner, seed, lower edge, width and count of every strip that a count reaches into."""
    parts, k = [(owner, mix(element), np.zeros(len(owner)), np.ones(len(owner)), count)], 1
    while len(owner := owner[(more := count > 2.0 ** (k - 1))]):
        element, count = element[more], count[more]
        width = np.full(len(owner), 2.0 ** (k - 1))
        parts.append((owner, mix(element + U(int(SALT) * k % 2**64)), width, width, count))
        k += 1
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def signatures(owner: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, size: int) -> np.ndarray:
    """The earliest time of each component for texts 0 .. n-1; infinite for texts without elements."""
    total = np.bincount(owner, count, n)
    out = np.full((n, size), np.inf)
    strips = _strips(owner, element, count)
    limit = size * (np.log(size) + 6) / np.maximum(total, 1)
    todo = np.flatnonzero(total)
    while len(todo):
        row = np.full(n, -1)
        row[todo] = np.arange(len(todo))
        mine = row[strips[0]] >= 0
        text, seed, low, width, most = (x[mine] for x in strips)
        text, times = row[text], np.full(len(todo) * size, np.inf)
        until, now, done, block = limit[todo][text], np.zeros(len(text)), 0, 0
        while len(text):
            points = BLOCKS[min(block, len(BLOCKS) - 1)]
            random = mix(seed[:, None] + (U(done) + np.arange(points, dtype=U)) * GOLD)
            at = now[:, None] + np.cumsum(-np.log(unit(random)) / width[:, None], axis=1)
            second = mix(random ^ SALT)
            weight = low[:, None] + width[:, None] * ((second & U(0xFFFFFFFF)).astype(float) * 2.0**-32)
            lane, point = np.nonzero((at < until[:, None]) & (weight < most[:, None]))
            part = ((second[lane, point] >> U(32)) * U(size) >> U(32)).astype(np.int64)
            np.minimum.at(times, text[lane] * size + part, at[lane, point])
            done, block = done + points, block + 1
            go = at[:, -1] < until
            text, seed, low, width, most, until, now = (x[go] for x in (text, seed, low, width, most, until, at[:, -1]))
        out[todo] = times.reshape(-1, size)
        todo = todo[np.isinf(out[todo]).any(1)]
        limit = limit * 2
    return out


def bands_of(times: np.ndarray, s: Settings) -> np.ndarray:
    bits = np.ascontiguousarray(times).view(U).reshape(len(times), s.bands, s.rows)
    out = np.broadcast_to(mix(np.arange(1, s.bands + 1, dtype=U) * SALT), bits.shape[:2]).copy()
    for k in range(s.rows):
        out = mix(out * BASE + bits[:, :, k])
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in chunks(batch.column("text")):
            n = end - row
            owner, element, count = shingles(data, offsets, s.shingle)
            units = np.bincount(owner, count, n).astype(np.int64)
            bands = bands_of(signatures(owner, element, count, n, s.size), s)
            some = units > 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), batch.column("digest").slice(row, n), _lists(bands[some].ravel(), np.where(some, s.bands, 0))], names=["doc_id", "digest", "bands"])


def _units(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """A hash for each shingle and each of its repetitions."""
    for batch in batches:
        for row, end, data, offsets in chunks(batch.column("text")):
            owner, element, count = shingles(data, offsets, s.shingle)
            first = np.cumsum(count) - count
            nth = np.arange(count.sum()) - np.repeat(first, count)
            every = mix(np.repeat(element, count) + SALT * nth.astype(U))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, end - row), _lists(every, np.bincount(owner, count, end - row).astype(np.int64))], names=["id", "units"])


def _verified(pairs: DataFrame, units: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose multisets of shingles are similar enough."""
    x, y = units.toDF("a", "units_a"), units.toDF("b", "units_b")
    both = F.size(F.array_intersect("units_a", "units_b"))
    joined = pairs.join(x, "a").join(y, "b").withColumn("both", both)
    return joined.where(F.col("both") >= s.similarity * (F.size("units_a") + F.size("units_b") - F.col("both"))).select("a", "b")


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _links_across(asked: pd.DataFrame, among: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """For each asked text and each other component, one text of it that is similar enough."""
    out: list[tuple[int, int]] = []
    if len(asked) and len(among):
        sizes = among["units"].map(len).to_numpy()
        units = np.concatenate(among["units"].to_numpy())
        order = np.argsort(units)
        units, owner = units[order], np.repeat(np.arange(len(among)), sizes)[order]
        ids, component = among["id"].to_numpy(), among["component"].to_numpy()
        for id_, own, mine in zip(asked["id"], asked["component"], asked["units"], strict=True):
            lo, hi = np.searchsorted(units, mine, "left"), np.searchsorted(units, mine, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(among))
            near = np.flatnonzero((both >= s.similarity * (sizes + len(mine) - both)) & (component != own))
            _, one = np.unique(component[near], return_index=True)
            out += [(int(id_), int(ids[k])) for k in near[one]]
    return pd.DataFrame(out, columns=["x", "y"]).astype("int64")


def _across(rest: DataFrame, units: DataFrame, s: Settings) -> DataFrame:
    """Links between components of a family (id, component, family): every text outside the family's
    largest component against all of the family, in blocks of bounded size."""
    sized = rest.groupBy("family", "component").agg(F.count("*").alias("n"))
    family = sized.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    known = rest.join(family, "family").join(units, "id").withColumns({"asked_blocks": F.ceil((F.col("n") - F.col("most")) / s.block).cast("int"), "among_blocks": F.ceil(F.col("n") / (8 * s.block)).cast("int")})
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = known.where("component <> largest").select("family", "id", "component", "units", block("asked_blocks").alias("p"), every("among_blocks").alias("q"), F.lit(True).alias("asked"))
    among = known.select("family", "id", "component", "units", every("asked_blocks").alias("p"), block("among_blocks").alias("q"), F.lit(False).alias("asked"))
    return asked.unionByName(among).groupBy("family", "p", "q").applyInPandas(lambda x: _links_across(x[x["asked"]], x[~x["asked"]], s), "x long, y long")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, text_id, class_id and kept of every row.

    ``text_id`` is the smallest id of the rows with the same text, ``class_id`` the smallest of
    those linked by similarity, directly or through others; ``kept`` marks the row whose id that is.
    Empty texts are copies of one another. A null text or id is a class of its own, and kept. Rows
    that repeat an id belong together; all but one of those with one text lose ``kept``.
    """
    some = docs.select("doc_id", "text").where("doc_id is not null and text is not null").withColumn("digest", F.unhex(F.md5("text")))
    sketched = written(some.mapInArrow(lambda x: _sketch(x, s), "doc_id long, digest binary, bands array<long>"), "sketches")
    texts = written(sketched.groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands")), "texts")
    banded = texts.select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "band")).alias("leader")).where("n > 1")
    met = written(banded.join(buckets, "band"), "buckets")
    small = met.where(F.col("n") <= s.small_bucket)
    each = small.groupBy("band").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.array_distinct("ids").alias("ids")).distinct()
    first = each.select("ids", F.posexplode("ids").alias("k", "x")).select("x", F.explode(F.slice("ids", F.col("k") + 2, F.size("ids"))).alias("y"))
    pairs = written(_ordered(first.unionByName(met.where(F.col("n") > s.small_bucket).select(F.col("id").alias("x"), F.col("leader").alias("y"))), "x", "y"), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # The candidates grow with the corpus: a merge join at every size, never a broadcast that later gives way to one.
    text_of = some.select(F.col("doc_id").alias("id"), "text").join(wanted.hint("merge"), "id", "left_semi")
    units = written(text_of.mapInArrow(lambda x: _units(x, s), "id long, units array<long>").groupBy("id").agg(F.any_value("units").alias("units")), "units")
    links = written(_verified(pairs, units, s), "links")
    found = components(links)
    large = met.where(F.col("n") > s.small_bucket).select("id", "band").join(found, "id", "left").select("id", "band", F.coalesce("component", "id").alias("component"))
    split = large.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "lo")
    rest = written(large.join(split, "band").select("id", "component", "lo").distinct(), "rest")
    if not rest.isEmpty():
        family = components(rest.select(F.col("component").alias("a"), F.col("lo").alias("b"))).toDF("component", "family")
        more = _ordered(_across(rest.select("id", "component").distinct().join(family, "component"), units, s), "x", "y")
        found = components(links.union(more))
    named = texts.select("digest", "id").join(found, "id", "left").select("digest", F.col("id").alias("text_id"), F.coalesce("component", "id").alias("class_id"))
    rows = sketched.select("doc_id", "digest").join(named, "digest")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text_id"))
    kept = rows.select("doc_id", "text_id", "class_id", ((F.col("doc_id") == F.col("class_id")) & (nth == 1)).alias("kept"))
    alone = docs.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("text_id"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return kept.unionByName(alone)


def dedup_stage(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One document of each class, with its own columns: that of the smallest id.

    Of rows that repeat an id one stays; rows with a null id or text stay.
    """
    alone = F.col("doc_id").isNull() | F.col("text").isNull()
    kept = classes(docs, s).where("kept and text_id is not null").select("doc_id", "text_id").distinct().select(F.col("doc_id").alias("kept_id"))
    packed = docs.where(~alone).select(F.struct("*").alias("doc"), F.col("doc_id").alias("kept_id"), F.md5("text").alias("print"))
    one = packed.join(kept, "kept_id", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("kept_id").orderBy("print"))).where("nth = 1")
    return one.select("doc.*").unionByName(docs.where(alone))

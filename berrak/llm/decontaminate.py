"""Benchmark decontamination by a generalised suffix automaton over the words of test items.

Items and documents are normalised alike: A-Z become lower case, and words are runs of ASCII
letters and digits and of all bytes from 0x80. The automaton holds every run of words of every
item. Documents are streamed through it: after each word it knows the longest run of item words
that ends there. Where that is at least ``window`` words long, or a whole shorter item ends, the
words are hit.

The benchmark is dealt by hash into blocks of about ``block_words`` words (an item is never cut);
each block's automaton is built by a task and written to the shared folder. Documents pass
``blocks_per_pass`` automata at a time, which are broadcast and dropped again; where there are more,
texts and what was found so far are written between passes. So neither the driver nor a task holds
more than the automata of one pass, however long the benchmark is, and documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import packed_schema, written

#: A-Z to a-z, other bytes that are not in words to a space.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Limits:
    """A run of ``window`` item words is removed; a document with more than ``coverage`` of its words hit goes whole."""

    window: int = 10
    coverage: float = 0.5
    block_words: int = 100_000
    blocks_per_pass: int = 2


class Automaton:
    """A generalised suffix automaton over sequences of word numbers.

    ``step``: transitions by state; ``link`` and ``length`` as usual. ``items`` has, for a
    state that holds a run of just the window's length, the items in which it occurs;
    ``whole``, the short items that end where a state is reached: (length, item), longest first.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: list[tuple[tuple[int, str | None], ...]] = []
        self.items: list[set[str | None]] = []
        sequences = [(item, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for item, words in items if words]
        for _, sequence in sequences:
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        self._mark(sequences)

    def _clone(self, p: int, c: int, q: int) -> int:
        r = len(self.link)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = r
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = r
            p = self.link[p]
        return r

    def _extend(self, p: int, c: int) -> int:
        q = self.step[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        new = len(self.link)
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[p] + 1)
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _mark(self, sequences: list[tuple[str | None, list[int]]]) -> None:
        self.items = [set() for _ in self.link]
        own: list[list[tuple[int, str | None]]] = [[] for _ in self.link]
        for item, sequence in sequences:
            state = 0
            for c in sequence:
                state = self.step[state][c]
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                if self.length[at] >= self.window:
                    self.items[at].add(item)
            if len(sequence) < self.window:
                own[state].append((len(sequence), item))
        self.whole = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.whole[state] = (*sorted(own[state], key=str, reverse=True), *self.whole[self.link[state]])
        self.shortest = min((len(s) for _, s in sequences), default=0)
        self.shortest = min(self.shortest, self.window)

    def match(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans of hit words in a run of known words, and the items that occur."""
        step, link, length, window = self.step, self.link, self.length, self.window
        state = size = 0
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        for i, c in enumerate(numbers, 1):
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]
                spans.append((i - window, i))
            for n, item in self.whole[state]:
                if n <= size:
                    spans.append((i - n, i))
                    found.add(item)
        return spans, found


def _normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def _build(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """One block's automaton; items without an id are numbered None."""
    items = [(None if pd.isna(i) else i, _normal_words(t)) for i, t in zip(rows["item"], rows["text"], strict=True)]
    return pd.DataFrame({"block": rows["block"].iloc[:1], "automaton": [pickle.dumps(Automaton(items, window), 5)]})


def automata(benchmark: DataFrame, limits: Limits) -> DataFrame:
    """block and automaton (pickled) of every block of the benchmark, as a written table."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit("[^\\s\\p{Punct}]+"), F.lit(0)))
    total = items.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-total // limits.block_words))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInPandas(lambda x: _build(x, limits.window), "block int, automaton binary"), "automata")


def passes(benchmark: DataFrame, limits: Limits) -> Iterator[tuple[Broadcast, bool]]:
    """The automata of each pass, broadcast, and whether it is the last. Each is gone when the next is asked for."""
    spark, table = benchmark.sparkSession, automata(benchmark, limits)
    blocks = sorted(r.block for r in table.select("block").collect())
    groups = [blocks[k : k + limits.blocks_per_pass] for k in range(0, len(blocks), limits.blocks_per_pass)] or [[]]
    for group in groups:
        found = [bytes(r.automaton) for r in table.where(F.col("block").isin(group)).collect()] if group else []
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, found))
        last = group is groups[-1]
        yield held, last
        if not last:
            held.unpersist()


#: The automata of the pass that this worker is at, by the pass's name.
_at_work: dict[str, list[Automaton]] = {}


def _machines(held: Broadcast) -> list[Automaton]:
    name, found = held.value
    if name not in _at_work:
        _at_work.clear()
        _at_work[name] = [pickle.loads(x) for x in found]
    return _at_work[name]


def _hits(words: list[bytes], machine: Automaton) -> tuple[np.ndarray, set[str | None]]:
    """Which words are hit, and the items found. Only runs of known words are streamed."""
    get = machine.ids.get
    numbers = [get(w, 0) for w in words]
    known = np.zeros(len(numbers) + 2, bool)
    known[1:-1] = np.array(numbers, np.int32) > 0
    cover = np.zeros(len(numbers) + 1, np.int32)
    found: set[str | None] = set()
    if machine.shortest:
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in edge.reshape(-1, 2)[np.diff(edge)[::2] >= machine.shortest]:
            spans, got = machine.match(numbers[a:b])
            found |= got
            for s, e in spans:
                cover[a + s] += 1
                cover[a + e] -= 1
    return np.cumsum(cover[:-1]) > 0, found


def _runs(hit: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def _word_places(raw: bytes) -> np.ndarray:
    """Start and end of each word in bytes."""
    on = np.frombuffer(b" " + raw.translate(NORMAL) + b" ", np.uint8) != 0x20
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


def _cut(raw: bytes, runs: np.ndarray) -> bytes:
    """The text without its runs of hit words and what stands between words of one run."""
    places, out, at = _word_places(raw), [], 0
    for a, b in runs:
        out.append(raw[at : places[a, 0]])
        at = places[b - 1, 1]
    return b"".join([*out, raw[at:]])


OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


#: What passes hand on: each row's columns, its text, the runs of words hit so far, the items found, and its words.
HELD = "runs array<int>, items array<string>, n_words long"


NO_ITEMS = hashlib.sha256(b"").hexdigest()


def _raw(value: pa.Scalar) -> bytes:
    """The bytes of a string, not decoded."""
    return value.as_buffer().to_pybytes()


def _search(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """The runs of hit words and the items of every row, with those of this pass."""
    machines = _machines(held)
    for batch in batches:
        runs: list[list[int]] = []
        found: list[list[str]] = []
        counts: list[int] = []
        for value, before, own in zip(batch.column("text"), batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
            words = _raw(value).translate(NORMAL).split() if value.is_valid else []
            counts.append(len(words))
            hit, items = np.zeros(len(words), bool), set(own)
            for a, b in zip(before[::2], before[1::2], strict=True):
                hit[a:b] = True
            for machine in machines:
                more, got = _hits(words, machine)
                hit |= more
                items |= got
            runs.append(_runs(hit).ravel().tolist() if hit.any() else [])
            found.append(sorted(x for x in items if x is not None))
        own = [pa.array(runs, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), *own], names=["doc", "text", "runs", "items", "n_words"])


def _told(batches: Iterator[pa.RecordBatch], cut: str | None) -> Iterator[pa.RecordBatch]:
    """The results of every row from its runs and items."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    for batch in batches:
        rows: list[tuple] = []
        kept: list[bytes | None] = []
        held = (batch.column(c).to_pylist() for c in ("runs", "items", "n_words"))
        for value, runs, ids, n_words in zip(batch.column("text"), *held, strict=True):
            places = np.array(runs, np.int64).reshape(-1, 2)
            n = int((places[:, 1] - places[:, 0]).sum())
            rows.append((n_words, n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else NO_ITEMS, n > 0))
            if cut is not None:
                raw = _raw(value) if value.is_valid else None
                kept.append(_cut(raw, places) if n else raw)
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        names = ["doc", *(x.split()[0] for x in OUT.split(", "))]
        if cut is not None:
            columns.append(pc.cast(pa.array(kept, pa.binary()), pa.string()))
            names.append("cut")
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=names)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, cut: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, then those of ``OUT``; ``cut`` names a further
    column with the text without its hit spans. Columns of these names are replaced.

    Null and empty texts have no words, null and empty items no windows. Item ids are taken as
    strings; items of one text count as often as they have ids, repeated items once. An item
    without an id hits words, but is neither counted nor listed. An empty benchmark hits nothing.
    """
    results = [x.split()[0] for x in OUT.split(", ")] + ([cut] if cut else [])
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{text}`").alias("text"))
    at = at.withColumns({"runs": F.array().cast("array<int>"), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")})
    told = packed_schema(at, OUT + (", cut string" if cut else ""))
    search = packed_schema(at, f"text string, {HELD}")
    for held, last in passes(benchmark, limits):
        if last:
            at = at.mapInArrow(lambda x, held=held: _told(_search(x, held), cut), told)
        else:
            at = written(at.mapInArrow(lambda x, held=held: _search(x, held), search), "decontamination")
    return at.select(*[F.col(f"doc.`{c}`").alias(c) for c in names], *results[:5], *([F.col("cut").alias(cut)] if cut else []))


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Documents without their hit spans; those with more than ``coverage`` of their words hit are dropped.

    ``n_chars`` follows the text where it changed. Columns as in ``docs``, whatever they are called.
    Rows with null or empty texts, and repeated rows, stay; an empty table stays empty.
    """
    packed = docs.select(F.struct("*").alias("doc"), F.col("text").alias("doc_text"))
    found = scan(packed, benchmark, "doc_text", ["doc"], "doc_cut", limits).where(F.col("n_hit") <= limits.coverage * F.col("n_words"))
    new = {"text": F.when(F.col("contaminated"), F.col("doc_cut")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("contaminated"), F.length("doc_cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return found.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))

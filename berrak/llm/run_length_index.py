"""Removal of repeated text by run-length compressed Burrows-Wheeler indexes.

A byte is removed if it lies in a string of ``length`` bytes that also starts earlier. One index
of the whole corpus would live in one place, so the corpus is cut by content:

1. Anchors. In every window of ``length`` bytes the ``gram``-byte string with the smallest hash
   is its anchor. Equal windows have equal anchors at the same distance, so what an anchor's
   context (all windows around it) repeats is found among the contexts of equal anchors.
2. Equal contexts. Contexts sorted by anchor and content stream past: all but the earliest of
   equal ones are repeated wholly, and anchors with one context only need no more.
3. Index. The other contexts are dealt by anchor, some MB at a time, in their order. Of each
   anchor's contexts the earlier half is indexed: the Burrows-Wheeler transform is kept as runs, with
   the places of the suffixes at both ends of every run. The later half is streamed through it
   from right to left: a match grows while the transform has the letter, and else falls back to the
   nearer run of that letter, as far as the sampled suffix there agrees. Where it is ``length`` bytes
   long, these start earlier. Then each half is halved again. Contexts that are found wholly are
   neither streamed nor indexed again: indexes hold first copies. Nor are contexts that share
   none of the parts, singled out by content, of which every window holds one, with the other half.

Contexts of anchors with more than ``hot`` of them are dealt again by a second anchor: the ``fine``-byte
strings with the smallest hash in each half of a window, in which equal windows agree too. A
key whose contexts still don't fit is worked on part by part, in order; each part's first copies stay as
bytes, and those of them that share a singled-out part with a later one are indexed when it comes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import written
from berrak.llm.textvec import BASE, CHUNK, INVERSE, U, chunks, mix, powers, span_hashes_of


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 32
    index_bytes: int = 1 << 22
    hot: int = 4_000
    fine: int = 16
    piece_bytes: int = CHUNK

    @property
    def reach(self) -> int:
        """How far windows around an anchor start before it."""
        return self.length - self.gram


def _doubled(values: np.ndarray, size: int, join) -> np.ndarray:
    """``join`` over every run of ``size`` values, by runs of powers of two."""
    have, n = values, 1
    while n * 2 <= size:
        have, n = join(have[:-n], have[n:], n), n * 2
    if n == size:
        return have
    return join(have[: len(have) - (size - n)], have[size - n :], size - n)


def string_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Polynomial hashes of every ``size`` consecutive bytes, for some sizes."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=sums[1:])
    inverse = powers(INVERSE, n)
    return [(sums[size:] - sums[: max(0, n + 1 - size)]) * inverse[: max(0, n + 1 - size)] for size in sizes]


def anchors(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, anchor hash, context hash, text and context start of every anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < s.length:
        return none, none.astype(U), none.astype(U), none, none
    grams, whole = string_hashes(data, s.gram, s.length)
    grams = mix(grams)
    order = (grams >> U(32)).astype(np.uint32) | np.uint32(1)
    width = s.reach + 1
    least = _doubled(order, width, lambda a, b, _: np.minimum(a, b))
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:][text_of]
    least[ends[: len(least)] - np.arange(len(least)) < s.length] = 0
    padded = np.zeros(len(order) + s.reach, np.uint32)
    padded[s.reach : s.reach + len(least)] = least
    most = _doubled(padded, width, lambda a, b, _: np.maximum(a, b))
    at = np.flatnonzero(most[: len(order)] == order)
    text = text_of[at]
    begin = np.maximum(offsets[text], at - s.reach)
    last = np.minimum(offsets[text + 1] - s.length, at)
    context = mix(mix(whole[begin] + (at - begin).astype(U)) * BASE + whole[last] + U(3) * (last - begin).astype(U))
    return at, grams[at], context, text, begin


def anchors_of_pieces(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """``anchors``; a text of its own that is longer than ``piece_bytes`` is worked on in overlapping pieces."""
    size = s.piece_bytes
    if len(offsets) > 2 or len(data) <= size:
        return anchors(data, offsets, s)
    parts = []
    for a in range(0, len(data), size):
        lo, hi = max(0, a - 2 * s.length), min(len(data), a + size + 2 * s.length)
        at, anchor, context, text, begin = anchors(data[lo:hi], np.array([0, hi - lo]), s)
        own = (at + lo >= a) & (at + lo < a + size)
        parts.append((at[own] + lo, anchor[own], context[own], text[own], begin[own] + lo))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


ROW = "anchor long, context long, doc_id long, tie long, place int, until int"


def _rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(k)) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])


def _anchor_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The first of equal contexts of each text as (anchor, context, doc_id, tie, place, -1); what the
    others cover as spans (a hash of the text, 0, doc_id, tie, start, end)."""
    for batch in batches:
        ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tie"))
        for row, _, data, offsets in chunks(batch.column("text")):
            at, anchor, context, text, begin = anchors_of_pieces(data, offsets, s)
            if not len(at):
                continue
            order = np.lexsort((at, context, anchor, text))
            again = np.zeros(len(at), bool)
            o = order
            again[o[1:]] = (context[o[1:]] == context[o[:-1]]) & (anchor[o[1:]] == anchor[o[:-1]]) & (text[o[1:]] == text[o[:-1]])
            one, own = ~again, text[~again] + row
            yield _rows([anchor[one], context[one], ids[own], ties[own], at[one] - offsets[text[one]], np.full(len(own), -1)])
            if again.any():
                start, end, text = begin[again], np.minimum(offsets[text[again] + 1], at[again] + s.length), text[again]
                new = np.ones(len(start), bool)
                new[1:] = (text[1:] != text[:-1]) | (start[1:] > end[:-1])
                k = np.flatnonzero(new)
                start, end, text = start[k], np.maximum.reduceat(end, k), text[k]
                own = text + row
                yield _rows([mix(ties[own].astype(np.int64).view(U)), np.zeros(len(k), U), ids[own], ties[own], start - offsets[text], end - offsets[text]])


def _equal_contexts(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, context and order. Spans pass; repeated contexts become spans (until >= 0),
    first contexts of anchors that have others stay (until -1)."""
    last: list[np.ndarray] | None = None
    told = False
    for batch in batches:
        columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        span = columns[5] >= 0
        if span.any():
            yield _rows([x[span] for x in columns])
            columns = [x[~span] for x in columns]
        if not len(columns[0]):
            continue
        n_old = 0
        if last is not None:
            columns, n_old = [np.concatenate([a, b]) for a, b in zip(last, columns, strict=True)], 1
        anchor, context, doc, tie, place, _ = columns
        same_anchor = np.concatenate([[False], anchor[1:] == anchor[:-1]])
        equal = same_anchor & np.concatenate([[False], context[1:] == context[:-1]])
        here = equal & np.concatenate([[False], (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (place[1:] == place[:-1])])
        again = equal & ~here
        again[:n_old] = False
        if again.any():
            start = np.maximum(place[again] - s.reach, 0)
            yield _rows([anchor[again], context[again], doc[again], tie[again], start, place[again] + s.length])
        first = np.flatnonzero(~equal)
        other = np.concatenate([anchor[first][1:] == anchor[first][:-1], [False]])
        branch = other | np.concatenate([[False], other[:-1]])
        if n_old and told:
            branch[0] = False
        if branch.any():
            k = first[branch]
            yield _rows([x[k] for x in columns[:5]] + [np.full(len(k), -1)])
        told = bool(branch[-1]) or (len(first) == 1 and n_old == 1 and told)
        last = [x[first[-1:]] for x in columns]


def anchor_table(docs: DataFrame, s: Settings) -> DataFrame:
    """Spans that equal contexts show as repeated, and the contexts that need an index."""
    rows = docs.mapInArrow(lambda x: _anchor_rows(x, s), ROW)
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "context", "doc_id", "tie", "place")
    return written(dealt.mapInArrow(lambda x: _equal_contexts(x, s), ROW), "anchors")


PIECE = "key long, doc_id long, tie long, start int, until int, context binary"
PIECE_NAMES = ["key", "doc_id", "tie", "start", "until", "context"]


def _pieces(columns: list[np.ndarray], contexts: pa.Array | None = None) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
    arrays = [pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(k)) for x, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(arrays[0]), pa.binary()) if contexts is None else contexts], names=PIECE_NAMES)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every ``width`` consecutive values, the leftmost of equal ones."""
    return (_doubled((values & ~U(0xFFFFFFFF)) | np.arange(len(values), dtype=U), width, lambda a, b, _: np.minimum(a, b)) & U(0xFFFFFFFF)).astype(np.int64)


def _dealt_again(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, doc: np.ndarray, tie: np.ndarray, begin: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """Contexts of hot anchors cut where the second anchor of their windows changes place.

    Of equal parts in this batch only the earliest is passed on; the others are spans.
    """
    half = s.length // 2
    grams = mix(string_hashes(data, s.fine)[0] + U(0x2545F4914F6CDD1D))
    place = _least(grams, half - s.fine + 1)
    n = len(data) - s.length + 1
    string = np.repeat(np.arange(len(doc)), np.diff(offsets))
    at = np.flatnonzero(offsets[1:][string[:n]] - np.arange(n) >= s.length)
    left, right, own = place[at], place[at + half], string[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    first, last, own = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])] + s.length, own[new]
    key = mix(mix(anchor[own].astype(np.int64).view(U) * BASE + grams[left[new]]) * BASE + grams[right[new]])
    content = span_hashes_of(data)(first, last)
    doc, tie, start = doc[own], tie[own], begin[own] + first - offsets[own]
    order = np.lexsort((start, tie, doc, content, key))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
    one = np.flatnonzero(~again)
    parts = pa.array([data[a:b].tobytes() for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)], pa.binary())
    yield _pieces([key[one], doc[one], tie[one], start[one], np.full(len(one), -1)], parts)
    # Rows that are given twice are no copies of themselves.
    here = np.zeros(len(order), bool)
    here[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (tie[order[1:]] == tie[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
    k = np.flatnonzero(again & ~here)
    if len(k):
        yield _pieces([mix(doc[k].astype(U) + start[k].astype(U)), doc[k], tie[k], start[k], start[k] + last[k] - first[k]])


def _cut_contexts(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The bytes around each place of each text; those around places of hot anchors are cut again.

    A window that holds an anchor twice belongs to the context of the first, so that a context holds no
    window that another one of its text and anchor has.
    """
    for batch in batches:
        texts, places, ids, ties = (batch.column(c) for c in ("text", "places", "doc_id", "tie"))
        columns: list[list] = [[], [], [], [], []]
        contexts: list[bytes] = []
        for i in range(len(batch)):
            raw, found = texts[i].as_buffer().to_pybytes(), places[i].values
            at, anchor, hot = (found.field(k).to_numpy(zero_copy_only=False) for k in ("place", "anchor", "hot"))
            order = np.lexsort((at, anchor))
            at, anchor, hot = at[order].astype(np.int64), anchor[order], hot[order]
            free = np.zeros(len(at), np.int64)
            free[1:] = np.where(anchor[1:] == anchor[:-1], at[:-1] + 1, 0)
            begin = np.maximum(np.maximum(at - s.reach, 0), free)
            end = np.minimum(at + s.length, len(raw))
            full = end - begin >= s.length
            for x, y in zip(columns, (anchor, np.full(len(at), ids[i].as_py()), np.full(len(at), ties[i].as_py()), begin, hot), strict=True):
                x.append(y[full])
            contexts.extend([raw[b:e] for b, e in zip(begin[full].tolist(), end[full].tolist(), strict=True)])
        if not contexts:
            continue
        anchor, doc, tie, begin, hot = (np.concatenate(x) for x in columns)
        hot, cut = hot.astype(bool), pa.array(contexts, pa.binary())
        cold = np.flatnonzero(~hot)
        if len(cold):
            yield _pieces([anchor[cold], doc[cold], tie[cold], begin[cold], np.full(len(cold), -1)], cut.take(pa.array(cold)))
        warm = np.flatnonzero(hot)
        for k in range(0, len(warm), max(1, s.hot)):
            part = warm[k : k + max(1, s.hot)]
            data, offsets = _binary(cut.take(pa.array(part)))
            yield from _dealt_again(data, offsets, anchor[part], doc[part], tie[part], begin[part], s)


class Index:
    """The run-compressed Burrows-Wheeler transform of many strings, each with a terminator of its own.

    Strings belong to groups; a letter is a byte of a group, so that nothing matches across groups.
    Of the transform its runs are kept: ``start`` (row), ``letter`` and ``to`` (the row to which the
    first of the run leads); for the first and the last row of each run, the place of its suffix and
    how many bytes the string has from there. ``by`` has the runs in the order of their letters.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
        n, m = len(data), len(offsets) - 1
        offsets, group = offsets.astype(np.int32), group.astype(np.int32)
        string = np.repeat(np.arange(m, dtype=np.int32), np.diff(offsets))
        left = offsets[1:][string] - np.arange(n, dtype=np.int32)
        suffixes = self._sorted(data, group[string], string, left, m)
        letters = group[string] * 256 + data
        at_start = left[suffixes] == np.diff(offsets)[string[suffixes]]
        before = np.concatenate([letters[offsets[1:] - 1], np.where(at_start, np.int32(-1), letters[np.maximum(suffixes - 1, 0)])])
        self.start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.letter, size = before[self.start].astype(np.int64), np.diff(np.concatenate([self.start, [n + m]]))
        del string, letters, at_start, before
        self.last = self.start + size - 1
        self.by = np.argsort(self.letter, kind="stable")
        self.keys = self.letter[self.by] * len(self.start) + self.by
        self.to = np.empty(len(self.start), np.int64)
        self.to[self.by] = np.cumsum(size[self.by]) - size[self.by]
        place = lambda rows: np.where(rows < m, offsets[1:][np.minimum(rows, m - 1)], suffixes[np.maximum(rows - m, 0)])
        rest = lambda rows: np.where(rows < m, 0, left[suffixes[np.maximum(rows - m, 0)]])
        self.first_at, self.first_left = place(self.start), rest(self.start)
        self.last_at, self.last_left = place(self.last), rest(self.last)
        del suffixes, left
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=self.sums[1:])

    @staticmethod
    def _sorted(data: np.ndarray, group: np.ndarray, string: np.ndarray, left: np.ndarray, m: int) -> np.ndarray:
        """Suffixes in the order of their groups and bytes, by ranks of 8, 24, 72 ... bytes; by 8, 16, 32 ... where
        three ranks are too long for 63 bits."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        key = np.zeros(n, U)
        for k in range(8):
            key <<= U(8)
            key |= np.where(left > k, padded[k : k + n], np.uint8(0))
        order = np.argsort(key)
        small = group.astype(np.int16) if group.max(initial=0) < 1 << 15 else group
        order = order[np.argsort(small[order], kind="stable")]
        new = np.concatenate([[False], (key[order][1:] != key[order][:-1]) | (small[order][1:] != small[order][:-1])])
        size, bits = 8, np.int64(max(1, (n + m).bit_length()))
        hops = (1, 2) if 3 * bits <= 63 else (1,)
        while not new[1:].all():
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32)
            key = rank.astype(np.int64)
            for hop in (size * x for x in hops):
                # Past its end a suffix is told apart by the number of its string.
                key <<= bits
                key |= np.where(left > hop, rank[np.minimum(np.arange(n, dtype=np.int32) + hop, n - 1)] + m, string)
            order = np.argsort(key)
            new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
            size *= 1 + len(hops)
        return order.astype(np.int32)

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes agree from two places on, at most ``most``; by hashes and halving."""
        inverse = powers(INVERSE, len(self.sums))
        low, high = np.zeros_like(most), most.copy()
        todo = np.flatnonzero(high > 0)
        while len(todo):
            x, y, size = a[todo], b[todo], (low[todo] + high[todo] + 1) >> 1
            same = (self.sums[x + size] - self.sums[x]) * inverse[x] == (self.sums[y + size] - self.sums[y]) * inverse[y]
            low[todo] = np.where(same, size, low[todo])
            high[todo] = np.where(same, high[todo], size - 1)
            todo = todo[low[todo] < high[todo]]
        return low

    def _fall_back(self, run: np.ndarray, at: np.ndarray, size: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The run of a letter beside each run whose end agrees longer, that end's row and place, and how far it
        agrees; -1 where no run has the letter."""
        k = np.searchsorted(self.keys, letter * len(self.start) + run)
        out = run.copy(), self.start[run], at.copy(), np.full(len(run), -1)
        for side, rows, places, rest in ((k - 1, self.last, self.last_at, self.last_left), (k, self.start, self.first_at, self.first_left)):
            other = self.by[np.minimum(np.maximum(side, 0), len(self.by) - 1)]
            has = np.flatnonzero((side >= 0) & (side < len(self.by)) & (self.letter[other] == letter))
            other = other[has]
            agree = self._common(at[has], places[other], np.minimum(size[has], rest[other]))
            more = agree > out[3][has]
            for x, y in zip(out, (other, rows[other], places[other], agree), strict=True):
                x[has[more]] = y[more]
        return out

    def match(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Matching statistics: how many bytes from each place of the given strings on stand, in this order, in an indexed string of their group.

        All strings are streamed from their ends to their starts, one byte of each at a time.
        """
        sizes = np.diff(offsets)
        out = np.zeros(len(data), np.int32)
        live = np.argsort(-sizes, kind="stable")
        letters, ends = data + np.repeat(group, sizes) * 256, offsets[1:]
        row, size, at = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.full(len(live), self.first_at[0])
        for k in range(1, int(sizes.max(initial=0)) + 1):
            if sizes[live[-1]] < k:
                n = int(np.searchsorted(-sizes[live], -k, "right"))
                live, row, at, size = live[:n], row[:n], at[:n], size[:n]
            place = ends[live] - k
            letter = letters[place]
            run = np.searchsorted(self.start, row, "right") - 1
            miss = np.flatnonzero(self.letter[run] != letter)
            if len(miss):
                run[miss], row[miss], at[miss], size[miss] = self._fall_back(run[miss], at[miss], size[miss], letter[miss])
            lost = size < 0
            row, at, size = np.where(lost, 0, self.to[run] + row - self.start[run]), np.where(lost, self.first_at[0], at - 1), size + 1
            out[place] = size
        return out


def _taken(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some of the strings: bytes, offsets, and where the bytes come from."""
    sizes = np.diff(offsets)[rows]
    new = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(new[-1]) + np.repeat(offsets[rows] - new[:-1], sizes)
    return data[at], new, at


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which values are among others."""
    if not len(others):
        return np.zeros(len(values), bool)
    have = np.sort(others)
    return have[np.minimum(np.searchsorted(have, values), len(have) - 1)] == values


@dataclass(frozen=True)
class Copies:
    """Strings of one key with their signs and the strings that hold these (see ``Repeats._signs``)."""

    data: np.ndarray
    offsets: np.ndarray
    sign: np.ndarray
    signed: np.ndarray


class Repeats:
    """Which windows of strings, given by key and in their order, equal earlier ones of their key."""

    def __init__(self, key: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length = data, offsets, length
        self.group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.rank = np.arange(len(key)) - first[self.group]
        self.found = np.zeros(len(data), bool)
        self.open = np.diff(offsets) - length + 1
        content = span_hashes_of(data)(offsets[:-1], offsets[1:])
        order = np.lexsort((np.arange(len(key)), content, self.group))
        again = np.zeros(len(key), bool)
        again[order[1:]] = (content[order[1:]] == content[order[:-1]]) & (self.group[order[1:]] == self.group[order[:-1]])
        self._mark(np.flatnonzero(again), None, None)
        self.sign, self.signed, self.first, self.last = self._signs()

    def _signs(self) -> tuple[np.ndarray, ...]:
        """Parts of five sixths of a window's length that have the smallest hash in some window, as hashes with
        their groups, the strings that hold them, and the first and last of these windows. Strings without a common one share no window."""
        size = self.length * 5 // 6
        grams = mix(string_hashes(self.data, size)[0])
        n = len(self.data) - self.length + 1
        string = np.repeat(np.arange(len(self.open), dtype=np.int32), np.diff(self.offsets))[:n]
        at = np.flatnonzero(self.offsets[1:].astype(np.int32)[string] - np.arange(n, dtype=np.int32) >= self.length)
        place, own = _least(grams, self.length - size + 1)[at], string[at]
        del string
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])]))
        return mix(grams[place[new]] + mix(self.group[own[new]].astype(U))), own[new], at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]

    def _marks(self) -> np.ndarray:
        """How many windows are found before each place."""
        marks = np.zeros(len(self.found) + 1, np.int32)
        np.cumsum(self.found, dtype=np.int32, out=marks[1:])
        return marks

    def _wanted(self) -> np.ndarray:
        """The signs of windows that are not found yet. The first copy of a window never is, so that others need not be looked for or in."""
        marks = self._marks()
        return np.flatnonzero(marks[self.last + 1] - marks[self.first] <= self.last - self.first)

    def _mark(self, rows: np.ndarray, at: np.ndarray | None, hit: np.ndarray | None) -> None:
        """Marks windows of some strings: those at ``at[hit]``, or all."""
        if not len(rows):
            return
        if at is None:
            _, new, at = _taken(self.data, self.offsets, rows)
            hit = np.repeat(new[1:], np.diff(new)) - np.arange(len(at)) >= self.length
        self.found[at[hit]] = True
        marks = self._marks()
        self.open[rows] = np.diff(self.offsets)[rows] - self.length + 1 - (marks[self.offsets[rows + 1]] - marks[self.offsets[rows]])

    def _stream(self, index: Index, rows: np.ndarray, group: np.ndarray) -> None:
        data, offsets, at = _taken(self.data, self.offsets, rows)
        self._mark(rows, at, index.match(data, offsets, group) >= self.length)

    def among_earlier(self, copies: Copies) -> None:
        """Marks what stands in earlier strings of the first key."""
        k = self._wanted()
        k = k[self.group[self.signed[k]] == 0]
        rows = np.unique(self.signed[k][_among(self.sign[k], copies.sign)])
        if len(rows):
            data, offsets, _ = _taken(copies.data, copies.offsets, np.unique(copies.signed[_among(copies.sign, self.sign[k])]))
            self._stream(Index(data, offsets, np.zeros(len(offsets) - 1, np.int64)), rows, np.zeros(len(rows), np.int64))

    def among_themselves(self) -> None:
        """Later halves against earlier ones, then halves of these, of all keys at once."""
        for bit in reversed(range(int(self.rank.max(initial=0)).bit_length())):
            block, late = self.rank >> (bit + 1), (self.rank >> bit & 1).astype(bool)
            k = self._wanted()
            own = self.signed[k]
            sign, half = self.sign[k] + mix(block[own].astype(U)), late[own]
            met = np.zeros(len(self.open), bool)
            met[own[half][_among(sign[half], sign[~half])]] = True
            met[own[~half][_among(sign[~half], sign[half])]] = True
            rows = np.flatnonzero(met)
            if len(rows):
                _, number = np.unique((self.group[rows].astype(np.int64) << 32) | block[rows], return_inverse=True)
                early = ~late[rows]
                data, offsets, _ = _taken(self.data, self.offsets, rows[early])
                self._stream(Index(data, offsets, number[early]), rows[~early], number[~early])

    def first_copies(self) -> Copies | None:
        """The strings that have windows of their own."""
        rows = np.flatnonzero(self.open > 0)
        if not len(rows):
            return None
        data, offsets, _ = _taken(self.data, self.offsets, rows)
        k = self._wanted()
        return Copies(data, offsets, self.sign[k], np.searchsorted(rows, self.signed[k]))


def _span_rows(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch | None:
    """Spans of ``length`` bytes from sorted starts, joined where they touch."""
    if not len(start):
        return None
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + length)
    k = np.flatnonzero(new)
    end = np.concatenate([start[k[1:] - 1], start[-1:]]) + length
    return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(tie[k]), pa.array(start[k].astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "tie", "start", "end"])


SPAN = "doc_id long, tie long, start int, end int"


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Task:
    """The pieces of one task, in the order of key, document and place, and what they repeat."""

    def __init__(self, s: Settings):
        self.s = s
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0
        self.key: int | None = None
        self.earlier: list[Copies] = []

    def add(self, key: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(offsets)
        for a, b in self._parts(key, offsets):
            # Twice where the key that goes on was kept.
            while self.bytes and self.bytes + offsets[b] - offsets[a] > self.s.index_bytes:
                yield from self.flush(key[a])
            self.waiting.append((key[a:b], doc[a:b], tie[a:b], start[a:b].astype(np.int64), sizes[a:b], data[offsets[a] : offsets[b]]))
            self.bytes += int(offsets[b] - offsets[a])

    def _parts(self, key: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of one key, of ``index_bytes`` at most but for a longer string."""
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            while a < b:
                c = min(b, max(a + 1, int(np.searchsorted(offsets, offsets[a] + self.s.index_bytes, "right")) - 1))
                yield a, c
                a = c

    def flush(self, following: int | None = None) -> Iterator[pa.RecordBatch]:
        """The repeated spans of what waits. ``following``: the key that comes next; if it is the last one here, that
        key's first copies are kept for what comes."""
        if not self.waiting:
            return
        key, doc, tie, start, sizes, data = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        goes_on = following is not None and following == key[-1]
        if goes_on and key[0] != key[-1]:
            # The key that goes on is kept, whole so far, for the next time.
            k = int(np.flatnonzero(key != key[-1])[-1]) + 1
            self.waiting, self.bytes = [(key[k:], doc[k:], tie[k:], start[k:], sizes[k:], data[offsets[k] :])], int(offsets[-1] - offsets[k])
            key, doc, tie, start, data, offsets, goes_on = key[:k], doc[:k], tie[:k], start[:k], data[: offsets[k]], offsets[: k + 1], False
        else:
            self.waiting, self.bytes = [], 0
        if key[0] != self.key:
            self.earlier = []
        repeats = Repeats(key, data, offsets, self.s.length)
        for copies in self.earlier:
            repeats.among_earlier(copies)
        repeats.among_themselves()
        if goes_on:
            self.key = int(key[0])
            if (copies := repeats.first_copies()) is not None:
                self.earlier.append(copies)
        at = np.flatnonzero(repeats.found)
        own = np.searchsorted(offsets, at, "right") - 1
        place = start[own] + at - offsets[own]
        sort = np.lexsort((place, tie[own], doc[own]))
        if (out := _span_rows(doc[own][sort], tie[own][sort], place[sort], self.s.length)) is not None:
            yield out


def _repeated(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Spans from pieces sorted by key, document and place; spans among them pass, and pieces of rows that
    are given twice count once."""
    task, last = Task(s), None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in PIECE_NAMES[:5]]
        span = columns[4] >= 0
        if span.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[span]) for x in columns[1:]], names=["doc_id", "tie", "start", "end"])
        own = np.flatnonzero(~span)
        if not len(own):
            continue
        rows = [x[own] for x in columns[:4]]
        again = np.concatenate([[last is not None and all(x[0] == y for x, y in zip(rows, last, strict=True))], np.logical_and.reduce([x[1:] == x[:-1] for x in rows])])
        last = [x[-1] for x in rows]
        own = own[~again]
        if len(own):
            data, offsets = _binary(batch.column("context").take(pa.array(own)))
            yield from task.add(*(x[own] for x in columns[:4]), offsets, data)
    yield from task.flush()


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch], names: list[str], cut: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers: list[tuple] = []
        kept: list[bytes] = []
        spans = batch.column("spans")
        for i, value in enumerate(batch.column("text")):
            raw = value.as_buffer().to_pybytes()
            parts, at, n, gone = [], 0, 0, 0
            if spans[i].is_valid:
                found = spans[i].values
                start, end = (found.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
                order = np.argsort(start)
                start, end = start[order], np.maximum.accumulate(np.minimum(end[order], len(raw)))
                first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                for a, b in zip(start[first].tolist(), end[np.concatenate([first[1:] - 1, [-1]])].tolist(), strict=True):
                    parts.append(raw[at:a])
                    at, n, gone = b, n + 1, gone + b - a
            left = b"".join([*parts, raw[at:]]) if n else raw
            numbers.append((len(raw), gone, n, hashlib.sha256(left).hexdigest()))
            kept.append(left)
        columns = [pa.array(x, k) for x, k in zip(zip(*numbers, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if numbers else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
        extra = [pa.array(kept, pa.binary())] if cut else []
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns, *extra], names=[*names, *(x.split()[0] for x in OUT.split(", ")), *([cut] if cut else [])])


def repeated_spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Spans (doc_id, tie, start, end) of repeated bytes of ``docs`` (doc_id, tie, text); they may overlap."""
    table = anchor_table(docs, s)
    spans = table.where("until >= 0").select("doc_id", "tie", F.col("place").alias("start"), F.col("until").alias("end"))
    branch = table.where("until < 0").select("anchor", "doc_id", "tie", "place")
    hot = branch.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > s.hot).select("anchor", F.lit(True).alias("hot"))
    placed = branch.join(hot, "anchor", "left").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    pieces = docs.join(placed, ["doc_id", "tie"]).mapInArrow(lambda x: _cut_contexts(x, s), PIECE)
    dealt = pieces.repartition("key").sortWithinPartitions("key", "doc_id", "tie", "start")
    return spans.unionByName(dealt.mapInArrow(lambda x: _repeated(x, s), SPAN))


def remove_repeats(docs: DataFrame, cut: str | None = None, s: Settings = Settings()) -> DataFrame:
    """doc_id and the columns of ``OUT`` for every row: bytes, repeated bytes, maximal runs of them, and a
    digest of the rest; ``cut`` names a further column with the rest itself (bytes, as a run may
    end within a character).

    Null text is empty. Null ids come first. Rows that repeat an id are ordered by a hash of
    their texts, and rows that are wholly equal count as one document given twice.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_ = F.coalesce("doc_id", F.lit(-(2**63)))
    numbered = keyed.select(id_.alias("doc_id"), F.xxhash64("text").alias("tie"), "text", F.col("doc_id").isNull().alias("no_id"))
    spans = repeated_spans(numbered.select("doc_id", "tie", "text"), s).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = numbered.join(spans, ["doc_id", "tie"], "left").select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", "spans")
    schema = "doc_id long, " + OUT + (f", `{cut}` binary" if cut else "")
    return joined.mapInArrow(lambda x: _removed(x, ["doc_id"], cut), schema)

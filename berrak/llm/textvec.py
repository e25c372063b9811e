"""Vectorised word and hash arithmetic over the bytes of many texts at once.

The functions work on the buffers that Arrow hands to Python, so that no Python object is
made for a text or a word. Hashes are polynomials modulo 2**64 with an odd base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C55)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for later calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, U)
        have[0] = 1
        _powers[int(base)] = have = np.cumprod(have, dtype=U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text: first row, end row, bytes, offsets from 0.

    Null counts as empty. A text longer than the limit is a run of its own, whole.
    """
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word: a run of bytes that are not ASCII white space.

    ``inside``: instead, which byte values are part of words.
    """
    on = (~SPACE if inside is None else inside)[data]
    starts, ends = on.copy(), on.copy()
    starts[1:] &= ~on[:-1]
    ends[:-1] &= ~on[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = on[edges]
    ends[edges - 1] = on[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def span_hashes_of(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and ends to hashes of the byte strings between, equal for equal strings anywhere."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=sums[1:])
    inverse = powers(INVERSE, len(data) + 1)
    return lambda start, end: mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings ``data[start:end]``."""
    return span_hashes_of(data)(start, end)


def windows(values: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive values within one text, and the places where they start."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    out = np.zeros(len(at), U)
    for k in range(size):
        out = mix(out * BASE + values[at + k] + U(k))
    return out, at

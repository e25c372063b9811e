"""Quality rules by compression: texts outside a band of zstandard ratios are rejected.

A ratio is compressed size / size in bytes. A whole document is held against the band of its
length; besides, it is cut into chunks of ``chunk_bytes``, each held against the band of the
chunk's length, and a document with more than ``chunk_share`` bad chunks is rejected. Every byte
is in a chunk: a remainder of less than half a chunk belongs to the chunk before it. A low ratio
means repetition or few words, a high one means noise such as encoded bytes.

Each text is measured where it is read: no shuffle, and memory for a few MB of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import packed_schema, quoted
from berrak.llm.textvec import SPACE, U, chunks, span_hashes, windows, words

SYMBOLS = b"#*$%&|<>"


#: The band of ordinary text by length, as ``fit_bands`` gave it for the labelled good rows of sf0.1; see there.
WHOLE: tuple[tuple[int, float, float], ...] = (
    (99, 0.0, 9.0), (100, 0.35, 1.02), (128, 0.718, 0.952), (181, 0.658, 0.892), (256, 0.604, 0.839),
    (362, 0.564, 0.782), (512, 0.539, 0.747), (724, 0.524, 0.681), (1024, 0.498, 0.64), (1448, 0.485, 0.592),
    (2048, 0.467, 0.572), (2896, 0.457, 0.553), (4096, 0.442, 0.528), (5793, 0.427, 0.517), (8192, 0.42, 0.503),
    (11585, 0.411, 0.496), (16384, 0.404, 0.491), (23170, 0.4, 0.487), (32768, 0.398, 0.484), (65536, 0.15, 0.58),
)


@dataclass(frozen=True)
class Bands:
    """Limits by length: rows of (bytes, lowest, highest ratio).

    Between two rows the limits run straight over the logarithm of the length; outside, the
    nearest row holds. Frames and tables of zstandard weigh on short texts, so that their bands
    are wide.
    """

    whole: tuple[tuple[int, float, float], ...] = WHOLE
    chunk_bytes: int = 2_048
    chunk_share: float = 0.5
    level: int = 3
    min_words: int = 20
    repeat_percent: int = 30

    def limits(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, low, high = (np.array(x, float) for x in zip(*self.whole, strict=True))
        x = np.log2(np.maximum(sizes, 1))
        return np.interp(x, np.log2(np.maximum(at, 1)), low), np.interp(x, np.log2(np.maximum(at, 1)), high)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"


def _duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _repeat_words(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text, words inside an 8-word window that occurs twice or more in the text."""
    found, at = windows(hashes, text, 8)
    if not len(found):
        return np.zeros(n, np.int64)
    owner = text[at].astype(U)
    order = np.lexsort((found, owner))
    f, o = found[order], owner[order]
    same = (f[1:] == f[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(f), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(text) + 1, np.int32)
    np.add.at(cover, at[order[twice]], 1)
    np.add.at(cover, at[order[twice]] + 8, -1)
    return np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=n)


def _pieces(text: bytes, size: int) -> list[bytes]:
    """Chunks of ``size`` bytes; the last has the remainder and is 0.5 to 1.5 times as long."""
    ends = [k * size for k in range(1, (len(text) + size // 2) // size)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]


def measure(batches: Iterator[pa.RecordBatch], text_column: str, names: list[str], bands: Bands) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    continued = np.zeros(256, bool)
    continued[0x80:0xC0] = True
    for batch in batches:
        parts = []
        for _, _, data, offsets in chunks(batch.column(text_column)):
            n = len(offsets) - 1
            start, end, text = words(data, offsets)
            n_words = np.bincount(text, minlength=n)
            chars = np.concatenate([[0], np.cumsum(~(SPACE | continued)[data])])
            repeat = _repeat_words(span_hashes(data, start, end), text, n)
            raw = data.tobytes()
            marks, lines, ratio, n_chunks, bad = (np.zeros(n, t) for t in (np.int64, np.int64, float, np.int64, np.int64))
            for i in range(n):
                one = raw[offsets[i] : offsets[i + 1]]
                marks[i] = len(one) - len(one.translate(None, SYMBOLS))
                lines[i] = _duplicate_lines(one)
                ratio[i] = len(squeeze.compress(one)) / len(one) if one else 0.0
                pieces = _pieces(one, bands.chunk_bytes)
                if len(pieces) > 1:
                    sizes = np.array([len(x) for x in pieces])
                    got = np.array([len(squeeze.compress(x)) for x in pieces]) / sizes
                    least, most = bands.limits(sizes)
                    n_chunks[i], bad[i] = len(pieces), np.count_nonzero((got < least) | (got > most))
            low, high = bands.limits(np.diff(offsets))
            base = (n_words < bands.min_words) | (100 * repeat > bands.repeat_percent * n_words)
            good = (ratio >= low) & (ratio <= high) & (bad <= bands.chunk_share * n_chunks)
            parts.append([n_words, chars[offsets[1:]] - chars[offsets[:-1]], marks, lines, repeat, ratio, n_chunks, bad, base, good & ~base])
        if parts:
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
            kept = [batch.column(c) for c in batch.schema.names if c in names]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=[*names, *[x.split()[0] for x in OUT.split(", ")]])


def compression_bands(docs: DataFrame, text: str = "text", keep: list[str] | None = None, bands: Bands = Bands()) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, then the counts and verdicts of ``OUT``.

    Null text counts as empty: no words, so base_failed. Repeated rows are judged one by one.
    Columns of ``docs`` named like a result column are replaced by it.
    """
    results = [x.split()[0] for x in OUT.split(", ")]
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    source = docs.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("doc"), F.col(quoted(text)).alias("text"))
    judged = source.mapInArrow(lambda batches: measure(batches, "text", ["doc"], bands), packed_schema(source, OUT))
    return judged.select(*[F.col(f"doc.{quoted(c)}").alias(c) for c in names], *results)


def quality_stage(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names."""
    packed = docs.select(F.struct("*").alias("doc"), F.col("text").alias("doc_text"))
    return compression_bands(packed, "doc_text", ["doc"], bands).where("kept").select("doc.*")


#: Rows that a fit reads at most, fitted lengths, rows a limit is taken from, its quantile, and its margins in ratios. No labelled
#: row of sf0.1 is bad by a high ratio, so that the upper margin is the wider one.
SAMPLE, LENGTHS, NEAR, QUANTILE, BELOW, ABOVE = 20_000, [round(2 ** (k / 2)) for k in range(14, 31)], 200, 0.002, 0.006, 0.05


def fit(sizes: np.ndarray, ratios: np.ndarray) -> tuple[tuple[int, float, float], ...]:
    """Limits from the lengths and ratios of good texts.

    A cubic of the logarithm of the length gives the middle. At each of ``LENGTHS``, the limits
    are quantiles of the distances of the ``NEAR`` texts nearest in length, and a margin. Under 100 bytes
    nothing is judged; at 100 bytes, and from 64 KiB on, where labelled texts are few, only far outliers are. Of long texts the chunks decide.
    """
    x = np.log2(sizes)
    curve = np.polyfit(x, ratios, 3)
    off, rows = ratios - np.polyval(curve, x), []
    for at in LENGTHS:
        near = off[np.argsort(np.abs(x - np.log2(at)), kind="stable")[:NEAR]]
        middle = np.polyval(curve, np.clip(np.log2(at), x.min(), x.max()))
        rows.append((at, round(float(middle + np.quantile(near, QUANTILE) - BELOW), 3), round(float(middle + np.quantile(near, 1 - QUANTILE) + ABOVE), 3)))
    return ((99, 0.0, 9.0), (100, 0.35, 1.02), *rows, (65_536, 0.15, 0.58))


def fit_bands(docs: DataFrame, labels: DataFrame, bands: Bands = Bands()) -> Bands:
    """Bands of the good rows (quality 1) that pass the base rules: at most ``SAMPLE``, by a hash of the id."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    some = docs.select("doc_id", "text").join(good, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    judged = compression_bands(some.withColumn("bytes", F.octet_length("text")), keep=["bytes"], bands=bands)
    rows = judged.where("not base_failed").select("bytes", "ratio").toPandas()
    return replace(bands, whole=fit(rows["bytes"].to_numpy(float), rows["ratio"].to_numpy()))

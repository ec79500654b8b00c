"""Quality rules on compression: bands of zstandard ratios over whole documents and over fixed chunks.

The ratio of a text is compressed size over size in bytes. Repetitive or padded text lies below the band of prose of its length, incompressible
text (base64 keys, encoded data, noise) above it. A text's chunks are runs of CHUNK bytes, and what follows the last full one with
its own length; they find a part that is out of band in a text that is fine on average. A text fails if its own ratio is out of band, or
those of more than ``chunk_share`` of its chunks' bytes.

Limits belong to lengths: RANGES ranges for each doubling, and the whole corpus gives each its limits (``calibrate``). A range's limits are the
median of its ratios less ``below``, and plus ``above``, times their spread (1.4826 times the median distance from the median, ``least_spread`` at least),
each distinct (length, compressed size) taken once, so that copies don't outvote other texts. Few texts are weak evidence: limits are drawn towards
``Bands.outer``, fixed values by length, as if ``prior`` more texts stood for these; and they never go beyond them. The outer limits lie between
prose and base64 (prose of 256, 1,024 and 4,096 bytes up to 0.80, 0.61 and 0.52, base64 0.93, 0.79 and 0.76). Hexadecimal digits compress as prose does and aren't
told by a ratio.

``measure`` also gives the word and line statistics that base rules use. Words are runs without ASCII white space.
Defined results: null counts as empty; an empty text has zero everywhere, no ratio (null) and no chunk, and no band rejects it;
texts of any length from one byte on have limits; repeated rows are measured and judged each; other columns pass through untouched, whatever
their names, but those of the names that are added, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import Workspace, as_bytes, prepare

CHUNK = 4096
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


#: Ranges of lengths for each doubling.
RANGES = 4


@dataclass(frozen=True)
class Bands:
    #: Fixed limits that hold without a corpus: (least bytes, lowest ratio, highest ratio), by rising length.
    outer: tuple[tuple[int, float, float], ...] = (
        (1, 0.0, 32.0), (32, 0.15, 1.6), (64, 0.15, 1.3), (128, 0.15, 1.05), (256, 0.12, 0.85), (384, 0.12, 0.80), (512, 0.12, 0.78), (768, 0.12, 0.75),
        (1024, 0.12, 0.72), (2048, 0.12, 0.70), (4096, 0.10, 0.68), (16384, 0.08, 0.65),
    )
    below: float = 4.0
    above: float = 6.0
    least_spread: float = 0.008
    prior: int = 50
    chunk_share: float = 0.25
    level: int = 3


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    each = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = each[:-1] * len(number) + each[1:]
    pair = np.unique(pair, return_inverse=True)[1] if len(number) >= 1 << 20 else pair
    _, place, count = np.unique(pair[:-1] * len(number) + each[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(words) - 2 + i] |= again
    return int(covered.sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    if not words:
        return 0, 0, 0, 0, 0
    inner = text.translate(None, _SPACES)
    chars = len(inner) if inner.isascii() else len(inner.decode())
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else [text]
    symbols = len(inner) - len(inner.translate(None, _SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def length_range(size: Column) -> Column:
    """The range of lengths that so many bytes lie in; a power of two begins one."""
    return F.floor(F.log2(F.greatest(size, F.lit(1))) * RANGES + 1e-9).cast("int")


def outer_limits(number: int, bands: Bands) -> tuple[float, float]:
    least = 2 ** (number / RANGES)
    return next((low, high) for size, low, high in reversed(bands.outer) if least >= size or size == bands.outer[0][0])


def _middle(found: list[tuple[float, int]]) -> float:
    """The lower median of (value, times)."""
    half, upto = (sum(n for _, n in found) + 1) // 2, 0
    for value, n in sorted(found):
        upto += n
        if upto >= half:
            return value
    return 0.0


def limits_of(counts: dict[int, list[tuple[float, int]]], bands: Bands) -> dict[int, tuple[float, float]]:
    """Range to (low, high), from how often each ratio (in steps of 0.001) occurs in it."""
    made = {}
    for number, found in counts.items():
        low, high = outer_limits(number, bands)
        n, middle = sum(n for _, n in found), _middle(found)
        spread = max(bands.least_spread, 1.4826 * _middle([(abs(r - middle), times) for r, times in found]))
        drawn = lambda limit, fixed: (n * limit + bands.prior * fixed) / (n + bands.prior)  # noqa: E731, B023
        made[number] = max(low, drawn(middle - bands.below * spread, low)), min(high, drawn(middle + bands.above * spread, high))
    return made


def calibrate(sizes: DataFrame, bands: Bands = Bands()) -> dict[int, tuple[float, float]]:
    """The limits of each range of lengths, from all rows (n, packed): bytes and compressed bytes.

    What reaches the driver is one row for each range and step of the ratio, however many texts there are."""
    once = sizes.filter("n > 0").groupBy("n", "packed").agg(F.lit(1).alias("one"))
    steps = once.select(length_range(F.col("n")).alias("number"), F.round(F.col("packed") * 1000 / F.col("n")).cast("int").alias("step"))
    counts: dict[int, list[tuple[float, int]]] = {}
    for r in steps.groupBy("number", "step").agg(F.count("*").alias("times")).collect():
        counts.setdefault(r.number, []).append((r.step / 1000, r.times))
    return limits_of(counts, bands)


def in_band(size: Column, packed: Column, limits: dict[int, tuple[float, float]]) -> Column:
    """Whether a length and its compressed size lie within the limits of the length; there are at most a few hundred ranges."""
    if not limits:
        return F.lit(True)
    number = length_range(size)
    table = F.create_map(*(F.lit(x) for k, (low, high) in sorted(limits.items()) for x in (k, F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))))
    limit = F.element_at(table, number)
    ratio = F.try_divide(packed, size)
    return F.coalesce(ratio.between(limit["low"], limit["high"]), F.lit(True))


_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "packed", "chunks")


def _measurer(level: int):
    def measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level, write_content_size=False)
        size = lambda x: len(packer.compress(x))
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(0)):
                whole = size(text) if text else 0
                chunks = [whole] if len(text) <= CHUNK else [size(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
                rows.append((*statistics(text), len(text), whole, chunks if text else []))
            kinds = (*(pa.int64(),) * 7, pa.list_(pa.int32()))
            added = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], [*(f"c{i}" for i in range(batch.num_columns - 1)), *_ADDED])

    return measurer


def measure(documents: DataFrame, bands: Bands = Bands(), keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default: all but those it adds) with the statistics, n_bytes, packed (compressed bytes) and chunks (those of each chunk)."""
    prepare(documents.sparkSession)
    kept = [c for c in (documents.columns if keep is None else keep) if c not in _ADDED]
    # by place, so that no name can clash with one of ours
    rows = documents.select("text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    shape = rows.drop("text").schema
    for name, kind in zip(_ADDED, ("long",) * 7 + ("array<int>",), strict=True):
        shape = shape.add(name, DataType.fromDDL(kind))
    return rows.mapInArrow(_measurer(bands.level), shape).toDF(*kept, *_ADDED)


def judge(documents: DataFrame, bands: Bands = Bands(), keep: list[str] | None = None, limits: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """What ``measure`` gives, with ratio, n_chunks, n_bad_chunks and band_kept; ``limits`` (of ``calibrate``) are the corpus's own by default."""
    work = Workspace(prepare(documents.sparkSession), "quality")
    kept = [c for c in (documents.columns if keep is None else keep) if c not in (*_ADDED, "ratio", "n_chunks", "n_bad_chunks", "band_kept")]
    measured = work.save(measure(documents, bands, kept), "measured")
    chunk_size = lambda i, n: F.least(F.lit(CHUNK), F.col("n_bytes") - i.cast("long") * CHUNK)
    if limits is None:
        parts = F.transform("chunks", lambda x, i: F.struct(chunk_size(i, x).alias("n"), x.cast("long").alias("packed")))
        # a text of one chunk is that chunk
        every = F.when(F.size("chunks") <= 1, parts).otherwise(F.concat(F.array(F.struct(F.col("n_bytes").alias("n"), F.col("packed"))), parts))
        limits = calibrate(measured.select(F.explode(every).alias("x")).select("x.n", "x.packed"), bands)
    bad = F.filter(F.transform("chunks", lambda x, i: F.when(~in_band(chunk_size(i, x), x.cast("long"), limits), chunk_size(i, x))), lambda x: x.isNotNull())
    judged = measured.withColumns({"ratio": F.when(F.col("n_bytes") > 0, F.try_divide("packed", "n_bytes")), "n_chunks": F.size("chunks").cast("long"), "__bad": bad})
    spoiled = F.aggregate("__bad", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = (F.col("n_bytes") == 0) | in_band(F.col("n_bytes"), F.col("packed"), limits)
    judged = judged.withColumns({"n_bad_chunks": F.size("__bad").cast("long"), "band_kept": whole & (spoiled <= bands.chunk_share * F.col("n_bytes"))})
    return judged.drop("__bad", "chunks")

"""Packing documents into token windows by best-fit decreasing.

A document is its token ids and an end id. It is first cut into full windows; what remains is shorter than a window.
Remainders are dealt by a hash into shards of a bounded number of narrow rows (no ids travel), and
each shard is packed by itself: longest first, each into the open window with the least room that holds it. Open
windows are kept in a segment tree indexed by remaining capacity, so the tightest one is found in log2(window) steps.

Token ids are those of the ``tokenizers`` library, by way of a bounded cache of words (wordcache.py).

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a window whose content has a
power of two of tokens isn't padded; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, binary_of, prepare
from .wordcache import opened

WINDOW = 2048
#: Remainders that one task packs; the last windows of each shard may stay part empty.
SHARD_ROWS = 20_000


def cutter(path: str, end_id: int, window: int):
    """(__row, text) to pieces: (__row, start, length, doc_tokens, ids little-endian uint32)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = opened(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = np.concatenate([cache.ids(text), end])
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for x, y in zip(rows, (key, start, len(piece), len(ids), piece), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), *(pa.array(x, pa.int64()) for x in rows[1:4]), binary_of(rows[4])], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return cut


def pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row for each full window and each remainder of every document, with its ids."""
    prepare(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(cutter(tokenizer, end_id, window), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


class OpenWindows:
    """Open windows by remaining room, in a segment tree over 0..window; leaf r counts the windows with room r."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, name: int) -> None:
        self.open.setdefault(room, []).append(name)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that some open window has."""
        at, count = length + self.leaves, self.count
        if count[at]:
            return length
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def take(self, room: int) -> int:
        at = room + self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """The window and the offset there of each length; lengths descend."""
    windows, names, offsets, made = OpenWindows(window), [], [], 0
    for length in lengths:
        room = windows.tightest(length)
        if room is None:
            room, name, made = window, made, made + 1
        else:
            name = windows.take(room)
        names.append(name)
        offsets.append(window - room)
        if room > length:
            windows.add(room - length, name)
    return names, offsets


def shard_packer(window: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        names, offsets = best_fit(rows["length"].tolist(), window)
        return rows.assign(sequence_id=rows["__shard"].to_numpy() * (1 << 32) + np.array(names, np.int64), offset=np.array(offsets, np.int64)).drop(columns="__shard")

    return pack


def pack(cut: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length and a few numbers), which should be a written table: it is read three times.

    A full window is a sequence of its own (with a negative id) and isn't moved."""
    full = cut.filter(F.col("length") == window).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.filter(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard_rows))
    dealt = rest.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))  # the position parts repeated rows
    return full.unionByName(dealt.groupBy("__shard").applyInPandas(shard_packer(window), full.schema))


def pack_with_ids(cut: DataFrame, work: Workspace, window: int = WINDOW) -> DataFrame:
    """What ``pack`` gives for pieces (doc_id, start, length, doc_tokens, ids), with the ids of each.

    Only narrow rows are packed; the ids of remainders meet their places by a number that is written with them."""
    pieces = work.save(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    placed = work.save(pack(pieces.drop("ids"), window).select("piece", "sequence_id", "offset", "length"), "places")
    whole = pieces.join(placed.filter(F.col("length") < window).drop("length"), "piece")
    full = pieces.filter(F.col("length") == window).withColumns({"sequence_id": -1 - F.col("piece"), "offset": F.lit(0).cast("long")})
    return full.unionByName(whole.select(full.columns)).drop("piece")


def padded_length(filled, window: int = WINDOW):
    """What a window holding ``filled`` tokens is padded to."""
    return F.when(F.conv(filled.cast("string"), 10, 2).rlike("^10*$"), filled).otherwise(F.lit(window))

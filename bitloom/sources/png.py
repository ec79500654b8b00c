"""PNG masks: a decoder and an encoder on zlib and numpy, and a scan of mask folders.

Decodes gray of 8 and 16 bits, RGB, RGBA, gray with alpha and palettes (as indices), without interlacing.
Modes: permissive (null and a reason for what isn't a mask; RGB with equal channels is collapsed), strict (raises),
first_channel (takes channel 0), raw (keeps channels, in row-major order)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGN = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((h, stride), np.uint8)
    zero = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        up = out[y - 1] if y else zero
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up
        elif kind == 1:  # each channel byte is a running sum along the row
            out[y] = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            now, above = [0] * step + line.tolist(), [0] * step + up.tolist()
            for i in range(step, stride + step):
                a, b, c = now[i - step], above[i], above[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = (now[i] + guess) & 255
            out[y] = now[step:]
        else:
            raise ValueError(f"unknown filter {kind}")
    return out


def decode(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, channels), uint8 or uint16."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    if depth not in (8, 16) or interlace or colour not in _CHANNELS:
        raise ValueError(f"unsupported PNG: depth {depth}, colour {colour}, interlace {interlace}")
    channels = _CHANNELS[colour]
    step = channels * depth // 8
    rows = _unfiltered(zlib.decompress(b"".join(packed)), h, w * step, step)
    pixels = (rows.view(">u2").astype(np.uint16) if depth == 16 else rows).reshape(h, w, channels)
    return pixels[:, :, 0] if channels == 1 else pixels


def encode(pixels: np.ndarray, level: int = 6) -> bytes:
    """A gray or RGB PNG; uint8 or uint16."""
    depth = 16 if pixels.dtype == np.uint16 else 8
    h, w = pixels.shape[:2]
    rows = np.ascontiguousarray(pixels.astype(">u2" if depth == 16 else np.uint8)).view(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, depth, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return _SIGN + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def as_mask(pixels: np.ndarray, mode: str) -> tuple[np.ndarray | None, str | None]:
    """The mask, or why there is none."""
    if mode == "raw" or pixels.ndim == 2:
        return pixels, None
    if mode == "first_channel" or (pixels.shape[2] >= 3 and (pixels[:, :, :3] == pixels[:, :, :1]).all()):
        return pixels[:, :, 0], None
    if mode == "strict":
        raise ValueError("mask has different channels")
    return None, "channels differ"


def _rows(mode: str):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    mask, error = as_mask(decode(bytes(content)), mode)
                except (ValueError, zlib.error, struct.error) as e:
                    if mode == "strict":
                        raise
                    mask, error = None, str(e)
                out.append((path, *(mask.shape[:2] if mask is not None else (None, None)), (mask.shape[2] if mask.ndim == 3 else 1) if mask is not None else None, str(mask.dtype) if mask is not None else None, mask.astype(np.int64).reshape(-1).tolist() if mask is not None else None, error))
            yield pd.DataFrame(out, columns=["path", "h", "w", "channels", "dtype", "labels", "error"]).astype({"h": "Int32", "w": "Int32", "channels": "Int32"})

    return rows


def scan(spark: SparkSession, root: str, subdir: str = "warped_masks", mode: str = "permissive") -> DataFrame:
    """(facade_id, name, path, h, w, channels, dtype, labels, error) of <root>/<facade_id>/<subdir>/*.png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(f"{root}/*/{subdir}").select("path", "content")
    parts = F.split("path", "/")
    return files.mapInPandas(_rows(mode), "path string, h int, w int, channels int, dtype string, labels array<long>, error string").select(F.get(parts, F.size(parts) - 3).alias("facade_id"), F.get(parts, F.size(parts) - 1).alias("name"), "path", "h", "w", "channels", "dtype", "labels", "error")


def pixels(scanned: DataFrame) -> DataFrame:
    """(facade_id, name, y, x, label) of readable masks of one channel."""
    rows = scanned.filter("error is null and channels = 1").select("facade_id", "name", "w", F.posexplode("labels").alias("p", "label"))
    return rows.select("facade_id", "name", F.expr("cast(p div w as long)").alias("y"), (F.col("p") % F.col("w")).cast("long").alias("x"), "label")


def class_ids(pixel_rows: DataFrame, colours: DataFrame, unknown: str = "error") -> DataFrame:
    """Adds class_id to rows with r, g, b. unknown: error, map0 or map_last. colours: (r, g, b, class_id), a small table."""
    last = colours.agg(F.max("class_id").alias("last"))
    met = pixel_rows.join(colours, ["r", "g", "b"], "left").crossJoin(F.broadcast(last))  # one row
    instead = {"error": F.raise_error(F.lit("unknown RGB")).cast("long"), "map0": F.lit(0).cast("long"), "map_last": F.col("last").cast("long")}[unknown]
    return met.withColumn("class_id", F.when(F.col("class_id").isNotNull(), F.col("class_id").cast("long")).otherwise(instead)).drop("last")


def unknown_colours(pixel_rows: DataFrame, colours: DataFrame, most: int = 10) -> DataFrame:
    """(r, g, b, n) of the colours that no class has, the most frequent first."""
    return pixel_rows.join(colours, ["r", "g", "b"], "left_anti").groupBy("r", "g", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r", "g", "b").limit(most)

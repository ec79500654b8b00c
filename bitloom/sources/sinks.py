"""Sinks: result tables, JSON, flat streams, mask files, heat maps, run bits, row caches, split files and tables for papers.

Tables of any size are written by Spark as folders. Single files are for results of bounded size and are written on the driver; files of one image each are
written by the tasks that hold them, under temporary names that are then renamed, so a task that runs again leaves whole files."""

from __future__ import annotations

import csv
import io
import json
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import png

#: Rows that a single file takes at most.
MOST_ROWS = 1_000_000


def _bounded(rows: DataFrame, most: int) -> list:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a single file")
    return found


def csv_file(rows: DataFrame, path: str, columns: list[str], append: bool = False, most: int = MOST_ROWS) -> None:
    """One CSV file with a fixed header; appending writes the header only where the file is missing or empty."""
    found = _bounded(rows.select(*columns), most)
    bare = append and os.path.exists(path) and os.path.getsize(path) > 0
    with open(path, "a" if append else "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        if not bare:
            out.writerow(columns)
        out.writerows(["" if x is None else x for x in r] for r in found)


def json_file(value: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.write("\n")


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _write(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def int32_stream(rows: DataFrame, order: list[str], tokens: str, path: str) -> int:
    """Appends the token arrays, in order, to one flat file of little-endian 32-bit numbers; rows come over one by one. Returns the tokens written."""
    n = 0
    with open(path, "ab") as f:
        for r in rows.select(*order, tokens).orderBy(*order).toLocalIterator():
            part = np.asarray(r[tokens], "<i4")
            f.write(part.tobytes())
            n += len(part)
    return n


def mask_files(rows: DataFrame, root: str, classes: int) -> int:
    """Writes (name, h, w, labels) as gray PNG files below a shared folder: 8 bits up to 255 classes, else 16. Returns how many."""
    kind = np.uint8 if classes <= 255 else np.uint16

    def write(frames):
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples():
                _write(os.path.join(root, r.name), png.encode(np.asarray(r.labels, kind).reshape(r.h, r.w)))
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("name", "h", "w", "labels").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def stretched(grid: np.ndarray) -> np.ndarray:
    """A grid between its least and greatest value as 0..255; a flat one is 0."""
    low, high = float(grid.min(initial=0)) if grid.size == 0 else float(grid.min()), float(grid.max(initial=0)) if grid.size == 0 else float(grid.max())
    return np.zeros(grid.shape, np.uint8) if high - low <= 0 else np.round((grid - low) / (high - low) * 255).astype(np.uint8)


def heat_files(grid: np.ndarray, path: str) -> None:
    """<path>.npy with the numbers and <path>.png with the picture."""
    held = io.BytesIO()
    np.save(held, grid.astype(np.float32))
    _write(f"{path}.npy", held.getvalue())
    _write(f"{path}.png", png.encode(stretched(grid)))


def run_bits_file(y: np.ndarray, start: np.ndarray, length: np.ndarray, bits: np.ndarray, path: str) -> None:
    """One image's run bits, by row and start."""
    order = np.lexsort((start, y))
    held = io.BytesIO()
    np.savez_compressed(held, y=y[order], start=start[order], length=length[order], bits=bits[order])
    _write(path, held.getvalue())


def row_cache(cache: DataFrame, by: str, path: str) -> None:
    """Row caches as Parquet, parted by a column, with a note of its layout beside them."""
    cache.write.mode("overwrite").partitionBy(by).parquet(path)


def model_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The count tables that are a model, each a Parquet folder."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def split_lists(splits: DataFrame, key: str, root: str, most: int = MOST_ROWS) -> None:
    """<split>.txt for each split, with sorted keys."""
    held: dict[str, list[str]] = {}
    for r in _bounded(splits.select("split", key).distinct(), most):
        held.setdefault(r.split, []).append(str(r[key]))
    for split, keys in held.items():
        _write(os.path.join(root, f"{split}.txt"), "".join(f"{k}\n" for k in sorted(keys)).encode())


def latex(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a LaTeX table."""
    escaped = lambda x: "" if x is None else str(x).translate({ord(c): f"\\{c}" for c in "&%$#_{}"})
    line = lambda cells: " & ".join(map(escaped, cells)) + r" \\"
    body = [line(r) for r in _bounded(rows, most)]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", r"\hline", line(rows.columns), r"\hline", *body, r"\hline", r"\end{tabular}"]) + "\n"

"""Scalar functions over names and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def log2_safe(x: Column) -> Column:
    """Base-2 logarithm; infinity where x isn't positive."""
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(float("inf")))


def year_pair(name: Column) -> tuple[Column, Column]:
    """Both years of names like 2015_2018_tile.png."""
    pattern = r"(?i)^(\d{4})_(\d{4})_.*\.png$"
    return tuple(_group(name, pattern, n).cast("int") for n in (1, 2))


def last_year(text: Column) -> Column:
    """The last four-digit year from 1900 to 2099 that stands by itself; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(?:19|20)\d{2}(?!\d)"), 0)
    return F.try_element_at(found, F.lit(-1)).cast("int")


def city_name(name: Column) -> dict[str, Column]:
    """city, seq, frame and kind of names like aachen_000001_000019_gtFine_labelIds.png; zero numbers are null."""
    pattern = r"^(.+?)_(\d+)_(\d+)_(.+)\.png$"
    return {"city": _group(name, pattern, 1), "seq": F.nullif(_group(name, pattern, 2).cast("int"), F.lit(0)), "frame": F.nullif(_group(name, pattern, 3).cast("int"), F.lit(0)), "kind": _group(name, pattern, 4)}


def tau_and_k(method: Column) -> dict[str, Column]:
    """method, tau and k of names like iid_tau0.10_k5."""
    pattern = r"^(.*)_tau([0-9.]+)_k([0-9]+)$"
    return {"base": _group(method, pattern, 1), "tau": _group(method, pattern, 2).try_cast("double"), "k": _group(method, pattern, 3).try_cast("int")}


def tile_name(name: Column) -> dict[str, Column]:
    """stem, gy and gx of names like mask__gy3__gx12.png."""
    pattern = r"^(.*)__gy(\d+)__gx(\d+)\.png$"
    return {"stem": _group(name, pattern, 1), "gy": _group(name, pattern, 2).cast("int"), "gx": _group(name, pattern, 3).cast("int")}


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def frame_number(name: Column) -> Column:
    """The nine digits before .png."""
    return _group(name, r"(\d{9})\.png$", 1).cast("long")


def codec_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def palette(label: Column) -> Column:
    return F.array(*((label * m) % 255 for m in (37, 67, 97)))


def argmax(scores: Column) -> Column:
    """The first place of the greatest score, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def exp_golomb_bins(n: Column, bins: int) -> Column:
    """floor(log2(n)) of a whole number, at most bins - 1."""
    out = F.lit(0)
    for k in range(1, bins):
        out = out + (n >= F.lit(1 << k)).cast("int")
    return out

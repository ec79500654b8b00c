"""Scans of mask folders in their several layouts, list and table files, class lists, caches and streams. Folders are read by Spark's file source.

What has a bounded size (a class list, a tile meta file, the names of split folders) is read on the driver through the same file system."""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IMAGE = "*.{png,PNG,tif,tiff,TIF,TIFF}"


def _named(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    piece = lambda n: F.get(parts, F.size(parts) - n)
    return files.select(piece(3).alias("facade_id"), piece(2).alias("subdir"), piece(1).alias("name"), "path", "length", "content")


def _binary(spark: SparkSession, paths: list[str] | str, pattern: str, recursive: bool = False) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(paths)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_bytes(spark: SparkSession, path: str, most: int = 64 << 20) -> bytes:
    """A file of bounded size; a larger one is an error."""
    row = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= most, F.col("content")).alias("content")).first()
    if row is None or row.content is None:
        raise ValueError(f"{path} is missing or larger than {most} bytes")
    return bytes(row.content)


def subfolders(spark: SparkSession, root: str, subdirs: list[str]) -> DataFrame:
    """(facade_id, subdir, name, path, length, content) of <root>/<facade_id>/<subdir>/*.png for several sub-folders; folders without one are skipped."""
    found = [f"{root}/*/{s}" for s in subdirs if _glob(spark, f"{root}/*/{s}")]
    if not found:
        raise ValueError(f"no PNG folder below {root}")
    return _named(_binary(spark, found, "*.png"))


def _glob(spark: SparkSession, pattern: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    hit = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return bool(hit) and len(hit) > 0


def split_files(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val", "test"), pattern: str = "*_gtFine_labelIds.png") -> DataFrame:
    """(split, ...) of all files of a pattern below the splits' folders, at any depth; splits without a folder are skipped."""
    out = None
    for split in splits:
        if exists(spark, f"{root}/{split}"):
            one = _named(_binary(spark, f"{root}/{split}", pattern, True)).withColumn("split", F.lit(split))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no split folder in {root}")
    return out


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    return next((c for c in candidates if exists(spark, c)), None)


def dataset_root(spark: SparkSession, root: str, name: str) -> str:
    """The folder itself, or the folder of the data set's name in it, whichever has a train folder."""
    if found := first_existing(spark, [f"{root}/train", f"{root}/{name}/train"]):
        return found.rpartition("/")[0]
    raise ValueError(f"no train folder in {root}")


def mask_folder(spark: SparkSession, root: str, split: str) -> str:
    """A split's folder of masks: mask before label."""
    if found := first_existing(spark, [f"{root}/{split}/{n}" for n in ("mask", "label")]):
        return found
    raise ValueError(f"no masks of {split} in {root}")


def scenes(spark: SparkSession, root: str, camera: str) -> DataFrame:
    """(scene, n_frames) of folders with label/cam_<camera>/*.png."""
    files = _binary(spark, f"{root}/*/label/cam_{camera}", "*.png").select(F.split("path", "/").alias("p"))
    return files.groupBy(F.get("p", F.size("p") - 4).alias("scene")).agg(F.count("*").alias("n_frames")).orderBy("scene")


def all_masks(spark: SparkSession, root: str) -> DataFrame:
    """PNG and TIFF files at any depth."""
    return _named(_binary(spark, root, _IMAGE, True))


def class_list(spark: SparkSession, path: str) -> list[tuple[int, int, int, str, int]]:
    """(r, g, b, name, class_id) of a JSON object from #RRGGBB to names; ids count in the order of the file. Bad or repeated colours are errors."""
    found: list[tuple[int, int, int, str, int]] = []
    seen: set[str] = set()

    def take(pairs: list[tuple[str, str]]) -> None:
        for colour, name in pairs:
            if not re.fullmatch(r"#[0-9a-fA-F]{6}", colour):
                raise ValueError(f"not a colour: {colour}")
            if colour.lower() in seen:
                raise ValueError(f"repeated colour: {colour}")
            seen.add(colour.lower())
            r, g, b = (int(colour[i : i + 2], 16) for i in (1, 3, 5))
            found.append((r, g, b, str(name), len(found)))

    json.loads(read_bytes(spark, path), object_pairs_hook=take)
    return found


def tile_meta(spark: SparkSession, path: str) -> DataFrame:
    """(stem, gh, gw, tile, stride) of a JSON array of objects."""
    return spark.createDataFrame([(str(x["stem"]), int(x["gh"]), int(x["gw"]), int(x["tile"]), int(x["stride"])) for x in json.loads(read_bytes(spark, path))], "stem string, gh long, gw long, tile long, stride long")


def manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("facade_id", "file_name", "cache_path")) -> DataFrame:
    """A cache's manifest; missing columns are an error."""
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return rows


def _bundles(fields: tuple[str, ...]):
    def bundles(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as held:
                    rows.append((path, *(held[f].astype(np.int64).reshape(-1).tolist() if f in held else None for f in fields)))
            yield pd.DataFrame(rows, columns=["path", *fields])

    return bundles


def row_bundles(spark: SparkSession, root: str) -> DataFrame:
    """(path, row_ptr, labels, lengths, above) of compressed-row caches (.npz); pickled ones aren't read."""
    fields = ("row_ptr", "labels", "lengths", "above")
    return _binary(spark, root, "*.npz", True).select("path", "content").mapInPandas(_bundles(fields), "path string, " + ", ".join(f"{f} array<long>" for f in fields))


def run_bits(spark: SparkSession, root: str) -> DataFrame:
    """(path, y, start, length, bits) of run-bits files (.npz)."""

    def rows(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as held:
                    yield pd.DataFrame({"path": path, **{c: held[c].astype(np.int64) for c in ("y", "start", "length")}, "bits": held["bits"].astype(np.float64)})

    return _binary(spark, root, "*.npz", True).select("path", "content").mapInPandas(rows, "path string, y long, start long, length long, bits double")


def heat_maps(spark: SparkSession, root: str) -> DataFrame:
    """(stem, gy, gx, heat) of .npy grids; a pair without a file has no rows."""

    def rows(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                grid = np.load(io.BytesIO(bytes(content)), allow_pickle=False).astype(np.float64)
                gy, gx = np.indices(grid.shape)
                yield pd.DataFrame({"stem": path.rsplit("/", 1)[-1][:-4], "gy": gy.reshape(-1), "gx": gx.reshape(-1), "heat": grid.reshape(-1)})

    return _binary(spark, root, "*.npy", True).select("path", "content").mapInPandas(rows, "stem string, gy long, gx long, heat double")


def token_streams(spark: SparkSession, root: str) -> DataFrame:
    """(name, n_bytes, data, total_pixels, total_tokens) of *.int32.bin files, with the totals of <name>.stats.json where there is one."""
    files = _binary(spark, root, "*.int32.bin").select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.int32\.bin$", "").alias("name"), F.col("length").alias("n_bytes"), F.col("content").alias("data"))
    stats = _binary(spark, root, "*.stats.json").select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.stats\.json$", "").alias("name"), F.from_json(F.decode("content", "UTF-8"), "total_pixels long, total_tokens long").alias("s"))
    return files.join(stats.select("name", "s.*"), "name", "left")


def checked_totals(streams: DataFrame) -> DataFrame:
    """Streams whose totals are known and positive; any other is an error."""
    good = (F.coalesce("total_pixels", F.lit(0)) > 0) & (F.coalesce("total_tokens", F.lit(0)) > 0)
    return streams.filter(F.when(good, True).otherwise(F.raise_error(F.lit("totals have to be positive")).cast("boolean")))

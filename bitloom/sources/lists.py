"""Split lists, pair tables and result tables from text and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered

PAIR_COLUMNS = ("pair_id", "sample_id", "prev_path", "cur_path", "t_prev", "t_cur", "split")


def split_list(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(id) of a list file: trimmed, without blank lines; with comments, lines from # on and repeats are dropped too."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"), F.monotonically_increasing_id().alias("n")).filter("id <> ''")
    if not comments:
        return lines.select("id")
    first = lines.filter(~F.col("id").startswith("#")).groupBy("id").agg(F.min("n").alias("n"))
    return first.orderBy("n").select("id")


def pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A pair table; all columns are strings, and a missing one is an error."""
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in PAIR_COLUMNS if c not in rows.columns]:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return rows.select(*(F.col(c).cast("string") for c in PAIR_COLUMNS))


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def result_csvs(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """All result rows below a folder, with ``run``: the name of the folder that holds their file."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.withColumn("run", F.get(parts, F.size(parts) - 2))


def random_split(ids: DataFrame, key: str, share: float, seed: int, least: int = 1, leave: int = 1) -> DataFrame:
    """(key, split): round-half-even(n * share) keys by hash order go to val, at least ``least``, leaving ``leave`` at least."""
    distinct = ids.select(key).distinct()
    n = distinct.count()
    val = max(min(round(n * share), n - leave), min(least, n - leave), 0)
    placed = numbered(distinct.withColumn("__hash", F.xxhash64(F.col(key), F.lit(seed))), "__hash", "__rank", (key,))
    return placed.select(key, F.when(F.col("__rank") <= val, "val").otherwise("train").alias("split"))

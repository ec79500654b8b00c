"""Report operators: weighted sizes, summaries, top lists, merges and parsed names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_bbp(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, id, filename, h, w, bytes_out): bits per pixel over all pixels, with distinct ids and images."""
    area = F.greatest(F.col("h") * F.col("w"), F.lit(1))
    return rows.groupBy(*by).agg((8 * F.sum("bytes_out") / F.greatest(F.sum(area), F.lit(1))).alias("bbp_weighted"), F.countDistinct("id").alias("n_ids"), F.countDistinct("id", "filename").alias("n_images"))


def merge_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join whose sides must not repeat a key; a repeated key is an error."""
    once = lambda df: df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).withColumn(key, F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("repeated key")).cast(df.schema[key].dataType))).drop("__n")
    return once(left).join(once(right), key)


def last_row(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in the order of a column: what a later entry overwrites."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")


def first_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def hybrid(pairs: DataFrame, classic: DataFrame, neural: DataFrame, area: Column, place: str) -> DataFrame:
    """Adds bits_c, bits_v, bbp_hybrid and bbp: two left joins on keys whose last row counts; without both parts the heat stays."""
    met = pairs.join(last_row(classic, ["pair_id"], place).select("pair_id", "bits_c"), "pair_id", "left").join(last_row(neural, ["pair_id"], place).select("pair_id", "bits_v"), "pair_id", "left")
    met = met.withColumn("bbp_hybrid", (F.col("bits_c") + F.col("bits_v")) / area)
    return met.withColumn("bbp", F.coalesce("bbp_hybrid", "bbp_heat"))


def level_pivot(rows: DataFrame, by: list[str], levels: list[int], value: str) -> DataFrame:
    """Mean of a value by level, one column for each."""
    return rows.groupBy(*by).pivot("level", levels).agg(F.avg(value)).select(*by, *(F.col(str(n)).alias(f"level_{n}") for n in levels))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median, 90th percentile, least and greatest; percentiles interpolate linearly."""
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("p50"), F.percentile(x, F.lit(0.9)).alias("p90"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; what a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def resolved(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Each wanted key with the best file of the same stem: least priority, then name."""
    best = first_row(files, [key], [F.col("priority"), F.col("path")])
    return wanted.join(best.select(key, "path"), key, "left").withColumn("status", F.when(F.col("path").isNull(), "missing_image").otherwise("ok"))


def to_markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a table")
    cells = [rows.columns, ["---"] * len(rows.columns), *([("" if x is None else str(x)) for x in r] for r in found)]
    return "\n".join("| " + " | ".join(r) + " |" for r in cells) + "\n"


def normalised(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A value stretched between its group's 5th and 95th percentile to 0..1; a flat group is 0."""
    x = F.col(value).cast("double")
    ends = rows.groupBy(*by).agg(F.percentile(x, F.lit(0.05)).alias("__lo"), F.percentile(x, F.lit(0.95)).alias("__hi"))
    met = rows.join(ends, by)
    flat = F.col("__hi") - F.col("__lo") <= 1e-12
    return met.withColumn("norm", F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))))).drop("__lo", "__hi")

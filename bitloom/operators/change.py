"""Change between two rasters: pairs, residuals, tile scores and exact ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running
from .runs import cells_to_tiles, tiles


def pairs(frames: DataFrame, delta: int = 1) -> DataFrame:
    """(pair_id, sample, prev, cur, t_prev, t_cur, split): each frame with the one ``delta`` places later in its sample and split.

    frames: (sample, split, stem, sort_key, t). Ids and times are strings."""
    order = Window.partitionBy("sample", "split").orderBy("sort_key", "stem")
    later = lambda c: F.lead(c, delta).over(order)
    met = frames.select("sample", "split", F.col("stem").alias("prev"), later("stem").alias("cur"), F.col("t").cast("string").alias("t_prev"), later("t").cast("string").alias("t_cur")).filter("cur is not null")
    return met.select(F.concat_ws("__", F.col("sample").cast("string"), "prev", "cur").alias("pair_id"), F.col("sample").cast("string").alias("sample"), "prev", "cur", "t_prev", "t_cur", "split")


def leaking(rows: DataFrame, key: str = "sample") -> DataFrame:
    """Keys that stand in train and in val: must be none."""
    return rows.filter("split = 'train'").select(key).intersect(rows.filter("split = 'val'").select(key))


def residual(prev: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, prev, cur, c, v): c marks changed pixels, v is their new label, else 0. A pixel without partner is an error."""
    met = prev.withColumnRenamed("label", "prev").join(cur.withColumnRenamed("label", "cur"), [*keys, "y", "x"], "full")
    whole = F.when(F.col("prev").isNull() | F.col("cur").isNull(), F.raise_error(F.lit("rasters differ in shape")).cast("int")).otherwise((F.col("prev") != F.col("cur")).cast("int"))
    return met.withColumn("c", whole).withColumn("v", F.when(F.col("c") == 1, F.col("cur")).otherwise(F.lit(0).cast("long")))


def reconstruct(residuals: DataFrame) -> DataFrame:
    return residuals.withColumn("rebuilt", F.when(F.col("c") == 1, F.col("v")).otherwise(F.col("prev")))


def iid_costs(residuals: DataFrame) -> DataFrame:
    """One row: bits of a changed and an unchanged pixel, and the bits of each new label, all with one count added."""
    n = residuals.agg(F.sum("c").alias("ones"), F.count("*").alias("n"))
    flags = n.select((-F.log2((F.col("ones") + 1) / (F.col("n") + 2))).alias("bit1"), (-F.log2((F.col("n") - F.col("ones") + 1) / (F.col("n") + 2))).alias("bit0"))
    seen = residuals.filter("c = 1").groupBy((F.col("v") % 256).alias("v")).agg(F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy())
    all_values = residuals.sparkSession.range(256).withColumnRenamed("id", "v").join(seen, "v", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    costs = all_values.withColumn("bits", -F.log2((F.col("k") + 1) / (total + 256)))  # 256 rows
    return flags.crossJoin(F.broadcast(costs.agg(F.map_from_entries(F.collect_list(F.struct("v", "bits"))).alias("bits_v"))))


def tile_scores(residuals: DataFrame, keys: list[str], tile: int, stride: int, h: int, w: Column) -> DataFrame:
    """(keys, gy, gx, n_pixels, changed_frac, iid_bits) on the floor grid.

    Where tiles are whole numbers of strides, pixels are summed into cells of a stride first, and cells into the tiles that cover them."""
    costed = residuals.withColumn("__w", w).crossJoin(F.broadcast(iid_costs(residuals)))
    cost = F.when(F.col("c") == 1, F.col("bit1") + F.element_at("bits_v", F.least("v", F.lit(255).cast("long")))).otherwise(F.col("bit0"))
    sums = (F.count("*").alias("n"), F.sum("c").alias("ones"), F.sum(cost).alias("cost"))
    if tile % stride:
        made = tiles(costed, tile, stride, F.lit(h), F.col("__w")).groupBy(*keys, "gy", "gx").agg(*sums)
    else:
        cell = lambda c: F.floor(F.col(c) / stride).cast("long")
        cells = costed.groupBy(*keys, cell("y").alias("cy"), cell("x").alias("cx")).agg(*sums, F.max("__w").alias("__w"))
        made = cells_to_tiles(cells, tile, stride, F.lit(h), F.col("__w")).groupBy(*keys, "gy", "gx").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum("cost").alias("cost"))
    return made.select(*keys, "gy", "gx", F.col("n").alias("n_pixels"), (F.col("ones") / F.col("n").cast("double")).alias("changed_frac"), F.col("cost").alias("iid_bits"))


def pair_scores(tile_rows: DataFrame, keys: list[str], area: Column, score: str) -> DataFrame:
    """(keys, bbp_heat, heat_min, heat_p50, heat_p90, heat_max); overlapping tiles count their pixels again."""
    heat = F.col(score).cast("double")
    return tile_rows.groupBy(*keys).agg((F.sum(heat) / F.first(area)).alias("bbp_heat"), F.min(heat).alias("heat_min"), F.percentile(heat, F.lit(0.5)).alias("heat_p50"), F.percentile(heat, F.lit(0.9)).alias("heat_p90"), F.max(heat).alias("heat_max"))


def _score_counts(rows: DataFrame) -> DataFrame:
    """(score, pos, neg) of distinct scores, with sums over all higher ones; by ranges of scores, as continuous scores are as many as rows."""
    by = rows.groupBy("score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    return running(by, "score", {"tp": "pos", "fp": "neg"}, descending=True)


def roc_auc(rows: DataFrame) -> DataFrame:
    """(auc, n): rows are (score, label 0/1). Ties count half; null where a class is missing."""
    c = _score_counts(rows)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return c.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(ap): sum over distinct scores of the step in recall times the precision there; null without positives."""
    c = _score_counts(rows)
    return c.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"))


def hit_and_recall(rows: DataFrame, k: int) -> DataFrame:
    """(hit_at_k, recall_at_k, n_pairs): rows are (pair, tile, score, label); ties go to the higher tile."""
    order = Window.partitionBy("pair").orderBy(F.desc("score"), F.desc("tile"))
    ranked = rows.withColumn("r", F.row_number().over(order))
    by = ranked.groupBy("pair").agg(F.sum(F.when(F.col("r") <= k, F.col("label")).otherwise(0)).alias("hits"), F.sum("label").alias("positives"))
    return by.agg(F.avg((F.col("hits") > 0).cast("double")).alias("hit_at_k"), (F.sum("hits") / F.greatest(F.sum("positives"), F.lit(1))).alias("recall_at_k"), F.count("*").alias("n_pairs"))

"""Manifests, splits and choices among files: filters, caps, gates, statuses, samples, and tables that describe a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that exclude a path, and the extensions of images.
EXCLUDED = ("mask", "label", "overlay", "_diff")
EXTENSIONS = ("png", "jpg", "jpeg")


def kept_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def first_files(rows: DataFrame, path: str, most: int) -> DataFrame:
    """The first files by path; what filters ids comes before, what reads files after."""
    return rows.orderBy(path).limit(most)


def every_nth(rows: DataFrame, scene: list[str], order: list[str], step: int, most: int) -> DataFrame:
    """Every ``step``-th row of each scene, beginning with the first, at most so many of them."""
    place = F.row_number().over(Window.partitionBy(*scene).orderBy(*order)) - 1
    return rows.withColumn("__n", place).filter((F.col("__n") % step == 0) & (F.col("__n") < step * most)).drop("__n")


def is_candidate(path: Column) -> Column:
    """Whether a path is an image that may stand behind a mask: its extension counts, derived images and augmented ones don't."""
    low, name = F.lower(path), F.lower(F.substring_index(path, "/", -1))
    fits = F.substring_index(name, ".", -1).isin(*EXTENSIONS)
    for token in EXCLUDED:
        fits = fits & ~low.contains(token)
    return fits & ~name.startswith("aug_")


def pending(rows: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Rows that have no result yet; with overwrite all."""
    return rows if overwrite else rows.join(done.select(key).distinct(), key, "left_anti")


def status(found: Column, error: Column) -> Column:
    """Where an item of a run stands: skipped without image, failed with an error, processed otherwise."""
    return F.when(~found, "skipped_missing_image").when(error.isNotNull(), "failed").otherwise("processed")


def without_overlap(train: DataFrame, val: DataFrame, key: str) -> DataFrame:
    """Training rows whose key isn't in val."""
    return train.join(val.select(key).distinct(), key, "left_anti")


def checked_split(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a split table; a key in train and in val is an error."""
    both = F.countDistinct("split")
    bad = rows.groupBy(key).agg(both.alias("n")).filter("n > 1").agg(F.count("*").alias("__bad"))
    checked = rows.crossJoin(F.broadcast(bad))  # one row
    return checked.filter(F.when(F.col("__bad") == 0, True).otherwise(F.raise_error(F.lit("a key is in train and in val")).cast("boolean"))).drop("__bad")


def val_size(n: Column, share: float, variant: str) -> Column:
    """How many of n ids go to val: round-half-even(n * share), by the variant's limits.

    library: 1 at least, n - 1 at most; ngram: 1 at least, none of a single id; varorder: none of up to one id, else 1 at least; frames: as many as the share
    gives, 0 for share 0, else 1 at least, n at most."""
    rounded = F.bround(n * F.lit(float(share))).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return {
        "library": F.when(n <= 1, zero).otherwise(F.least(F.greatest(rounded, one), n - 1)),
        "ngram": F.when(n <= 1, zero).otherwise(F.greatest(rounded, one)),
        "varorder": F.when(n <= 1, zero).otherwise(F.greatest(rounded, one)),
        "frames": F.least(zero if share == 0 else F.greatest(rounded, one), n),
    }[variant]


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows by the order of a hash of seed and key."""
    return rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def with_first_row(rows: DataFrame, metrics: DataFrame, order: str) -> DataFrame:
    """Every row with the first metrics row's columns that it lacks."""
    added = [c for c in metrics.columns if c not in rows.columns]
    return rows.crossJoin(F.broadcast(metrics.orderBy(order).limit(1).select(*added)))  # one row


def heat_grid(tile_rows: DataFrame, meta: DataFrame, keys: list[str], place: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """(keys, gy, gx, heat) of whole grids: a tile that is missing is 0, of repeated ones the last counts, those outside the grid are dropped.

    Of several at the last place the first by ``ties`` counts. meta: (keys, gh, gw). Tiles of a key without meta are an error."""
    last = Window.partitionBy(*keys, "gy", "gx").orderBy(F.desc(place), *ties)
    once = tile_rows.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")
    stray = once.join(meta, keys, "left_anti").agg(F.count("*").alias("__stray"))
    known = once.join(meta, keys).select(*keys, "gy", "gx", "gh", "gw", F.col("heat").alias("__heat"))
    inside = known.filter((F.col("gy") < F.col("gh")) & (F.col("gx") < F.col("gw"))).drop("gh", "gw")
    cells = meta.filter("gh > 0 and gw > 0").select(*keys, "gw", F.explode(F.expr("sequence(0L, cast(gh as long) - 1)")).alias("gy")).select(*keys, "gy", F.explode(F.expr("sequence(0L, cast(gw as long) - 1)")).alias("gx"))
    checked = F.when(F.col("__stray") == 0, F.coalesce("__heat", F.lit(0.0))).otherwise(F.raise_error(F.lit("no meta of a tile")).cast("double"))
    return cells.join(inside, [*keys, "gy", "gx"], "left").crossJoin(F.broadcast(stray)).select(*keys, "gy", "gx", checked.alias("heat"))  # one row


def settings_grid(rows: DataFrame, streams: list[str], codecs: list[str], levels: list[int]) -> DataFrame:
    """Each row with each stream, codec and level."""
    some = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    return rows.select("*", some(streams).alias("stream")).select("*", some(codecs).alias("codec")).select("*", some(levels).alias("level"))


def background_stem(stem: Column) -> Column:
    """The stems that a mask's image may have, best first: those of its overlay and difference, then its own."""
    return F.array(F.regexp_replace(stem, "_warped$", "_overlay"), F.regexp_replace(stem, "_warped$", "_diff"), stem)


def coder_overheads(rows: DataFrame) -> DataFrame:
    """Adds bits_payload, bits_file, overhead_pct (of the payload over the ideal) and header_pct; rows: (payload_bytes, header_bytes, ideal_bits)."""
    ideal = F.greatest(F.col("ideal_bits"), F.lit(1e-12))
    return rows.withColumns({
        "bits_payload": 8 * F.col("payload_bytes"), "bits_file": 8 * (F.col("payload_bytes") + F.col("header_bytes")),
        "overhead_pct": 100 * (8 * F.col("payload_bytes") / ideal - 1), "header_pct": 100 * F.col("header_bytes") / F.greatest(F.col("payload_bytes") + F.col("header_bytes"), F.lit(1)),
    })


def against_best(lm: DataFrame, classic: DataFrame) -> DataFrame:
    """Language-model results with the least classic bbp, their ratio and the difference in per cent; lm: (name, bbp), classic: (codec, level, bbp)."""
    best = classic.orderBy("bbp", "codec", "level").limit(1).select(F.col("codec").alias("best_codec"), F.col("level").alias("best_level"), F.col("bbp").alias("best_bbp"))
    met = lm.crossJoin(F.broadcast(best))  # one row
    under = F.greatest(F.col("best_bbp"), F.lit(1e-12))
    return met.withColumns({"ratio": F.col("bbp") / under, "delta_pct": 100 * (F.col("bbp") - F.col("best_bbp")) / under})

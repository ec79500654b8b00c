"""Change detection over a stream of mask pairs: stateless rows go through as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Columns of a pair row: labels in row-major order.
PAIR_SCHEMA = "pair_id string, w int, prev array<long>, cur array<long>"


def changed_share(pairs: DataFrame, tile: int) -> DataFrame:
    """(pair_id, gy, gx, n_pixels, changed_frac) of each tile of the ceil grid, for a batch or a stream of pair rows."""
    cells = F.filter(F.transform(F.arrays_zip("prev", "cur"), lambda p, i: F.struct(F.expr("0").alias("z"), F.floor(F.floor(i / F.col("w")) / tile).alias("gy"), F.floor((i % F.col("w")) / tile).alias("gx"), (p["prev"] != p["cur"]).cast("int").alias("c"))), lambda s: s["c"].isNotNull())
    return pairs.select("pair_id", F.explode(cells).alias("s")).groupBy("pair_id", "s.gy", "s.gx").agg(F.count("*").alias("n_pixels"), F.avg(F.col("s.c").cast("double")).alias("changed_frac"))


def run(pairs: DataFrame, tile: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch by itself, so that no state is kept: a pair arrives whole in one row."""
    return pairs.writeStream.foreachBatch(lambda batch, n: sink(changed_share(batch, tile), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Cutting the lineage of a table that several passes read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder (spark.checkpoint.dir), so that they are computed once and outlive lost executors.

    Where the folder isn't set, a temporary one of this machine, if Spark runs on it alone; else an error."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="bitloom-"))
    return rows.checkpoint()

"""Label rasters read from plain tables: pixels (image, y, x, label), and the keys that splits and pairs need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import carried


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 16 rows, one for each vector; a pixel's label is a component's bucket at -0.1, 0 and 0.1."""
    low, high = F.lit(-0.1).cast("float"), F.lit(0.1).cast("float")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    label = F.when(F.col("v") < low, 0).when(F.col("v") < F.lit(0.0).cast("float"), 1).when(F.col("v") < high, 2).otherwise(3)
    image = F.expr("vec_id div 16")
    return rows.select(image.alias("image"), (F.col("vec_id") % 16).alias("y"), F.col("x").cast("long").alias("x"), label.cast("long").alias("label"))


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user: event types in the order of time, numbered by name."""
    events = read(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    number = kinds.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("label"))  # a handful of names
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.withColumn("x", place.cast("long")).join(F.broadcast(number), "event_type").select(F.col("user_id").alias("image"), F.lit(0).cast("long").alias("y"), "x", "label")


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames (return flags) of each sample of ten suppliers: shipments by supplier and week, at most 3, zeros filled in."""
    items = read(spark, sf_dir, "lineitem")
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    span = items.agg(F.min(days).alias("first"), F.expr("(max(datediff(to_date(l_shipdate), date'1970-01-01')) - min(datediff(to_date(l_shipdate), date'1970-01-01'))) div 7").alias("weeks"))
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    cells = items.crossJoin(F.broadcast(span)).groupBy(F.expr("l_suppkey div 10").alias("sample"), flag.alias("t"), (F.col("l_suppkey") % 10).alias("y"), F.floor((days - F.col("first")) / 7).cast("long").alias("x")).agg(F.least(F.count("*"), F.lit(3)).cast("long").alias("label"))
    grid = items.select(F.expr("l_suppkey div 10").alias("sample")).distinct().crossJoin(F.broadcast(span)).select("sample", F.explode(F.expr("sequence(0L, 2L)")).alias("t"), "weeks")
    grid = grid.select("sample", "t", F.explode(F.expr("sequence(0L, 9L)")).alias("y"), "weeks").select("sample", "t", "y", F.explode(F.expr("sequence(0L, cast(weeks as long))")).alias("x"))
    return grid.join(cells, ["sample", "t", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0).cast("long")))


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, codes, counts = [], [], []
        for doc, text, a1, a2 in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            b = np.frombuffer(bytes([a2 or 0, a1 or 0]) + text, np.uint8).astype(np.int64)
            found, n = np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:], return_counts=True)
            ids.append(np.full(len(found), doc))
            codes.append(found)
            counts.append(n)
        code = np.concatenate([np.zeros(0, np.int64), *codes])
        columns = [np.concatenate([np.zeros(0, np.int64), *ids]), code >> 16, code >> 8 & 255, code & 255, np.concatenate([np.zeros(0, np.int64), *counts])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc_id", "b2", "b1", "b", "c"])


def byte_contexts(documents: DataFrame) -> DataFrame:
    """(doc_id, b2, b1, b, c): counts of each text's bytes by the two before; the first look back at the texts before, by doc_id.

    Counts leave the worker, not bytes; only each text's last two bytes, one narrow row, are put in order."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("e")).filter("octet_length(e) > 0")
    code = lambda c: F.conv(F.hex(c), 16, 10).cast("int")
    size = F.octet_length("e")
    ends = texts.select("doc_id", code(F.substring("e", -1, 1)).alias("e1"), F.when(size > 1, code(F.substring("e", F.greatest(size - 1, F.lit(1)), F.lit(1)))).alias("e2"))
    ends = carried(ends, "doc_id", {"a1": ("e1", 1), "b2": ("e2", 1), "b1": ("e1", 2)}).select("doc_id", "a1", F.coalesce("b2", "b1").alias("a2"))
    return texts.join(ends, "doc_id").select("doc_id", "e", "a1", "a2").mapInArrow(_count_contexts, "doc_id long, b2 long, b1 long, b long, c long")

"""What the corpus operators share: session settings, the shared work folder, and typed access to Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker; it bounds a worker's memory whatever the length of the rows.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches by bytes, drops a query's shuffle files when it ends, and lets Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    root = str(Path(__file__).resolve().parents[2])
    known = os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment.setdefault("PYTHONPATH", os.pathsep.join(x for x in (root, known) if x))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it isn't set, a temporary one of this machine, if Spark runs on it alone; else an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="bitloom-"))
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Intermediate tables under the shared folder; writing one cuts the lineage.

    close() drops every table but those named in ``keep``, which a lazy result still reads; they go when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.names.append(name)
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        if name in self.names:
            self.names.remove(name)
            delete(self.spark, f"{self.root}/{name}")

    def close(self, keep: tuple[str, ...] = ()) -> None:
        for name in [x for x in self.names if x not in keep]:
            self.drop(name)

    def _end(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session may have ended before
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def binary_of(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())

"""Token counts by a digest cache.

A text's key is the SHA-256 of its normalised content beside the SHA-256 of the tokenizer file, so counts of another
version never answer. Normalised content is what the tokenizer itself sees first: null becomes empty, and UTF-8 bytes are
taken as they are, because a byte-level tokenizer has no normaliser and any change could change its count.
``count`` joins the keys to the stored counts, encodes each missing text once, appends the new counts to the cache, a Parquet folder parted by
tokenizer version, and joins all documents to it. The cache is append-only: a job that fails before its append is
committed leaves it as it was, and concurrent jobs add rows that agree, of which one is read.

Copies are dropped before the shuffle (partial aggregation by digest), so a text that a third of all rows share travels
once for each task. Defined results: null counts as empty; repeated rows get the same count; null doc_ids are counted as others; other columns
don't matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, prepare, text_or_empty
from .wordcache import opened

_SHAPE = "version string, digest string, n_tokens long"


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            number = lambda text: len(pieces.encode(text.decode()))
        else:
            number = opened(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([number(x) for x in as_bytes(batch.column(1))], pa.int64())], ["digest", "n_tokens"])

    return counter


def stored(documents: DataFrame, cache: str, tokenizer_version: str) -> DataFrame:
    try:
        known = documents.sparkSession.read.schema(_SHAPE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = documents.sparkSession.createDataFrame([], _SHAPE)
    return known.filter(F.col("version") == tokenizer_version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def count(documents: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document; new texts are added to the cache, a Parquet folder."""
    prepare(documents.sparkSession)
    named = version(tokenizer)
    text = text_or_empty()
    digest = F.sha2(text.cast("binary"), 256).alias("digest")
    distinct = documents.select(digest, text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored(documents, cache, named).select("digest"), "digest", "left_anti")
    misses.select("digest", "text").mapInArrow(_counter(tokenizer), "digest string, n_tokens long").select(F.lit(named).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache)
    asked = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest)
    return asked.join(stored(documents, cache, named), "digest").select("doc_id", "n_bytes", "n_tokens")


def counted(documents: DataFrame, tokenizer: str, name: str) -> DataFrame:
    """All columns and the tokens of each row's text, counted in place without the cache: for stages that carry texts along anyway."""
    prepare(documents.sparkSession)
    kept = [c for c in documents.columns if c != name]
    rows = documents.select(text_or_empty().alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    schema = rows.drop("text").withColumn("n", F.lit(0).cast("long")).schema

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = opened(tokenizer).count
        for batch in batches:
            made = pa.array([number(x) for x in as_bytes(batch.column(0))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*(f"c{i}" for i in range(len(kept))), "n"])

    return rows.mapInArrow(count_rows, schema).toDF(*kept, name)

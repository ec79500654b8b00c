"""A training corpus from documents: toxicity, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before wrote, and judges all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import minhash, mixing, packing, secret_scan, tokencount, toxicity
from bitloom.llm.common import Workspace, prepare, table
from bitloom.llm.queries import TREE, tokenizer, weight_columns, with_tree

TOXIC_FROM = 0.3
#: The mixture's budget, as a share of the tokens that reach it.
MIXED = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below TOXIC_FROM; it learns from all labels of the corpus.

    Null and empty texts have the score of a text without n-grams; rows that repeat are judged alike; an empty table stays empty."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model, "__toxic").filter(F.col("__toxic") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group, by shingles of five words; documents without doc_id or without words stay.

    Rows that share a doc_id stay or go together: they go if a row of the id is in a group with a smaller id."""
    dropped = minhash.cluster(docs).filter("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [KIND] in place of secrets and n_chars of the new text; null texts stay null, with n_chars null."""
    clean = secret_scan.scan(docs, redact=True)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets take, once at most; the shares of sources in tokens, as packing cuts them, move towards their weights.

    Null names are a source or language of their own; a null or empty text is its end id; rows that share a doc_id in a leaf go together."""
    work = Workspace(prepare(spark), "mixing-counts")
    counted = work.save(tokencount.counted(docs, tokenizer("word_bpe_49k.json"), "__tokens"), "counted").withColumn("__tokens", F.col("__tokens") + 1)
    names = {c: F.col(f"__{c}") for c in ("lang", "source")}
    kept = counted.withColumns({f"__{c}": F.col(c) for c in names})
    taken = mixing.mix(with_tree(kept), TREE, weight_columns(), F.col("total") * MIXED, seed=7, epochs=1, tokens="__tokens")
    return taken.select(*(names[c].alias(c) if c in names else F.col(c) for c in docs.columns))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids (little-endian unsigned 32-bit numbers) and places in windows of 2048 tokens; a null text is its end id."""
    cut = packing.pieces(docs, tokenizer("word_bpe_49k.json"))
    placed = packing.pack_with_ids(cut, Workspace(prepare(spark), "packing"))
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't run a classifier, MinHash or a tokenizer; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: the packed corpus, in doc_id, start and ids of each piece, sequence_id and offset."""
    work = Workspace(prepare(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    work.close(keep=(STAGES[-1][0],))
    return docs

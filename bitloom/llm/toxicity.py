"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its character n-grams (lower case, hashed to 2**bits buckets); a bucket's value is log(1 + rate), the rate being
its occurrences in 1,000 n-grams of the text, so long texts don't have more of everything. The ratio of a bucket is
log((p + a) / (toxic texts + 2a)) - log((q + a) / (other texts + 2a)), where p and q sum its values over the toxic and the other training texts;
a logistic regression with an l2 penalty is fitted on the ratio-scaled values. The fit happens once on the driver, on at
most ``max_toxic + max_other`` labelled doc_ids (those with the smallest hash, so the choice doesn't depend on order), of whose distinct
texts it takes as many, up to ``max_bytes``; a text that would go beyond that is left out of the fit and the next one tried. Its intercept is
corrected by the share of toxic rows among all training labels. Scoring is a map over all
documents without a shuffle; what is broadcast is one weight for each bucket, whatever the size of the input.

Defined results: a null text counts as empty; an empty text has the intercept's score; without labels of both classes
all scores are the share of toxic labels (0 without labels); several labels of one doc_id count as toxic if one is;
several texts of one doc_id all have its label, repeated rows count once in the fit; a null doc_id has no label; every row is scored, repeated ones each;
other columns pass through ``classify`` untouched, whatever their names, but one of the score's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, prepare, text_or_empty

_CHUNK = 1 << 18
#: Texts whose features the fit widens at once.
_FIT_ROWS = 250
_RATE = 1000.0


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    max_toxic: int = 2500
    max_other: int = 5000
    max_bytes: int = 64 << 20
    smoothing: float = 0.5
    least_ratio: float = 1.5
    least_texts: int = 10
    l2: float = 0.3
    steps: int = 60


def grams(text: str, settings: Settings) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, with repeats, in parts of bounded size."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), _CHUNK):
        # a part ends where the next begins; the n-grams that begin in it read on
        own, piece = min(_CHUNK, len(points) - at), points[at : at + _CHUNK + max(settings.orders) - 1]
        rolled, used = np.zeros(len(piece), np.uint32), 0
        for n in sorted(settings.orders):
            if len(piece) < n:
                break
            while used < n:  # extends the hash of each position by one more character
                width = len(piece) - used
                rolled = rolled[:width] * np.uint32(0x01000193) + piece[used:] * np.uint32(0x9E3779B1)
                used += 1
            begins = rolled[:own]
            mixed = (begins ^ (begins >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            yield (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - settings.bits)


def values(text: str, settings: Settings, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their values; ``wanted`` limits them to some buckets."""
    total, names, counts = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for part in grams(text, settings):
        total += len(part)
        part, times = np.unique(part if wanted is None else part[wanted[part]], return_counts=True)
        if len(names):
            part, place = np.unique(np.concatenate([names, part]), return_inverse=True)
            times = np.bincount(place, np.concatenate([counts, times])).astype(np.int64)
        names, counts = part, times
    return names, np.log1p(counts * (_RATE / max(total, 1))).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    settings: Settings


def training_rows(documents: DataFrame, labels: DataFrame, usable: Column | None, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(doc_id, toxic) of all training labels, and (doc_id, h, toxic, text) of the distinct texts of a bounded sample of doc_ids."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    known = known if usable is None else known.filter(usable)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sides = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((1, settings.max_toxic), (0, settings.max_other))]
    sample = sides[0].unionByName(sides[1])
    # the sample has at most max_toxic + max_other rows of two numbers, so it may be broadcast
    met = documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    return known, met.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))


def sampled(found: DataFrame, settings: Settings) -> list:
    """The rows (doc_id, h, toxic, text) that the fit reads, of a written table: as many as ``settings`` allows, in rows and in bytes."""
    order = (F.xxhash64("doc_id"), "doc_id", "h")
    sizes = found.select("doc_id", "h", "toxic", F.octet_length("text").alias("n"))
    rows = [r for y, most in ((1, settings.max_toxic), (0, settings.max_other)) for r in sizes.filter(F.col("toxic") == y).orderBy(*order).limit(most).collect()]
    spent, taken = {0: 0, 1: 0}, []
    for r in rows:
        if spent[r.toxic] + r.n <= settings.max_bytes // 2:
            spent[r.toxic] += r.n
            taken.append((r.doc_id, r.h))
    if not taken:
        return []
    picked = found.sparkSession.createDataFrame(taken, found.select("doc_id", "h").schema)
    return sorted(found.join(F.broadcast(picked), ["doc_id", "h"]).collect(), key=lambda r: (r.doc_id, r.h))


def fit(documents: DataFrame, labels: DataFrame, usable: Column | None = None, settings: Settings = Settings()) -> Model:
    work = Workspace(prepare(documents.sparkSession), "toxicity")
    known, found = training_rows(documents, labels, usable, settings)
    rows = sampled(work.save(found, "sample"), settings)
    work.close()
    share = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return train([r.text for r in rows], np.array([r.toxic for r in rows]), share.get(1, 0), share.get(0, 0), settings)


def train(texts: list[str], y: np.ndarray, toxic: int, other: int, settings: Settings) -> Model:
    """toxic, other: how many training labels of either class there are beyond the sample too."""
    size = 1 << settings.bits
    if len(set(y.tolist())) < 2:
        rate = toxic / max(1, toxic + other)
        edge = float(np.clip(np.log((rate + 1e-9) / (1 - rate + 1e-9)), -40, 40))
        return Model(np.zeros(size, np.float32), edge, settings)
    sums, seen = np.zeros((2, size)), np.zeros(size, np.int32)
    for text, k in zip(texts, y, strict=True):
        names, value = values(text, settings)
        sums[k, names] += value
        seen[names] += 1
    a, n_toxic = settings.smoothing, int(y.sum())
    ratio = np.log((sums[1] + a) / (n_toxic + 2 * a)) - np.log((sums[0] + a) / (len(y) - n_toxic + 2 * a))
    ratio[(np.abs(ratio) < settings.least_ratio) | (seen < settings.least_texts)] = 0
    wanted = np.flatnonzero(ratio)
    place = np.zeros(size, np.int32)
    place[wanted] = np.arange(len(wanted), dtype=np.int32)
    # the n-grams are taken a second time, so that only those in use are held
    used, parts = ratio != 0, []
    for at in range(0, len(texts), _FIT_ROWS):
        found = [values(t, settings, used) for t in texts[at : at + _FIT_ROWS]]
        upto = np.cumsum([0, *(len(names) for names, _ in found)])
        names = np.concatenate([x for x, _ in found])
        parts.append((upto, place[names], np.concatenate([x for _, x in found]) * ratio[names].astype(np.float32)))
    del sums, seen, place
    weight, bias = np.zeros(len(wanted)), float(np.log(n_toxic / (len(y) - n_toxic)))
    moment = [np.zeros(len(wanted)), np.zeros(len(wanted)), 0.0, 0.0]
    for step in range(1, settings.steps + 1):
        error, slope = np.zeros(len(y)), np.zeros(len(wanted))
        for i, (upto, column, value) in enumerate(parts):
            own = slice(i * _FIT_ROWS, i * _FIT_ROWS + len(upto) - 1)
            running = np.concatenate([[0.0], np.cumsum(weight[column] * value)])
            z = running[upto[1:]] - running[upto[:-1]] + bias
            error[own] = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / len(y)
            slope += np.bincount(column, np.repeat(error[own], np.diff(upto)) * value, minlength=len(wanted))
        slope += settings.l2 * weight / max(1, len(wanted)) ** 0.5
        rate = 0.02 * min(1.0, 3 * (1 - step / (settings.steps + 1)))
        moment[0], moment[1] = 0.9 * moment[0] + 0.1 * slope, 0.99 * moment[1] + 0.01 * slope**2
        moment[2], moment[3] = 0.9 * moment[2] + 0.1 * error.sum(), 0.99 * moment[3] + 0.01 * error.sum() ** 2
        fix = (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        weight -= rate * fix * moment[0] / (moment[1] ** 0.5 + 1e-9)
        bias -= 5 * rate * fix * moment[2] / (moment[3] ** 0.5 + 1e-9)
    full = np.zeros(size, np.float32)
    full[wanted] = weight * ratio[wanted]
    shift = np.log(max(toxic, 1) / max(other, 1)) - np.log(n_toxic / (len(y) - n_toxic))
    return Model(full, bias + float(shift), settings)


def scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted = model.weights != 0
        for batch in batches:
            z = []
            for text in batch.column(0).to_pylist():
                names, value = values(text or "", model.settings, wanted)
                z.append(float((model.weights[names] * value).sum(dtype=np.float64)) + model.intercept)
            out = pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -40, 40))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], out], [*(f"c{i}" for i in range(batch.num_columns - 1)), "score"])

    return score


def classify(documents: DataFrame, model: Model, score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default: all) and the score of every document; a column of the score's name is replaced."""
    spark = prepare(documents.sparkSession)
    kept = [c for c in (documents.columns if keep is None else keep) if c != score]
    # by place, so that no name can clash with one of ours
    rows = documents.select("text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    schema = rows.drop("text").withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(scorer(spark.sparkContext.broadcast(model)), schema).toDF(*kept, score)

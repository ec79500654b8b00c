"""Exact top-k inner-product search by block-at-a-time pruning.

Candidates are cut into blocks of consecutive ids. A block holds its forward index (the vectors) and, for each signed
term (a dimension and the sign of the query's weight there), the largest value any of its members has. For a query the
weighted sum of a block's maxima bounds every member's score. A query visits the blocks in descending order of that
bound, scores a block through its forward index, and stops at the first block whose bound lies below its k-th score.

Runs of blocks are gathered into segments and queries into chunks, both bounded in rows and in bytes. First each chunk meets the
segments at its own place in id order; the k-th scores found there go with the queries. Then the maxima of whole segments, gathered into packs,
bound every query's scores in every segment, and a chunk is sent only to segments in which some query's bound reaches its k-th score, with those
queries only. The k best of each meeting are merged by rank. No task or driver holds more than one segment (or pack) and one chunk at a time.

Bounds are taken in floating point and raised by more than their rounding error; scores are exact, whatever the size of the numbers.

Defined results: vectors that are null or hold a null or non-finite component take no part; a shorter vector counts as
having zeros; a component whose scaled value is beyond the largest double counts as that; scores beyond 64 bits are ranked
exactly and returned as the nearest 64-bit number; every row is a candidate, repeated ids and repeated vectors too, but no row is its own or a
query's of the same id; of queries that share an id the k best of all are returned; ties go to the smaller id; fewer than k candidates
give fewer rows; null ids take no part; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, prepare

_TYPES = (np.int16, np.int32, np.int64)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: What one segment or chunk holds at most, as padded 64-bit numbers, beside one vector.
BYTES = 16 << 20
#: Segments whose maxima one pack holds at most.
PACK = 1024
_SHAPE = "n int, dims int, kind string, ids binary, data binary, upper binary, lower binary"


def quantised(vectors: DataFrame, key: str, value: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of every component as doubles, of the rows that take part."""
    usable = F.col(value).isNotNull() & F.col(key).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    edge = float(np.finfo(np.float64).max)
    scaled = lambda x: F.greatest(F.lit(-edge), F.least(F.lit(edge), F.lit(scale) * x.cast("double")))
    # doubles from 2**53 on are whole numbers already
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    return vectors.filter(usable).select(F.col(key).cast("long").alias("id"), F.transform(F.transform(value, scaled), whole).alias("v"))


def _row(ids: list[int], vectors: list[np.ndarray]) -> dict:
    wide = max((len(v) for v in vectors), default=0)
    data = np.zeros((len(vectors), wide))
    for i, v in enumerate(vectors):
        data[i, : len(v)] = v
    top = np.abs(data).max(initial=0)
    kind = next((t for t in _TYPES if top < np.iinfo(t).max), np.float64)
    return {
        "n": len(ids), "dims": wide, "kind": np.dtype(kind).str, "ids": np.array(ids, np.int64).tobytes(), "data": data.astype(kind).tobytes(),
        "upper": data.max(axis=0, initial=-np.inf).tobytes(), "lower": (-data).max(axis=0, initial=-np.inf).tobytes(),
    }


_ARROW = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("ids", "data", "upper", "lower"))])


def packer(size: int):
    """From rows sorted by id to runs of at most ``size`` vectors and about BYTES, with their maxima by dimension and sign."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        wide = 0
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for at, i in enumerate(batch.column(0).to_pylist()):
                v = flat[ends[at] : ends[at + 1]].copy()
                if ids and (len(ids) == size or 8 * (len(ids) + 1) * max(wide, len(v)) > BYTES):
                    yield pa.RecordBatch.from_pylist([_row(ids, vectors)], _ARROW)
                    ids, vectors, wide = [], [], 0
                ids.append(i)
                vectors.append(v)
                wide = max(wide, len(v))
        if ids:
            yield pa.RecordBatch.from_pylist([_row(ids, vectors)], _ARROW)

    return pack


def unpack(row: dict, mark: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a run, the vectors in the least type that holds them."""
    data = np.frombuffer(row[f"{mark}data"], row[f"{mark}kind"]).reshape(row[f"{mark}n"], row[f"{mark}dims"])
    return np.frombuffer(row[f"{mark}ids"], np.int64), data


def bounds(queries: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """(queries, blocks): at least the largest inner product that a member of a block has with a query; both are doubles.

    Where the exact bound may not be told, it is infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        plus, minus = np.maximum(queries, 0), np.maximum(-queries, 0)
        found = plus @ upper.T + minus @ lower.T
        size = plus @ np.abs(upper).T + minus @ np.abs(lower).T
        found = found + size * ((queries.shape[1] + 2) * 2.0**-51)
    return np.where(np.isnan(found), np.inf, found)


def _double(x) -> float:
    """A score as a double no larger than it."""
    try:
        return float(np.nextafter(float(x), -np.inf))
    except OverflowError:
        return float(np.finfo(np.float64).max) if x > 0 else -np.inf


def _exact(queries: np.ndarray, data: np.ndarray) -> type:
    """The number type in which all inner products and their sums are exact."""
    top = max(1, int(np.abs(queries.astype(np.float64)).max(initial=0))) * max(1, int(np.abs(data.astype(np.float64)).max(initial=0))) * max(1, data.shape[1])
    return np.float64 if top < 1 << 52 else np.int64 if top < 1 << 62 else object


def _as(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is object and values.dtype.kind == "f":
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return values.astype(kind)


def visit(queries: np.ndarray, own: np.ndarray, least: np.ndarray, ids: np.ndarray, data: np.ndarray, size: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query its k best of a segment: (query, ids, scores, blocks scored). ``least``: doubles not above a score that k others reach."""
    wide = min(queries.shape[1], data.shape[1])  # beyond it one of both has zeros
    queries, data = queries[:, :wide], data[:, :wide]
    kind, plain = _exact(queries, data), data.astype(np.float64)
    cuts = np.arange(0, len(ids), size)
    upper, lower = np.maximum.reduceat(plain, cuts, axis=0), np.maximum.reduceat(-plain, cuts, axis=0)
    limits = bounds(queries.astype(np.float64), upper, lower)
    order = np.argsort(-limits, axis=1, kind="stable")
    queries, data = _as(queries, kind), _as(data, kind)
    for q in range(len(queries)):
        best_ids, best, scored = np.zeros(0, np.int64), np.zeros(0, kind), 0
        edge = least[q]
        for b in order[q]:
            if limits[q, b] < edge:
                break
            at = slice(cuts[b], cuts[b] + size)
            other = ids[at] != own[q]
            score, names = (data[at] @ queries[q])[other], ids[at][other]
            scored += 1
            best, best_ids = np.concatenate([best, score]), np.concatenate([best_ids, names])
            keep = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[keep], best_ids[keep]
            if len(best) == k:
                edge = max(edge, _double(best[-1]))
        yield q, best_ids, best, scored


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.string()), ("scored", pa.int64())])
_FOUND_DDL = "query_id long, vec_id long, score string, scored long"


def _least(row: dict, mark: str) -> np.ndarray:
    """The highest of the k-th scores found so far."""
    found = [np.frombuffer(x, np.float64) for x in row.get("least") or []]
    return np.max(found, axis=0) if found else np.full(row[f"{mark}n"], -np.inf)


def searcher(size: int, k: int):
    """A chunk and a segment to the k best of each query in it. Scores are written out: they may not fit into 64 bits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, data), (own, queries) = unpack(row), unpack(row, "q_")
                least = _least(row, "q_")
                if row.get("asked") is not None:
                    asked = np.frombuffer(row["asked"], np.int32)
                    own, queries, least = own[asked], queries[asked], least[asked]
                out: list[list] = [[], [], [], []]
                for q, names, scores, scored in visit(queries, own, least, ids, data, size, k):
                    out[0] += [int(own[q])] * len(names)
                    out[1] += names.tolist()
                    out[2] += [str(int(x)) for x in scores]
                    out[3] += [scored] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _FOUND.types, strict=True)], schema=_FOUND)

    return search


def thresholds(size: int, k: int):
    """A chunk and a segment to the chunk's k-th scores there: (chunk, least)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, data), (own, queries) = unpack(row), unpack(row, "q_")
                least = _least(row, "q_").copy()
                for q, names, scores, _ in visit(queries, own, least, ids, data, size, k):
                    if len(names) == k:
                        least[q] = _double(scores[-1])
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([least.tobytes()], pa.binary())], ["chunk", "least"])

    return found


def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk and a pack of segments' maxima to the segments that its queries' bounds reach: (chunk, segment, asked)."""
    for batch in batches:
        for row in batch.to_pylist():
            queries, least = unpack(row, "q_")[1].astype(np.float64), _least(row, "q_")
            rows: list[list] = [[], []]
            for segment in row["members"]:
                upper, lower = (np.frombuffer(segment[c], np.float64)[None, : queries.shape[1]] for c in ("upper", "lower"))
                asked = np.flatnonzero(bounds(queries[:, : upper.shape[1]], upper, lower)[:, 0] >= least)
                if len(asked):
                    rows[0].append(segment["segment"])
                    rows[1].append(asked.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(rows[0]), pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], ["chunk", "segment", "asked"])


def meetings(vectors: DataFrame, is_query, work: Workspace, k: int, key: str, value: str, scale: float, block: int, segment: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score as text, scored) of every meeting of a chunk and a segment, and the meetings (chunk, segment, asked)."""
    rows = quantised(vectors, key, value, scale)
    numbered = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())  # noqa: E731, rising with the ids
    cut = lambda df, size, name: work.save(numbered(df.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(packer(size), _SHAPE), name), f"{name}s")
    segments, asked = cut(rows, segment, "segment"), cut(rows.filter(is_query), chunk, "chunk")
    queries = asked.drop("upper", "lower").select("chunk", *(F.col(c).alias(f"q_{c}") for c in asked.columns if c not in ("chunk", "upper", "lower")))
    first = lambda ids: F.conv(F.hex(F.reverse(F.substring(ids, 1, 8))), 16, -10).cast("long")
    begins = segments.select("segment", first(F.col("ids")).alias("id"), F.lit(None).cast("long").alias("chunk")).unionByName(asked.select(F.lit(None).cast("long").alias("segment"), first(F.col("ids")).alias("id"), "chunk"))
    home = work.save(homes(begins), "homes")
    own = queries.join(home, "chunk").join(segments.drop("upper", "lower"), "segment")
    # a chunk has a few home segments: about as many as it is wider in ids
    least = work.save(own.mapInArrow(thresholds(block, k), "chunk long, least binary").groupBy("chunk").agg(F.collect_list("least").alias("least")), "least")
    packs = work.save(segments.select("segment", "upper", "lower").withColumn("pack", F.xxhash64("segment")), "maxima")
    held = packs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("upper") + F.length("lower")), F.lit(0)).alias("bytes")).first()
    seats = max(1, -(-held.n // PACK), -(-held.bytes // BYTES))
    packs = packs.groupBy(F.pmod("pack", F.lit(seats)).alias("seat")).agg(F.collect_list(F.struct("segment", "upper", "lower")).alias("members"))
    known = queries.join(least, "chunk", "left")
    copies = known.withColumn("seat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seats - 1).cast("long"))))
    met = work.save(copies.join(packs, "seat").drop("seat").mapInArrow(reached, "chunk long, segment long, asked binary"), "met")
    # the segment is the wide side: the meetings go to it, chunk by chunk
    found = known.join(met, "chunk").join(segments.drop("upper", "lower"), "segment").mapInArrow(searcher(block, k), _FOUND_DDL)
    return found, met


def homes(begins: DataFrame) -> DataFrame:
    """(chunk, segment) that lie side by side in id order; begins: (segment, id, chunk), one of both null.

    A chunk's first segment is the last that begins no later; the others begin in it, up to where the next chunk does. One narrow row for each
    segment and chunk, thousands of vectors each; by ranges, so that no task sorts them all."""
    parts = begins.repartitionByRange("id", F.col("chunk").isNotNull()).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("id", F.col("chunk").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    sides = ("segment", "chunk")
    filled = parts.withColumns({f"last_{c}": F.last(c, True).over(within) for c in sides})
    before = filled.groupBy("part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("id", c))).alias(f"ends_{c}") for c in sides))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = before.select("part", *(F.last(f"ends_{c}", True).over(upto).alias(f"before_{c}") for c in sides))
    met = filled.join(F.broadcast(carried), "part")
    side = lambda c, other: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.coalesce(f"last_{c}", f"before_{c}")).alias(c)
    return met.select(side("chunk", "segment"), side("segment", "chunk")).filter("chunk is not null and segment is not null").distinct()


def search(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", value: str = "embedding", scale: float = 256.0, block: int = 64, segment: int = 8192, chunk: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row for which ``is_query`` (a column over ``id``) holds."""
    work = Workspace(prepare(vectors.sparkSession), "topk")
    found, _ = meetings(vectors, is_query, work, k, key, value, scale, block, segment, chunk)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    # scores of any size sort by sign, then by number of digits, then by digits; those below zero the other way round
    negative = F.col("score").startswith("-")
    length, text = F.length("score"), F.col("score")
    order = Window.partitionBy("query_id").orderBy(negative, F.when(negative, length).otherwise(-length), F.when(negative, text), F.desc(F.when(~negative, text)), "vec_id")
    near = F.coalesce(text.try_cast("long"), F.when(negative, F.lit(_LEAST)).otherwise(F.lit(_MOST)))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", near.cast("long").alias("score"))

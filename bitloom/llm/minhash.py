"""Near-duplicate documents by MinHash, banding, verification and connected components.

1. Each text becomes the set of its distinct word shingles (64-bit hashes) and, of this set, HASHES universal hash
   minima; ``digest`` names the set. Documents with one digest are copies and are stood for by the smallest doc_id.
2. The minima form BANDS bands of ROWS; representatives that agree on a whole band share a bucket.
3. Buckets chain documents into families: each bucket ties its members to its smallest one, and alternating large-star and
   small-star joins these ties. No bucket is expanded into its pairs.
4. Each family is dealt into blocks of bounded bytes. A block compares its members by signature and, most alike first, exactly on
   the full sets, unless links found before connect the two already; it returns the components of its members. Blocks of a
   family share no member, so these need no further joining.
5. A family of several blocks goes on with its buckets that still span several components: their documents outside the family's
   largest component are compared, again block by block, with all documents in such buckets; or, where that ships more (many
   texts that are chained but unlike), each bucket that fits a block is compared by itself. So every pair that shares a
   bucket is compared or connected already. What these blocks join are components, by alternating stars again.

Two documents at similarity 0.8 share no band with a probability of (1 - 0.8**7)**56 = 2e-6, and the signature
test leaves out a true link with about 1e-6 (five standard deviations).

Defined results: null, empty and white-space texts have no shingles and link with nothing; with fewer words than a
shingle the whole sequence is the one shingle; rows that share a doc_id but not a text are clustered each by its own text;
null doc_ids take no part in links and get no component; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, binary_of, prepare

_SEED = 20_240_229
_MEMORY_WORDS = 500_000
#: Up to so many rows (8 numbers each, 64 MB) of a placement are broadcast to pick the texts to compare; more are joined by a shuffle.
_BROADCAST_ROWS = 1_000_000
#: What a block holds at most, beside one document: bytes of sets and signatures, and documents.
_BLOCK_BYTES, _BLOCK_ROWS = 16 << 20, 1000


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    bands: int = 56
    rows: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < _MEMORY_WORDS:
            self[word] = found
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sketcher:
    def __init__(self, settings: Settings):
        draw = np.random.default_rng(_SEED)
        self.settings, self.known = settings, WordHashes()
        self.times = draw.integers(1, 1 << 63, settings.hashes, np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = draw.integers(0, 1 << 63, settings.hashes, np.uint64)
        self.place = draw.integers(1, 1 << 63, max(settings.words, settings.rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = draw.integers(1, 1 << 63, settings.bands, np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles."""
        words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        each = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.settings.words, len(words))
        total = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            total += each[i : len(words) - k + 1 + i] * self.place[i]
        return np.unique(_mixed(total + np.uint64(k)))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.settings.hashes, np.iinfo(np.uint64).max, np.uint64)
        space = np.empty((min(len(shingles), 512), self.settings.hashes), np.uint64)
        for at in range(0, len(shingles), 512):
            part = shingles[at : at + 512, None]
            values = np.multiply(part, self.times, out=space[: len(part)])
            values += self.plus
            np.minimum(least, values.min(axis=0), out=least)
        return (least >> np.uint64(16)).astype(np.uint16)  # bits that are even for sets of up to 2**32

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(self.settings.bands, self.settings.rows).astype(np.uint64)
        return _mixed((rows * self.place[: self.settings.rows]).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def _sketch(settings: Settings):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Sketcher(settings)
        empty = np.zeros(0, np.uint16)
        for batch in batches:
            sizes, digests, signs = [], [], []
            for text in as_bytes(batch.column(1)):
                found = of.shingles(text)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(of.minima(found) if len(found) else empty)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), binary_of(signs)], ["doc_id", "n_shingles", "digest", "sign"])

    return sketch


def _bands(settings: Settings):
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Sketcher(settings)
        for batch in batches:
            keys = [of.buckets(np.frombuffer(x, np.uint16)) for x in batch.column(1).to_pylist()]
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), settings.bands)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())], ["node", "bucket"])

    return bands


def _measured(settings: Settings):
    """Adds the full set and the signature of each text, for the block comparisons."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Sketcher(settings)
        for batch in batches:
            sets = [of.shingles(x) for x in as_bytes(batch.column("text"))]
            names = ["node", "family", "component", "cells"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), binary_of(sets), binary_of([of.minima(x) for x in sets])], [*names, "shingles", "sign"])

    return measured


def connecting(rows: list[tuple], settings: Settings, within: bool) -> list[tuple[int, int]]:
    """Pairs (joined, component): what components become by links between rows (node, component, is_left, shingles, sign).

    A component takes the smallest name of those it is linked with; the ones that keep their name aren't listed. Pairs most alike come first.
    within: all pairs; else pairs of a left row and a right row. A pair is linked if 100 * intersection >= percent * union. Signatures
    that agree less often than five standard deviations below the limit aren't compared further."""
    limit = settings.percent / 100
    least = settings.hashes * limit - 5 * (settings.hashes * limit * (1 - limit)) ** 0.5
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    signs = np.stack([np.frombuffer(r[4], np.uint16) for r in rows])
    sizes, component = np.array([len(x) for x in sets]), np.array([r[1] for r in rows])
    left = np.arange(len(rows)) if within else np.flatnonzero([r[2] for r in rows])
    right = left if within else np.flatnonzero([not r[2] for r in rows])
    found: list[tuple[np.ndarray, ...]] = []
    for at, i in enumerate(left):
        others = right[at + 1 :] if within else right
        fit = 100 * np.minimum(sizes[others], sizes[i]) >= settings.percent * np.maximum(sizes[others], sizes[i])
        others = others[fit & (component[others] != component[i])]
        agree = (signs[others] == signs[i]).sum(axis=1, dtype=np.int32)
        near = agree >= least
        found.append((np.full(int(near.sum()), i), others[near], agree[near]))
    if not found:
        return []
    one, two, agree = (np.concatenate(x) for x in zip(*found, strict=True))
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for at in np.argsort(-agree, kind="stable"):
        i, j = int(one[at]), int(two[at])
        a, b = top(rows[i][1]), top(rows[j][1])
        if a == b:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= settings.percent * (len(sets[i]) + len(sets[j]) - both):
            parent[max(a, b)] = min(a, b)
    return [(top(x), x) for x in list(parent)]


def _linked(settings: Settings, within: bool):
    """Rows sorted by block to what each block joins; only one block is held at a time."""

    def table_of(links: Iterable[tuple[int, int]]) -> pa.RecordBatch:
        hubs, nodes = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(nodes, pa.int64())], ["hub", "node"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("node", "component", "is_left", "shingles", "sign")]
            keys = zip(*(batch.column(c).to_pylist() for c in ("family", "part", "chunk")), strict=True)
            for key, *row in zip(keys, *columns, strict=True):
                if key != now:
                    if len(rows) > 1 and (links := connecting(rows, settings, within)):
                        yield table_of(links)
                    now, rows = key, []
                rows.append(row)
        if len(rows) > 1 and (links := connecting(rows, settings, within)):
            yield table_of(links)

    return linked


def sketches(documents: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, n_shingles, digest, sign); digest is null where there is no shingle."""
    prepare(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch(settings), "doc_id long, n_shingles long, digest binary, sign binary")


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) of the nodes of links (hub, node): the smallest node reachable, by alternating stars."""
    edges = work.save(links.select(F.greatest("hub", "node").alias("u"), F.least("hub", "node").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    step, state = 0, None
    total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while total[0] and tuple(total) != state:
        state, step = tuple(total), step + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = work.save(small, f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    # each node now has one edge, to the smallest of its component
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return work.save(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), name)


def compare(documents: DataFrame, placed: DataFrame, settings: Settings, work: Workspace, name: str, within: bool) -> DataFrame:
    """Components joined within blocks, as (hub, node): the smallest one and another; placed: (node, family, component, cells), cells being the blocks (part, chunk, is_left) of a node."""
    placed = work.save(placed, f"{name}-placed")
    if placed.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0] <= _BROADCAST_ROWS:
        placed = F.broadcast(placed)  # else whole texts would be shuffled for the few that are asked for
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(placed, "node").select("node", "family", "component", "cells", "text")
    kind = "node long, family long, component long, cells array<struct<part:long,chunk:long,is_left:boolean>>, shingles binary, sign binary"
    measured = texts.mapInArrow(_measured(settings), kind).filter(F.length("shingles") > 0)
    dealt = measured.select("*", F.explode("cells").alias("cell")).select("family", "cell.*", "node", "component", "shingles", "sign")
    block = ["family", "part", "chunk"]
    return work.save(dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_linked(settings, within), "hub long, node long"), f"{name}-links")


def _blocks(rows, weight):
    """How many blocks hold so many rows of this weight in bytes."""
    return F.greatest(F.ceil(rows / _BLOCK_ROWS), F.ceil(weight / _BLOCK_BYTES), F.lit(1)).cast("long")


def _place(blocks, salt: int):
    return F.pmod(F.xxhash64("node", F.lit(salt)), blocks)


def _cell(part, chunk, is_left):
    return F.struct(part.cast("long").alias("part"), chunk.cast("long").alias("chunk"), F.lit(is_left).alias("is_left"))


def _sided(live: DataFrame) -> DataFrame:
    """live with outside (of the family's largest component), and the numbers of blocks that hold the family's documents outside (parts) and all (chunks)."""
    main = live.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    sided = live.join(main, "family").withColumn("outside", F.col("component") != F.col("main"))
    outside = lambda x: F.sum(F.when(F.col("outside"), x))
    sizes = sided.groupBy("family").agg(_blocks(outside(F.lit(1)), outside(F.col("weight"))).alias("parts"), _blocks(F.count("*"), F.sum("weight")).alias("chunks"))
    return sided.join(sizes, "family")


def _grid(sided: DataFrame) -> DataFrame:
    """(node, family, component, cells): the documents outside meet all of the family's, block by block."""
    every = lambda n, of: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), of)
    lefts = F.when(F.col("outside"), every(F.col("chunks"), lambda c: _cell(_place(F.col("parts"), 2), c, True)))
    rights = every(F.col("parts"), lambda p: _cell(p, _place(F.col("chunks"), 3), False))
    cells = F.concat(F.coalesce(lefts, F.filter(rights, lambda _: F.lit(False))), rights)
    return sided.select("node", "family", "component", cells.alias("cells"))


def _across(documents: DataFrame, members: DataFrame, named: DataFrame, settings: Settings, work: Workspace) -> DataFrame:
    """Links (hub, node) between components of families of several blocks, named: (node, family, weight, component).

    Only buckets that span several components count. A family's grid ships its documents once for each block that they meet; where
    that is more than once for each of their buckets, the buckets that fit a block are compared each by itself, and the grid
    is left to the documents of larger ones. So texts that are merely chained cost their buckets, not the square of the family."""
    held = members.select("bucket", "node").join(named, "node")
    kinds = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), _blocks(F.count("*"), F.sum("weight")).alias("blocks"))
    open_ = kinds.filter("low <> high").select("bucket", (F.col("blocks") > 1).alias("wide"))
    held = work.save(held.join(open_, "bucket"), "open")
    documents_of = lambda rows: rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("family", "weight", "component")))
    sided = work.save(_sided(documents_of(held)), "live")
    shipped = F.col("weight") * (F.when(F.col("outside"), F.col("chunks")).otherwise(0) + F.col("parts"))
    spent = sided.groupBy("family").agg(F.sum(shipped).alias("by_grid"))
    spread = held.groupBy("family").agg(F.sum("weight").alias("by_bucket"))
    dense = spent.join(spread, "family").filter("by_grid <= by_bucket").select("family")
    links = compare(documents, _grid(sided.join(dense, "family", "left_semi")), settings, work, "across", False)
    loose = work.save(held.join(dense, "family", "left_anti"), "loose")
    if loose.isEmpty():
        return links
    each = loose.filter("not wide").groupBy("node", "family", "component").agg(F.collect_set(_cell(F.col("bucket"), F.lit(0), False)).alias("cells"))
    links = links.unionByName(compare(documents, each, settings, work, "buckets", True))
    return links.unionByName(compare(documents, _grid(_sided(documents_of(loose.filter("wide")))), settings, work, "wide", False))


def cluster(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    spark = prepare(documents.sparkSession)
    work = Workspace(spark, "minhash")
    sketched = work.save(sketches(documents, settings), "sketches")
    has = sketched.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    nodes = work.save(has.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign")), "nodes")
    exploded = nodes.select("node", "sign").mapInArrow(_bands(settings), "node long, bucket long")
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket", "low")
    members = work.save(exploded.join(shared, "bucket"), "members")
    family = components(members.select(F.col("low").alias("hub"), "node"), work, "families").withColumnRenamed("component", "family")
    weight = nodes.groupBy("node").agg((F.max("n_shingles") * 8 + 2 * settings.hashes).alias("weight"))
    family = work.save(family.join(weight, "node"), "weighed")
    blocks = family.groupBy("family").agg(_blocks(F.count("*"), F.sum("weight")).alias("blocks"))
    first = family.join(blocks, "family").select("node", "family", "weight", "blocks", _place(F.col("blocks"), 1).alias("part"))
    first = work.save(first, "first")
    found = compare(documents, first.select("node", "family", F.col("node").alias("component"), F.array(_cell(F.col("part"), F.lit(0), False)).alias("cells")), settings, work, "within", True)
    component = found.select("node", F.col("hub").alias("component"))
    of_digest = nodes.select("digest", "node").join(component, "node", "left").select("digest", F.coalesce("component", "node").alias("node"))
    large = first.filter("blocks > 1").select("node", "family", "weight")
    if not large.isEmpty():
        named = large.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        joined = components(_across(documents, members, named, settings, work), work, "joined")
        of_digest = of_digest.join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("node"))
    of_digest = work.save(of_digest, "result")
    work.close(keep=("sketches", "result"))
    named = sketched.select("doc_id", "n_shingles", "digest").join(of_digest, "digest", "left")
    component_id = F.coalesce("node", "doc_id")
    return named.select("doc_id", "n_shingles", component_id.alias("component_id"), (F.col("doc_id") == component_id).alias("kept"))

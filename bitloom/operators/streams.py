"""Streams and row caches: bytes of runs, packed bits, compressed-row tables, padded batches, shuffled files, decoded token streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the label over the first row of a cached image.
NO_ABOVE = 65535


def _byte(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2, "0")


def varint_hex(n: Column) -> Column:
    """An unsigned base-128 number, lowest digits first, in hexadecimal digits."""
    shifted = lambda k: F.shiftright(n.cast("long"), 7 * k)
    digit = lambda k: F.when(shifted(k) > 127, _byte(shifted(k).bitwiseAND(127).bitwiseOR(128))).when((shifted(k) > 0) | F.lit(k == 0), _byte(shifted(k))).otherwise("")
    return F.concat(*(digit(k) for k in range(5)))


def int32_bytes(numbers: Column) -> Column:
    """An array of whole numbers as little-endian signed 32-bit numbers, one after the other."""
    one = lambda x: F.concat(*(_byte(F.shiftright(x.cast("long"), 8 * k).bitwiseAND(255)) for k in range(4)))
    return F.unhex(F.array_join(F.transform(numbers, one), ""))


def run_bytes(run_rows: DataFrame, keys: list[str], itemsize: int = 1) -> DataFrame:
    """(keys, data): value (little-endian) and length (base 128) of each run, in row-major order."""
    value = F.concat(*(_byte(F.shiftright(F.col("label").cast("long"), 8 * k).bitwiseAND(255)) for k in range(itemsize)))
    part = F.struct("y", "start_x", F.concat(value, varint_hex(F.col("len"))).alias("h"))
    return run_rows.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda r: r["h"]), "")).alias("data"))


def packed(pixels: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """(keys, data): one bit for each pixel in row-major order, eight to a byte, the first in the lowest bit. Bytes are summed before they are gathered."""
    sizes = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("__w"))
    place = F.col("y") * F.col("__w") + F.col("x")
    flat = pixels.join(sizes, keys).select(*keys, F.floor(place / 8).cast("long").alias("at"), (flag.cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), (place % 8).cast("int"))).alias("bit"))
    byte = flat.groupBy(*keys, "at").agg(F.sum("bit").alias("byte"))
    return byte.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", _byte(F.col("byte")).alias("h")))), lambda r: r["h"]), "")).alias("data"))


def row_cache(run_rows: DataFrame, above_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, row_ptr, n_runs, labels, lengths, above): each row's runs as arrays, and where they begin in the image's run arrays.

    above has the label over each run's start, NO_ABOVE in the first row. A width beyond 65,535 is an error, as lengths are kept in 16 bits."""
    narrow = F.when(F.col("len") <= 65535, F.col("len")).otherwise(F.raise_error(F.lit("a run is too long for 16 bits")).cast("long"))
    met = run_rows.join(above_rows.select(*keys, "y", "run_idx", "above_label"), [*keys, "y", "run_idx"])
    over = F.when(F.col("y") == 0, F.lit(NO_ABOVE).cast("long")).otherwise(F.col("above_label"))
    part = F.struct("run_idx", F.col("label").alias("a"), narrow.alias("b"), over.alias("c"))
    rows = met.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(part)).alias("p"))
    before = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    field = lambda name: F.transform("p", lambda r: r[name])
    return rows.select(*keys, "y", F.coalesce(F.sum(F.size("p")).over(before), F.lit(0)).cast("long").alias("row_ptr"), F.size("p").cast("long").alias("n_runs"), field("a").alias("labels"), field("b").alias("lengths"), field("c").alias("above"))


def cached_runs(cache: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, y, run_idx, start_x, len, label) of a row cache; the inverse of ``row_cache``."""
    one = cache.select(*keys, "y", "lengths", F.posexplode("labels").alias("run_idx", "label"))
    start = F.aggregate(F.slice("lengths", 1, F.col("run_idx")), F.lit(0).cast("long"), lambda a, x: a + x)
    return one.select(*keys, "y", F.col("run_idx").cast("long").alias("run_idx"), start.alias("start_x"), F.get("lengths", F.col("run_idx")).alias("len"), "label")


def shifted_tokens(typed: DataFrame, keys: list[str], bos: int) -> DataFrame:
    """(keys, y, tokens, types, room, targets) of each row: tokens behind a BOS; BOS has target -100, type -1 and room 0.

    A token's target is itself, one place later than it is read."""
    part = F.struct("t", "token", "token_type", "rem_width")
    rows = typed.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(part)).alias("p"))
    field = lambda name: F.transform("p", lambda r: r[name].cast("long"))
    first = lambda n: F.array(F.lit(n).cast("long"))
    return rows.select(*keys, "y", F.concat(first(bos), field("token")).alias("tokens"), F.concat(first(-1), field("token_type")).alias("types"), F.concat(first(0), field("rem_width")).alias("room"), F.concat(first(-100), field("token")).alias("targets"))


def decode_contract(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, label) of contract streams (BOS, height, width, value and length of each run, EOS)."""
    body = F.slice("tokens", 4, F.size("tokens") - 4)
    pairs = F.transform(F.sequence(F.lit(0), (F.size(body) / 2).cast("int") - 1), lambda i: F.struct(F.get(body, i * 2).alias("label"), F.get(body, i * 2 + 1).alias("len")))
    one = tokens.select(*keys, F.get("tokens", F.lit(2)).alias("w"), pairs.alias("pairs")).select(*keys, "w", "pairs", F.posexplode("pairs").alias("i", "r"))
    start = F.aggregate(F.slice("pairs", 1, F.col("i")), F.lit(0).cast("long"), lambda a, r: a + r["len"])
    flat = one.select(*keys, "w", F.col("r.label").alias("label"), F.explode(F.sequence(start, start + F.col("r.len") - 1)).alias("p"))
    return flat.select(*keys, F.floor(F.col("p") / F.col("w")).cast("long").alias("y"), (F.col("p") % F.col("w")).alias("x"), "label")


def batches(rows: DataFrame, keys: list[str], order: list[str], value: str, size: int, pad: int) -> DataFrame:
    """(keys, batch, place, values, mask): arrays of ``size`` consecutive rows, padded on the right to the longest of their batch."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    placed = rows.withColumn("__n", number).withColumns({"batch": F.floor(F.col("__n") / size).cast("long"), "place": (F.col("__n") % size).cast("long")})
    longest = F.max(F.size(value)).over(Window.partitionBy(*keys, "batch"))
    gap = longest - F.size(value)
    fill = lambda x: F.array_repeat(F.lit(x).cast("long"), gap)
    return placed.select(*keys, "batch", "place", F.concat(F.col(value), fill(pad)).alias("values"), F.concat(F.transform(value, lambda _: F.lit(1).cast("long")), fill(0)).alias("mask"))


def file_order(key: str, seed: int, epoch: int) -> Column:
    """A key's place of an epoch: files are shuffled by it, their rows stay in order behind it."""
    return F.md5(F.concat(F.lit(f"{seed + epoch}:"), F.col(key).cast("string")))


def tile_images(tile_pixels: DataFrame, stem: str, tile: int) -> DataFrame:
    """Pixels of tiles (stem, gy, gx) as images of their own, named stem__gyN__gxM.png, with places inside the tile."""
    name = F.concat_ws("", F.col(stem).cast("string"), F.lit("__gy"), F.col("gy").cast("string"), F.lit("__gx"), F.col("gx").cast("string"), F.lit(".png"))
    return tile_pixels.withColumns({"name": name, "ty": F.col("y") - F.col("gy") * tile, "tx": F.col("x") - F.col("gx") * tile})


def truncated_nll(scores: Column, room: Column, target: Column) -> Column:
    """Bits of a length under a softmax over 1..room (scores start at length 1); targets below 1 cost nothing."""
    held = F.slice(scores, 1, F.greatest(F.lit(1), F.least(room, F.size(scores))).cast("int"))
    top = F.array_max(held)
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    chosen = F.get(held, F.least(target, F.size(held)).cast("int") - 1)
    return F.when(target < 1, 0.0).otherwise((F.log(total) + top - chosen) / F.log(F.lit(2.0)))

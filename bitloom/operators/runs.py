"""Run-length operators: gaps and islands over pixels, tokens, contexts and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, run_idx, start_x, len, label, w): maximal runs of one label within each row, in order."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    breaks = pixels.withColumns({"before": F.lag("label").over(row), "w": F.max(F.col("x") + 1).over(Window.partitionBy(*keys, "y"))})
    starts = breaks.filter(F.col("before").isNull() | (F.col("before") != F.col("label")))
    return starts.select(*keys, "y", (F.row_number().over(row) - 1).cast("long").alias("run_idx"), F.col("x").alias("start_x"), (F.coalesce(F.lead("x").over(row), "w") - F.col("x")).alias("len"), "label", "w")


def decode(run_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of runs; the inverse of ``runs``."""
    return run_rows.select(*keys, "y", F.explode(F.expr("sequence(start_x, start_x + len - 1)")).alias("x"), "label")


def check_rows(run_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose runs are not positive or don't fill the width: what a strict decoder refuses."""
    return run_rows.groupBy(*keys, "y").agg(F.sum("len").alias("filled"), F.max("w").alias("w"), F.min("len").alias("least")).filter("filled <> w or least < 1")


def typed_tokens(run_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, t, token, token_type, rem_width): label and length tokens in turn; the room left stands at lengths."""
    pair = F.array(F.struct(F.lit(0).alias("k"), F.col("label").alias("token"), F.lit(0).cast("long").alias("rem_width")), F.struct(F.lit(1).alias("k"), F.col("len").alias("token"), (F.col("w") - F.col("start_x")).alias("rem_width")))
    return run_rows.select(*keys, "y", "run_idx", F.explode(pair).alias("p")).select(*keys, "y", (F.col("run_idx") * 2 + F.col("p.k")).alias("t"), "p.token", F.col("p.k").alias("token_type"), "p.rem_width")


def label_index(pixels: DataFrame) -> DataFrame:
    """(label, idx): labels in ascending order, numbered from 0."""
    return pixels.select("label").distinct().select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("long").alias("idx"))  # as many rows as labels


def above(run_rows: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with the label and the end of the run over their first pixel; label -2 and room 1 in the first row."""
    up = Window.partitionBy(*keys, "y").orderBy("start_x")
    over = run_rows.select(*keys, (F.col("y") + 1).alias("y"), F.explode(F.expr("sequence(start_x, start_x + len - 1)")).alias("start_x"), F.col("label").alias("above_label"), (F.col("start_x") + F.col("len")).alias("above_end"))
    met = run_rows.join(over, [*keys, "y", "start_x"], "left")
    return met.withColumns({"above_rem": F.greatest(F.lit(1).cast("long"), F.coalesce(F.col("above_end") - F.col("start_x"), F.lit(1).cast("long"))), "above_label": F.coalesce("above_label", F.lit(-2).cast("long"))}).drop("above_end")


def scanline(pixels: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Runs of a value over a whole image in row-major order, crossing row ends: (keys, run_idx, start, len, value)."""
    sizes = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    flat = pixels.join(sizes, keys).select(*keys, (F.col("y") * F.col("w") + F.col("x")).alias("p"), value.cast("long").alias("value"), "h", "w")
    row = Window.partitionBy(*keys).orderBy("p")
    starts = flat.withColumn("before", F.lag("value").over(row)).filter("before is null or before <> value")
    return starts.select(*keys, "h", "w", (F.row_number().over(row) - 1).cast("long").alias("run_idx"), F.col("p").alias("start"), (F.coalesce(F.lead("p").over(row), F.col("h") * F.col("w")) - F.col("p")).alias("len"), "value")


def contract_tokens(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tokens): BOS -1, height, width, value and length of each run, EOS -2."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "value", "len"))), lambda r: F.array(r["value"], r["len"]))
    sign = lambda n: F.array(F.lit(n).cast("long"))
    return lines.groupBy(*keys).agg(F.max("h").alias("h"), F.max("w").alias("w"), F.flatten(pairs).alias("body")).select(*keys, F.concat(sign(-1), F.array("h", "w"), "body", sign(-2)).alias("tokens"))


def contract_errors(tokens: Column) -> Column:
    """Why a token array isn't a valid contract stream; null if it is."""
    n = F.size(tokens)
    body = F.slice(tokens, 4, F.greatest(n - 4, F.lit(0)))
    lengths = F.filter(body, lambda x, i: i % 2 == 1)
    values = F.filter(body, lambda x, i: i % 2 == 0)
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        F.when(tokens.isNull() | (n < 4), "too short")
        .when(F.get(tokens, F.lit(0)) != -1, "no BOS")
        .when(F.get(tokens, n - 1) != -2, "no EOS")
        .when((F.get(tokens, F.lit(1)) <= 0) | (F.get(tokens, F.lit(2)) <= 0), "bad shape")
        .when((n - 4) % 2 != 0, "odd body")
        .when(F.exists(values, lambda x: ~x.isin(0, 1)), "not binary")
        .when(F.exists(lengths, lambda x: x <= 0), "bad length")
        .when(total != F.get(tokens, F.lit(1)) * F.get(tokens, F.lit(2)), "bad sum")
    )


def unified_tokens(run_rows: DataFrame, keys: list[str], vocab: int, support: int) -> DataFrame:
    """(keys, y, t, sym, lo, hi): labels and lengths in one alphabet; labels beyond the vocabulary are dropped, lengths clamped.

    lo and hi bound the symbols that are possible there: all labels, or the lengths that fit into the row."""
    kept = run_rows.filter((F.col("label") >= 0) & (F.col("label") < vocab))
    room = F.least(F.lit(support).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("w") - F.col("start_x")))
    row = lambda k, sym, lo, hi: F.struct(F.lit(k).alias("k"), sym.alias("sym"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    length = F.least(F.col("len"), F.lit(support).cast("long")) + vocab - 1
    pair = F.array(row(0, F.col("label"), F.lit(0), F.lit(vocab - 1)), row(1, length, F.lit(vocab), room + vocab - 1))
    return kept.select(*keys, "y", "run_idx", F.explode(pair).alias("p")).select(*keys, "y", (F.col("run_idx") * 2 + F.col("p.k")).alias("t"), "p.sym", "p.lo", "p.hi")


def delta_left(pixels: DataFrame, keys: list[str], modulus: int = 256) -> DataFrame:
    """Pixels with the difference to the left neighbour, modulo the type's range; the first column stays."""
    before = F.lag("label", 1, 0).over(Window.partitionBy(*keys, "y").orderBy("x"))
    return pixels.withColumn("delta", F.pmod(F.col("label") - before, F.lit(modulus)))


def varint_size(n: Column) -> Column:
    """Bytes of an unsigned base-128 number."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + (n >= F.lit(1 << (7 * k))).cast("int")
    return size


def windows(rows: DataFrame, keys: list[str], order: str, value: str, size: int, pad: int) -> DataFrame:
    """Each row with the ``size`` values before it, padded on the left."""
    before = F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-size, -1))
    return rows.withColumn("context", F.concat(F.array_repeat(F.lit(pad).cast("long"), F.lit(size) - F.size(before)), before))


def boundaries(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels that differ from their left or upper neighbour, spread to the 3 x 3 pixels around each (inside the image)."""
    left = F.lag("label").over(Window.partitionBy(*keys, "y").orderBy("x"))
    up = F.lag("label").over(Window.partitionBy(*keys, "x").orderBy("y"))
    edge = pixels.withColumns({"l": left, "u": up}).filter("l <> label or u <> label")
    near = edge.select(*keys, F.explode(F.expr("flatten(transform(sequence(-1, 1), dy -> transform(sequence(-1, 1), dx -> struct(y + dy as y, x + dx as x))))")).alias("p")).select(*keys, "p.y", "p.x").distinct()
    return pixels.select(*keys, "y", "x").join(near, [*keys, "y", "x"], "left_semi")


def tiles(pixels: DataFrame, tile: int, stride: int, h: Column, w: Column) -> DataFrame:
    """Each pixel with every tile (gy, gx) of the floor grid that covers it; what is left over at the edges is dropped."""
    some = lambda c, size: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - tile) / stride) + 1).cast("long"), F.least(F.floor(F.col(c) / stride), F.floor((size - tile) / stride)).cast("long"))
    held = lambda c, size: F.when((size >= tile) & (F.greatest(F.lit(0), F.floor((F.col(c) - tile) / stride) + 1) <= F.least(F.floor(F.col(c) / stride), F.floor((size - tile) / stride))), some(c, size))
    return pixels.withColumn("gy", F.explode(held("y", h))).withColumn("gx", F.explode(held("x", w)))


def cells_to_tiles(cells: DataFrame, tile: int, stride: int, h: Column, w: Column) -> DataFrame:
    """Cells (cy, cx) of a stride with every tile (gy, gx) of the floor grid that covers them; a tile is a whole number of strides."""
    steps = tile // stride

    def held(cell: str, size: Column) -> Column:
        last = F.floor((size - tile) / stride).cast("long")
        low, high = F.greatest(F.lit(0).cast("long"), F.col(cell) - (steps - 1)), F.least(F.col(cell), last)
        return F.when((size >= tile) & (low <= high), F.sequence(low, F.greatest(low, high)))

    return cells.withColumn("gy", F.explode(held("cy", h))).withColumn("gx", F.explode(held("cx", w)))


def integral(pixels: DataFrame, keys: list[str], value: str = "label") -> DataFrame:
    """Adds ``total``: the sum of a value over the rectangle from the first pixel of the image to this one."""
    along = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("__row", F.sum(value).over(along)).withColumn("total", F.sum("__row").over(down)).drop("__row")


def rectangle(totals: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys, y, x, sum) of every rectangle of that size whose last pixel is (y, x), from an integral image by three look-ups."""
    corner = lambda dy, dx, name: totals.select(*keys, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("total").alias(name))
    met = totals.filter((F.col("y") >= height - 1) & (F.col("x") >= width - 1))
    for dy, dx, name in ((height, 0, "__up"), (0, width, "__left"), (height, width, "__both")):
        met = met.join(corner(dy, dx, name), [*keys, "y", "x"], "left")
    got = F.col("total") - F.coalesce("__up", F.lit(0)) - F.coalesce("__left", F.lit(0)) + F.coalesce("__both", F.lit(0))
    return met.select(*keys, "y", "x", got.alias("sum"))

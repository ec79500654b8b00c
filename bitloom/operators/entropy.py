"""Count-based codelength models: each is a set of counts, joined to the symbols it scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bits(p: Column) -> Column:
    """-log2 of a probability; a probability of 0 or less gives minus infinity, as the negated infinity of a safe logarithm."""
    return F.when(p > 0, -F.log2(p)).otherwise(F.lit(float("-inf")))


def label_contexts(run_rows: DataFrame, order: int, reset: bool = True) -> DataFrame:
    """Runs with the ``order - 1`` labels before them as p1, p2, ...; -1 before the start of the row, or of the image."""
    w = Window.partitionBy("image", "y").orderBy("run_idx") if reset else Window.partitionBy("image").orderBy("y", "run_idx")
    return run_rows.withColumns({f"p{k}": F.lag("label", k, -1).over(w) for k in range(1, order)}) if order > 1 else run_rows


def label_bits(train: DataFrame, rows: DataFrame, order: int, alpha: float = 0.5) -> DataFrame:
    """Adds bits_label: -log2((c + a) / (n + a * v)); a label that training lacks costs log2(v)."""
    ctx = [f"p{k}" for k in range(1, order)]
    counts = train.groupBy(*ctx, "label").agg(F.count("*").alias("c"))
    totals = (counts.groupBy(*ctx) if ctx else counts.groupBy()).agg(F.sum("c").alias("n"))
    known = train.groupBy("label").agg(F.lit(True).alias("known"))
    size = known.agg(F.greatest(F.count("*"), F.lit(1)).cast("double").alias("v"))
    met = rows.join(counts, [*ctx, "label"], "left")
    met = met.join(totals, ctx, "left") if ctx else met.crossJoin(F.broadcast(totals))  # one row
    met = met.join(known, "label", "left").crossJoin(F.broadcast(size))
    c, n, v = F.coalesce("c", F.lit(0)), F.coalesce("n", F.lit(0)), F.col("v")
    return met.withColumn("bits_label", F.when(F.col("known").isNull(), F.log2(v)).otherwise(-F.log2((c + alpha) / (n + alpha * v)))).drop("c", "n", "known", "v")


#: The keys of the specific counts of each mode, and the default weight of its estimate.
MODES = {"label": ([], 0.0), "bigram": (["prev", "label"], 0.95), "xbin": (["label", "xb"], 0.8), "above": (["label", "above_label"], 0.8), "above_lenbin": (["label", "above_label", "lb"], 0.8)}


def length_features(run_rows: DataFrame, xbins: int = 8, lenbins: int = 4) -> DataFrame:
    """Runs with the label before (-1 at a row's start), the horizontal bin, and the bin of the room under the run above."""
    prev = F.lag("label", 1, -1).over(Window.partitionBy("image", "y").orderBy("run_idx"))
    rows = run_rows.withColumns({"prev": prev, "xb": F.least(F.floor(F.lit(xbins) * F.col("start_x") / F.col("w")), F.lit(xbins - 1)).cast("long")})
    if "above_rem" in rows.columns:
        steps = reduce(lambda a, k: a + (F.col("above_rem") >= F.lit(1 << k)).cast("long"), range(1, lenbins), F.lit(0).cast("long"))
        rows = rows.withColumn("lb", steps)
    return rows


def length_bits(train: DataFrame, rows: DataFrame, mode: str, width: int, beta: float = 0.5, w_label: float = 0.95, w_mode: float | None = None) -> DataFrame:
    """Adds bits_len of a run's length among 1..room: a chain of add-beta estimates, specific, label, global, cut at the room.

    With t counts of a key, c of them at the length and C up to the room k: p = (c + b) / (t + b * W), Z = (C + b * k) / (t + b * W);
    both are mixed with the same weights and bits = log2(Z) - log2(p). A key that training lacks has weight 0."""
    keys, weight = MODES[mode]
    weight = weight if w_mode is None else w_mode
    clamp = lambda c: F.least(F.greatest(c, F.lit(1)), F.lit(width).cast("long"))
    train = train.withColumn("len", clamp(F.col("len")))
    rows = rows.withColumn("k", clamp(F.col("w") - F.col("start_x")))
    rows = rows.withColumn("l", F.least(clamp(F.col("len")), F.col("k")))
    levels = {"g": [], "b": ["label"]} | ({"s": keys} if keys else {})
    asked = rows
    for tag, by in levels.items():
        # running counts at the lengths that occur or are asked for, not at every length
        met = train.select(*by, "len", F.lit(1).alias("n")).unionByName(asked.select(*by, F.col("k").alias("len"), F.lit(0).alias("n")))
        counts = met.groupBy(*by, "len").agg(F.sum("n").alias("c"))
        key = Window.partitionBy(*(by or [F.lit(0)]))
        points = counts.withColumns({"upto": F.sum("c").over(key.orderBy("len")), "t": F.sum("c").over(key)})
        rows = rows.join(points.select(*by, F.col("len").alias("l"), F.col("c").alias(f"{tag}_c")), [*by, "l"], "left")
        rows = rows.join(points.select(*by, F.col("len").alias("k"), F.col("upto").alias(f"{tag}_u"), F.when(F.col("t") > 0, F.col("t")).alias(f"{tag}_t")), [*by, "k"], "left")
    mixes = []
    for part in (lambda tag: F.coalesce(f"{tag}_c", F.lit(0)) + beta, lambda tag: F.coalesce(f"{tag}_u", F.lit(0)) + beta * F.col("k")):
        of = lambda tag, part=part: part(tag) / (F.coalesce(f"{tag}_t", F.lit(0)) + beta * width)
        seen = F.when(F.col("b_t").isNotNull(), w_label).otherwise(0.0)
        mixed = seen * of("b") + (1 - seen) * of("g")
        if keys:
            special = F.when(F.col("s_t").isNotNull(), weight).otherwise(0.0)
            mixed = special * of("s") + (1 - special) * mixed
        mixes.append(mixed)
    added = [f"{tag}_{x}" for tag in levels for x in "ctu"]
    return rows.withColumn("bits_len", -F.log2(mixes[0]) + F.log2(mixes[1])).drop("k", "l", *added)


def image_bits(scored: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bits of each image, by kind and per pixel; sizes: (image, h, w)."""
    sums = scored.groupBy("image").agg(F.sum("bits_label").alias("bits_label"), F.sum("bits_len").alias("bits_len")).join(sizes, "image")
    total, area = F.col("bits_label") + F.col("bits_len"), F.col("h") * F.col("w")
    return sums.withColumns({"bits_total": total, "bbp": total / area, "bbp_label": F.col("bits_label") / area, "bbp_len": F.col("bits_len") / area, "len_frac": F.col("bits_len") / F.greatest(total, F.lit(1e-12))})


def tile_means(scored: DataFrame, tile: int, sizes: DataFrame) -> DataFrame:
    """Mean bits per pixel of each tile of the ceil grid: a run's bits are spread over its pixels."""
    part = scored.withColumn("per", (F.col("bits_label") + F.col("bits_len")) / F.greatest("len", F.lit(1)))
    part = part.withColumn("gx", F.explode(F.expr(f"sequence(start_x div {tile}, (start_x + len - 1) div {tile})")))
    overlap = F.least(F.col("start_x") + F.col("len"), (F.col("gx") + 1) * tile) - F.greatest(F.col("start_x"), F.col("gx") * tile)
    sums = part.groupBy("image", F.expr(f"y div {tile}").alias("gy"), "gx").agg(F.sum(F.col("per") * overlap).alias("s")).join(sizes, "image")
    area = (F.least("h", (F.col("gy") + 1) * tile) - F.col("gy") * tile) * (F.least("w", (F.col("gx") + 1) * tile) - F.col("gx") * tile)
    return sums.select("image", "gy", "gx", (F.col("s") / area).alias("heat"))


def histories(tokens: DataFrame, order: int, by: list[str], sort: list[str]) -> DataFrame:
    """Tokens with ctx: the up to ``order`` symbols before them; a shorter context near the start is another context."""
    before = Window.partitionBy(*by).orderBy(*sort).rowsBetween(-order, -1)
    return tokens.withColumn("ctx", F.collect_list("sym").over(before) if order else F.array().cast("array<bigint>"))


def kt_columns(train: DataFrame, rows: DataFrame, order: int, alphabet: int, by: list[str], sort: list[str]) -> DataFrame:
    """Adds k{order}_p, and k{order}_z: the estimate's mass between lo and hi."""
    known = histories(train, order, by, sort).groupBy("ctx", "sym").agg(F.count("*").alias("c"))
    totals = known.groupBy("ctx").agg(F.sum("c").alias("n"))
    asked = histories(rows, order, by, sort)
    # counts between lo and hi: each distinct (context, range) once, not each token
    ranges = asked.select("ctx", "lo", "hi").distinct()
    masses = ranges.join(known.select("ctx", F.col("sym").alias("s2"), F.col("c").alias("c2")), "ctx").filter("s2 between lo and hi").groupBy("ctx", "lo", "hi").agg(F.sum("c2").alias("m"))
    met = asked.join(known, ["ctx", "sym"], "left").join(totals, "ctx", "left").join(masses, ["ctx", "lo", "hi"], "left")
    under = F.coalesce("n", F.lit(0)) + 0.5 * alphabet
    p = F.when((F.col("sym") < 0) | (F.col("sym") >= alphabet), F.lit(max(1 / alphabet, 1e-12))).otherwise((F.coalesce("c", F.lit(0)) + 0.5) / under)
    z = (F.coalesce("m", F.lit(0)) + 0.5 * (F.col("hi") - F.col("lo") + 1)) / under
    return met.withColumns({f"k{order}_p": p, f"k{order}_z": z}).drop("c", "n", "m", "ctx")


def kt_mixture(train: DataFrame, rows: DataFrame, weights: list[float] | DataFrame, alphabet: int, by: list[str], sort: list[str], orders: int) -> DataFrame:
    """Adds p and z of the weighted mixture of orders 0..orders-1; weights: numbers, or one row w0, w1, ..."""
    for k in range(orders):
        rows = kt_columns(train, rows, k, alphabet, by, sort)
    if isinstance(weights, DataFrame):
        rows = rows.crossJoin(F.broadcast(weights))  # one row
        each = [F.col(f"w{k}") for k in range(orders)]
    else:
        each = [F.lit(float(x)) for x in weights]
    total = lambda c: F.greatest(reduce(lambda a, k: a + each[k] * F.col(f"k{k}_{c}"), range(1, orders), each[0] * F.col(f"k0_{c}")), F.lit(1e-12))
    return rows.withColumns({"p": total("p"), "z": total("z")})


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0: Stirling's series after eight steps of the recurrence."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(reduce(lambda a, k: a * (x + float(k)), range(1, 8), x))


def evidence(train: DataFrame, orders: int, alphabet: int, by: list[str], sort: list[str]) -> DataFrame:
    """(k, log_evidence): the natural log probability that each order gives the training symbols one after the other.

    The product over a context depends on its final counts alone, so no running counts are needed:
    sum of lnG(c + 1/2) - lnG(1/2) over symbols, less lnG(n + A/2) - lnG(A/2)."""
    out = None
    for k in range(orders):
        counts = histories(train, k, by, sort).groupBy("ctx", "sym").agg(F.count("*").cast("double").alias("c"))
        of = counts.groupBy("ctx").agg(F.sum("c").alias("n"), F.sum(log_gamma(F.col("c") + 0.5) - log_gamma(F.lit(0.5))).alias("e"))
        one = of.agg(F.sum(F.col("e") - log_gamma(F.col("n") + alphabet / 2) + log_gamma(F.lit(alphabet / 2))).alias("log_evidence")).select(F.lit(k).alias("k"), "log_evidence")
        out = one if out is None else out.unionByName(one)
    return out


def evidence_weights(found: DataFrame, orders: int) -> DataFrame:
    """One row w0, w1, ...: the softmax of the log evidence."""
    top = found.agg(F.max("log_evidence").alias("top"))
    e = found.crossJoin(F.broadcast(top)).withColumn("e", F.exp(F.col("log_evidence") - F.col("top")))
    return e.agg(*(F.sum(F.when(F.col("k") == k, F.col("e"))).alias(f"e{k}") for k in range(orders)), F.greatest(F.sum("e"), F.lit(1e-12)).alias("s")).select(*((F.col(f"e{k}") / F.col("s")).alias(f"w{k}") for k in range(orders)))


def markov_bits(train: DataFrame, counted: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Adds e: bits of one byte under (c + a) / (n + 256 a), to rows (b2, b1, b, ...)."""
    totals = train.groupBy("b2", "b1").agg(F.sum("c").alias("n"))
    met = counted.join(train.withColumnRenamed("c", "c0"), ["b2", "b1", "b"], "left").join(totals, ["b2", "b1"], "left")
    return met.withColumn("e", -F.log2((F.coalesce("c0", F.lit(0)) + alpha) / (F.coalesce("n", F.lit(0)) + 256 * alpha))).drop("c0", "n")

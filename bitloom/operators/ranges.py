"""Running sums and places over a whole table, without a window that puts all rows into one task.

The key's approximate quantiles cut the table into ranges. Sums of ranges, one row each, are put in order by themselves and broadcast; within a range an
ordinary window goes on from there. The cuts are plain numbers, so every pass deals the rows alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Ranges that a table is cut into at most; it bounds the rows that are broadcast and the driver's part.
RANGES = 64


def cuts(rows: DataFrame, key: str, ranges: int = RANGES) -> list[float]:
    """Values at which ranges of about equal size begin; equal keys stay in one range."""
    found = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first().q
    return sorted(set(found or []))


def range_of(key: Column, starts: list) -> Column:
    """The number of the range that a key lies in; null keys lie in the first."""
    if not starts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, starts)), lambda start: start <= key))


def running(rows: DataFrame, key: str, sums: dict[str, str], ties: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """Adds a column of each name in ``sums``: the sum of the named column over all rows up to this one, in the order of ``key`` and ``ties``."""
    rows = settled(rows)
    starts = cuts(rows, key)
    number = range_of(F.col(key), starts)
    ranged = rows.withColumn("__range", -number if descending else number)
    order = [(F.desc if descending else F.asc)(key), *ties]
    whole = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = whole.select("__range", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.join(F.broadcast(offsets), "__range")
    return met.withColumns({n: F.col(f"__{n}") + F.sum(c).over(within) for n, c in sums.items()}).drop("__range", *(f"__{n}" for n in sums))


def numbered(rows: DataFrame, key: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds each row's place from 1 in the order of ``key`` and ``ties``."""
    return running(rows.withColumn("__one", F.lit(1).cast("long")), key, {name: "__one"}, ties).drop("__one")


def carried(rows: DataFrame, key: str, values: dict[str, tuple[str, int]], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds a column of each name: the value of a column so many rows before (``lag``), over the whole table's order."""
    rows = settled(rows)
    starts = cuts(rows, key)
    ranged = rows.withColumn("__range", range_of(F.col(key), starts))
    deepest = max(n for _, n in values.values())
    columns = sorted({c for c, _ in values.values()})
    last = Window.partitionBy("__range").orderBy(F.desc(key), *(F.desc(c) for c in ties))
    # the last rows of every range go over into the one that follows, marked as such
    ends = ranged.withColumn("__place", F.row_number().over(last)).filter(F.col("__place") <= deepest).select("__range", "__place", *(F.col(c).alias(f"__{c}") for c in columns))
    order = Window.orderBy("__range", F.desc("__place")).rowsBetween(Window.unboundedPreceding, -1)  # a few rows for each range
    tail = ends.withColumn("__before", F.slice(F.reverse(F.collect_list(F.struct(*(f"__{c}" for c in columns))).over(order)), 1, deepest))
    first = tail.groupBy("__range").agg(F.max_by("__before", "__place").alias("__before"))
    within = Window.partitionBy("__range").orderBy(key, *ties)
    met = ranged.join(F.broadcast(first), "__range", "left").withColumn("__row", F.row_number().over(within))
    earlier = lambda c, n: F.get(F.col("__before"), F.lit(n) - F.col("__row"))[f"__{c}"]
    return met.withColumns({name: F.when(F.col("__row") > n, F.lag(c, n).over(within)).otherwise(earlier(c, n)) for name, (c, n) in values.items()}).drop("__range", "__row", "__before")

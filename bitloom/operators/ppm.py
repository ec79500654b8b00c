"""Prediction by partial matching (method C, with exclusion). Which symbols are excluded depends on the path down the
orders, so scoring runs in Python, one context at a time, over count rows that are joined to it."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entropy import histories

_FLOOR = 1e-12

Counts = dict[tuple[int, ...], dict[int, int]]


def escapes(counts: Counts, history: tuple[int, ...], order: int) -> Iterable[tuple[float, float, dict[int, int], set[int]]]:
    """From the longest context down: (mass that arrives, 1 / (n + u), fresh symbols with counts, symbols seen before)."""
    seen: set[int] = set()
    mass = 1.0
    for k in range(min(order, len(history)), -1, -1):
        fresh = {s: c for s, c in counts.get(history[len(history) - k :], {}).items() if s not in seen}
        if not fresh:
            continue
        whole = sum(fresh.values()) + len(fresh)
        yield mass, 1 / whole, fresh, seen
        mass = max(mass * len(fresh) / whole, 1e-300)
        seen = seen | fresh.keys()
    yield mass, 0.0, {}, seen


def probability(counts: Counts, history: tuple[int, ...], order: int, symbol: int, alphabet: int) -> float:
    if not 0 <= symbol < alphabet:
        return max(1 / alphabet, _FLOOR)
    for mass, unit, fresh, seen in escapes(counts, history, order):
        if symbol in fresh:
            return max(mass * fresh[symbol] * unit, _FLOOR)
    left = alphabet - len(seen)
    return max(mass / left, _FLOOR) if left > 0 else _FLOOR


def mass_between(counts: Counts, history: tuple[int, ...], order: int, low: int, high: int, alphabet: int) -> float:
    """The probability of all symbols in low..high together."""
    low, high = max(0, low), min(alphabet - 1, high)
    if high < low:
        return 0.0
    total = 0.0
    for mass, unit, fresh, seen in escapes(counts, history, order):
        total += mass * unit * sum(c for s, c in fresh.items() if low <= s <= high)
    left = alphabet - len(seen)
    inside = high - low + 1 - sum(low <= s <= high for s in seen)
    return max(total + (mass * inside / left if left > 0 and inside > 0 else 0.0), _FLOOR)


def count_rows(train: DataFrame, order: int, by: list[str], sort: list[str]) -> DataFrame:
    """(ctx, sym, c) of all orders up to ``order``."""
    out = None
    for k in range(order + 1):
        rows = histories(train, k, by, sort).filter(F.size("ctx") == k).groupBy("ctx", "sym").agg(F.count("*").alias("c"))
        out = rows if out is None else out.unionByName(rows)
    return out


def score(train: DataFrame, rows: DataFrame, order: int, alphabet: int, by: list[str], sort: list[str], renorm: bool = True) -> DataFrame:
    """rows with p and z. Each context comes once, with the counts of its suffixes and all that is asked in it.

    Counts without context, at most one for each symbol of the alphabet, go to all workers instead of along with every context."""
    asked = histories(rows, order, by, sort).select(*rows.columns, "ctx")
    wanted = asked.groupBy("ctx").agg(F.collect_set(F.struct("sym", "lo", "hi")).alias("asks"))
    size = F.size("ctx")
    suffix = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda k: F.slice("ctx", size - k + 1, k)))
    counted = count_rows(train, order, by, sort)
    short = {int(r.sym): int(r.c) for r in counted.filter(F.size("ctx") == 0).collect()}
    longer = counted.filter(F.size("ctx") > 0).groupBy("ctx").agg(F.collect_list(F.struct("sym", "c")).alias("next")).withColumnRenamed("ctx", "part")
    held = wanted.select("ctx", F.explode(suffix).alias("part")).join(longer, "part").groupBy("ctx").agg(F.collect_list(F.struct("part", "next")).alias("known"))

    def scored(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                counts: Counts = {(): short}
                for x in r.known if r.known is not None else ():
                    counts[tuple(int(s) for s in x["part"])] = {int(y["sym"]): int(y["c"]) for y in x["next"]}
                history = tuple(int(s) for s in r.ctx)
                chances: dict[int, float] = {}
                masses: dict[tuple[int, int], float] = {}
                for x in r.asks:
                    symbol, between = int(x["sym"]), (int(x["lo"]), int(x["hi"]))
                    if symbol not in chances:
                        chances[symbol] = probability(counts, history, order, symbol, alphabet)
                    if between not in masses:
                        masses[between] = mass_between(counts, history, order, *between, alphabet) if renorm else 1.0
                    out.append((list(history), symbol, *between, chances[symbol], masses[between]))
            yield pd.DataFrame(out, columns=["ctx", "sym", "lo", "hi", "p", "z"])

    found = wanted.join(held, "ctx", "left").mapInPandas(scored, "ctx array<long>, sym long, lo long, hi long, p double, z double")
    return asked.join(found, ["ctx", "sym", "lo", "hi"]).select(*rows.columns, "p", "z")

"""URL filters with dated lists: entries become validity intervals, and an as-of join judges each capture at its fetch time.

An entry (kind, pattern, action, listed) says from which day on an action holds for a host, a domain with all its subdomains, or a
path prefix of a host. The next entry of the same kind and pattern ends it; 'remove' leaves nothing active. A
capture is judged by the entries active on its day: the most specific one wins (longer prefix, then host, then longer domain).

Each capture becomes one row for each of its keys, and the as-of join is an equi-join on (kind, key, period) with the
day's place inside the interval as a residue: intervals are cut at period borders, so a key with many entries meets a
capture only with those of its period. Hot hosts are one side of a join that may be split or broadcast by its measured size.

Defined results: a null, empty or relative url, or one without host, has no keys and is kept with a null host; a null fetch day
meets no entry; of entries for one day the strongest counts (block before allow before remove); entries with null
fields take no part; hosts are compared in lower case; repeated captures are judged each; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 64
_STRENGTH = ("remove", "allow", "block")


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(name: Column, way: Column) -> Column:
    """Array of (kind, key, rank): what entries may say about a host and a path; a higher rank is more specific."""
    labels = F.split(name, r"\.")
    steps = F.filter(F.split(way, "/"), lambda x: x != "")
    some = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array().cast("array<struct<kind:string,key:string,rank:int>>"))
    row = lambda kind, key, rank: F.struct(F.lit(kind).alias("kind"), key.alias("key"), rank.cast("int").alias("rank"))
    domains = some(F.size(labels) - 1, lambda i: row("domain", F.array_join(F.slice(labels, F.size(labels) - i, i + 1), "."), i))
    prefixes = some(F.size(steps), lambda i: row("prefix", F.concat(name, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")), 20_000 + i))
    return F.concat(domains, F.array(row("host", name, F.lit(10_000))), prefixes)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, action, since, until): the days [since, until) on which an entry holds; until is null for the last."""
    usable = entries.filter(F.col("kind").isNotNull() & F.col("pattern").isNotNull() & F.col("action").isin(*_STRENGTH) & F.col("listed").isNotNull())
    strength = F.array_position(F.array(*map(F.lit, _STRENGTH)), F.col("action"))
    daily = usable.groupBy("kind", F.lower("pattern").alias("key"), F.col("listed").alias("since")).agg(F.max_by("action", strength).alias("action"))
    return daily.withColumn("until", F.lead("since").over(Window.partitionBy("kind", "key").orderBy("since"))).filter(F.col("action") != "remove")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, host, fetched, n_active, matched, verdict) of each capture (key, url, fetched)."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    last = captures.agg(F.max("fetched").alias("last"))
    held = intervals(entries).crossJoin(F.broadcast(last)).filter(F.col("last").isNotNull() & (F.col("since") <= F.col("last")))  # one row
    period = lambda c: F.floor(day(c) / PERIOD)
    end = F.least(F.coalesce(F.date_sub("until", 1), F.col("last")), F.col("last"))
    held = held.withColumn("period", F.explode(F.sequence(period(F.col("since")), period(end)))).drop("last")
    rows = captures.select(F.monotonically_increasing_id().alias("__row"), F.col(key), F.col("fetched"), host(F.col("url")).alias("host"), path(F.col("url")).alias("__path"))
    asked = rows.select("__row", key, "fetched", "host", F.explode_outer(F.when(F.col("host").isNotNull(), keys(F.col("host"), F.col("__path")))).alias("k")).select("__row", key, "fetched", "host", F.col("k.kind").alias("__kind"), F.col("k.key").alias("__key"), F.col("k.rank").alias("__rank"), period(F.col("fetched")).alias("__period"))
    same = (F.col("__kind") == F.col("kind")) & (F.lower("__key") == F.col("key")) & (F.col("__period") == F.col("period"))
    inside = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = asked.join(held.withColumnRenamed("key", "key"), same & inside, "left")
    best = F.max_by(F.struct("action", F.concat_ws(":", "kind", "key").alias("entry")), F.when(F.col("action").isNotNull(), F.col("__rank")))
    judged = met.groupBy("__row").agg(F.first(F.struct(key, "host", "fetched")).alias("c"), F.count("action").alias("n_active"), best.alias("best"))
    blocked = F.when(F.col("best.action") == "block", "block").otherwise("keep")
    return judged.select("c.*", "n_active", F.col("best.entry").alias("matched"), blocked.alias("verdict"))

"""Mixing sources to target weights: hierarchical budgets over a tree, then a token prefix of each leaf.

The tree is given by columns from the top down (here domain, language, source). A node's budget is parted among its
children by weight. A child whose texts, repeated over at most ``epochs`` epochs, hold fewer tokens than its share takes
what it has, and its shortage goes to its siblings by their weights, again up to what they hold. Only what all siblings
together can't take is seen by their parent, whose own capacity is the sum of theirs; so shortages reach an ancestor's
siblings last. Each level is one window over as many rows as the tree has nodes, in whole numbers.

A leaf with budget b and a tokens takes b div a whole epochs, and of the next epoch the longest prefix, in the order of
md5(seed:epoch:doc_id), whose tokens fit into the rest. The running sum over a leaf is taken in two steps: sums of hash ranges
first, then within the one range in which the budget ends, so a leaf with a third of all rows isn't sorted in one task.

Defined results: null names count as ''; null or empty texts have no tokens and go with the prefix they fall
into; a node whose weight is missing, null or below 1 gets weight 1; a budget beyond the capacity takes everything; of a leaf
without tokens nothing is taken;
rows with the same doc_id in a leaf have the same place and are taken or left together; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, prepare

#: Rows of one hash range of a leaf, about.
RANGE_ROWS = 20_000


def words(text: Column) -> Column:
    """Words of a text: runs without ASCII white space."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1).cast("long")


def leaves(rows: DataFrame, tree: list[str], tokens: str) -> DataFrame:
    return rows.groupBy(*tree).agg(F.sum(tokens).cast("long").alias("available"), F.count("*").alias("n_rows"))


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Parts the column ``budget`` of each parent among its children (weight, capacity) and replaces it."""
    order = Window.partitionBy(*parent).orderBy((F.col("capacity").cast("double") / F.col("weight")), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    exact = lambda c: c.cast("decimal(38,0)")
    left = nodes.withColumns({"__left": F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), "__weights": F.sum("weight").over(after)})
    # by rising capacity for each unit of weight the children that are filled come first
    full = left.withColumn("__full", exact(F.col("capacity")) * F.col("__weights") <= exact(F.col("weight")) * exact(F.col("__left")))
    marked = full.withColumns({"__part_left": F.first(F.when(~F.col("__full"), F.col("__left")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "__part_weights": F.first(F.when(~F.col("__full"), F.col("__weights")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    part = F.floor(exact(F.col("weight")) * exact(F.greatest("__part_left", F.lit(0))) / F.col("__part_weights")).cast("long")
    return marked.withColumn("budget", F.when(F.col("__full"), F.col("capacity")).otherwise(F.least("capacity", part))).drop("__left", "__weights", "__full", "__part_left", "__part_weights")


def budgets(leaf: DataFrame, tree: list[str], weights: dict[str, Column], target: Column, epochs: int) -> DataFrame:
    """(tree columns, available, n_rows, budget) of each leaf. target: a column over ``total``, the tokens of all leaves."""
    held = leaf.withColumn("capacity", F.col("available") * epochs)
    weigh = lambda level: F.greatest(F.coalesce(weights.get(level, F.lit(1)).cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    above = held.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("all")).select(F.least(F.floor(target).cast("long"), F.col("all")).alias("budget"), F.lit(0).alias("__root"))
    for depth, level in enumerate(tree, 1):
        path = tree[:depth]
        parent = path[:-1] or ["__root"]
        nodes = held.groupBy(*path).agg(F.sum("capacity").cast("long").alias("capacity")).withColumns({"weight": weigh(level), "__root": F.lit(0)})
        above = share(nodes.join(above.select(*parent, "budget"), parent), parent, level).select(*path, "budget")
    return leaf.join(above, tree)


def place(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def hash_range(placed: Column, ranges: Column) -> Column:
    return F.floor(F.conv(F.substring(placed, 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long")


def mix(rows: DataFrame, tree: list[str], weights: dict[str, Column], target: Column, seed: int = 0, epochs: int = 2, tokens: str = "n_tokens") -> DataFrame:
    """The rows that are taken, with ``copies``: how often. ``tokens`` counts a row's tokens; names of the tree aren't null.

    A leaf's prefix is told by one place in its order, so the rows themselves meet only a table of one row for each leaf."""
    work = Workspace(prepare(rows.sparkSession), "mixing")
    narrow = work.save(rows.select("doc_id", *tree, F.coalesce(tokens, F.lit(0)).cast("long").alias("__tokens")), "narrow")
    leaf = work.save(leaves(narrow, tree, "__tokens"), "leaves")
    plan = budgets(leaf, tree, weights, target, epochs)
    whole = F.floor(F.col("budget") / F.greatest("available", F.lit(1))).cast("long")
    plan = plan.withColumns({"__epoch": whole, "__rest": F.col("budget") - whole * F.col("available"), "__ranges": F.greatest(F.lit(1), F.least(F.lit(1 << 20), F.floor(F.col("n_rows") / RANGE_ROWS)))})
    plan = work.save(plan.select(*tree, "__epoch", "__rest", "__ranges"), "plan")
    placed = place(seed, F.col("__epoch"))
    keyed = narrow.join(plan, tree).withColumn("__place", placed).withColumn("__range", hash_range(F.col("__place"), F.col("__ranges")))
    sums = keyed.groupBy(*tree, "__range").agg(F.sum("__tokens").alias("__sum"), F.first("__rest").alias("__rest"))
    upto = F.sum("__sum").over(Window.partitionBy(*tree).orderBy("__range"))
    edge = sums.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__sum")).filter("__from <= __rest and __upto > __rest")
    edge = work.save(edge.select(*tree, "__range", "__from"), "edge")
    running = F.sum("__tokens").over(Window.partitionBy(*tree).orderBy("__place").rangeBetween(Window.unboundedPreceding, 0))
    last = keyed.join(edge, [*tree, "__range"]).withColumn("__running", F.col("__from") + running).filter("__running <= __rest").groupBy(*tree).agg(F.max("__place").alias("__last"))
    cuts = work.save(plan.join(edge.select(*tree, F.col("__range").alias("__edge")), tree, "left").join(last, tree, "left"), "cuts")
    work.close(keep=("cuts",))
    met = rows.join(cuts, tree).withColumn("__place", placed).withColumn("__range", hash_range(F.col("__place"), F.col("__ranges")))
    taken = (F.col("__range") < F.col("__edge")) | ((F.col("__range") == F.col("__edge")) & (F.col("__place") <= F.col("__last")))
    copies = (F.col("__epoch") + F.coalesce(taken, F.lit(False)).cast("int")).cast("int")
    return met.withColumn("copies", copies).filter("copies > 0").drop("__epoch", "__rest", "__ranges", "__place", "__range", "__edge", "__last")

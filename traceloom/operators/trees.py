"""Trees of processes: depths and sums over subtrees by pointers that double their reach.

A node holds one pointer, so a round moves as many rows as there are nodes, and a tree of any depth ends after a
logarithmic number of rounds; pairs of ancestor and descendant are never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.ranks import running_sum
from traceloom.store import write_table

#: How a value of a node takes in those of the nodes below it.
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def linked(nodes: DataFrame, by: list[str], node: str = "pid", parent: str = "ppid", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, up, *keep): up is the parent where that is a node too and not the node itself, else null. A node stands there once."""
    known = nodes.select(*by, F.col(node).alias(parent)).distinct().withColumn("__known", F.lit(True))
    up = F.when(F.col("__known") & (F.col(parent) != F.col(node)), F.col(parent))
    return nodes.join(known, [*by, parent], "left").select(*by, F.col(node).alias("node"), up.alias("up"), *keep)


def _round(table: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Values first go up by the pointers, which then double; both work on rows dealt by node."""
    if values:
        own = [F.lit(True).alias("__own"), *by, "node", "up", "steps", *values]
        given = table.where("up IS NOT NULL").select(F.lit(False).alias("__own"), *by, F.col("up").alias("node"), F.lit(None).cast(table.schema["up"].dataType).alias("up"), F.lit(0).alias("steps"), *values)
        at_own = [F.max(F.when(F.col("__own"), F.col(c))).alias(c) for c in ("up", "steps")]
        table = table.select(*own).unionByName(given).groupBy(*by, "node").agg(*at_own, *(FOLDS[f](v).alias(v) for v, f in values.items()))
    far = table.select(*by, F.col("node").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"))
    return table.join(far, [*by, "up"], "left").select(*by, "node", F.col("__up").alias("up"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), *values)


def climbed(links: DataFrame, by: list[str], values: dict[str, str] | None = None, at_once: int | None = None) -> DataFrame:
    """(*by, node, depth, *values): the number of steps to a node without `up`, and each value folded over the node and
    all below it. values: column -> sum, min or max; nulls count as absent.

    After k rounds a node points 2^k steps up and its value covers what lies less than 2^k below. Nodes that lead into a
    circle have depth null; min and max are right for them, for sums the links along a circle are cut. `at_once` rounds are
    planned together and then written, so lost executors cost no more than those.
    """
    values = values or {}
    at_once = at_once or (1 if values else 2)
    table = write_table(links.select(*by, "node", "up", F.col("up").isNotNull().cast("int").alias("steps"), *values), "climb")
    count = lambda t: t.agg(F.count("*"), F.count("up")).first()
    (n, open_), reach, now = count(table), 1, table
    while open_ and reach <= n:
        for _ in range(at_once):
            now, reach = _round(now, by, values), 2 * reach
        now = write_table(now, "climb")
        open_ = count(now)[1]
    if open_ and "sum" in values.values():  # what 2^k >= n steps lead to lies on a circle, and all of it
        circle = now.where("up IS NOT NULL").select(*by, F.col("up").alias("node")).distinct().withColumn("__on", F.lit(True))
        cut = links.join(circle, [*by, "node"], "left").withColumn("up", F.when(F.col("__on").isNull(), F.col("up"))).drop("__on")
        sums = climbed(cut, by, values, at_once).drop("depth")
        return now.select(*by, "node", F.when(F.col("up").isNull(), F.col("steps")).alias("depth")).join(sums, [*by, "node"])
    return now.select(*by, "node", F.when(F.col("up").isNull(), F.col("steps")).alias("depth"), *values)


def preorder(links: DataFrame, by: list[str]) -> DataFrame:
    """(*by, node, top, depth, place, size): a node and all below it are `size` neighbours of their tree, from `place` on; top is
    the tree's node without `up`, at place 0. Nodes that lead into a circle have no row. links: (*by, node, up), each node once.

    A node's place is that of its parent, plus 1, plus the sizes of the siblings before it; so it is a sum along the way to
    the top, by pointers that double.
    """
    sized = climbed(links.withColumn("size", F.lit(1).cast("bigint")), by, {"size": "sum"}).where("depth IS NOT NULL")
    sized = write_table(sized.join(links.select(*by, "node", "up"), [*by, "node"]), "sizes")
    below = running_sum(sized.where("up IS NOT NULL"), [*by, "up"], ["node"], F.col("size"), "__upto")
    none = F.lit(None).cast(sized.schema["node"].dataType)
    now = below.select(*by, "node", "up", none.alias("top"), (F.col("__upto") - F.col("size") + 1).alias("place"))
    now = now.unionByName(sized.where("up IS NULL").select(*by, "node", "up", F.col("node").alias("top"), F.lit(0).cast("bigint").alias("place")))
    now = write_table(now, "places")
    while now.where("up IS NOT NULL").limit(1).count():
        for _ in range(2):
            far = now.select(*by, F.col("node").alias("up"), F.col("up").alias("__up"), F.col("top").alias("__top"), F.col("place").alias("__place"))
            met = now.where("up IS NOT NULL").join(far, [*by, "up"])
            met = met.select(*by, "node", F.col("__up").alias("up"), F.col("__top").alias("top"), (F.col("place") + F.col("__place")).alias("place"))
            now = met.unionByName(now.where("up IS NULL"))
        now = write_table(now, "places")
    return now.drop("up").join(sized.drop("up"), [*by, "node"]).select(*by, "node", "top", "depth", "place", "size")

"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.store import drop_table, read_table, save_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node that it knows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them; edges point down already."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    ends = F.explode(F.array("a", "b")).alias("a")
    return joined.select(ends, F.col("m").alias("b")).where("a <> b").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, component): every node but the smallest of its component, with that smallest.

    Rounds end when the table stays as it is, after a number of rounds logarithmic in the number of nodes.
    Self loops, repeated and null-ended pairs are dropped; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    path, mark = save_table(now, "edges"), None
    while True:
        table = read_table(spark, path, now)
        new = table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark or new[0] == 0:
            return table.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark, old = new, path
        path = save_table(_small_star(_large_star(table)), "edges")
        drop_table(spark, old)

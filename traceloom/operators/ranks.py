"""Running sums and percentiles of keys of any size: rows are cut by ranges of key and order, not by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.store import write_table


def running_sum(df: DataFrame, by: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """df with the sum of `amount` over the rows of a key up to each, in ascending order.

    Rows are dealt by ranges of (by, order) and written, so a key of most rows lies in many parts; sums run inside a
    part, and start at the total of the parts before, of which there is one number a key and part. Rows that are equal in
    by and order lie in one part, in no certain order among themselves.
    """
    ranged = df.withColumn("__a", amount).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    table = write_table(ranged, "ranges")
    totals = table.groupBy(*by, "__part").agg(F.sum("__a").alias("__t"))
    # without a key: over one number a part
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.sum("__t").over(earlier)).where("__before IS NOT NULL")
    before = before.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), "__before")
    same = [table[c].eqNullSafe(before[f"__{c}"]) for c in by]
    on = table["__part"] == before["__p"]
    for s in same:
        on = on & s
    joined = table.join(before, on, "left")
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.coalesce("__before", F.lit(0)) + F.sum("__a").over(inside)).select(*df.columns, name)


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place of each row among those of its key, from 1; as row_number over a window, for keys of any size."""
    return running_sum(df, by, order, F.lit(1), name)


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(*by, *points): continuous percentiles of the values of each key that are not null, by linear interpolation
    between the two ranks around each point.

    Rows are first counted by key and value, then summed up along the values, so no task holds the values of a key. Keys
    without a value have no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    ranked = running_sum(counts, by, [value], F.col("__n"), "__upto")
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__all")).select(*(F.col(c).alias(f"__k_{c}") for c in by), "__all")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    rows = ranked.join(totals, on)
    at = {n: F.lit(float(p)) * (F.col("__all") - 1) for n, p in points.items()}
    holds = lambda rank: (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
    low = {n: F.max(F.when(holds(F.floor(a)), F.col(value))) for n, a in at.items()}
    high = {n: F.max(F.when(holds(F.ceil(a)), F.col(value))) for n, a in at.items()}
    part = {n: F.max(a - F.floor(a)) for n, a in at.items()}
    return rows.groupBy(*by).agg(*((low[n] + (high[n] - low[n]) * part[n]).alias(n) for n in points))

"""Buckets whose rows meet in one task: hot ones are dealt out as pairs of chunks, and read back group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, keys: list[str], by: Column, cap: int) -> DataFrame:
    """Adds i, j and own and puts rows of (keys, i, j) in one partition.

    Buckets of over `cap` rows are cut into chunks by `by`; each chunk meets each other (and itself) in a
    group (i, j) of its own, so every pair of rows meets and no task gets an unbounded group. own: the row's chunk; in
    a group of two chunks, rows of one chunk have met elsewhere.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > cap)
    large = large.select(*keys, F.ceil(F.col("n") / cap).cast("int").alias("chunks"))
    rows = rows.join(large, keys, "left").withColumn("own", F.coalesce(F.pmod(by, "chunks").cast("int"), F.lit(0)))
    spread = F.expr("CASE WHEN chunks IS NULL THEN array(struct(0 AS i, 0 AS j)) ELSE transform(sequence(0, chunks - 1), o -> struct(least(o, own) AS i, greatest(o, own) AS j)) END")
    rows = rows.withColumn("part", F.explode(spread)).select("*", "part.i", "part.j").drop("part", "chunks")
    return rows.repartition(*keys, "i", "j")


def complete(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run number, int64 values as columns) of whole groups, from batches sorted by integer keys; a group never comes in parts."""
    k, held = len(keys), np.zeros((0, len(keys) + len(values)), np.int64)

    def runs(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = (np.diff(part[:, :k], axis=0, prepend=part[:1, :k] - 1) != 0).any(axis=1)
        return np.cumsum(new), np.ascontiguousarray(part[:, k:].T)

    for batch in batches:
        held = np.concatenate([held, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys + values])])
        before = np.flatnonzero((held[:, :k] != held[-1, :k]).any(axis=1)) if len(held) else []
        if len(before):
            yield runs(held[: before[-1] + 1])
            held = held[before[-1] + 1 :]
    if len(held):
        yield runs(held)


def left_in_run(run: np.ndarray) -> np.ndarray:
    """For each row, the number of rows from it to the end of its run, itself included."""
    end = np.append(np.flatnonzero(np.diff(run)) + 1, len(run))
    return np.repeat(end, np.diff(end, prepend=0)) - np.arange(len(run))

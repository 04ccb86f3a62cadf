"""Approximate nearest neighbours: inverted lists of two levels, scanned with adaptive numbers of dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.store import write_table

SCHEMA = "query_id long, rank int, vec_id long, score double"
MOST_LISTS, MOST_PARTS = 1024, 256


@dataclass(frozen=True)
class Index:
    """What a bounded sample gives: a rotation, centroids, parts of lists that all lists share, and how many cells to probe.

    A cell is a list and one of the shared residuals; its centre is the sum of both.
    """

    rotation: np.ndarray
    centroids: np.ndarray
    residuals: np.ndarray
    probes: int
    ids: np.ndarray
    sample: np.ndarray
    cells: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        own = (x @ self.centroids.T).argmax(axis=1)
        rest = x - self.centroids[own]
        near = 2 * rest @ self.residuals.T - (self.residuals**2).sum(axis=1)
        return own * len(self.residuals) + near.argmax(axis=1)

    @cached_property
    def norms(self) -> np.ndarray:
        """Squared lengths of all centres: |c|^2 + |r|^2 + 2 c.r, one number a cell."""
        own = (self.centroids**2).sum(axis=1)[:, None] + (self.residuals**2).sum(axis=1)[None]
        return own + 2 * self.centroids @ self.residuals.T

    def distances(self, x: np.ndarray, cells: int = 1 << 21) -> Iterator[tuple[int, np.ndarray]]:
        """First row and distances to all centres (but for the rows' own lengths), for as many rows at a time as make about `cells` numbers."""
        step = max(1, cells // self.norms.size)
        for lo in range(0, len(x), step):
            some = x[lo : lo + step]
            yield lo, (self.norms[None] - 2 * (some @ self.centroids.T)[:, :, None] - 2 * (some @ self.residuals.T)[:, None, :]).reshape(len(some), -1)

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells of nearest centre, nearest first."""
        out = np.empty((len(x), min(n, self.norms.size)), np.int64)
        for lo, far in self.distances(x):
            first = np.argpartition(far, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            out[lo : lo + len(far)] = np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, 1), axis=1, kind="stable"), 1)
        return out

    def places(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells are nearer to each row than those of its row of `cells`."""
        out = np.empty(cells.shape, np.int64)
        for lo, far in self.distances(x):
            for i, row in enumerate(far, lo):
                out[i] = np.searchsorted(np.sort(row), row[cells[i]])
        return out


def sound(v: str) -> Column:
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, the largest component near 1: cosines stay the same to the bit, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int, sphere: bool) -> np.ndarray:
    """k-means; with sphere, of directions."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (2 * x @ centres.T - (0 if sphere else (centres**2).sum(axis=1))).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True) if sphere else np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def fit(ids: np.ndarray, x: np.ndarray, lists: int, parts: int, k: int, recall: float, seed: int, rounds: int = 12, trials: int = 300) -> Index:
    """Spherical k-means on the sample, k-means on what is left; probes: as many cells as find `recall` of the sample's own neighbours."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    x = unit(x)
    centroids = means(x, lists, rng, rounds, True)
    rest = x - centroids[(x @ centroids.T).argmax(axis=1)]
    residuals = means(rest, parts, rng, rounds, False) if parts > 1 else np.zeros((1, x.shape[1]))
    index = Index(rotation, centroids, residuals, 0, ids, x, np.zeros(0, np.int64))
    cells = index.assign(x)
    asked = rng.choice(len(x), min(trials, len(x)), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, : max(1, min(k, len(x) - 1))]
    needed = np.sort(index.places(x[asked], cells[best]).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
    return Index(rotation, centroids, residuals, probes, ids, x, cells)


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, steps: list[int], eps: float, block: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the rows of x that may be among its k nearest, by rotated unit vectors.

    Squared distances grow block of columns by block; after each a candidate is abandoned when the distance
    so far, scaled to all dimensions, exceeds the bound by more than the test with width eps allows. The bound is the
    k-th distance found so far, and tightens after every `block` rows.
    """
    dim = x.shape[1]
    edges = list(zip([0, *steps[:-1]], steps, strict=True))
    blocks = [np.ascontiguousarray(x[:, lo:hi]) for lo, hi in edges]
    squares = [(b * b).sum(axis=1) for b in blocks]
    for i, target in enumerate(q):
        limit_now, found, fars = bound[i], np.zeros(0, np.int64), np.zeros(0)
        for first in range(0, len(x), block):
            alive = np.arange(first, min(first + block, len(x)))
            alive = alive[ids[alive] != own[i]]
            far = 0.0
            for (lo, hi), b, square in zip(edges, blocks, squares, strict=True):
                part = target[lo:hi]
                far = far + square[alive] + part @ part - 2 * (b[alive] @ part)
                limit = limit_now if hi == dim else limit_now * (1 + eps / np.sqrt(hi)) ** 2 * hi / dim
                keep = far <= limit + 1e-9
                alive, far = alive[keep], far[keep]
                if not len(alive):
                    break
            if len(alive):
                found, fars = np.concatenate([found, alive]), np.concatenate([fars, far])
                if len(fars) > k:
                    limit_now = min(limit_now, np.partition(fars, k - 1)[k - 1])
                    keep = fars <= limit_now + 1e-9
                    found, fars = found[keep], fars[keep]
        yield i, found


def nearest(vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5, lists: int | None = None, parts: int | None = None, sample_rows: int = 8192, recall: float = 0.97, eps: float = 2.1, cap: int = 20_000, query_cap: int = 16_384, seed: int = 11) -> DataFrame:
    """The k rows of largest cosine for each row where `queries` holds: (query_id, rank, vec_id, score).

    Rotation, lists, the shared parts of lists and the number of cells (list and part) to probe are fitted on
    `sample_rows` rows (those of smallest id hash); cells grow with the table, about one for `cap` rows, up to MOST_LISTS x
    MOST_PARTS. Every row is indexed, and every query reads its probed cells whole. Queries go to the cells;
    a cell of over `cap` rows is split, and only one with over `query_cap` queries is read more than once. A query's
    bound is its k-th neighbour among the sample's rows in the probed cells, and tightens while it scans. Scores are
    cosines in double precision on the vectors as given; ties go to the smaller id. A query that found fewer than k
    rows reads all cells. Rows whose id or vector is null, zero, or holds null or non-finite components take no
    part; vectors of each length are searched by themselves. Rows with the query's id are its own; rows that repeat
    an id are one answer, of the best score. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_column).isNotNull()).withColumn("__q", F.coalesce(queries, F.lit(False)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col("__q").alias("asks")).where(sound("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count_if("asks").alias("asks"), F.count_distinct("id").alias("ids")).where("asks > 0 AND ids > 1").orderBy("n").collect()  # a row per length
    out = spark.createDataFrame([], SCHEMA)
    for s in sizes:
        per = lists or max(1, min(MOST_LISTS, round(s["rows"] ** 0.5 / 4)))
        split = parts or min(MOST_PARTS, -(-s["rows"] // (cap * per)))
        out = out.unionByName(_of_length(rows.where(F.size("v") == s["n"]), s["n"], s["ids"], k, per, split, sample_rows, recall, eps, cap, query_cap, seed))
    return out


def _of_length(rows: DataFrame, dim: int, n_ids: int, k: int, lists: int, parts: int, sample_rows: int, recall: float, eps: float, cap: int, query_cap: int, seed: int) -> DataFrame:
    taken = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    index = fit(taken.column("id").to_numpy(), matrix(taken.column("v")), lists, parts, k, recall, seed)
    held = rows.sparkSession.sparkContext.broadcast(index)  # sample_rows + MOST_LISTS + MOST_PARTS vectors at most
    n_cells = len(index.centroids) * len(index.residuals)
    steps = sorted({max(1, dim * i // 4) for i in range(1, 4)} | {dim})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, salt = held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                if not part.num_rows:
                    continue
                x, ids = unit(matrix(part.column("v"))), part.column("id").to_numpy()
                asks = np.flatnonzero(part.column("asks").to_numpy(zero_copy_only=False))
                probed: list = [None] * part.num_rows
                bound = np.full(part.num_rows, 5.0)
                if len(asks):
                    order = ix.order(x[asks], ix.probes)
                    if len(ix.ids) >= k:
                        near = x[asks] @ ix.sample.T
                        for i, cells in enumerate(order):
                            known = np.isin(ix.cells, cells) & (ix.ids != ids[asks[i]])
                            if known.sum() >= k:
                                bound[asks[i]] = 2 - 2 * np.partition(near[i, known], -k)[-k]
                    for i, at in enumerate(asks):
                        probed[at] = order[i].tolist()
                made = [part.column("id"), part.column("v"), pa.array(ix.assign(x).astype(np.int32)), pa.array(probed, pa.list_(pa.int32())), pa.array(bound), pa.array(salt + np.arange(part.num_rows))]
                salt += part.num_rows
                yield pa.RecordBatch.from_arrays(made, names=["id", "v", "own", "probed", "bound", "salt"])

    assigned = write_table(rows.mapInArrow(assign, "id long, v array<double>, own int, probed array<int>, bound double, salt long"), "vector-lists")

    def search(group: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if group.num_rows and asked.num_rows:
            x, ids = scaled(matrix(group.column("v"))), group.column("id").to_numpy()
            q, own = scaled(matrix(asked.column("qv"))), asked.column("qid").to_numpy()
            rotation, size = held.value.rotation, np.sqrt((x * x).sum(axis=1))
            for i, at in scan(x / size[:, None] @ rotation, ids, unit(q) @ rotation, own, asked.column("bound").to_numpy(), k, steps, eps):
                score = (x[at] * q[i]).sum(axis=1) / (size[at] * np.sqrt((q[i] * q[i]).sum()))
                best = np.lexsort((ids[at], -score))
                best = best[np.sort(np.unique(ids[at[best]], return_index=True)[1])][:k]  # the best of each id
                for a, b in zip(out, (np.full(len(best), own[i]), ids[at[best]], score[best]), strict=True):
                    a.append(b)
        flat = [np.concatenate(a) if a else np.zeros(0, t) for a, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(flat, names=["query_id", "vec_id", "score"])

    def top(asked: DataFrame) -> DataFrame:
        """asked: id, v, bound, probed. Cells are at most MOST_LISTS x MOST_PARTS, and so is what is broadcast."""
        asked = asked.select(F.col("id").alias("qid"), F.col("v").alias("qv"), "bound", "salt", F.explode("probed").alias("cell"))
        wanted = asked.groupBy("cell").agg(F.ceil(F.count("*") / query_cap).cast("int").alias("queries"))
        sized = assigned.groupBy(F.col("own").alias("cell")).agg(F.ceil(F.count("*") / cap).cast("int").alias("shares"))
        cells = F.broadcast(write_table(sized.join(wanted, "cell"), "cells"))
        place = assigned.select(F.col("own").alias("cell"), "id", "v", "salt").join(cells, "cell")
        place = place.select("cell", "id", "v", F.pmod(F.xxhash64("salt"), "shares").cast("int").alias("part"), F.explode(F.expr("sequence(0, queries - 1)")).alias("qpart"))
        asked = asked.join(cells, "cell").select("qid", "qv", "bound", "cell", F.explode(F.expr("sequence(0, shares - 1)")).alias("part"), F.pmod(F.xxhash64("salt"), "queries").cast("int").alias("qpart"))
        keys = ["cell", "part", "qpart"]
        found = place.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asking = assigned.where("probed IS NOT NULL")
    first = write_table(top(asking), "neighbours")
    short = asking.join(first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    short = short.where(F.coalesce("n", F.lit(0)) < min(k, n_ids - 1)).drop("n")
    if short.isEmpty():
        return first
    wide = short.withColumn("probed", F.sequence(F.lit(0), F.lit(n_cells - 1))).withColumn("bound", F.lit(5.0))
    return first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(top(wide))


def op6_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)

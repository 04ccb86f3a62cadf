"""Vector code compression: integer codebooks of consecutive parts, learned in rounds of assignments and means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.store import write_table

MOST = 1 << 62


def integers(v: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; what is beyond 2^62 counts as 2^62 with its sign."""
    return F.transform(F.col(v).cast("array<double>"), lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * scale))))


def finite(v: str) -> Column:
    """A vector without null and non-finite components."""
    x = F.col(v).cast("array<double>")
    return F.coalesce(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def int_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def largest(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


def widened(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are, or as whole numbers of any size where a sum of int64 products might overflow."""
    if max(largest(x), largest(books), 1) ** 2 * 4 * max(1, x.shape[-1]) < 1 << 63:
        return x, books
    return x.astype(object), books.astype(object)


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (the first, on ties) and its squared distance; x (rows, parts, width), books (parts, entries, width)."""
    x, books = widened(x, books)
    code = np.empty(x.shape[:2], np.int64)
    far = np.empty(x.shape[:2], x.dtype)
    for p in range(x.shape[1]):
        own, book = x[:, p], books[p]
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ book.T) + (book * book).sum(axis=1)[None]
        code[:, p] = d.argmin(axis=1)
        far[:, p] = np.take_along_axis(d, code[:, p, None], axis=1)[:, 0]
    return code, far


def parted(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width): equal consecutive parts; the last are filled up with zeros."""
    width = -(-x.shape[1] // parts)
    padded = np.zeros((len(x), parts * width), x.dtype)
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), parts, width)


def learn_codebooks(vectors: DataFrame, id_column: str, column: str, dim: int, parts: int, entries: int, rounds: int, cells: int = 1 << 21) -> np.ndarray:
    """Codebooks (parts, entries, width) of the integer vectors of length `dim`.

    They start as the vectors of the smallest ids. A round broadcasts them (a fixed size), assigns all parts in Arrow batches, and adds
    up rows and components of each entry: once inside each task, then by one grouped shuffle of at most parts x entries x width
    rows a task. Means are floors of exact quotients; entries without rows stay.
    """
    spark = vectors.sparkSession
    first = vectors.orderBy(F.col(id_column).asc_nulls_last(), column).limit(entries).select(column).toArrow()  # `entries` vectors
    books = parted(int_matrix(first.column(column).combine_chunks(), dim), parts).transpose(1, 0, 2).copy()
    size, width = books.shape[1], books.shape[2]

    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(books_shape, object), np.zeros(books_shape[:2], np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, max(1, cells // max(dim, size))):
                    x = parted(int_matrix(batch.column(column).slice(lo, max(1, cells // max(dim, size))), dim), parts)
                    code = coded(x, held.value)[0]
                    exact = largest(x) * len(x) < 1 << 62
                    for p in range(parts):
                        order = np.argsort(code[:, p], kind="stable")
                        some, at = np.unique(code[order, p], return_index=True)
                        own = x[order, p] if exact else x[order, p].astype(object)
                        sums[p, some] += np.add.reduceat(own, at, axis=0).astype(object)
                        counts[p, some] += np.diff(np.append(at, len(x)))
            p, e = np.nonzero(counts)
            if len(p):
                flat = np.stack([np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p))])
                total = pa.array([str(s) for s in sums[p, e].ravel()], pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(a) for a in flat), total, pa.array(np.repeat(counts[p, e], width))], names=["p", "e", "i", "s", "n"])

        books_shape = books.shape
        made = vectors.select(column).mapInArrow(tally, "p long, e long, i long, s string, n long")
        merged = made.groupBy("p", "e", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # parts x entries x width rows at most
        books = books.copy()
        for r in merged:
            books[r["p"], r["e"], r["i"]] = int(r["s"]) // r["n"]
        held.unpersist()
    return books


def encode_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, cells: int = 1 << 21) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each row whose vector holds no null or non-finite component.

    Components become floor(scale * x); vectors are cut into `parts` parts of equal width, each coded by the nearest of
    `entries` entries (at most 256: two hex digits), first on ties, after `rounds` rounds of learning. error is the squared
    distance over all parts, label_error its sum over the rows of an equal label, null being one label; both stop at the
    largest long. Vectors of each length have codebooks of their own; a length that `parts` does not divide is filled up with
    zeros; empty vectors have empty parts, code 0 and error 0. Fewer rows than entries give fewer entries. Rows that repeat count as
    often as they stand there, those of null id last in the choice of first entries. Sums of labels are
    aggregated before the join, so a label of most rows is no hot group. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite(vector)).select(F.col(id_column).alias("id"), integers(vector, scale).alias("x"), F.col(label).alias("l"))
    table = write_table(rows, "integer-vectors")
    sizes = [r[0] for r in table.select(F.size("x").alias("n")).distinct().orderBy("n").collect()]  # a row per length
    done = spark.createDataFrame([], "id long, l string, code string, error decimal(38,0), codebooks_sha256 string")
    done = done.select(F.col("id").cast(table.schema["id"].dataType), F.col("l").cast(table.schema["l"].dataType), "code", "error", "codebooks_sha256")
    for dim in sizes:
        own = table.where(F.size("x") == dim)
        books = learn_codebooks(own, "id", "x", dim, parts, entries, rounds, cells)
        digest = hashlib.sha256(",".join(str(c) for c in books.ravel().tolist()).encode()).hexdigest()
        held = spark.sparkContext.broadcast(books)  # parts x entries x width numbers
        done = done.unionByName(own.mapInArrow(_coder(held, dim, parts, cells), _with(own, "code string, error string")).select("id", "l", "code", F.col("error").cast("decimal(38,0)").alias("error"), F.lit(digest).alias("codebooks_sha256")))
    codes = write_table(done, "vector-codes")
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = codes.groupBy(F.col("l").alias("__l")).agg(F.least(F.sum("error"), top).cast("long").alias("label_error"))
    joined = codes.join(total, F.col("l").eqNullSafe(F.col("__l")))
    return joined.select(F.col("id").alias(id_column), "code", F.least("error", top).cast("long").alias("error"), "label_error", "codebooks_sha256")


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in ("id", "l")] + [more])


def _coder(held, dim: int, parts: int, cells: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, cells // max(dim, held.value.shape[1]))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                if not batch.num_rows:
                    continue
                at, far = coded(parted(int_matrix(batch.column("x"), dim), parts), held.value)
                text = pa.array([bytes(row).hex() for row in at.astype(np.uint8)], pa.string())
                error = pa.array([str(e) for e in far.sum(axis=1)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("l"), text, error], names=["id", "l", "code", "error"])

    return code


def op13_codebooks(spark, sf_dir: str) -> DataFrame:
    return encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.buckets import deal, left_in_run
from traceloom.llm.components import star_components
from traceloom.llm.store import write_table


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y, z = x.reshape(len(x), n // (2 * h), 2, h), np.empty((len(x), n // (2 * h), 2, h), x.dtype)
        np.add(y[:, :, 0], y[:, :, 1], out=z[:, :, 0])
        np.subtract(y[:, :, 0], y[:, :, 1], out=z[:, :, 1])
        x, h = z.reshape(len(x), n), 2 * h
    return x


def probes(x: np.ndarray, tables: int, hashes: int, extra: int, seed: int) -> np.ndarray:
    """Bucket keys (rows, tables, 1 + extra) of unit vectors: the own bucket, then those that a small turn would give.

    A hash is the signed axis nearest to the vector after three rounds of random signs and Hadamard transform.
    """
    rows, dim = x.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((rows, size), np.float32)  # a bucket needs no more; links are verified in double precision
    padded[:, :dim] = x
    rng, alts = np.random.default_rng((seed, size)), min(3, 2 * size)
    out = np.empty((rows, tables, 1 + extra), np.int64)
    for t in range(tables):
        own, cost, change = np.zeros(rows, np.int64), [], []
        for k in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * (rng.choice([-1.0, 1.0], size) / np.sqrt(size)).astype(np.float32))
            y = np.concatenate([y, -y], axis=1)
            order = np.argpartition(-y, alts - 1, axis=1)[:, :alts]
            height = np.take_along_axis(y, order, 1)
            by = np.lexsort((order, -height), axis=1)
            order, height = np.take_along_axis(order, by, 1), np.take_along_axis(height, by, 1)
            scale = (2 * size) ** k
            own += order[:, 0] * scale
            for j in range(1, alts):
                cost.append(height[:, 0] - height[:, j])
                change.append((order[:, j] - order[:, 0]) * scale)
        cost, change = np.stack(cost, 1), np.stack(change, 1)
        near = np.argsort(cost, axis=1, kind="stable")[:, :extra]
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + np.take_along_axis(change, near, 1)
    return out


@functools.cache
def layout(bits: int, rows: int, least: float, extra: int, miss: float, seed: int, hashes: int | None = None, tables: int | None = None) -> tuple[int, int]:
    """(tables, hashes) for vectors of up to 2 ** bits components, of which a label has `rows`.

    As many hashes, two at least, as give eight buckets a row, and as many tables as leave a pair of cosine `least` apart
    with a chance of `miss` at most; the chance to meet in one table is measured on made-up pairs of just that cosine.
    """
    size = 1 << bits
    if hashes is None:
        hashes = 2
        while (2 * size) ** hashes < 8 * rows and (2 * size) ** (hashes + 1) < 1 << 62:
            hashes += 1
    if tables is None:
        rng = np.random.default_rng((seed, bits))
        n = max(200, min(2000, (1 << 18) >> bits))
        x, z = rng.standard_normal((2, n, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        near = least * x + np.sqrt(max(0.0, 1 - least * least)) * z
        a, b = (probes(v, 8, hashes, extra, seed) for v in (x, near))
        same = a[:, :, :, None] == b[:, :, None, :]
        same[:, :, 1:, 1:] = False
        chance = same.any(axis=(2, 3)).mean()
        tables = max(1, math.ceil(math.log(miss) / math.log(1 - min(max(chance, 1e-3), 0.999))))
    return tables, hashes


def meeting(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first (table, key) at which the pairs a, b meet: in the own bucket of one of them at least."""
    if len(a) > 16_384:
        parts = [meeting(keys, a[lo : lo + 16_384], b[lo : lo + 16_384]) for lo in range(0, len(a), 16_384)]
        return np.concatenate([t for t, _ in parts]), np.concatenate([k for _, k in parts])
    same = keys[a][:, :, :, None] == keys[b][:, :, None, :]
    same[:, :, 1:, 1:] = False
    key = np.where(same, keys[a][:, :, :, None], np.iinfo(np.int64).max).reshape(len(a), keys.shape[1], -1).min(axis=2)
    table = same.any(axis=(2, 3)).argmax(axis=1)
    return table, key[np.arange(len(a)), table]


def cosines(x: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (x[a] * x[b]).sum(axis=1) / (size[a] * size[b])


def close_pairs(x: np.ndarray, size: np.ndarray, run: np.ndarray, probed: np.ndarray, own: np.ndarray, mixed: np.ndarray, least: float, small: int = 48, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a run, not both probed, of cosine `least` or more. mixed: only rows of unlike own are tried.

    Small runs are compared step by step, all at a time; a larger one by blocks of one matrix product, and what
    comes near the bound is decided by the plain sum.
    """
    counts = np.bincount(run - run[0])
    n = counts[run - run[0]]
    left, at, step = left_in_run(run), np.flatnonzero(n <= small), 0
    while len(at):
        step += 1
        at = at[left[at] > step]
        a = at[((probed[at] & probed[at + step]) == 0) & ((mixed[at] == 0) | (own[at] != own[at + step]))]
        for lo in range(0, len(a), 50_000):
            some = a[lo : lo + 50_000]
            good = some[cosines(x, size, some, some + step) >= least]
            if len(good):
                yield good, good + step
    first = np.cumsum(counts) - counts
    for f, m in zip(first[counts > small].tolist(), counts[counts > small].tolist(), strict=True):
        u = x[f : f + m] / size[f : f + m, None]
        for lo in range(0, m, max(1, block // m)):
            hi = min(m, lo + max(1, block // m))
            a, b = np.nonzero(u[lo:hi] @ u[lo:].T >= least - 1e-9)
            a, b = a + f + lo, b + f + lo
            keep = (a < b) & ((probed[a] & probed[b]) == 0) & ((mixed[a] == 0) | (own[a] != own[b]))
            a, b = a[keep], b[keep]
            for at in range(0, len(a), 50_000):
                p, q = a[at : at + 50_000], b[at : at + 50_000]
                good = cosines(x, size, p, q) >= least
                yield p[good], q[good]


def joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest row that each row reaches over the pairs."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def embedding_groups(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, tables: int | None = None, hashes: int | None = None, extra: int = 3, miss: float = 2e-5, cap: int = 8192, seed: int = 7) -> DataFrame:
    """One row per row of vectors: (id, n_links, component_id, kept).

    Rows link when their labels are equal and not null and the cosine, in double precision, is `least` or more.
    Equal vectors of a label are one class, so copies are counted and not paired; classes meet in tables of
    cross-polytope hashes, in the own bucket and `extra` probed ones. The hashes of a table grow with the classes of the largest
    label, so that buckets stay nearly empty but for neighbours, and the tables with them, so that a link of cosine `least` is missed
    with a chance of `miss`; both can be given (see `layout`; counted for each power of two that holds a vector). Buckets with
    company get the vectors, candidates are verified there, and a link counts in the first bucket in which its two classes meet;
    so no link is false or counted twice, and no row per pair leaves a task. Hot buckets are dealt out as chunk pairs.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different length or rows with a null label or id: n_links 0, component_id their own id. kept is false
    for a null id. Rows that repeat an id count as vectors of their own. An empty table gives an empty result.
    """
    if extra > 2 * (hashes or 2):
        raise ValueError("extra is at most twice hashes")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(sound & F.col("l").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    good = rows.where(sound).withColumn("h", F.xxhash64("l", "v"))
    classes = good.groupBy("h", "l", "v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = write_table(classes.withColumn("c", F.monotonically_increasing_id()), "vectors")

    bits = F.length(F.bin(F.size("v") - 1))
    most = classes.groupBy("l", bits.alias("bits")).agg(F.count("*").alias("n")).groupBy("bits").agg(F.max("n").alias("n")).collect()  # a row per power of two
    layouts = {r["bits"]: layout(r["bits"], r["n"], least, extra, miss, seed, hashes, tables) for r in most}

    def sized(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of each length of vector, and their vectors times a power of two."""
        sizes = pc.list_value_length(column).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), size)
            yield at, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in sized(batch.column("v")):
                key = probes(x / np.linalg.norm(x, axis=1, keepdims=True), *layouts[max(1, (x.shape[1] - 1).bit_length())], extra, seed)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("l1"), part.column("l2"), part.column("c"), pa.array(list(key.reshape(len(at), -1)), pa.list_(pa.int64()))], names=["l1", "l2", "c", "keys"])

    # a label and a length of vector by two hashes
    labelled = classes.select(F.xxhash64("l", F.size("v")).alias("l1"), F.xxhash64(F.size("v"), "l", F.lit(1)).alias("l2"), "c", "v")
    signed = write_table(labelled.mapInArrow(sign, "l1 long, l2 long, c long, keys array<long>"), "vector-keys")
    bucket = ["l1", "l2", "tab", "key"]
    buckets = signed.select("l1", "l2", "c", F.posexplode("keys").alias("place", "key"))
    buckets = buckets.select("l1", "l2", F.floor(F.col("place") / (1 + extra)).alias("tab"), "key", "c", (F.col("place") % (1 + extra) > 0).cast("long").alias("probed"))
    company = buckets.groupBy(*bucket).agg(F.count("*").alias("m"), F.min("probed").alias("p")).where("m > 1 AND p = 0").select(*bucket)
    dealt = deal(buckets.join(company, bucket, "left_semi"), bucket, F.xxhash64("c"), cap)
    carried = classes.select("c", "n", "v").join(signed.select("c", "keys"), "c")
    groups = [*bucket, "i", "j"]
    met = dealt.join(carried, "c").repartition(*groups).sortWithinPartitions(*groups, "c")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, x in sized(part.column("v")):
                some = part.take(pa.array(at))
                own = {c: some.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*groups, "c", "n", "probed", "own"]}
                run = np.cumsum(np.any([np.diff(own[c], prepend=own[c][:1] - 1) != 0 for c in groups], axis=0))
                keys = some.column("keys").flatten().to_numpy().reshape(len(at), -1, 1 + extra)
                size, m, label = np.sqrt((x * x).sum(axis=1)), np.zeros(len(at), np.int64), np.arange(len(at))
                for a, b in close_pairs(x, size, run, own["probed"], own["own"], (own["i"] != own["j"]).astype(np.int64), least):
                    label = joined(len(at), a, b, label)
                    tab, key = meeting(keys, a, b)
                    here = (tab == own["tab"][a]) & (key == own["key"][a])
                    np.add.at(m, a[here], own["n"][b[here]])
                    np.add.at(m, b[here], own["n"][a[here]])
                counted, star = np.flatnonzero(m), np.flatnonzero(label != np.arange(len(at)))
                made = [np.concatenate([own["c"][counted], own["c"][star]]), np.concatenate([own["c"][counted], own["c"][label[star]]]), np.concatenate([m[counted], np.zeros(len(star), np.int64)])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["a", "b", "m"])

        for batch in batches:  # whole groups only
            k = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in groups])
            if not len(k):
                continue
            other = np.flatnonzero((k != k[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and any(held[-1].column(c)[-1].as_py() != int(k[0, i]) for i, c in enumerate(groups)):
                yield from links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            if cut:
                yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    found = write_table(met.mapInArrow(verify, "a long, b long, m long").groupBy("a", "b").agg(F.sum("m").alias("m")), "vector-links")
    labels = star_components(found.select("a", "b")).withColumnRenamed("node", "c")
    more = found.where("m > 0").select(F.col("a").alias("c"), "m")
    named = classes.select("h", "l", "v", "least", "n", "c").join(more, "c", "left").join(labels, "c", "left")
    named = named.withColumn("group", F.coalesce("component", "c"))
    least_id = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(least_id, "group").select(F.col("h").alias("__h"), F.col("l").alias("__l"), F.col("v").alias("__v"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(named, (F.col("h") == F.col("__h")) & (F.col("l") == F.col("__l")) & (F.col("v") == F.col("__v"))).select("id", "n_links", "component_id")
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

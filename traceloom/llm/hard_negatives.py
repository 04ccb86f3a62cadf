"""Hard negatives by a distributed kNN join: candidates go only to the groups of anchors that they might serve."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.ann import means
from traceloom.llm.codebooks import finite, int_matrix, integers, largest
from traceloom.llm.store import write_table

MOST_GROUPS = 1024
MOST_SCORE = 1 << 56


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact up to MOST_SCORE, where they stop.

    Below 2^53 sums of doubles are exact, and so the fast product is; beyond, numbers of any size are taken.
    """
    bound = largest(q) * largest(x) * max(1, q.shape[1])
    if bound < 1 << 53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -MOST_SCORE, MOST_SCORE).astype(np.int64)


@dataclass(frozen=True)
class Space:
    """Pivots, and the largest norm of all candidates.

    A candidate x stands at (x, sqrt(top^2 - |x|^2)), an anchor and a pivot at (a, 0). All candidates have norm `top` there, so
    the largest inner product is the smallest distance, and the triangle inequality bounds it. Distances are widened by
    more than their rounding, so bounds err to the safe side.
    """

    pivots: np.ndarray
    top: float

    def from_pivots(self, x: np.ndarray, augmented: bool) -> np.ndarray:
        x = x.astype(np.float64)
        own = np.full(len(x), self.top**2) if augmented else (x * x).sum(axis=1)
        far = own[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(far, 0))

    def reach(self, a: np.ndarray, score: np.ndarray, side: float) -> np.ndarray:
        """The distance from anchors at which candidates have the score; side: 1 a little more, -1 a little less."""
        both = (a.astype(np.float64) ** 2).sum(axis=1) + self.top**2
        return np.sqrt(np.maximum(both - 2 * score + side * self.slack**2, 0))

    @property
    def slack(self) -> float:
        return 1e-4 * (self.top + float(np.sqrt((self.pivots**2).sum(axis=1)).max(initial=0)) + 1)


@dataclass(frozen=True)
class Sample:
    """A bounded sample of classes: scores against it bound each anchor's k-th best from below."""

    x: np.ndarray
    label: np.ndarray
    rows: np.ndarray


def kth(scores: np.ndarray, rows: np.ndarray, k: int) -> float:
    """The k-th largest score, each taken `rows` times; minus infinity where there are fewer."""
    order = np.argsort(-scores, kind="stable")
    at = np.searchsorted(np.cumsum(rows[order]), k)
    return float(scores[order[at]]) if at < len(order) else -np.inf


def best(scores: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, id, class) of the k rows of largest score, ties to the smaller id; class i has count[i] ids from first[i]."""
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    own = np.repeat(some, count[some])
    at = np.repeat(first[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(len(own))
    order = np.lexsort((ids[at], -scores[own]))[:k]
    return scores[own[order]], ids[at[order]], own[order]


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest score of a negative for each positive's score: low and high percent of it."""
    return -((-low * scores) // 100), (high * scores) // 100


def hard_negatives(vectors: DataFrame, anchors: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, per_group: int = 128, cells: int = 1 << 21, sample_rows: int = 8192, seed: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where `anchors` holds.

    Components become floor(scale * x); scores are inner products, larger first, ties to the smaller id. An anchor's
    positives are its first `positives` other rows of its label; the negatives of each pair the first `negatives` rows of other
    labels whose score is at least `low` and at most `high` percent of the positive's.

    Rows of equal label and vector are one class; of its ids the few smallest are kept, as no answer can hold more, and
    anchors of a class are searched once. Anchors are grouped by their nearest pivot. Scores against a bounded sample
    bound each anchor's answers, and so the distances from the pivot between which a candidate must lie to serve any
    anchor of the group: only those are sent there, then joined exactly. Groups of many candidates or anchors are split by
    count, so that a task holds about `cells` numbers of each side. Nothing is dropped: the bounds are safe ones.

    Rows with a null id, label or vector, or a null or non-finite component take no part; nor do vectors of unlike length
    meet. Rows equal in id, label and vector count once; other rows of an anchor's id are rows like any other. Inner products beyond 2^56
    count as 2^56 with their sign. An empty table gives no rows.
    """
    keep = max(positives + 1, negatives)
    good = finite(vector) & F.col(id_column).isNotNull() & F.col(label).isNotNull()
    rows = vectors.where(good).select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("l"), integers(vector, scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    same = ["h", "l", "v"]
    rows = rows.withColumn("h", F.xxhash64("l", "v")).groupBy(*same, "id").agg(F.max("asks").alias("asks"))
    place = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    firsts = rows.withColumn("n", place).where(F.col("n") <= keep).groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asking = rows.where("asks").groupBy(*same).agg(F.lit(True).alias("asks"))
    classes = firsts.join(asking, same, "left").withColumn("c", F.monotonically_increasing_id())
    classes = write_table(classes.select("c", *same, F.size("v").alias("dim"), "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "vector-classes")
    own = write_table(rows.where("asks").select(*same, "id").join(classes.where("asks").select(*same, "c"), same).select("id", "c"), "anchor-rows")

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = classes.groupBy("dim").agg(F.count("*").alias("rows"), F.count_if("asks").alias("asks"), F.max(norm).alias("top")).where("asks > 0").orderBy("dim").collect()  # a row per length
    plus = rows.sparkSession.createDataFrame([], "c long, score long, id long, cls long")
    minus = rows.sparkSession.createDataFrame([], "c long, p long, score long, id long")
    for s in sizes:
        a, b = _of_length(classes.where(F.col("dim") == s["dim"]), s["dim"], s["rows"], s["asks"], s["top"], positives, negatives, low, high, per_group, cells, sample_rows, seed)
        plus, minus = plus.unionByName(a), minus.unionByName(b)

    mates = plus.groupBy("c").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "cls"))).alias("mates"))  # positives + 1 at most
    pairs = own.join(mates, "c").select("c", F.col("id").alias("anchor_id"), F.explode(F.slice(F.filter("mates", lambda m: (m["id"] != F.col("id")) | (m["cls"] != F.col("c"))), 1, positives)).alias("m"))
    pairs = pairs.select("c", "anchor_id", F.col("m.id").alias("positive_id"), (-F.col("m.less")).alias("positive_score"))
    found = minus.groupBy("c", F.col("p").alias("positive_score")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("found"))
    out = pairs.join(found, ["c", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("n", "f"))
    return out.select("anchor_id", "positive_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"), "positive_score", (-F.col("f.less")).alias("negative_score"))


def _of_length(classes: DataFrame, dim: int, n: int, n_asking: int, top: float, positives: int, negatives: int, low: int, high: int, per_group: int, cells: int, sample_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession
    order = F.xxhash64("c")
    taken = classes.select("v", "l", F.size("ids").alias("k")).orderBy(order, "c").limit(sample_rows).toArrow()
    starts = classes.where("asks").select("v").orderBy(order, "c").limit(sample_rows).toArrow()
    groups = max(1, min(MOST_GROUPS, -(-n_asking // per_group)))
    pivots = means(int_matrix(starts.column("v").combine_chunks(), dim).astype(np.float64), groups, np.random.default_rng(seed), 8, False)
    sample = Sample(int_matrix(taken.column("v").combine_chunks(), dim), np.array(taken.column("l").to_pylist(), object), taken.column("k").to_numpy())
    held = spark.sparkContext.broadcast((Space(pivots, top * (1 + 1e-9)), sample))  # MOST_GROUPS and sample_rows vectors

    def bound(score: Callable[[np.ndarray, str, list], tuple[list[int], list[int]]]):
        """Adds to anchor classes their group, the bounds (low, high) of each wanted score, and how near and far from the pivot candidates lie."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, known = held.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    a = int_matrix(batch.column("v"), dim)
                    far, all_scores = space.from_pivots(a, False), products(a, known.x)
                    wanted = batch.column("wanted").to_pylist()
                    limits = [score(all_scores[i], label, wanted[i]) for i, label in enumerate(batch.column("l").to_pylist())]
                    g = far.argmin(axis=1)
                    d = far[np.arange(len(g)), g]
                    near = space.reach(a, np.array([max(h) for _, h in limits], float), -1) - d - space.slack
                    reach = space.reach(a, np.array([min(w) for w, _ in limits], float), 1) + d + space.slack
                    made = [pa.array([x[0] for x in limits], pa.list_(pa.int64())), pa.array([x[1] for x in limits], pa.list_(pa.int64())), pa.array(g.astype(np.int32)), pa.array(near), pa.array(reach)]
                    yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("l"), batch.column("v"), batch.column("wanted"), *made], names=["c", "l", "v", "wanted", "lows", "highs", "g", "near", "reach"])

        return run

    def first_bound(scores: np.ndarray, label: str, wanted: list) -> tuple[list[int], list[int]]:
        mate = held.value[1].label == label
        least = kth(scores[mate], held.value[1].rows[mate], positives + 1)
        return [int(max(least, -MOST_SCORE))], [MOST_SCORE]

    def second_bound(scores: np.ndarray, label: str, wanted: list) -> tuple[list[int], list[int]]:
        other = held.value[1].label != label
        least, most = windows(np.array(wanted, np.int64), low, high)
        lows = []
        for a, b in zip(least.tolist(), most.tolist(), strict=True):
            inside = other & (scores >= a) & (scores <= b)
            lows.append(int(max(a, kth(scores[inside], held.value[1].rows[inside], negatives))))
        return lows, most.tolist()

    schema = "c long, l string, v array<long>, wanted array<long>, lows array<long>, highs array<long>, g int, near double, reach double"
    anchors = classes.where("asks").select("c", "l", "v", F.array().cast("array<long>").alias("wanted"))
    asked = write_table(anchors.mapInArrow(bound(first_bound), schema), "anchors")
    plus = _meet(classes, asked, held, dim, True, positives + 1, cells).select("c", "score", "id", "cls")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "id", "cls"))
    plus = write_table(plus.withColumn("n", rank).where(F.col("n") <= positives + 1).drop("n"), "positives")

    wanted = plus.where("score >= 0").groupBy("c").agg(F.sort_array(F.collect_set("score")).alias("wanted"))  # below 0 no score is inside its window
    asked = write_table(anchors.drop("wanted").join(wanted, "c").select("c", "l", "v", "wanted").mapInArrow(bound(second_bound), schema), "anchors")
    minus = _meet(classes, asked, held, dim, False, negatives, cells)
    rank = F.row_number().over(Window.partitionBy("c", "p").orderBy(F.desc("score"), "id"))
    minus = write_table(minus.select("c", "p", "score", "id").withColumn("n", rank).where(F.col("n") <= negatives).drop("n"), "negatives")
    return plus, minus


def _meet(classes: DataFrame, asked: DataFrame, held, dim: int, mates: bool, k: int, cells: int) -> DataFrame:
    """(c, p, score, id, cls): what each part of a group finds; p is the wanted score. mates: rows of the anchor's label, else of others."""
    spark = classes.sparkSession
    limits = asked.groupBy("g").agg(F.max("reach").alias("reach"), F.min("near").alias("near"), F.count("*").alias("n")).collect()  # a row per group
    n_groups = len(held.value[0].pivots)
    reach, near, n_asked = np.full(n_groups, -np.inf), np.full(n_groups, np.inf), np.zeros(n_groups, np.int64)
    for r in limits:
        reach[r["g"]], near[r["g"]], n_asked[r["g"]] = r["reach"], r["near"], r["n"]
    least = spark.sparkContext.broadcast((near, reach))  # two numbers a group

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, cells // max(dim, n_groups))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                far = held.value[0].from_pivots(int_matrix(batch.column("v"), dim), True)
                at, g = np.nonzero((far >= least.value[0]) & (far <= least.value[1]))
                ends = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
                groups = pa.ListArray.from_arrays(pa.array(ends), pa.array(g.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("l"), batch.column("v"), batch.column("ids"), groups], names=["c", "l", "v", "ids", "groups"])

    sent = write_table(classes.select("c", "l", "v", "ids").mapInArrow(serve, "c long, l string, v array<long>, ids array<long>, groups array<int>").where(F.size("groups") > 0), "candidates")
    counts = sent.select(F.explode("groups").alias("g")).groupBy("g").count().collect()  # a row per group
    most = max(64, cells // max(1, dim))
    share, chunk = [1] * n_groups, [max(1, -(-int(a) // max(64, most // 16))) for a in n_asked]
    for r in counts:
        share[r["g"]] = -(-r["count"] // most)
    shares, chunks = (F.array(*[F.lit(int(x)) for x in xs]) for xs in (share, chunk))
    keys = (["g", "l"] if mates else ["g"]) + ["share", "chunk"]

    def part(of: Column, salt: str) -> Column:
        return F.pmod(F.xxhash64("c", F.lit(salt)), of).cast("int")

    left = sent.select("c", "l", "v", "ids", F.explode("groups").alias("g")).withColumn("share", part(F.get(shares, "g"), "share")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(chunks, "g") - 1)))
    right = asked.select("c", "l", "v", "wanted", "lows", "highs", "g").withColumn("chunk", part(F.get(chunks, "g"), "chunk")).withColumn("share", F.explode(F.sequence(F.lit(0), F.get(shares, "g") - 1)))
    if mates:  # a label without an anchor in the group finds none
        left = left.join(right.select(*keys).distinct(), keys, "left_semi")

    def search(there: pa.Table, here: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        if there.num_rows and here.num_rows:
            x, a = (int_matrix(t.column("v").combine_chunks(), dim) for t in (there, here))
            lists = there.column("ids").combine_chunks()
            count = lists.value_lengths().to_numpy()
            first, ids, cls = np.cumsum(count) - count, lists.flatten().to_numpy(), there.column("c").to_numpy()
            code = np.unique(np.array(there.column("l").to_pylist() + here.column("l").to_pylist(), object), return_inverse=True)[1]
            label, mine = code[: len(x)], code[len(x) :]
            lows, highs, wanted = (here.column(n).to_pylist() for n in ("lows", "highs", "wanted"))
            me = here.column("c").to_numpy()
            step = max(1, cells // max(1, len(x)))
            for lo in range(0, len(a), step):
                for i, scores in enumerate(products(a[lo : lo + step], x), lo):
                    able = np.flatnonzero((scores >= min(lows[i])) & (scores <= max(highs[i])) & ((label == mine[i]) == mates))
                    for p, l, h in zip(wanted[i] or [0], lows[i], highs[i], strict=True):
                        some = able[(scores[able] >= l) & (scores[able] <= h)]
                        if len(some):
                            s, found, at = best(scores[some], ids, first[some], count[some], k)
                            for col, new in zip(out, (np.full(len(s), me[i]), np.full(len(s), p), s, found, cls[some[at]]), strict=True):
                                col.append(new)
        return pa.table([np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out], names=["c", "p", "score", "id", "cls"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "c long, p long, score long, id long, cls long")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)

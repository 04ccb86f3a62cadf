"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.batches import added, by_bytes, with_columns
from traceloom.llm.language import held_out, letters
from traceloom.llm.store import write_table

BLOCK = 4096
SPACE, LETTER, DIGIT, MARK = range(4)
GAP = re.compile(r"\s")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point: white space, letter, digit, or any other mark."""
    points = np.arange(0x110000, dtype=np.uint32).view("U1")
    found = np.full(len(points), MARK, np.uint8)
    for kind, test in ((DIGIT, np.char.isdigit), (LETTER, np.char.isalpha), (SPACE, np.char.isspace)):
        found[test(points)] = kind
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape and text of each word of all texts; a word is a run of letters, digits or other marks.

    The hash is of the word in lower case. The shape tells its kind, its capitals, its rough length and, of marks, the first.
    """
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    at = np.flatnonzero((kind != SPACE) & (kind != np.concatenate([[SPACE], kind[:-1]]))) if len(codes) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(kind != SPACE)
    first = np.searchsorted(inside, at)
    long = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, long)
    power = np.cumprod(np.concatenate([[1], np.full(long.max(), 0x100000001B3)]).astype(np.uint64))
    low = letters()[codes[inside]]
    value = np.where(low > 0, low, codes[inside].astype(np.uint64))
    hashes = mixed(np.add.reduceat(value * power[place], first) + long.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    upper = np.add.reduceat(((low > 0) & (low != codes[inside])).astype(np.int64), first)
    case = np.where(upper == 0, 0, np.where((upper == long) & (long > 1), 2, np.where(upper == 1, 1, 3)))
    own = kind[at]
    mark = np.where(own == MARK, codes[at] % 64 + 1, 0)
    shape = ((own * 4 + case) * 4 + np.digitize(long, (3, 6, 10))) * 65 + mark
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, shape.astype(np.uint64), np.searchsorted(ends, at, side="right")


def pieces(text: str, limit: int) -> Iterator[str]:
    """Cuts of about `limit` characters at white space, where no word reaches over."""
    start = 0
    while len(text) - start > limit and (m := GAP.search(text, start + limit)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def features(texts: list[str], size: int, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts: n-grams of 1 and 2 words and of 1 to 3 shapes, hashed to `size` features.

    A word that repeats the one before it has a shape of its own. The value grows with the logarithm of the count;
    a text's values have length 1. Texts without a word have no feature.
    """
    found: list[tuple] = []
    some: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        h, s, piece = words(some)
        found.append((h, s, np.array(owner, np.int64)[piece]))

    for i, text in enumerate(texts):
        for piece in pieces(text, limit):
            if held and held + len(piece) > limit:
                flush()
                some, owner, held = [], [], 0
            some.append(piece)
            owner.append(i)
            held += len(piece)
    if some:
        flush()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    h, s, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    s = mixed(s * np.uint64(2) + again.astype(np.uint64) + np.uint64(1))
    keys = []
    for tag, of, longest in ((1, h, 2), (4, s, 3)):
        gram = np.zeros(len(of), np.uint64)
        for n in range(longest):
            gram = mixed(gram[: len(of) - n] * np.uint64(0x85EBCA77C2B2AE63) + of[n:] + np.uint64(tag + n))
            whole = doc[: len(of) - n] == doc[n:] if n else slice(None)
            keys.append(doc[: len(gram)][whole] * size + ((gram[whole] >> np.uint64(24)) % np.uint64(size)).astype(np.int64))
            if len(of) - n <= 1:
                break
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    doc, value = key // size, 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    return doc, key % size, value / norm[doc]


@dataclass(frozen=True)
class Rates:
    """Step sizes and penalties of the updates; bias is the value of a feature that all texts have."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    bias: float = 0.3


def weights(z: np.ndarray, n: np.ndarray, r: Rates) -> np.ndarray:
    """The leader's weights: zero where the penalty holds."""
    return np.where(np.abs(z) <= r.l1, 0.0, (np.sign(z) * r.l1 - z) / ((r.beta + np.sqrt(n)) / r.alpha + r.l2))


def learn(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, y: float, r: Rates) -> None:
    """One update in place, by the features of one text and its label."""
    w = weights(z[at], n[at], r)
    g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
    new = n[at] + g * g
    z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / r.alpha * w
    n[at] = new


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, id_column: str, text: str, quality: str) -> DataFrame:
    """(place, y, t): at most `sample_rows` different labelled rows, those of smallest hash of id and text.

    y is the mean of an id's labels, as a table of labels may hold several; only ids, hashes and labels move before the cut.
    """
    marks = labels.where(F.col(id_column).isNotNull() & F.col(quality).isin(0, 1)).groupBy(F.col(id_column).alias("__id")).agg(F.avg(quality).alias("y"))
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), F.xxhash64(text, F.lit(1)).alias("__t"), F.col(text).alias("t"))
    known = rows.select("__id", "__t").distinct().join(marks, "__id")
    place = F.xxhash64("__id", "__t").alias("place")
    taken = known.select("__id", "__t", "y", place).orderBy("place", "__id", "__t").limit(sample_rows)
    return rows.join(F.broadcast(taken), ["__id", "__t"]).dropDuplicates(["__id", "__t"]).select("place", "y", F.coalesce("t", F.lit("")).alias("t"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", quality: str = "quality", sample_rows: int = 24_000, size: int = 1 << 18, shards: int = 8, rounds: int = 4, rates: Rates = Rates()) -> np.ndarray:
    """Weights of `size` hashed features, then of the bias.

    Learned from whole texts of at most `sample_rows` labelled rows (see labelled_sample). Their features are written
    once; each round, every one of `shards` shards runs through its rows in order of their hashes, from the state that the
    round before left, and what the shards add to the state is summed by Spark in blocks. The state (two numbers a feature)
    is all that reaches the driver. Shards go by hash, so any number of tasks gives the same weights. Without labelled rows all
    weights are zero.
    """
    spark = docs.sparkSession

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "t", 1 << 18):
                doc, at, x = features(batch.column("t").to_pylist(), size)
                ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(a)) for a in (at.astype(np.int32), x.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("y"), *lists], names=["place", "y", "at", "x"])

    sample = labelled_sample(docs, labels, sample_rows, id_column, text, quality)
    table = write_table(sample.mapInArrow(make, "place long, y double, at array<int>, x array<float>"), "quality-sample")
    dealt = table.withColumn("shard", F.pmod(F.hash("place"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "place")
    blocks = -(-(size + 1) // BLOCK)
    state = np.zeros((2, blocks * BLOCK))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, own = None, np.zeros((2, 0))

            def gained() -> pa.RecordBatch:
                gain = (own - held.value).reshape(2, blocks, BLOCK)
                some = np.flatnonzero(gain.any(axis=(0, 2)))
                lists = [pa.array(list(gain[i, some]), pa.list_(pa.float64())) for i in range(2)]
                return pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), now, np.int32)), *lists], names=["block", "shard", "z", "n"])

            for batch in batches:
                for shard, y, at, x in zip(batch.column("shard").to_pylist(), batch.column("y").to_pylist(), batch.column("at"), batch.column("x"), strict=True):
                    if shard != now:
                        if now is not None:
                            yield gained()
                        now, own = shard, held.value.copy()
                    learn(own[0], own[1], np.append(at.values.to_numpy(), size), np.append(x.values.to_numpy(), np.float32(rates.bias)).astype(np.float64), y, rates)
            if now is not None:
                yield gained()

        # gains of a block in the order of shards, as sums of doubles hang on it: `shards` rows a block
        gains = dealt.mapInArrow(run, "block long, shard int, z array<double>, n array<double>").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "z", "n"))).alias("g"))
        total = [F.aggregate(F.slice(f"g.{c}", 2, shards), F.get(f"g.{c}", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(c) for c in ("z", "n")]
        state = state.copy()
        for r in write_table(gains.select("block", *total), "quality-gains").toArrow().to_pylist():  # two numbers a feature
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            state[0, at] += r["z"]
            state[1, at] += r["n"]
        held.unpersist()
    return weights(state[0, : size + 1], state[1, : size + 1], rates)


def score_quality(docs: DataFrame, w: np.ndarray, text: str = "text", batch_bytes: int = 1 << 18, rates: Rates = Rates()) -> DataFrame:
    """Appends score, the probability of label 1, from the whole text alone, as a sparse dot product with the weights.

    Null and empty texts score by the bias only. Rows stay as they are, repeated ones too, and columns pass through but one
    named score; an empty table gives an empty table. No shuffle. Texts of over 2^20 characters are read in pieces.
    """
    size = len(w) - 1
    held = docs.sparkSession.sparkContext.broadcast(w)  # size + 1 numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, text, batch_bytes):
                doc, at, x = features([t or "" for t in batch.column(text).to_pylist()], size)
                raw = np.bincount(doc, held.value[at] * x, minlength=batch.num_rows) + held.value[size] * rates.bias
                yield with_columns(batch, {"score": pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))})

    return docs.mapInArrow(score, added(docs, [("score", T.DoubleType())]))


def op11_quality(spark, sf_dir: str, least: float = 0.3) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    fold = held_out("doc_id", folds=5, fold=0)
    w = fit_quality(docs.where(~fold), labels.where(~fold))
    scored = score_quality(docs.withColumn("held_out", fold), w)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))

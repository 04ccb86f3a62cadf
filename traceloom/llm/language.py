"""Language identification: each document's mixture of languages, by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.batches import added, by_bytes, with_columns

UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """logp[feature, language]: smoothed log-probability of a hashed letter trigram."""

    langs: list[str]
    logp: np.ndarray


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, its lower case if it is a letter, else 0."""
    lower = [c if len(x := chr(c).lower()) > 1 else ord(x) for c in range(0x110000)]
    return np.array([x if chr(c).isalpha() else 0 for c, x in enumerate(lower)], np.uint64)


def features(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: a trigram code for each letter (with its two neighbours; what is no letter counts
    as one mark), the first letter's place of each word, and the text of each word."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    x = np.zeros(len(codes) + 2, np.uint64)
    x[1:-1] = letters()[codes]
    at = np.flatnonzero(x[1:-1])
    mixed = (x[at] * np.uint64(0x9E3779B1) + x[at + 1] * np.uint64(0x85EBCA77C2B2AE63) + x[at + 2] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B185EBCA87)
    starts = np.flatnonzero(np.diff(at, prepend=-5) > 1)
    return (mixed >> np.uint64(40)) % np.uint64(size), starts, np.searchsorted(ends, at[starts], side="right")


def mixtures(texts: list[str], model: Model, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(language index or -1, its proportion) of each text.

    Words are the units; the likelihood of a word is that of its trigrams. EM over all languages orders them;
    of the sets of the 1, 2, ... largest, each fitted by EM again, the one of best log-likelihood less
    half the logarithm of the number of words per language is kept (BIC). A text's set grows until a language
    more is no gain, so texts of any number of languages end with the set that the penalty chooses.
    """
    n, k = len(texts), len(model.langs)
    best, share = np.full(n, -1), np.zeros(n)
    codes, starts, doc = features(texts, len(model.logp))
    if not len(starts) or not k:
        return best, share
    ll = np.add.reduceat(model.logp[codes.astype(np.int64)], starts, axis=0)
    weight = np.exp(ll - ll.max(axis=1, keepdims=True)).astype(np.float32)
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    words = np.diff(np.append(at, len(doc)))
    tiny = np.float32(1e-30)

    def em(weight: np.ndarray, words: np.ndarray, theta: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after so many rounds, and their log-likelihood."""
        first, row = np.cumsum(words) - words, np.repeat(np.arange(len(words)), words)
        for _ in range(times):
            part = weight * theta[row]
            part /= part.sum(axis=1, keepdims=True) + tiny
            theta = np.add.reduceat(part, first, axis=0) / words[:, None].astype(np.float32)
        return theta, np.add.reduceat(np.log((weight * theta[row]).sum(axis=1) + tiny), first)

    full = em(weight, words, np.full((len(at), k), 1 / k, np.float32), rounds)[0]
    order = np.argsort(-full, axis=1, kind="stable")
    good, chosen, open_ = np.full(len(at), -np.inf), np.zeros_like(full), np.arange(len(at))
    for m in range(1, k + 1):
        top, theta = order[open_, :m], np.zeros((len(open_), k), np.float32)
        np.put_along_axis(theta, top, np.take_along_axis(full[open_], top, 1) + np.float32(1e-6), 1)
        theta, value = em(weight, words[open_], theta / theta.sum(axis=1, keepdims=True), 3 if m > 1 else 0)
        value -= 0.5 * m * np.log(words[open_] + 1)
        better = value > good[open_]
        good[open_[better]], chosen[open_[better]] = value[better], theta[better]
        weight, open_ = weight[np.repeat(better, words[open_])], open_[better]
        if not len(open_):
            break
    best[doc[at]], share[doc[at]] = chosen.argmax(axis=1), np.minimum(chosen.max(axis=1), 1)
    return best, share


def fit_languages(docs: DataFrame, label: str = "lang", text: str = "text", id_column: str = "doc_id", sample_rows: int = 24_000, size: int = 1 << 16, smoothing: float = 0.05) -> Model:
    """Trigram counts of the labelled rows, over whole texts of at most `sample_rows` of them: as many of each label, those
    of smallest id hash; equal rows count once. Rows without an id are not taken. The model is labels x size floats, which the
    driver and each worker hold: with over a thousand labels take a smaller `size`."""
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull())
    counts = labelled.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__c"))  # a row per label
    each = max(1, sample_rows // max(1, counts.count()))
    # a cut of the hash leaves few more than are wanted of each label, before any row moves; ranks leave just as many
    keyed = labelled.select(F.col(label).alias("__l"), F.col(id_column).alias("__id"), F.xxhash64(id_column).alias("__h"), F.xxhash64(text, F.lit(1)).alias("__t"), F.col(text).alias("t"))
    ids = keyed.drop("t").join(counts, "__l")
    ids = ids.where(F.pmod("__h", F.lit(1 << 30)) * F.col("__c").cast("double") < F.lit((1.2 * each + 100) * (1 << 30))).drop("__c").distinct()
    place = F.row_number().over(Window.partitionBy("__l").orderBy(F.pmod("__h", F.lit(1 << 30)), "__h", "__id", "__t"))
    ids = ids.withColumn("__n", place).where(F.col("__n") <= each).select("__l", "__id", "__t")  # sample_rows at most
    rows = keyed.join(F.broadcast(ids), ["__l", "__id", "__t"]).dropDuplicates(["__l", "__id", "__t"]).select(F.col("__l").alias("l"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in by_bytes(whole, "t", 1 << 18):
                langs = batch.column("l").to_pylist()
                for lang in set(langs):
                    texts = [t for x, t in zip(langs, batch.column("t").to_pylist(), strict=True) if x == lang]
                    codes = features(texts, size)[0]
                    total[lang] = total.get(lang, 0) + np.bincount(codes.astype(np.int64), minlength=size)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["l", "f", "n"])

    table = rows.mapInArrow(count, "l string, f long, n long").groupBy("l", "f").agg(F.sum("n").alias("n")).toArrow()  # at most languages x size rows
    langs = sorted(set(table.column("l").to_pylist()))
    counts = np.zeros((size, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    counts[table.column("f").to_numpy(), [place[x] for x in table.column("l").to_pylist()]] = table.column("n").to_numpy()
    return Model(langs, np.log((counts + smoothing) / (counts.sum(axis=0, keepdims=True) + smoothing * size)).astype(np.float32))


def predict_languages(docs: DataFrame, model: Model, text: str = "text", batch_bytes: int = 1 << 18) -> DataFrame:
    """Appends lang_pred and score (the share of the words in that language, 0 to 1) from the whole text alone.

    Texts that are null or have no letter, and all texts if no language was learned, get `und` and 0.
    Ties go to the language first by name. Rows stay as they are; an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x size floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*held.value.langs, UNKNOWN]
        for whole in batches:
            for batch in by_bytes(whole, text, batch_bytes):
                best, share = mixtures([t or "" for t in batch.column(text).to_pylist()], held.value)
                yield with_columns(batch, {"lang_pred": pa.array([names[i] for i in best], pa.string()), "score": pa.array(share.astype(np.float64))})

    return docs.mapInArrow(predict, added(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())]))


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score; learned from the rows that are not held out."""
    marked = docs.withColumn("held_out", held_out())
    return predict_languages(marked, fit_languages(marked.where(~F.col("held_out"))))


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    model = fit_languages(docs.where(~held_out()))
    return predict_languages(marked, model).select("doc_id", "held_out", "lang_pred", "score")

"""Mixing sources to target weights: cube-method balanced sampling of whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.store import read_table, save_table, write_table

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) rows -> (source, source_size, target), a row per source.

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes; a
    target stops at `most` times its source's size, and the excess goes to the others by weight until none
    is above. Only sums reach the driver, one pair a round.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # over one row per source
    place = F.row_number().over(order) - 1
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(most))
    per = write_table(per, "sources")
    total = (per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.lit(level) * F.col("weight") >= F.col("most")
        held, free = per.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (total - held) / free if free else level
        if not free or new <= level * (1 + 1e-15):
            break
        level = new
    return per.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), "most").alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> None:
    """Moves p, in place, along the null space of the two totals (documents, words), three units at a time,
    until at most two are fractional. Units of large size come first, so small ones are left."""
    queue = [int(i) for i in np.lexsort((np.arange(len(p)), -size)) if EPS < p[i] < 1 - EPS][::-1]
    s, q, active = size.astype(float).tolist(), p.tolist(), []
    draws = iter(rng.random(len(p) + 8).tolist())
    while True:
        while queue and len(active) < 3:
            active.append(queue.pop())
        if len(active) == 3:
            i, j, k = active
            u = (s[k] - s[j], s[i] - s[k], s[j] - s[i])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and s[active[0]] == s[active[1]]:
            u = (1.0, -1.0)
        else:
            break
        top = max(map(abs, u))
        u = [x / top for x in u]
        up = min((1 - q[a]) / x if x > 0 else q[a] / -x for a, x in zip(active, u, strict=True) if x)
        down = min(q[a] / x if x > 0 else (1 - q[a]) / -x for a, x in zip(active, u, strict=True) if x)
        move = up if next(draws) * (up + down) < down else -down
        for a, x in zip(active, u, strict=True):
            q[a] += move * x
            if q[a] < EPS or q[a] > 1 - EPS:
                q[a] = round(q[a])
        active = [a for a in active if 0 < q[a] < 1]
    p[:] = q


def land(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> None:
    """Rounds the few fractional units left, and no others, so that each keeps its probability.

    Of the samples of two units that keep both probabilities, those that take both with a probability t are a line;
    the landing program's cost, the expected distance from the totals, is least at one of its ends. One unit alone
    is drawn. (More are left only by rounding; they are first moved in pairs, with the number of documents kept.)
    """
    left = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    while len(left) > 2:
        i, j = left[:2]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        move = up if rng.random() * (up + down) < down else -down
        p[i], p[j] = p[i] + move, p[j] - move
        left = [x for x in left if EPS < p[x] < 1 - EPS]
    if len(left) == 2:
        i, j = left
        cost = lambda a, b: abs(a * size[i] + b * size[j] - p[i] * size[i] - p[j] * size[j]) + 0.02 * (size[i] + size[j]) / 2 * abs(a + b - p[i] - p[j])
        choices = [(1, 1), (1, 0), (0, 1), (0, 0)]
        chances = [np.maximum([t, p[i] - t, p[j] - t, 1 - p[i] - p[j] + t], 0) for t in (max(0.0, p[i] + p[j] - 1), min(p[i], p[j]))]
        best = min(chances, key=lambda q: sum(x * cost(a, b) for x, (a, b) in zip(q, choices, strict=True)))
        p[i], p[j] = choices[int(np.searchsorted(np.cumsum(best), rng.random() * best.sum(), side="right").clip(0, 3))]
    elif left:
        p[left[0]] = float(rng.random() < p[left[0]])
    p[:] = np.round(np.where((p < EPS) | (p > 1 - EPS), np.round(p), p), 12)


def repair(size: np.ndarray, p: np.ndarray, words: float, helpers: int = 14) -> None:
    """Where landing misses the words by much (few documents, one of them large), settled units, up to `helpers` spread
    evenly over the sizes, change sides: the choice nearest to the words, then to the number of documents, is taken."""
    units = np.lexsort((np.arange(len(p)), size))
    units = units[size[units] > 0]
    units = units[np.unique(np.linspace(0, len(units) - 1, helpers).astype(int))] if len(units) else units
    flips = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    change = flips @ ((1 - 2 * p[units]) * size[units])
    best = flips[np.argmin(np.abs(p @ size + change - words) + 0.02 * size.mean() * flips.sum(axis=1))].astype(bool)
    p[units[best]] = 1 - p[units[best]]


def mixture(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, block: int = 2048, most_off: float = 0.001, seed: int = 5, **options) -> DataFrame:
    """One row per row of docs: (id, size, source_size, target, copies, taken), and the columns named in keep.

    size counts the words; a source's documents are wanted target / source_size times: the whole part is
    given to each, the rest by a balanced sample whose word and document totals stay those of the fractions.
    Blocks of about `block` documents fly on their own (by the hash of id and text, so a source of any size is spread) and
    leave two fractional documents each; those meet again in blocks until a source has one block, which lands.
    Each document keeps its probability, but where the landing misses by over `most_off` of the source's target.
    taken = copies x size, copies <= 2.
    Null and wordless texts have size 0; null sources are one source; rows that repeat are units of their own.
    Draws are seeded by block, so reruns agree. An empty table gives an empty result.
    """
    spark, keep = docs.sparkSession, keep or []
    sized = write_table(docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(id_column, text).alias("salt"), *(F.col(c).alias(f"__{c}") for c in keep)), "sizes")
    targets = source_targets(sized, **options)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate") + EPS)
    units = sized.join(F.broadcast(targets), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"]) if targets.count() <= 100_000 else sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    units = units.withColumn("rate", rate).withColumn("base", whole.cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - whole)).drop("rate")
    units = units.withColumn("p", F.when(F.col("p") < EPS, 0.0).otherwise(F.col("p")))
    schema = units.schema

    def fly(key: tuple, group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, [("size", "descending"), ("id", "ascending"), ("salt", "ascending")]))
        size, p = group.column("size").to_numpy(), group.column("p").to_numpy().copy()
        rng = np.random.default_rng((seed, group.column("level")[0].as_py(), key[1].as_py(), len(p), int(size.sum())))
        last, words = group.column("blocks")[0].as_py() == 1, float(p @ size)
        flight(size, p, rng)
        if last:
            land(size, p, rng)
            if abs(float(p @ size) - words) > most_off * group.column("target")[0].as_py():
                repair(size, p, words)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p)).select(schema.names)

    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    done, left, level = [units.where(~fractional)], units.where(fractional), 0
    while True:
        counts = left.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
        counts = counts.select("of", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        dealt = left.join(counts, left["source"].eqNullSafe(counts["of"])).drop("of")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "salt", F.lit(level)), "blocks").cast("int")).withColumn("level", F.lit(level))
        path = save_table(dealt.groupBy("source", "block").applyInArrow(fly, schema), "flight")
        flown = read_table(spark, path, units)
        done.append(flown.where(~fractional))
        left, level = flown.where(fractional), level + 1
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("p").cast("int")).alias("copies")
    out = out.select("id", "size", "source_size", "target", copies, *(F.col(f"__{c}").alias(c) for c in keep))
    return out.withColumn("taken", F.col("size") * F.col("copies")).withColumnRenamed("id", id_column)


def op4_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")

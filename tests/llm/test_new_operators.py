"""Quality classifier, hard negatives and vector codes against brute force; odd rows and empty tables."""

import hashlib
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import ann, codebooks, hard_negatives, quality

VECTOR = "vec_id long, embedding array<double>, label int"


# --- op11 ---------------------------------------------------------------------------------------------------------


def plain_words(text):
    """(lower-case word, shape) of runs of one kind of character."""
    out, now, kind = [], "", None
    for c in text + " ":
        k = 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3
        if k != kind and now:
            out.append((now, kind))
            now = ""
        if k:
            now += c
        kind = k
    shaped = []
    for w, k in out:
        upper = sum(c.isalpha() and c != c.lower() and len(c.lower()) == 1 for c in w)
        case = 0 if upper == 0 else 2 if upper == len(w) > 1 else 1 if upper == 1 else 3
        size = sum(len(w) >= n for n in (3, 6, 10))
        low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c for c in w)
        shaped.append((low, (k, case, size, ord(w[0]) % 64 if k == 3 else -1)))
    return shaped


def plain_counts(text):
    found = plain_words(text)
    low = [w for w, _ in found]
    shape = [(s, i > 0 and low[i] == low[i - 1]) for i, (_, s) in enumerate(found)]
    grams = [("w", *low[i : i + n]) for n in (1, 2) for i in range(len(low) - n + 1)]
    return Counter(grams + [("s", *shape[i : i + n]) for n in (1, 2, 3) for i in range(len(shape) - n + 1)])


TEXTS = ["", "one", "The cat, the CAT!! 42 cats\nand the the the end.", "Ünder ÉAIRE!! straße 你好 x1y2", " \t\n", "a b " * 50, "!!! *** $$$", "A"]


def test_features_are_those_of_plain_counting():
    doc, at, x = quality.features(TEXTS, 1 << 40)
    for i, text in enumerate(TEXTS):
        want = sorted(1 + math.log(n) for n in plain_counts(text).values())
        size = math.sqrt(sum(v * v for v in want))
        assert np.allclose(np.sort(x[doc == i]), [v / size for v in want])
        assert len(set(at[doc == i])) == len(want)


def test_features_do_not_depend_on_neighbours_or_pieces():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Cat", "SAT", "on!!", "7", "x"]) for _ in range(rng.randrange(400))) for _ in range(20)]
    whole = quality.features(texts, 1 << 20)
    for limit in (1, 7, 100):
        cut = quality.features(texts, 1 << 20, limit)
        assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    for i, t in enumerate(texts):
        alone = quality.features([t], 1 << 20)
        assert np.array_equal(alone[1], whole[1][whole[0] == i]) and np.allclose(alone[2], whole[2][whole[0] == i])


def test_kinds_of_all_code_points():
    kinds = quality.kinds()
    for c in list(range(3000)) + [0x4E00, 0x1F600, 0xD800, 0x10FFFF]:
        t = chr(c)
        assert kinds[c] == (0 if t.isspace() else 1 if t.isalpha() else 2 if t.isdigit() else 3), unicodedata.name(t, hex(c))


def plain_ftrl(rows, size, r, rounds):
    """z and n as dictionaries, one feature at a time, in the order of rows; one shard."""
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= r.l1 else -(z[i] - math.copysign(r.l1, z[i])) / ((r.beta + math.sqrt(n[i])) / r.alpha + r.l2)

    for _ in range(rounds):
        for text, y in rows:
            _, at, x = quality.features([text], size)
            pairs = [*zip(at.tolist(), x.astype(np.float32).tolist(), strict=True), (size, float(np.float32(r.bias)))]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / r.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return np.array([weight(i) for i in range(size + 1)])


def test_training_is_plain_ftrl(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("good fine well bad poor spam".split()[: 3 + 3 * (i % 2)]) for _ in range(1 + rng.randrange(30)))) for i in range(40)]
    d = spark.createDataFrame([*docs, (1, docs[1][1]), (50, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, 1 - i % 2) for i, _ in docs], (0, 0), (50, 0), (None, 1), (1, None), (77, 1)], "doc_id long, quality int")
    w = quality.fit_quality(d, labels, size=512, shards=1, rounds=2)
    order = quality.labelled_sample(d, labels, 10_000, "doc_id", "text", "quality").orderBy("place").collect()
    assert len(order) == 41 and {r["y"] for r in order} == {0.0, 0.5, 1.0}  # a repeated row counts once, two labels by their mean
    assert np.allclose(w, plain_ftrl([(r["t"], r["y"]) for r in order], 512, quality.Rates(), 2))
    again = quality.fit_quality(d.repartition(7), labels.repartition(3), size=512, shards=3, rounds=2)
    assert np.array_equal(again, quality.fit_quality(d, labels, size=512, shards=3, rounds=2))
    few = quality.labelled_sample(d, labels, 5, "doc_id", "text", "quality").collect()
    assert sorted(r["place"] for r in few) == sorted(r["place"] for r in order)[:5]


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "spam " * 10, 5), (3, "spam " * 10, 5), (None, "good", 5), (4, "word " * 300_000, 5)], "doc_id long, text string, score int")
    w = np.zeros(1025)
    w[1024] = 2.0
    got = quality.score_quality(docs, w).collect()
    assert len(got) == 6 and all(r["score"] == pytest.approx(1 / (1 + math.exp(-0.6))) for r in got)
    assert quality.score_quality(docs.limit(0), w).count() == 0
    none = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"), size=64)
    assert not none.any() and len(none) == 65


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op11_quality(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    known = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    known = known[known.held_out]
    assert len(known) > 50 and (known.predicted == known.quality).mean() >= 0.95


# --- op12 ---------------------------------------------------------------------------------------------------------


def floors(v):
    return [math.floor(256 * float(x)) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, anchor, positives=5, negatives=10):
    kept = sorted({(i, lab, tuple(floors(v))) for i, v, lab in rows if i is not None and lab is not None and usable(v)})
    out = []
    for a in kept:
        if not anchor(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b) for b in kept if len(b[2]) == len(a[2])]
        mates = sorted((s, i) for s, i, b in scored if b != a and b[1] == a[1])[:positives]
        others = sorted((s, i) for s, i, b in scored if b[1] != a[1])
        for s, i in mates:
            found = [(t, j) for t, j in others if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a[0], i, n, j, -s, -t) for n, (t, j) in enumerate(found, 1)]
    return sorted(out)


def many_vectors(seed, n, dim, labels):
    """Clusters, a vector that a third of all rows share, a label of most rows, ties of whole numbers."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        kind = rng.integers(6)
        v = centres[0] if kind < 2 else np.round(rng.normal(size=dim) * 2) / 2 if kind == 2 else centres[kind] + rng.normal(size=dim) * 0.4
        rows.append((int(i), [float(x) for x in v], int(rng.integers(labels)) if rng.random() < 0.6 else 0))
    return rows


ODD_VECTORS = [(900, None, 1), (901, [1.0] * 6, None), (None, [1.0] * 6, 1), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (903, [float("nan")] + [1.0] * 5, 1), (904, [float("inf")] * 6, 2), (905, [0.0] * 6, 1), (906, [], 1), (907, [], 2), (908, [1.0, 2.0], 1), (910, [1.0, 2.5], 1), (911, [1.0, 0.7], 2), (0, [0.3] * 6, 1), (0, [0.3] * 6, 1), (7, [0.3] * 6, 2)]


@pytest.mark.parametrize(("seed", "n", "dim", "labels"), [(1, 400, 6, 4), (2, 250, 3, 2), (3, 60, 6, 40)])
def test_hard_negatives_are_brute_force(spark, seed, n, dim, labels):
    rows = many_vectors(seed, n, dim, labels) + ODD_VECTORS
    df = spark.createDataFrame(rows, VECTOR).withColumns({c: F.lit("x") for c in ("id", "c", "l", "v", "h", "g", "rank", "share")})
    for more in ({}, {"per_group": 4, "cells": 64, "sample_rows": 40}):
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more)
        assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_go_to_few_groups(spark):
    """Bounds keep candidates from groups that they can't serve, and of equal vectors only a few ids move."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 10
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16) * 0.05], int(rng.integers(3))) for i in range(1600)]
    rows += [(2000 + i, [float(x) for x in centres[0]], 1) for i in range(1500)]
    df = spark.createDataFrame(rows, VECTOR)
    sent, write = [], hard_negatives.write_table

    def spy(table, label):
        done = write(table, label)
        if label in ("candidates", "vector-classes"):
            sent.append((label, done))
        return done

    hard_negatives.write_table = spy
    try:
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, per_group=10).collect()
    finally:
        hard_negatives.write_table = write
    assert got
    classes, first = sent[0][1], sent[1][1]
    assert classes.count() <= 1600 + 1 and classes.agg(F.max(F.size("ids"))).first()[0] == 10
    groups = first.select(F.explode("groups").alias("g")).distinct().count()
    assert groups >= 8 and first.agg(F.sum(F.size("groups"))).first()[0] < 0.5 * groups * first.count()


def test_hard_negatives_of_huge_numbers_and_none(spark):
    big = [(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [3e5, 4e5], 1), (10, [3e5, 4.1e5], 1), (3, [2e5, 3e5], 2), (4, [-1e300, 0.0], 2)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(big, VECTOR), F.col("vec_id") % 10 == 0).collect()
    exact = [tuple(r) for r in got if r["anchor_id"] == 10 and r["positive_id"] == 2]
    s, t = (sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(big[3][1], other, strict=True)) for other in (big[2][1], big[4][1]))
    assert exact == [(10, 2, 1, 3, s, t)]
    empty = spark.createDataFrame([], VECTOR)
    assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []


# --- op13 ---------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, floors(v), lab) for i, v, lab in rows if usable(v)]
    books = {}
    for dim in {len(v) for _, v, _ in kept}:
        width = -(-dim // parts)
        own = [(i, [(v + [0] * (parts * width - dim))[p * width : (p + 1) * width] for p in range(parts)]) for i, v, _ in kept if len(v) == dim]
        start = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
        book = [[r[1][p] for r in start] for p in range(parts)]
        for _ in range(rounds):
            for p in range(parts):
                held = [[] for _ in book[p]]
                for _, v in own:
                    held[nearest(v[p], book[p])[1]].append(v[p])
                book[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for h, e in zip(held, book[p], strict=True)]
        books[dim] = (width, book)
    out = []
    for i, v, lab in kept:
        width, book = books[len(v)]
        v = v + [0] * (parts * width - len(v))
        best = [nearest(v[p * width : (p + 1) * width], book[p]) for p in range(parts)]
        text = ",".join(str(c) for part in book for e in part for c in e)
        out.append([i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab, hashlib.sha256(text.encode()).hexdigest()])
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    return sorted(((i, c, e, total[lab], s) for i, c, e, lab, s in out), key=repr)


def nearest(x, book):
    return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))


@pytest.mark.parametrize(("seed", "dim", "parts", "entries"), [(1, 16, 16, 20), (2, 10, 4, 7), (3, 6, 3, 64)])
def test_codes_are_brute_force(spark, seed, dim, parts, entries):
    rows = many_vectors(seed, 300, dim, 5) + ODD_VECTORS + [(5000, [-0.001] * dim, None), (5001, [0.5] * dim, None)]
    df = spark.createDataFrame(rows, VECTOR).withColumns({c: F.lit("x") for c in ("id", "x", "l", "code", "error")}).repartition(5)
    for more in ({}, {"cells": 64}):
        got = codebooks.encode_vectors(df, parts=parts, entries=entries, **more)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows, parts, entries, 2)


def test_codes_of_huge_numbers_and_none(spark):
    rows = [(1, [1e300, 2.0], 1), (2, [-1e300, 1.0], 1), (3, [1e9, -3.0], 2)]
    got = codebooks.encode_vectors(spark.createDataFrame(rows, VECTOR), parts=2, entries=1).collect()
    assert len(got) == 3 and max(r["error"] for r in got) == max(r["label_error"] for r in got) == (1 << 63) - 1
    assert codebooks.encode_vectors(spark.createDataFrame([], VECTOR)).collect() == []


# --- op6 at the size of its own index -------------------------------------------------------------------------------


def full_index(dim, lists=1024, parts=256):
    rng = np.random.default_rng(1)
    return ann.Index(np.eye(dim), ann.unit(rng.normal(size=(lists, dim))), rng.normal(size=(parts, dim)) * 0.1, 8, np.arange(4), rng.normal(size=(4, dim)), np.zeros(4, np.int64)), rng


def test_cells_in_order_are_those_of_plain_distances():
    index, rng = full_index(12, 30, 7)
    x = ann.unit(rng.normal(size=(50, 12)))
    centres = (index.centroids[:, None] + index.residuals[None]).reshape(-1, 12)
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert np.array_equal(index.order(x, 9), np.argsort(far, axis=1, kind="stable")[:, :9])
    cells = rng.integers(len(centres), size=(50, 5))
    assert np.array_equal(index.places(x, cells), np.take_along_axis(np.argsort(np.argsort(far, axis=1), axis=1), cells, 1))


def test_full_index_fits_in_bounded_memory():
    """1024 lists of 256 parts at 768 dimensions: ordering cells and finding the number of probes."""
    import tracemalloc

    index, rng = full_index(768)
    x = ann.unit(rng.normal(size=(64, 768)))
    tracemalloc.start()
    assert index.order(x, 8).shape == (64, 8)
    assert index.places(x[:16], rng.integers(1024 * 256, size=(16, 5))).shape == (16, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_fit_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    x = rng.normal(size=(2048, 768))
    tracemalloc.start()
    index = ann.fit(np.arange(2048), x, 1024, 256, 5, 0.97, 1, rounds=2, trials=100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1 <= index.probes <= 1024 * 256 and peak < 300 << 20

"""Each operator against a brute-force version, an exact round trip or held-out accuracy; odd rows and empty tables."""

import hashlib
import json
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceloom.llm import ann, embedding_dedup, html_text, huffman, language, mixture, packing, repeats, simhash, subwords, suffixes, token_counts, token_files
from traceloom.llm.components import star_components
from traceloom.llm.xxh import xxh64_ranges

TEXT = "the cat sat on the mat and looked at the moon over the hill. "
LONG = " ".join(f"word{i % 977} und{i}" for i in range(30_000))
ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t", None, "a"), (4, "one", "en", "b"), (5, TEXT * 3, "en", "a"), (6, TEXT * 3, "en", "a"), (6, TEXT * 3, "en", "a"), (7, TEXT * 3 + "x", "en", None), (None, TEXT * 3, "en", "b"), (8, LONG, "de", "b"), (9, "Ünïcode ÇA va\u0000<|endoftext|> 你好", "fr", "c"), (10, "ABC def GHI jkl", "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators add or use.
CLASH = ("n_bytes", "n_tokens", "size", "p", "simhash", "score", "held_out", "kept", "copies", "part", "id", "t")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- helpers ------------------------------------------------------------------------------------------------------


def test_xxh64():
    rng = random.Random(1)
    buffer = bytes(rng.randrange(256) for _ in range(3000))
    a = np.array([rng.randrange(2900) for _ in range(500)])
    b = a + np.array([rng.randrange(100) for _ in range(500)])
    assert [int(x) for x in xxh64_ranges(buffer, a, b)] == [xxhash.xxh64_intdigest(buffer[i:j], 42) for i, j in zip(a, b, strict=True)]


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent if find(x) != x}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = star_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute_components(edges)
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------------------------------


def brute_simhash(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = raw.split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(data):
    prints = [brute_simhash(t) for _, t in data]
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for x, (d, _) in zip(label, data, strict=True):
        least[x] = min((v for v in (d, least.get(x)) if v is not None), default=None)
    return sorted(((d, f"{p:016x}", least[x]) for (d, _), p, x in zip(data, prints, label, strict=True)), key=repr)


def test_simhash(spark, odd, empty):
    assert rows(simhash.simhash_groups(odd)) == brute_groups([r[:2] for r in ODD])
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_of_hot_buckets(spark):
    """Near copies in one bucket, split into chunk pairs."""
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(300)]
    data = [(i, " ".join(base[:k] + [f"z{i}"] + base[k + 1 :])) for i in range(80) for k in [rng.randrange(300)]] + [(900 + i, f"other text {i} of its own") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_groups(data)
    assert rows(simhash.simhash_groups(df, cap=7)) == want == rows(simhash.simhash_groups(df))


def shingles_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def test_near_copies(spark):
    """Links of 0.8 of the five-word shingles; two texts of one often repeated line of their own are none."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(600)] for _ in range(8)]
    texts = []
    for b in base:
        for edits in (0, 4, 8, 12, 16):
            w = list(b)
            for k in rng.sample(range(0, 600, 6), edits):
                w[k] = f"x{rng.random()}"
            texts.append(" ".join(w))
    line = "the same line stands here again and again "
    texts += [line * 200 + " ".join(f"{c}{i}" for i in range(60)) for c in "ab"] + [texts[0].upper(), "", None, "one two", "One  two"]
    shingles = [shingles_of(t) for t in texts]
    edges = [(i, j) for i, a in enumerate(shingles) for j in range(i) if len(a & shingles[j]) >= 0.8 * len(a | shingles[j])]
    root = brute_components(edges)
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "x")], "doc_id long, text string")
    want = sorted([(i, root.get(i, i)) for i in range(len(texts))] + [(0, 0)])
    groups = lambda df, **o: simhash.simhash_groups(df, words_each=5, least=0.8, **o)
    assert len(root) >= 20
    for room in (200_000, 2000):
        got = groups(df, room=room).select("doc_id", "component_id", "kept").collect()
        assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(want, key=repr)
        assert sorted(r[0] for r in got if r[2]) == sorted([0, *(i for i in range(len(texts)) if i not in root)])
    assert groups(df.limit(0)).count() == 0
    # texts that share an id are nodes of their own
    same = groups(spark.createDataFrame([(1, texts[0]), (1, texts[10]), (2, texts[0])], "doc_id long, text string"), keep=["text"])
    assert sorted(((r["doc_id"], r["text"] == texts[0], r["kept"]) for r in same.collect())) == [(1, False, True), (1, True, True), (2, True, False)]


# --- 2, 3, 9: tokens ----------------------------------------------------------------------------------------------


def test_token_counts(odd, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    got = token_counts.token_counts(odd, split_chars=50)
    assert set(got.columns) == set(odd.columns)
    want = sorted(((d, len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in ODD), key=repr)
    assert rows(got.select("doc_id", "n_bytes", "n_tokens")) == want
    assert token_counts.token_counts(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab Cé\n\t.'1▁ ᠎")), max_size=60), st.integers(1, 10))
def test_cuts_keep_counts(text, limit):
    model, safe = token_counts.load(token_counts.MODEL)
    assert safe and len(model.encode(text)) == sum(len(model.encode(x)) for x in token_counts.cut(text, limit))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("abZ éÉßİ'1,.\n\t \x1c")), st.characters(exclude_categories=["Cs"])), max_size=30).map(lambda t: t.replace("z", "<|endoftext|>")), max_size=4))
def test_pieces_keep_ids(texts):
    for path in (subwords.WORDS, subwords.BYTES):
        e = subwords.encoder(path)
        ids, n = e.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == [e.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_real_texts_keep_ids(sf):
    """Whole documents, one of them very long, and ones with white space beyond ASCII, in one batch and in small memory."""
    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()] + [LONG, "日本語 の　文 " * 50, "a\u2003 b \u180e c  d\n\n e\x85 f" * 40, "x" * 5000]
    for path in (subwords.WORDS, subwords.BYTES):
        for held in (1000, 1 << 26):
            e = subwords.Encoder(path, held)
            assert e.cutting
            for some in (texts[:100], texts[100:]):
                ids, n = e.encode(pa.array(some))
                assert all(x.tolist() == e.model.encode(t, add_special_tokens=False).ids for x, t in zip(np.split(ids, np.cumsum(n)[:-1]), some, strict=True))


def test_unknown_model_keeps_texts_whole(tmp_path):
    """A model whose splitting isn't recognised gets whole texts."""
    d = json.loads(Path(subwords.BYTES).read_text())
    d["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    (tmp_path / "m.json").write_text(json.dumps(d))
    e = subwords.Encoder(str(tmp_path / "m.json"))
    texts = ["the cat  sat", "", "on the mat"]
    ids, n = e.encode(pa.array(texts))
    assert e.cutting == "" and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.model.encode(t).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(6, 12))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=41)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (len(ids) == 0 or sum(2.0 ** -int(n) for n in lengths if n) <= 1)
    for counts in (None, np.array([len(ids) // 3, 0, len(ids) - len(ids) // 3])):
        bits, marks = huffman.pack(ids, huffman.canonical(lengths), lengths, 16, counts)
        sizes = np.array([min(16, n - i) for n in ([len(ids)] if counts is None else counts.tolist()) for i in range(0, n, 16)], np.int64)
        assert (huffman.unpack(bits, marks, sizes, *huffman.tables(lengths)) == ids).all()


def test_token_files(spark, odd, empty, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "a"), part_ids=2000, block_ids=300)
    got = token_files.read_token_files(spark, str(tmp_path / "a")).collect()
    model = Tokenizer.from_file(subwords.WORDS)
    want = Counter((d, tuple([*model.encode(t or "", add_special_tokens=False).ids, 2])) for d, t, *_ in ODD)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    token_files.write_token_files(empty, str(tmp_path / "b"))
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_packing(spark, odd, empty):
    got = packing.pack_documents(odd, room=64).collect()
    model = Tokenizer.from_file(subwords.BYTES)
    whole = Counter((d, tuple([*model.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, *_ in ODD)
    for d, ids in whole:
        own = [r for r in got if r["doc_id"] == d]
        n = len(ids)
        cuts = [0, *range(n % 64 or 64, n, 64), n] if n > 64 else [0, n]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            raw = np.array(ids[a:b], "<u4").tobytes()
            same = [r for r in own if (r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) == (i, a, b - a, zlib.crc32(raw), raw)]
            assert len(same) >= whole[d, ids]
    assert len(got) == sum(-(-len(ids) // 64) * n for (_, ids), n in whole.items())
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(empty).count() == 0


def test_parts_with_ids_are_bounded_by_bytes(odd):
    pieces = packing.token_pieces(odd, 64, "doc_id", "text", subwords.BYTES, 0, True, part_bytes=3 * 64 * 4).groupBy("part").count().collect()
    assert len(pieces) > 1 and max(r["count"] for r in pieces) <= 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_two_fit(sizes):
    counts = np.bincount(np.array(sizes, np.int64), minlength=51)
    patterns = packing.best_two_fit(counts)
    used = Counter()
    for lengths, repeat in patterns:
        assert sum(lengths) <= 50
        for n in lengths:
            used[n] += repeat
    assert used == Counter(sizes)
    n = sum(r for _, r in patterns)
    assert -(-sum(sizes) // 50) <= n <= max(1, int(1.25 * -(-sum(sizes) // 50)) + 1)


# --- 4 ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        new = {s for s in order if target[s] > most * sizes[s]} - full
        if not new:
            return target
        full |= new


def test_mixture(spark, odd, empty):
    import re

    got = mixture.mixture(odd)
    assert rows(got) == rows(mixture.mixture(odd))
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ODD}
    assert rows(got.select("doc_id", "size")) == sorted(((r[0], size[id(r)]) for r in ODD), key=repr)
    per = Counter()
    for r in ODD:
        per[r[3]] += size[id(r)]
    target = brute_targets(per)
    assert {(r["source_size"], round(r["target"], 6)) for r in got.collect()} == {(per[s], round(target[s], 6)) for s in per}
    assert all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in got.collect())
    assert mixture.mixture(empty).count() == 0


def test_mixture_meets_targets(spark):
    rng = random.Random(4)
    data = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(int(rng.lognormvariate(3, 1)) + 1)), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(3000)]
    got = mixture.mixture(spark.createDataFrame(data, "doc_id long, text string, source string"), keep=["source"], block=100)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.sum("copies").alias("c"), F.count("*").alias("n"), F.first("source_size").alias("s")).collect():
        assert abs(r["t"] - r["w"]) <= 0.002 * r["w"] + 5
        assert abs(r["c"] - r["n"] * r["w"] / r["s"]) <= 10


# --- 5 ------------------------------------------------------------------------------------------------------------


def test_language(spark, odd, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marked = language.identify(docs).where("held_out").collect()
    assert len(marked) > 30 and sum(r["lang_pred"] == r["lang"] for r in marked) >= 0.97 * len(marked)
    got = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(empty).count() == 0
    none = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_mixtures_by_plain_em():
    """Proportions and sets against a plain version over lists, up to all of seven languages."""
    rng = np.random.default_rng(12)
    size, langs = 1 << 12, [f"l{i}" for i in range(7)]
    model = language.Model(langs, np.log(rng.dirichlet(np.full(7, 0.4), size) * 1e-2 + 1e-5).astype(np.float32))
    pool = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    best = {w: int(np.add.reduce(model.logp[language.features([w], size)[0].astype(int)]).argmax()) for w in pool}
    texts = []
    for n in (1, 2, 5, 7):
        own = [[w for w in pool if best[w] == i] for i in rng.permutation(7)[:n]]
        texts.append(" ".join(rng.choice(o) for _ in range(150) for o in own if o))
    found, share = language.mixtures([*texts, "", "12"], model)

    def plain(text):
        logs = [[float(sum(model.logp[int(c), i] for c in language.features([w], size)[0])) for i in range(7)] for w in text.split()]
        like = [[np.exp(x - max(row)) for x in row] for row in logs]

        def em(theta, times):
            for _ in range(times):
                total = [0.0] * 7
                for row in like:
                    part = [a * b for a, b in zip(row, theta, strict=True)]
                    for i, x in enumerate(part):
                        total[i] += x / sum(part)
                theta = [x / len(like) for x in total]
            return theta

        full = em([1 / 7] * 7, 12)
        order, kept = sorted(range(7), key=lambda i: -full[i]), None
        for m in range(1, 8):
            theta = [full[i] + 1e-6 if i in order[:m] else 0.0 for i in range(7)]
            theta = em([x / sum(theta) for x in theta], 3 if m > 1 else 0)
            value = sum(np.log(sum(a * b for a, b in zip(row, theta, strict=True))) for row in like) - 0.5 * m * np.log(len(like) + 1)
            if kept is not None and value <= kept[0]:
                break
            kept = (value, theta)
        return max(range(7), key=lambda i: kept[1][i]), max(kept[1]), sum(x > 0 for x in kept[1])

    want = [plain(t) for t in texts]
    assert [w[0] for w in want] == found[:4].tolist() and np.allclose([w[1] for w in want], share[:4], atol=2e-3)
    assert want[3][2] > 4 and found[4:].tolist() == [-1, -1]


def test_landing_keeps_probabilities():
    """Settled units stay, and each fractional one is taken as often as its probability says."""
    size, p = np.array([5, 9, 3, 7]), np.array([1.0, 0.3, 0.6, 0.0])
    rng, total = np.random.default_rng(1), np.zeros(4)
    for _ in range(4000):
        q = p.copy()
        mixture.land(size, q, rng)
        assert set(q.tolist()) <= {0.0, 1.0} and q[0] == 1 and q[3] == 0
        total += q
    assert np.allclose(total / 4000, p, atol=0.03)


def test_mixture_of_rows_without_id(spark):
    data = [(None, " ".join(["w"] * (i % 7 + 1)) + f" {i}", "a" if i % 3 else "b") for i in range(600)]
    got = mixture.mixture(spark.createDataFrame(data, "doc_id long, text string, source string"), keep=["source"], block=50)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect():
        assert abs(r["t"] - r["w"]) <= 0.01 * r["w"] + 5


def test_mixed_languages():
    model = language.Model(["x", "y"], np.log(np.full((1 << 10, 2), 1e-4)).astype(np.float32))
    codes = [language.features([w], 1 << 10)[0].astype(int) for w in ("aaa bab", "ooo uou")]
    for i, c in enumerate(codes):
        model.logp[c, i] = np.log(0.1)
    best, share = language.mixtures(["aaa bab " * 30 + "ooo uou " * 10, "ooo", "", "123"], model)
    assert best.tolist() == [0, 1, -1, -1] and abs(share[0] - 0.75) < 0.02 and share[1] == 1


# --- 6, 8: vectors ------------------------------------------------------------------------------------------------


def vectors(spark, rng, n=400, dim=16):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[50] + 0.02 * rng.normal(size=(40, dim))
    x[100:130] = x[100]
    data = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    data[5] = (5, None, 1)
    data[7] = (7, [0.0] * dim, 1)
    data[9] = (9, [float("nan")] * dim, 1)
    data[11] = (11, [None] * dim, 1)
    data[13] = (13, data[16][1], None)
    data += [(n, [1.0, 2.0], 1), (None, data[3][1], 0), (50, data[50][1], 2)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def test_embedding_groups(spark):
    data, df = vectors(spark, np.random.default_rng(5))
    sound = [d[0] is not None and d[1] is not None and d[2] is not None and all(v is not None and np.isfinite(v) for v in d[1]) and any(d[1]) for d in data]
    links, edges = Counter(), []
    for i, a in enumerate(data):
        for j in range(i):
            b = data[j]
            if sound[i] and sound[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    edges.append((a[0], b[0]))
    root = brute_components(edges)
    want = sorted(((d[0], links[i], root.get(d[0], d[0]), d[0] is not None and root.get(d[0], d[0]) == d[0]) for i, d in enumerate(data)), key=repr)
    assert rows(embedding_dedup.embedding_groups(df)) == want == rows(embedding_dedup.embedding_groups(df, cap=9))
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0
    clashing = df.withColumns({c: F.lit(1) for c in ("v", "l", "id", "c", "n", "h", "n_links", "component_id", "kept", "part")})
    assert rows(embedding_dedup.embedding_groups(clashing)) == want
    # near vectors of one id and label; another vector shares the id too
    a, b, far = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 0.0, 1.0]
    got = embedding_dedup.embedding_groups(spark.createDataFrame([(1, a, 0), (1, b, 0), (2, a, 1), (2, far, 1), (3, b, 1)], "vec_id long, embedding array<float>, label int"))
    assert rows(got) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (2, 0, 2, True), (3, 1, 2, False)], key=repr)


@pytest.mark.parametrize("rows_a_label", [1_000, 30_000, 3_000_000])
def test_layout_keeps_recall_as_hashes_grow(rows_a_label):
    """The tables chosen find pairs of just the least cosine, of other vectors than those the chance was measured on."""
    tables, hashes = embedding_dedup.layout(6, rows_a_label, 0.93, 3, 2e-5, 7)
    assert 128**hashes >= 8 * rows_a_label and (hashes == 2 or 128 ** (hashes - 1) < 8 * rows_a_label)
    rng = np.random.default_rng(99)
    x, z = rng.standard_normal((2, 1500, 50))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (embedding_dedup.probes(v, tables, hashes, 3, 7) for v in (x, 0.93 * x + np.sqrt(1 - 0.93**2) * z))
    same = a[:, :, :, None] == b[:, :, None, :]
    same[:, :, 1:, 1:] = False
    assert same.any(axis=(1, 2, 3)).mean() >= 0.999


def test_embedding_groups_with_more_hashes(spark):
    _, df = vectors(spark, np.random.default_rng(6))
    assert rows(embedding_dedup.embedding_groups(df, hashes=4)) == rows(embedding_dedup.embedding_groups(df, hashes=2, tables=12))


def brute_nearest(data, k=5):
    """The best answers of each query, over rows of its length."""
    sound = [(d[0], np.array(d[1], float)) for d in data if d[0] is not None and d[1] is not None and all(v is not None and np.isfinite(v) for v in d[1]) and any(d[1])]
    out = {}
    for q, v in sound:
        if q % 50 == 0:
            for i, w in sound:
                if i != q and len(w) == len(v):
                    x, y = v / np.abs(v).max(), w / np.abs(w).max()
                    score = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)
                    own = out.setdefault(q, {})
                    own[i] = max(score, own.get(i, -2))
    return {q: sorted(((-round(s, 12), i) for i, s in own.items()))[:k] for q, own in out.items()}


@pytest.mark.parametrize("options", [{"lists": 12}, {"lists": 6, "parts": 4, "cap": 60, "query_cap": 5}, {}])
def test_nearest(spark, options):
    data, df = vectors(spark, np.random.default_rng(6), n=900)
    data += [(1000, [1.0, 2.0], 1), (1001, [2.0, 1.0], 1), (1050, data[20][1], 1), (1050, data[21][1], 1), (1100, [1e200 * x for x in data[22][1]], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "cell", "score", "rank", "__q", "own")})
    want, got = brute_nearest(data), {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -round(r["score"], 12), r["vec_id"]))
    assert sorted(got) == sorted(want)
    assert all([r for r, _, _ in got[q]] == list(range(1, len(want[q]) + 1)) for q in want)
    assert sum(len({i for _, i in want[q]} & {i for _, _, i in got[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
    assert sum([(s, i) for _, s, i in got[q]] == want[q] for q in want) >= 0.8 * len(want)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.nearest(df.where("vec_id IN (0, 50, 51)"), F.col("vec_id") % 50 == 0)
    assert few.groupBy("query_id").count().where("count < 2").count() == 0


def test_nearest_on_the_table(spark):
    """Recall on all embeddings at sf0.1."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = df.select("vec_id", "embedding").toPandas()
    x = np.array(data["embedding"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = data["vec_id"].to_numpy()
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -2
        hits += len(set(ids[np.lexsort((ids, -np.round(score, 12)))[:5]].tolist()) & got[ids[q]])
    assert hits >= 0.95 * 5 * int((ids % 50 == 0).sum())


# --- 7 ------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="col-{n}"><div class="entry"><h2>Title {n} &amp; more</h2><p>A paragraph that is long&nbsp;enough to <b>win</b>,
indeed.<p>Another one &lt;here&gt;, of number {n}.<ul><li>first<li>second</ul></div><aside><p>Aside text</p></aside><section class="comments"><p>I love this long comment, it is far longer than all of the article put together, so that it wins by size.</p></section></div>
<script>var a = "<p>no</p>";</script><form><p>Mail</p></form><footer>&copy; x</footer></body></html>"""
WANT = "Title {n} & more\nA paragraph that is long enough to win, indeed.\nAnother one <here>, of number {n}.\nfirst\nsecond"


def test_html(spark):
    data = [(i, "http://h.example/x", PAGE.format(n=i)) for i in range(5)] + [(10, None, PAGE.format(n=1)), (11, "http://h.example/y", None), (12, "http://h.example/z", ""), (13, "nonsense", "<p>plain"), (14, "http://o.example/", "<div class='post'><p>cut off te"), (0, "http://h.example/x", PAGE.format(n=0))]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("n_chars", F.lit(1)).withColumn("host", F.lit("x")).withColumn("text", F.lit("y"))
    want = [WANT.format(n=i) for i in range(5)] + [WANT.format(n=1), "", "", "plain", "cut off te", WANT.format(n=0)]
    for bound in (1 << 20, -1):
        got = html_text.extract_text(df, broadcast_bytes=bound)
        assert rows(got.select("page_id", "url", "text", "n_chars")) == sorted(((d[0], d[1], t, len(t)) for d, t in zip(data, want, strict=True)), key=repr)
    assert html_text.extract_text(df.limit(0)).count() == 0


def brute_consensus(pages):
    """All voted paths of a host in order, tried one by one on each page."""
    votes = {}
    for host, html in pages:
        own = html_text.best_container(html_text.parse(html))
        if own:
            votes.setdefault(host, Counter())[own[0]] += own[1] ** 0.5
    out = []
    for host, html in pages:
        page = html_text.parse(html)
        own = html_text.best_container(page)
        ranked = [p for p, _ in sorted(votes.get(host, {}).items(), key=lambda x: (-round(x[1], 3), x[0]))]
        out.append(html_text.text_by(html_text.parse(html), [*ranked, *([own[0]] if own else [])]))
    return out


def test_html_votes_of_many_paths(spark):
    """A host with more paths than come as a list, against trying them all."""
    rng = random.Random(5)
    pages = []
    for i in range(60):
        kind = rng.randrange(25)
        name = "".join("abcdefghij"[int(c)] for c in str(kind))
        body = "".join(f"<p>Sentence {i} {j} of the long text of this page.</p>" for j in range(rng.randrange(1, 6)))
        side = "".join(f"<p>Other {i} {j}</p>" for j in range(rng.randrange(4)))
        pages.append(("h.example" if i % 4 else "o.example", f'<html><body><div class="k{name}">{body}</div><div class="s{"abc"[i % 3]}">{side}</div></body></html>'))
    df = spark.createDataFrame([(i, f"http://{h}/{i}", t) for i, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    want = brute_consensus(pages)
    for winners in (16, 3, 1000):
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(df, winners=winners).collect()}
        assert [got[i] for i in range(len(pages))] == want


def test_html_of_deep_and_long_pages():
    deep = "<div class='a1'>" * 20_000 + "<p>text at the bottom</p>" + "</div>" * 20_000
    page = html_text.parse(deep)
    assert html_text.text_by(page, [html_text.best_container(page)[0]]) == "text at the bottom"
    long = "<article>" + "".join(f"<p>part {i}</p>" for i in range(30_000)) + "</article>"
    page = html_text.parse(long)
    assert html_text.text_by(page, [html_text.best_container(page)[0]]).count("\n") == 29_999


def test_class_words_of_wrappers():
    """Class words of wrappers, states and headings cut no article; those of comments and asides still do."""
    body = "<h1>Title</h1><p>A paragraph of the article, long enough to win.</p><p>And one more paragraph of it.</p>"
    want = "Title\nA paragraph of the article, long enough to win.\nAnd one more paragraph of it."
    rest = '<div class="sidebar"><p>Aside</p></div><div id="comments" class="comments-area"><p>A comment</p></div>'
    pages = [
        f'<div class="content-sidebar-wrap"><main>{body}</main>{rest}</div>', f'<div class="site no-sidebar"><div class="entry">{body}</div>{rest}</div>', f'<article class="post comments-open">{body}</article>{rest}',
        f'<article><div class="post-header"><h1>Title</h1></div>{body[14:]}</article>{rest}', f'<div class="form"><div>{body}</div></div>', f'<div class="sidebar-left side"><div><article>{body}</article></div></div>{rest}',
    ]
    for p in pages:
        page = html_text.parse(f"<html><body>{p}</body></html>")
        own = html_text.best_container(page)
        assert own and html_text.text_by(page, [own[0]]) == want, p
    assert html_text.kept_blocks(html_text.parse(f"<p>text</p>{rest}"))[0][0] == "text" and len(html_text.kept_blocks(html_text.parse(f"<p>text</p>{rest}"))) == 1


# --- 10 -----------------------------------------------------------------------------------------------------------


def brute_repeats(data, window=50):
    first = {}
    for d, t in data:
        if d is not None:
            for i in range(len(t) - window + 1):
                w = t[i : i + window]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - window + 1):
                if first[t[i : i + window]] < d:
                    gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        out.append((d, len(t), sum(gone), sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_sort():
    """Order and common lengths against sorting by the bytes, also where all hashes collide."""
    rng = np.random.default_rng(3)
    for letters, n in ((2, 300), (1, 40), (200, 100)):
        data = rng.integers(0, letters, (n, 24)).astype(np.uint8)
        data[n // 2 :] = data[: n - n // 2]
        row, at = rng.integers(0, n, 600), rng.integers(0, 12, 600)
        group = np.sort(rng.integers(0, 9, 600))
        text = [data[r, p : p + 12].tobytes() for r, p in zip(row, at, strict=True)]
        for broken in (False, True):
            s = suffixes.Suffixes(data, 12)
            if broken:
                s.sums = np.zeros_like(s.sums)
            order, common = s.extensions(row, at, group)
            want = sorted(range(600), key=lambda i: (group[i], text[i]))
            assert [(group[i], text[i]) for i in order] == [(group[i], text[i]) for i in want]
            for k in range(600):
                if k and group[order[k]] == group[order[k - 1]]:
                    x, y = text[order[k - 1]], text[order[k]]
                    assert common[k] == next((n for n in range(12) if x[n] != y[n]), 12)
                else:
                    assert common[k] == -1
            assert broken or order.tolist() == want  # stable


@pytest.mark.parametrize("options", [{}, {"cap": 0}, {"batch_bytes": 500, "parts": 3}, {"batch_bytes": 500, "block": 1}, {"hot_rows": 0, "look_at": 1, "salts": 3, "batch_bytes": 500}, {"hot_rows": 12, "look_at": 1, "batch_bytes": 300}, {"same_id": 1}, {"same_id": 2, "cap": 0}, {"seed": -1, "batch_bytes": 300}, {"seed": 5}])
def test_repeats(spark, options):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(30, 160))) for _ in range(12)]
    data = [(rng.choice([i, i, i, i % 40, None]), "".join(rng.choice(base)[rng.randrange(0, 40) :][: rng.randrange(10, 150)] for _ in range(rng.randrange(0, 6))) if rng.random() > 0.05 else None) for i in range(150)]
    data += [(500, "ab" * 200), (501, "ab" * 300), (502, "x" * 49), (503, "x" * 50), (504, "x" * 51), (3, "x" * 80)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("n_bytes", F.lit(2))
    got = repeats.drop_repeats(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(got) == brute_repeats([(d, (t or "").encode()) for d, t in data])


def test_repeats_of_odd_rows(odd, empty):
    got = repeats.drop_repeats(odd, as_text=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(got) == brute_repeats([(r[0], (r[1] or "").encode()) for r in ODD])
    assert repeats.drop_repeats(empty).count() == 0


def test_repeats_deals_rows_out():
    """Texts of one id go to many parts."""
    th = np.array([zlib.crc32(f"text {i}".encode()) for i in range(400)], np.int64)
    assert len(set(repeats.part_of(np.full(400, 7), th, 16).tolist())) == 16


def test_repeats_of_rows_without_id(spark):
    """Rows without an id meet no other rows: they are cut in the tasks that read them."""
    df = spark.createDataFrame([(None, TEXT * 3 + str(i)) for i in range(40)] + [(1, TEXT), (2, TEXT)], "doc_id long, text string")
    out = repeats.drop_repeats(df, part_bytes=50)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow alone" in plan
    got = rows(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == brute_repeats([(r["doc_id"], r["text"].encode()) for r in df.collect()])


def test_long_texts_in_pieces():
    rng = random.Random(8)
    big = "".join(rng.choice("abcdefgh ") for _ in range(5000)).encode()
    texts = [big, big[100:4000] + b"zz" + big[200:900]]
    found = lambda chunk: {(int(d), int(p), int(h), int(c)) for part in repeats.anchors_of(texts, 50, 20, chunk) for d, p, h, c in zip(*part, strict=True)}
    assert found(1 << 19) == found(700)


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark, odd, empty, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out = corpus_pipeline.write_table(out, name)
        if name == "language":
            assert out.count() >= 0.98 * docs.where("text RLIKE '[a-z]'").count()
        if name == "simhash":
            have = [(r["doc_id"], shingles_of(r["text"])) for r in docs.select("doc_id", "text").collect()]
            root = brute_components([(a, b) for i, (a, x) in enumerate(have) for b, y in have[:i] if len(x & y) >= 0.8 * len(x | y)])
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({d for d, _ in have} - set(root)) and root
        if name == "repeats":
            kept = {r[0]: r[4] for r in brute_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()])}
            got = {r["doc_id"]: r["text"] for r in out.collect()}
            assert all(hashlib.sha256(t.encode()).hexdigest() == kept[d] for d, t in got.items() if "�" not in t and all(ord(c) < 128 for c in t))
        docs = out
    packed = corpus_pipeline.packing(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for frame in (odd.select("doc_id", "text", "lang", "source"), empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, sf).count()

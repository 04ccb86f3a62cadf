"""SimHash near-duplicates: fingerprints, and links found through pivot distance tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.batches import added, by_bytes, with_columns
from traceloom.llm.buckets import complete, deal
from traceloom.llm.components import star_components
from traceloom.llm.store import write_table
from traceloom.llm.xxh import xxh64_ranges

U = np.uint64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(texts: list[bytes], words_each: int, chunk: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of the shingles, in order, some at a time; a text of fewer words is one shingle."""
    words, ends = [], [0]
    for t in texts:
        words += t.translate(LOWER).split()  # ASCII white space
        ends.append(len(words))
    if not words:
        return
    joined = b" ".join(words)
    del words
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin, stop = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    first, n_words = np.array(ends[:-1]), np.diff(ends)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - words_each + 1, 1), 0)
    offset = np.concatenate([[0], np.cumsum(n_shingles)])
    for lo in range(0, int(offset[-1]), chunk):
        k = np.arange(lo, min(lo + chunk, int(offset[-1])))
        doc = np.searchsorted(offset, k, side="right") - 1
        word = first[doc] + k - offset[doc]
        last = np.minimum(word + words_each, first[doc] + n_words[doc]) - 1
        base = begin[word[0]]
        yield doc, xxh64_ranges(joined[base : stop[last[-1]]], begin[word] - base, stop[last] - base)


def simhashes(texts: list[bytes], words_each: int = 3, chunk: int = 20_000) -> np.ndarray:
    """Fingerprints (uint64) of texts: a bit is set where over half of the shingle hashes have it."""
    ones, n_shingles = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for doc, h in shingle_hashes(texts, words_each, chunk):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.diff(doc, prepend=-1))
        ones[doc[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        n_shingles[doc[at]] += np.diff(np.append(at, len(doc)))
    over = (2 * ones > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def with_simhash(docs: DataFrame, text: str = "text", column: str = "simhash", words_each: int = 3, batch_bytes: int = 2 << 20) -> DataFrame:
    """Appends the 64-bit fingerprint as a (signed) long; a text that is null or has no words gets 0."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, text, batch_bytes):
                texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
                yield with_columns(batch, {column: pa.array(simhashes(texts, words_each).view(np.int64))})

    return docs.mapInArrow(add, added(docs, [(column, T.LongType())]))


def pivots(n: int) -> np.ndarray:
    """n <= 64 reference fingerprints, any two of them 32 bits apart: bit i of the j-th is the parity of i & j."""
    i = np.arange(64)
    return np.array([sum(int(np.bitwise_count(np.uint64(b & j)) & 1) << int(b) for b in i) for j in range(n)], np.uint64)


def linked_pairs(fp: np.ndarray, bucket: np.ndarray, refs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (i, smallest index reached) of the links inside buckets.

    Rows come sorted by bucket and then by the distance to the first pivot. The table of distances to all
    pivots is made first; a pair is discarded when a coordinate differs by over `most` (triangle inequality),
    at the first coordinate already while scanning, and what survives is verified.
    """
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    run_end = np.append(np.flatnonzero(np.diff(bucket)) + 1, n)
    left = np.repeat(run_end, np.diff(run_end, prepend=0)) - np.arange(n)
    label, i, step = np.arange(n), np.arange(n), 0
    while len(i):
        step += 1
        i = i[left[i] > step]
        i = i[table[i + step, 0] - table[i, 0] <= most]
        a, b = i, i + step
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for k in range(1, len(refs)):
            if not len(a):
                break
            near = np.abs(table[a, k] - table[b, k]) <= most
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= most
        a, b = a[near], b[near]
        while len(a):  # join the classes of the linked rows
            la, lb = label[a], label[b]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def near_links(prints: DataFrame, column: str = "simhash", most: int = 3, blocks: int = 6, n_pivots: int = 24, cap: int = 8192) -> DataFrame:
    """Links (a, b) between different fingerprints of at most `most` differing bits, as many as keep each group connected.

    Of `blocks` bit blocks, `most` differing bits leave blocks - most as they are, so linked fingerprints meet
    in a bucket for one of the choices of that many blocks. Pivot distance tables work inside the buckets.
    A bucket of over `cap` fingerprints is dealt out as pairs of chunks, so no task gets an unbounded group.
    """
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    mask = [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    keys = [F.col("fp").bitwiseAND(F.lit(signed(sum(mask[i] for i in chosen)))) for chosen in combinations(range(blocks), blocks - most)]
    fps = prints.select(F.col(column).alias("fp")).distinct()
    rows = fps.select("fp", F.posexplode(F.array(*keys)).alias("tab", "key"))
    refs = pivots(n_pivots)
    rows = deal(rows, ["tab", "key"], F.xxhash64("fp"), cap).withColumn("d0", F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(refs[0])))))
    rows = rows.sortWithinPartitions("tab", "key", "i", "j", "d0", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, (fp,) in complete(batches, ["tab", "key", "i", "j"], ["fp"]):
            a, b = linked_pairs(fp.view(np.uint64), run, refs, most)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return rows.mapInArrow(link, "a long, b long")


def shingle_sets(texts: list[bytes], words_each: int) -> list[np.ndarray]:
    """The different shingle hashes (uint64, sorted) of each text."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for doc, h in shingle_hashes(texts, words_each):
        at = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, b in zip(at, np.append(at[1:], len(doc)), strict=True):
            parts[doc[a]].append(h[a:b])
    return [np.unique(np.concatenate(p)) if p else np.zeros(0, U) for p in parts]


def set_prints(sets: list[np.ndarray], chunk: int = 1 << 16) -> np.ndarray:
    """Fingerprints of sets of shingle hashes: a bit is set where over half of a set has it."""
    out = np.zeros(len(sets), U)
    lo = 0
    while lo < len(sets):
        hi, held = lo + 1, len(sets[lo])
        while hi < len(sets) and held + len(sets[hi]) <= chunk:
            held, hi = held + len(sets[hi]), hi + 1
        some = [i for i in range(lo, hi) if len(sets[i])]
        if some:
            ones = np.zeros((len(some), 64), np.int64)
            flat, n = np.concatenate([sets[i] for i in some]), np.array([len(sets[i]) for i in some])
            at = np.cumsum(n) - n
            for p in range(0, len(flat), chunk):  # of a long text, some shingles at a time
                bits = np.unpackbits(flat[p : p + chunk].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                own = np.flatnonzero((at < p + chunk) & (at + n > p))
                ones[own] += np.add.reduceat(bits, np.maximum(at[own] - p, 0), axis=0, dtype=np.int64)
            out[some] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(U).ravel()
        lo = hi
    return out


def band_keys(sets: list[np.ndarray], bands: int, each: int) -> np.ndarray:
    """(texts, bands) of hashes over `each` minima of a band; sets are sorted and not empty.

    The hashes of a set fall into bands x each bins by their size; a bin's value is its least hash, and an empty bin
    takes that of the first bin that has one in an order of its own, the same for all texts.
    """
    bins = bands * each
    value, filled = np.zeros((len(sets), bins), U), np.zeros((len(sets), bins), bool)
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = doc * bins + ((flat >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(cell, prepend=-1))
    value.ravel()[cell[at]], filled.ravel()[cell[at]] = flat[at], True
    turns = np.random.default_rng(17).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)
    row, col = np.nonzero(~filled)
    for turn in range(bins):
        if not len(row):
            break
        donor = turns[col, turn]
        has = filled[row, donor]
        value[row[has], col[has]] = value[row[has], donor[has]]
        row, col = row[~has], col[~has]
    out = np.zeros((len(sets), bands), U)
    for k in range(bins):
        out[:, k % bands] = (out[:, k % bands] ^ value[:, k]) * U(0x9E3779B97F4A7C15)
        out[:, k % bands] ^= out[:, k % bands] >> U(29)
    return out


def similar_pairs(sets: list[np.ndarray], fp: np.ndarray, label: np.ndarray, side: np.ndarray, both: bool, least: float, most: int, n_pivots: int = 24) -> Iterator[tuple[int, int]]:
    """Pairs of similarity `least` that join the classes given by label; with both, only pairs of unlike sides are tried.

    The table of distances to `n_pivots` of the fingerprints comes first: pairs of which a coordinate differs by
    over `most` are discarded, then those of which the fingerprints do; the sets verify the others.
    """
    size = np.array([len(s) for s in sets])
    at = np.cumsum(size) - size
    refs = fp[np.unique(np.linspace(0, len(fp) - 1, n_pivots).astype(int))]
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.unique(label, return_inverse=True)[1]
    for i in range(len(sets)):
        apart = label[i + 1 :] != label[i]
        if both:
            apart &= side[i + 1 :] != side[i]
        rest = np.flatnonzero(apart) + i + 1
        rest = rest[(size[rest] >= least * size[i] - 1e-9) & (size[i] >= least * size[rest] - 1e-9)]
        rest = rest[(np.abs(table[rest] - table[i]) <= most).all(axis=1)]
        rest = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= most]
        if not len(rest):
            continue
        own = np.zeros(len(known), bool)
        own[flat[at[i] : at[i] + size[i]]] = True
        for j in rest.tolist():
            if label[j] != label[i] and (shared := int(own[flat[at[j] : at[j] + size[j]]].sum())) >= least * (size[j] + size[i] - shared) - 1e-9:
                label[label == label[j]] = label[i]
                yield i, j


def similar_groups(docs: DataFrame, id_column: str, text: str, words_each: int, least: float, keep: list[str], most: int = 24, bands: int = 16, each: int = 4, batch_bytes: int = 1 << 20, room: int = 200_000) -> DataFrame:
    """Groups over links of a shingle similarity of `least`; see simhash_groups."""
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("t"), *(F.col(c).alias(f"keep_{c}") for c in keep))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        for whole in batches:
            for batch in by_bytes(whole, "t", batch_bytes):
                yield batch, [b" ".join((t or b"").translate(LOWER).split()) for t in batch.column("t").cast(pa.binary()).to_pylist()]

    def key_of(texts: list[bytes]) -> pa.Array:
        return pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            sets, keys = shingle_sets(texts, words_each), [None] * len(texts)
            some = [i for i, s in enumerate(sets) if len(s)]
            if some:
                for i, k in zip(some, band_keys([sets[i] for i in some], bands, each).view(np.int64).tolist(), strict=True):
                    keys[i] = k
            names = [c for c in batch.schema.names if c != "t"]
            made = [*(batch.column(c) for c in names), key_of(texts), pa.array(set_prints(sets).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=[*names, "key", "fp", "keys"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            sets = [s.view(np.int64) for s in shingle_sets(texts, words_each)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), key_of(texts), pa.array(sets, pa.list_(pa.int64()))], names=["least", "key", "set"])

    kept = T.StructType([f for f in rows.schema.fields if f.name != "t"] + [T.StructField("key", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    signed = write_table(rows.mapInArrow(sign, kept), "near-keys")
    nodes = signed.groupBy("key").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = write_table(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    buckets = nodes.select("node", "least", "key", "fp", F.posexplode("keys").alias("band", "h"))
    shared = buckets.groupBy("band", "h").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.min_by("fp", "node").alias("first_fp")).where("first < last").drop("last")
    met = write_table(buckets.join(shared, ["band", "h"]), "near-buckets")
    asked = met.select("node", "least", "key").distinct()
    some = rows.join(asked.select(F.col("least").alias("id")).distinct(), "id", "left_semi").select("id", "t").mapInArrow(spell, "least long, key binary, set array<long>")
    sets = write_table(some.join(asked, ["least", "key"]).select("node", "set").dropDuplicates(["node"]), "near-sets")

    # the distance to the first of a bucket is the coordinate of one pivot: it discards what can't be alike
    pairs = met.where((F.col("node") != F.col("first")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("first_fp"))) <= most)).select("node", "first").distinct()
    pairs = pairs.join(sets, "node").join(sets.select(F.col("node").alias("first"), F.col("set").alias("other")), "first")
    n = F.size(F.array_intersect("set", "other"))
    alike = pairs.where(n >= least * (F.size("set") + F.size("other") - n) - 1e-9).select(F.col("node").alias("a"), F.col("first").alias("b"))
    stars = write_table(alike, "near-stars")
    label = star_components(stars)
    left = met.join(label, "node", "left").select("band", "h", "node", "fp", F.coalesce("component", "node").alias("c"))
    open_ = left.groupBy("band", "h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("band", "h")
    left = left.join(open_, ["band", "h"]).join(sets, "node")
    chunks = left.groupBy("band", "h").agg(F.ceil(F.sum(F.size("set")) / room).cast("int").alias("chunks"))
    left = left.join(chunks, ["band", "h"]).withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    left = left.withColumn("o", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("i", F.least("o", "own")).withColumn("j", F.greatest("o", "own"))

    def compare(group: pa.Table) -> pa.Table:
        node, fp, c, side = (group.column(x).to_numpy() for x in ("node", "fp", "c", "own"))
        found = list(similar_pairs([np.asarray(s.values) for s in group.column("set")], fp.view(U), c, side, group.column("i")[0] != group.column("j")[0], least, most))
        return pa.table({"a": pa.array([int(node[a]) for a, _ in found], pa.int64()), "b": pa.array([int(node[b]) for _, b in found], pa.int64())})

    more = left.select("band", "h", "i", "j", "node", "fp", "c", "own", "set").groupBy("band", "h", "i", "j").applyInArrow(compare, "a long, b long")
    label = write_table(star_components(stars.unionByName(more)), "near-labels")
    named = nodes.select("node", "least", "key", "fp").join(label, "node", "left").withColumn("group", F.coalesce("component", "node"))
    first = named.groupBy("group").agg(F.min(F.struct("least", "key")).alias("first"))
    named = named.join(first, "group").select("key", "group", F.col("first.least").alias("component_id"), (F.col("first.key") == F.col("key")).alias("leads"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    stays = (F.col("leads") & (F.col("id") == F.col("component_id"))).alias("kept")
    return signed.join(named, "key").select(F.col("id").alias(id_column), hexed, "component_id", "group", stays, *(F.col(f"keep_{c}").alias(c) for c in keep))


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words_each: int = 3, most: int = 3, least: float | None = None, keep: list[str] | None = None, **options) -> DataFrame:
    """One row per row of docs: (id, fingerprint as 16 hex digits, component_id).

    component_id is the smallest id reachable over links of at most `most` differing bits, itself included;
    rows of one fingerprint are one node, so copies cost nothing. Null and wordless texts share fingerprint
    zero and link like any other. Rows with a null id keep their row and take part, but are no smallest id
    (component_id is null only if all ids reached are null). An empty table gives an empty result.

    With `least`, links are pairs whose sets of word shingles have that Jaccard similarity (case of ASCII letters and
    kind of white space don't count), each verified on the sets. Fingerprints of such pairs can differ in many bits
    (about 10 at 0.8), so candidates meet in buckets of minima of shingle hashes; fingerprints, then of the sets,
    discard candidates through pivot distances and their own, at over 24 bits. A pair of similarity s is a
    candidate with probability 1 - (1 - s ** 4) ** 16, 0.9998 at 0.8. Members of a bucket meet its first first, then,
    where a bucket still has several components, each other, in groups of about `room` shingles. Texts of equal words
    are one node, null and wordless ones too; rows with a null id have no row; the result also has group (a
    number), kept (true for the copies of one text of smallest id of each group) and the columns named in keep.
    """
    if least is not None:
        return similar_groups(docs, id_column, text, words_each, least, keep or [], **options)
    prints = write_table(with_simhash(docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")), "t", words_each=words_each).select("id", "simhash"), "simhash")
    labels = write_table(star_components(near_links(prints, most=most, **options)), "simhash-labels")
    nodes = prints.groupBy(F.col("simhash").alias("node")).agg(F.min("id").alias("least")).join(labels, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.select("node", "component").join(ids, "component").select(F.col("node").alias("simhash"), "component_id")
    hexed = F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint")
    return prints.join(nodes, "simhash").select(F.col("id").alias(id_column), hexed, "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Passages that repeat across documents: a suffix sort, by polynomial prefix hashes, of the suffixes near sampled places."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.batches import by_bytes, give_back
from traceloom.llm.store import write_table
from traceloom.llm.suffixes import Suffixes

U = np.uint64
MIX = U(0x9E3779B97F4A7C15)
FOUND = "kind int, part int, doc array<long>, th array<long>, x array<long>, y array<long>, z array<long>, w array<long>"
COVERED, AROUND, ASKED = 1, 2, 3  # x to y is covered; all windows with the anchor at x are; compare the windows with the anchor at x, of hash y
VERIFY = 5  # the bytes from x to y are those of the other row of key z
HOT = 4  # as ASKED, but its class may have more records: the surroundings are in z


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * MIX
    return x ^ (x >> U(29))


@lru_cache(maxsize=8)
def family(which: int, seed: int) -> tuple[int, np.ndarray]:
    """An odd base, and a value for each byte, of one of the two hashes; a seed below 0 makes the second one blind to bytes, for tests."""
    rng = np.random.default_rng((which, abs(seed)))
    base, values = int(rng.integers(1 << 32, 1 << 63)) * 2 + 1, rng.integers(1, 2**63, 256, dtype=np.uint64)
    return base, np.ones(256, U) if which and seed < 0 else values


class Prefix:
    """Polynomial hashes, modulo 2**64, of all ranges of a buffer."""

    def __init__(self, data: np.ndarray, which: int, seed: int = 0):
        odd, values = family(which, seed)
        base = np.full(len(data) + 1, U(odd), U)
        base[0] = 1
        inverse = np.full(len(data) + 1, U(pow(odd, -1, 2**64)), U)
        inverse[0] = 1
        self.down = np.multiply.accumulate(inverse)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * np.multiply.accumulate(base)[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over x[i : i + width], for each i where that fits."""
    done = 1
    while done * 2 <= width:
        x = least(x[:-done], x[done:])
        done *= 2
    return least(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def sampled(ends: np.ndarray, prefix: Prefix, size: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors: places of the smallest gram hash of each window, the same in all copies of a window; and their hashes.

    ends: for each byte of the buffer, where its document ends.
    """
    width = window - gram + 1
    if size < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    value = prefix.of(slice(0, size - gram + 1), slice(gram, size + 1)) | U(1)
    least = slide(value, width, np.minimum)
    least[ends[: len(least)] < np.arange(len(least)) + window] = 0
    around = np.zeros(len(value) + width - 1, U)
    around[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(slide(around, width, np.maximum)[: len(value)] == value)
    return at, value[at]


def anchors_of(texts: list[bytes], window: int, gram: int, chunk: int = 1 << 18, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document, place, gram hash and hash of the surroundings of each anchor, some documents at a time; longer texts come in overlapping pieces."""
    reach = window - gram
    group, held = [], 0
    pieces = []
    for i, t in enumerate(texts):
        if len(t) < window:
            continue
        for lo in range(0, len(t), chunk):
            if lo + window > len(t):
                break
            pieces.append((i, lo, t[max(0, lo - reach) : lo + chunk + window + reach] if len(t) > chunk else t, len(t)))
    for n, piece in enumerate(pieces):
        group.append(piece)
        held += len(piece[2])
        if held < chunk and n + 1 < len(pieces):
            continue
        data = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
        sizes = np.array([len(p[2]) for p in group])
        end = np.cumsum(sizes)
        one, two = Prefix(data, 0, seed), Prefix(data, 1, seed)
        at, h = sampled(np.repeat(end, sizes), one, len(data), window, gram)
        own = np.searchsorted(end, at, side="right")
        begin = (end - sizes)[own]
        left, right = np.maximum(at - reach, begin), np.minimum(at + window, end[own])
        around = two.of(left, right) ^ mixed(((at - left) * 64 + right - at).astype(U))
        skipped = np.array([max(0, p[1] - reach) if p[3] > chunk else 0 for p in group])
        doc, place = np.array([p[0] for p in group])[own], at - begin + skipped[own]
        whole = np.array([p[3] for p in group])[own]
        # in a piece of a longer text, what lies near a cut belongs to the neighbour, which sees all around it
        sound = ((at - left == reach) | (skipped[own] == 0)) & ((right - at == window) | (place + right - at == whole))
        yield doc[sound], place[sound], h[sound], around[sound]
        group, held = [], 0


def merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the ranges of each document; input sorted by document and begin."""
    if not len(doc):
        return doc, begin, end
    shift = doc * (int(end.max()) + 1)
    reached = np.maximum.accumulate(end + shift)
    new = np.append(True, (begin + shift)[1:] > reached[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], begin[first], reached[last] - shift[first]


def identity(text: bytes) -> int:
    """What tells apart the texts that share an id: 64 bits."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def rows_of(kind: int, part: np.ndarray, doc: np.ndarray, th: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray = np.zeros(0, np.int64), w: np.ndarray = np.zeros(0, np.int64)) -> Iterator[dict]:
    order = np.lexsort((x, doc, part))
    cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = order[a:b]
        yield {"kind": kind, "part": int(part[at[0]]), "doc": doc[at], "th": th[at], "x": x[at], "y": y[at] if len(y) else y, "z": z[at] if len(z) else z, "w": w[at] if len(w) else w}


def table(rows: list[dict], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in schema})


LONGS = pa.list_(pa.int64())
FOUND_FIELDS = [("kind", pa.int32()), ("part", pa.int32()), ("doc", LONGS), ("th", LONGS), ("x", LONGS), ("y", LONGS), ("z", LONGS), ("w", LONGS)]


def common_runs(data: np.ndarray, group: np.ndarray) -> Callable[[int], np.ndarray]:
    """Sorts the rows of a byte matrix inside their groups (runs of equal numbers) as suffixes; for a length, the rows that
    share so many first bytes have one number."""
    if not data.shape[1]:
        return lambda _: group
    rows = np.arange(len(data))
    order, common = Suffixes(np.ascontiguousarray(data), data.shape[1]).extensions(rows, np.zeros(len(data), np.int64), group)

    def numbers(length: int) -> np.ndarray:
        out = np.empty(len(data), np.int64)
        out[order] = np.cumsum(common < length)
        return out

    return numbers


def part_of(doc: np.ndarray, th: np.ndarray, parts: int) -> np.ndarray:
    """By id and text hash, so that different texts of one id are dealt out too."""
    return (mixed(mixed(doc.astype(U)) ^ th.astype(U)) % U(parts)).astype(np.int64)


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 50, gram: int = 20, parts: int | None = None, batch_bytes: int = 2 << 20, part_bytes: int = 8 << 20, cap: int = 4096, block: int = 8192, as_text: bool = False, hot_rows: int = 1 << 20, look_at: int = 64, salts: int = 64, same_id: int = 4096, seed: int = 0) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay).

    A byte goes if a `window`-byte string that covers it also starts in a document of smaller id. Each window
    has an anchor, the place of its smallest gram hash, so its copies meet at the hash of that gram:
    anchors equal in gram and surroundings (two 64-bit hashes) have all their windows in common, which is verified: in a
    batch on the bytes, across batches by 128-bit digests of the whole run of bytes that neighbouring anchors share with
    one document, and if any differ, all is done anew with other hashes. Only the smallest document of each such class goes on: the
    suffixes at the anchors of a gram are merge sorted, and so is what stands before them, read backwards; each
    comparison finds the common extension by binary search over polynomial prefix hashes. The common lengths of
    neighbours, verified on the bytes, tell for each place of the anchor in its window which windows are copies. Classes are formed in each batch before the
    shuffle, so a passage in any share of the documents stays one record a batch. Anchors meet in buckets of their grams;
    the anchors of one document in `look_at` are counted first, and grams that would bring over `hot_rows` anchors
    together are dealt by their surroundings and one of `salts` salts instead, and meet again as the classes that are
    left. A gram with over `cap` different surroundings is split by its windows and aggregated by Spark. Rows that repeat
    an id over `same_id` times are worked on once for each different text, and get its result by a join.

    Null texts count as empty; texts shorter than a window stay whole. Rows with a null id keep their text and
    take part in nothing; rows with one id are one document for "smaller" and each gets its own result; the
    added names replace columns of docs. An empty table gives an empty table. A removal may cut a UTF-8
    character, so kept is binary; with as_text it is a string without the bytes of cut characters.
    """
    spark = docs.sparkSession
    reach = window - gram
    slim = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("t"))
    if not parts:  # a part holds its texts whole
        held = slim.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // part_bytes))
    buckets = 2 * parts  # of anchors; a bucket sends each part a few rows at most
    often = write_table(slim.groupBy(F.col("id").alias("__o")).count().where(F.col("count") > same_id).select("__o"), "repeated-ids")
    if not often.isEmpty():
        return _repeated(docs, often, id_column, text, lambda d: drop_repeats(d, id_column, text, window, gram, parts, batch_bytes, part_bytes, cap, block, as_text, hot_rows, look_at, salts, 1 << 62, seed))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "t", batch_bytes // 8):
                raw = [t or b"" for t in batch.column("t").cast(pa.binary()).to_pylist()]
                for _, _, h, _ in anchors_of(raw, window, gram, seed=seed):
                    some, n = np.unique(h.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n)], names=["h", "n"])

    few_docs = slim.where(F.pmod(F.xxhash64("id"), F.lit(look_at)) == 0)
    counts = few_docs.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * look_at > hot_rows)
    # at most one gram for each hot_rows anchors of the table
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in counts.select("h").collect()], np.int64).view(U)))

    def alike(raw: list[bytes], doc: np.ndarray, at: np.ndarray, doc2: np.ndarray, at2: np.ndarray) -> np.ndarray:
        """Whether the surroundings of each pair of anchors are the same, on the bytes."""
        data = np.frombuffer(b"".join(raw) + bytes(window), np.uint8)
        size = np.array([len(t) for t in raw])
        base, out = np.cumsum(size) - size, np.zeros(len(doc), bool)
        for lo in range(0, len(doc), 4096):
            d, a, d2, a2 = (x[lo : lo + 4096] for x in (doc, at, doc2, at2))
            left, right = np.minimum(a, reach), np.minimum(size[d] - a, window)
            span = np.arange(-reach, window)
            outside = (span < -left[:, None]) | (span >= right[:, None])
            same = data[np.maximum((base[d] + a)[:, None] + span, 0)] == data[np.maximum((base[d2] + a2)[:, None] + span, 0)]
            out[lo : lo + 4096] = (same | outside).all(axis=1) & (left == np.minimum(a2, reach)) & (right == np.minimum(size[d2] - a2, window))
        return out

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def made() -> list[pa.RecordBatch]:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            own, raw = np.array(ids, np.int64)[order], [texts[i] for i in order]
            th = np.array([identity(t) for t in raw], np.int64)
            found = list(anchors_of(raw, window, gram, seed=seed)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))]
            doc, at, h, around = (np.concatenate(c) for c in zip(*found, strict=True))
            both = mixed(h) ^ around
            order = np.argsort(both, kind="stable")  # documents are in order of id
            new = np.append(True, np.diff(both[order]) != 0)[: len(order)]
            leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            known = np.zeros(len(doc), bool)
            known[order] = (own[doc[order]] > own[doc[leader]]) & (h[order] == h[leader]) & (around[order] == around[leader])
            some, of = order[known[order]], leader[known[order]]
            known[some[~alike(raw, doc[some], at[some], doc[of], at[of])]] = False  # a collision is no copy
            by = np.lexsort((at[known], doc[known]))
            d, lo, hi = merged(doc[known][by], np.maximum(at[known][by] - reach, 0), at[known][by] + window)
            rows = [r | {"bucket": r["part"], "salt": 0} for r in rows_of(COVERED, part_of(own[d], th[d], parts), own[d], th[d], lo, hi)]
            doc, at, h, around = doc[~known], at[~known], h[~known], around[~known]
            is_hot = np.isin(h, hot.value)
            bucket = np.where(is_hot, mixed(h ^ around), h >> U(1)) % U(buckets)
            # hot grams go by themselves, and a batch to one salt
            lot = np.where(is_hot, 1 + int(mixed(np.array([th.sum()]).astype(U))[0] % U(salts)), 0)
            order = np.lexsort((doc, lot, bucket))
            cuts = np.append(np.flatnonzero((np.diff(bucket[order].astype(np.int64), prepend=-1) != 0) | (np.diff(lot[order], prepend=-1) != 0)), len(order))
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = order[a:b]
                first = np.flatnonzero(np.diff(doc[some], prepend=-1))
                rows.append({"kind": 0, "bucket": int(bucket[some[0]]), "salt": int(lot[some[0]]), "doc": own[doc[some[first]]], "th": th[doc[some[first]]], "n": np.diff(np.append(first, len(some))), "x": at[some], "y": h[some].view(np.int64), "z": around[some].view(np.int64)})
            return table(rows, SAMPLE_FIELDS).to_batches()

        for whole in batches:
            for batch in by_bytes(whole, "t", batch_bytes // 8):
                ids += batch.column("id").to_pylist()
                texts += [t or b"" for t in batch.column("t").cast(pa.binary()).to_pylist()]
                held += sum(map(len, texts[len(texts) - batch.num_rows :]))
                if held >= batch_bytes:
                    yield from made()
                    ids, texts, held = [], [], 0
        if ids:
            yield from made()

    sample_schema = "bucket int, salt int, kind int, part int, doc array<long>, th array<long>, n array<int>, x array<int>, y array<long>, z array<long>"
    SAMPLE_FIELDS = [("bucket", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("doc", LONGS), ("th", LONGS), ("n", pa.list_(pa.int32())), ("x", pa.list_(pa.int32())), ("y", LONGS), ("z", LONGS)]

    def meet(group: pa.Table) -> pa.Table:
        known = group.filter(pa.compute.not_equal(group.column("kind"), 0))
        rows = [{k: v for k, v in r.items() if k in ("kind", "part", "doc", "th", "x", "y")} for r in known.to_pylist()]
        group = group.filter(pa.compute.equal(group.column("kind"), 0))
        salted = group.num_rows > 0 and group.column("salt")[0].as_py() > 0
        if group.num_rows:
            flat = lambda c: np.concatenate([x.values.to_numpy() for x in group.column(c)])
            n = flat("n")
            doc, th, at, h, around = np.repeat(flat("doc"), n), np.repeat(flat("th"), n), flat("x"), flat("y"), flat("z")
            order = np.argsort(h, kind="stable")
            if not salted:  # only grams of at least two documents matter
                run = np.cumsum(np.diff(h[order], prepend=h[order[0]] - 1) != 0) - 1
                count = np.bincount(run)
                order = order[count[run] > 1]
            order = order[np.lexsort((doc[order], around[order], h[order]))]
            if len(order):
                doc, th, at, h, around = doc[order], th[order], at[order].astype(np.int64), h[order], around[order]
                first = np.append(True, (np.diff(h) != 0) | (np.diff(around) != 0))
                leader = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
                later = doc > doc[leader]
                of = leader[later]
                rows += rows_of(AROUND, part_of(doc[later], th[later], parts), doc[later], th[later], at[later], doc[of], th[of], at[of])
                keep = ~later
                doc, th, at, h, around = doc[keep], th[keep], at[keep], h[keep], around[keep]
                if salted:  # the leaders of this salt
                    rows += rows_of(HOT, ((mixed(h.view(U) ^ around.view(U)) % U(buckets)).astype(np.int64)), doc, th, at, h, around)
                    return table(rows, FOUND_FIELDS)
                run = np.cumsum(np.diff(h, prepend=h[0] - 1) != 0) - 1
                start = np.flatnonzero(np.diff(run, prepend=-1))
                several = (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start))[run]
                rows += rows_of(ASKED, part_of(doc[several], th[several], parts), doc[several], th[several], at[several], h[several])
        give_back()
        return table(rows, FOUND_FIELDS)

    def again(group: pa.Table) -> pa.Table:
        """The leaders of all salts: the smallest document of a class is asked, the others are marked."""
        doc, th, at, h, around = (np.concatenate([v.values.to_numpy() for v in group.column(c)]) for c in ("doc", "th", "x", "y", "z"))
        order = np.lexsort((doc, around, h))
        doc, th, at, h, around = doc[order], th[order], at[order], h[order], around[order]
        first = np.append(True, (np.diff(h) != 0) | (np.diff(around) != 0))
        leader = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        later = doc > doc[leader]
        of = leader[later]
        rows = list(rows_of(AROUND, part_of(doc[later], th[later], parts), doc[later], th[later], at[later], doc[of], th[of], at[of]))
        rows += rows_of(ASKED, part_of(doc[~later], th[~later], parts), doc[~later], th[~later], at[~later], h[~later])
        return table(rows, FOUND_FIELDS)

    found = write_table(slim.mapInArrow(sample, sample_schema).groupBy("bucket", "salt").applyInArrow(meet, FOUND), "repeats")
    if len(hot.value):
        left = write_table(found.where(F.col("kind") == HOT).groupBy("part").applyInArrow(again, FOUND), "repeats-of-hot-grams")
        found = found.where(F.col("kind") != HOT).unionByName(left)

    def runs(group: pa.Table) -> pa.Table:
        """Neighbouring anchors that share their surroundings with one document at one distance make a run; both its sides are to be digested."""
        doc, th, at, doc2, th2, at2 = (np.concatenate([v.values.to_numpy() for v in group.column(c)]) for c in ("doc", "th", "x", "y", "z", "w"))
        by = np.lexsort((at, at - at2, th2, doc2, th, doc))
        doc, th, at, doc2, th2, at2 = (c[by] for c in (doc, th, at, doc2, th2, at2))
        other = np.any([np.diff(c, prepend=c[:1] - 1) != 0 for c in (doc, th, doc2, th2, at - at2)], axis=0)
        first = np.flatnonzero(other | (np.diff(at, prepend=at[:1]) > window))
        last = np.append(first[1:], len(doc)) - 1
        lo = np.maximum(at[first] - reach, 0)
        lo2 = at2[first] - (at[first] - lo)
        key = mixed(mixed(mixed(mixed(mixed(doc[first].astype(U)) ^ th[first].astype(U)) ^ lo.astype(U)) ^ doc2[first].astype(U)) ^ (lo2 + seed).astype(U)).view(np.int64)
        rows = list(rows_of(VERIFY, part_of(doc[first], th[first], parts), doc[first], th[first], lo, at[last] + window, key))
        rows += rows_of(VERIFY, part_of(doc2[first], th2[first], parts), doc2[first], th2[first], lo2, at2[last] + window, key)
        return table(rows, FOUND_FIELDS)

    with_leaders = found.where(F.col("kind") == AROUND).groupBy("part").applyInArrow(runs, FOUND)
    checks = write_table(with_leaders, "runs")

    def with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "th" in batch.schema.names:
                th = batch.column("th").to_numpy()
            else:
                th = np.array([identity(t or b"") for t in batch.column("__t").cast(pa.binary()).to_pylist()], np.int64)
            own = part_of(batch.column("__id").to_numpy(), th, parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*batch.schema.names, "__part"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.mapInArrow(with_part, T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType())]))

    def look(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"h": [], "doc": [], "th": [], "at": [], "lead": [], "ctx": []}
        if texts.num_rows and asked.num_rows:
            doc, th, x, y, z = (np.concatenate([v.values.to_numpy() for v in asked.column(c)]) for c in ("doc", "th", "x", "y", "z"))
            kind = np.repeat(asked.column("kind").to_numpy(), [len(v) for v in asked.column("doc")])
            by = np.lexsort((x, th, doc))
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(doc[by]) != 0) | (np.diff(th[by]) != 0))), len(by))
            spans = {(int(doc[by[a]]), int(th[by[a]])): by[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
            done = set()
            for d, t in zip(texts.column("__id").to_pylist(), texts.column("__t").cast(pa.binary()).to_pylist(), strict=True):
                if t is None or (key := (d, identity(t))) in done or key not in spans:
                    continue
                done.add(key)
                for i in spans[key]:
                    p = int(x[i])
                    lo = max(0, p - reach)
                    row = (int(y[i]), d, key[1], p, p - lo, t[lo : p + window])
                    if kind[i] == VERIFY:
                        row = (int(z[i]), d, key[1], p, -1, hashlib.blake2b(t[p : int(y[i])], digest_size=16).digest())
                    for name, v in zip(out, row, strict=True):
                        out[name].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    # z is filled up where it is not used, so that rows of both kinds can be put together
    asked = found.where(F.col("kind") == ASKED).withColumn("z", F.col("y")).unionByName(checks).select("kind", F.col("part").alias("__part"), "doc", "th", "x", "y", "z")
    texts = dealt(slim.select(F.col("id").alias("__id"), F.col("t").alias("__t")))
    seen = write_table(texts.groupBy("__part").cogroup(asked.groupBy("__part")).applyInArrow(look, "h long, doc long, th long, at long, lead int, ctx binary"), "surroundings")
    if not seen.where("lead < 0").groupBy("h").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("a <> b").isEmpty():
        return drop_repeats(docs, id_column, text, window, gram, parts, batch_bytes, part_bytes, cap, block, as_text, hot_rows, look_at, salts, same_id, seed + 1)
    near = seen.where("lead >= 0")
    many = write_table(near.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > cap).select("h"), "many")

    def windows_of(lead: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, first byte in its surroundings) of each window that holds the anchor."""
        n = np.maximum(np.minimum(size - window, lead) + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

    def compare(group: pa.Table) -> pa.Table:
        """The suffixes at the anchors of a gram are sorted, and so are the bytes before them read backwards; neighbours in both
        orders tell which windows are copies."""
        rows = []
        if group.num_rows:
            h, doc, th, at, lead = (group.column(c).to_numpy() for c in ("h", "doc", "th", "at", "lead"))
            raw = group.column("ctx").to_pylist()
            tail = np.array([len(r) for r in raw]) - lead  # bytes from the anchor on
            # one row each, with the anchors below each other
            data = np.frombuffer(b"".join((bytes(reach - n) + r).ljust(reach + window, b"\0") for n, r in zip(lead.tolist(), raw, strict=True)), np.uint8).reshape(-1, reach + window)
            most, least = np.full(len(data), -1), np.full(len(data), reach + 1)
            by = np.lexsort((doc, h))
            stops, lo = np.append(np.flatnonzero(np.diff(h[by], prepend=h[by[:1]] - 1)), len(by)), 0
            while lo < len(by):  # whole grams, some thousand anchors at a time
                hi = stops[max(np.searchsorted(stops, lo + block, side="right") - 1, np.searchsorted(stops, lo, side="right"))]
                own, lo = by[lo:hi], hi
                gram = np.cumsum(np.diff(h[own], prepend=h[own[:1]] - 1) != 0)
                after, ahead = common_runs(data[own, reach:], gram), common_runs(data[own, reach - 1 :: -1] if reach else data[own, :0], gram)
                d, before, behind = doc[own], lead[own], tail[own]
                for shift in range(reach + 1):  # windows that begin so many bytes before their anchor
                    # copies have the window's bytes from the anchor on in common, and those before it
                    key = after(window - shift) * np.int64(len(own) + 1) + ahead(shift)
                    whole = np.flatnonzero((before >= shift) & (behind + shift >= window))
                    order = whole[np.argsort(key[whole], kind="stable")]  # documents stay in order
                    leader = order[np.maximum.accumulate(np.where(np.diff(key[order], prepend=-1) != 0, np.arange(len(order)), 0))]
                    hit = own[order[d[order] > d[leader]]]
                    most[hit], least[hit] = shift, np.minimum(least[hit], shift)
            # all windows of an anchor overlap, so what they cover is one range
            hit = np.flatnonzero(most >= 0)
            rows = list(rows_of(COVERED, part_of(doc[hit], th[hit], parts), doc[hit], th[hit], at[hit] - most[hit], at[hit] - least[hit] + window))
        return table(rows, FOUND_FIELDS)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                raw = some.column("ctx").to_pylist()
                lead = some.column("lead").to_numpy()
                row, skip = windows_of(lead, np.array([len(r) for r in raw]))
                cut = [raw[r][s : s + window] for r, s in zip(row, skip, strict=True)]
                own = pa.array(row)
                start = some.column("at").to_numpy()[row] - lead[row] + skip
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), some.column("doc").take(own), some.column("th").take(own), pa.array(start)], names=["w", "doc", "th", "x"])

    bucket = F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")
    few = near.join(many, "h", "left_anti").select(bucket, "h", "doc", "th", "at", "lead", "ctx").groupBy("bucket").applyInArrow(compare, FOUND)
    wide = near.join(many, "h", "left_semi").select("h", "doc", "th", "at", "lead", "ctx").mapInArrow(expand, "w binary, doc long, th long, x long")
    # a table, so that a window of most rows meets its smallest document in a join that Spark can split
    firsts = write_table(wide.groupBy("w").agg(F.min("doc").alias("m"), F.max("doc").alias("last")).where("m < last").select("w", "m"), "first-windows")
    wide = wide.join(firsts, "w").where("doc > m").withColumn("__id", F.col("doc"))
    wide = dealt(wide).select(F.lit(COVERED).alias("kind"), F.col("__part").alias("part"), F.array("doc").alias("doc"), F.array("th").alias("th"), F.array("x").alias("x"), F.array(F.col("x") + window).alias("y"), F.array().cast("array<bigint>").alias("z"), F.array().cast("array<bigint>").alias("w"))
    covered = write_table(few.unionByName(wide), "covered")
    marks = found.where(F.col("kind") != ASKED).unionByName(covered).select("kind", F.col("part").alias("__part"), "doc", "th", "x", "y")

    fields = [("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()), ("kept_sha256", T.StringType(), pa.string()), ("kept", T.StringType() if as_text else T.BinaryType(), pa.string() if as_text else pa.binary())]
    added = {n for n, _, _ in fields}
    own_columns = [f for f in docs.schema.fields if f.name.lower() not in added]

    def cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if marks.num_rows and texts.num_rows:
            doc, th, lo, hi = [], [], [], []
            for r in range(marks.num_rows):
                x = marks.column("x")[r].values.to_numpy()
                around = marks.column("kind")[r].as_py() == AROUND
                doc.append(marks.column("doc")[r].values.to_numpy())
                th.append(marks.column("th")[r].values.to_numpy())
                lo.append(np.maximum(x - reach, 0) if around else x)
                hi.append(x + window if around else marks.column("y")[r].values.to_numpy())
            doc, th, lo, hi = map(np.concatenate, (doc, th, lo, hi))
            by = np.lexsort((th, doc))
            doc, th, lo, hi = doc[by], th[by], lo[by], hi[by]
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(th) != 0))), len(doc))
            spans = {(int(doc[a]), int(th[a])): (lo[a:b], hi[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)}
        made: list[list] = [[], [], [], [], []]
        for d, t in zip(texts.column("__id").to_pylist(), texts.column("__t").cast(pa.binary()).to_pylist(), strict=True):
            t = t or b""
            kept, n_spans = t, 0
            if d is not None and (own := spans.get((d, identity(t)))):
                depth = np.bincount(own[0], minlength=len(t) + 1)[: len(t) + 1] - np.bincount(np.minimum(own[1], len(t)), minlength=len(t) + 1)
                gone = np.cumsum(depth)[:-1] > 0
                n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            for column, v in zip(made, (len(t), len(t) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if as_text else kept), strict=True):
                column.append(v)
        columns = {f.name: texts.column(f.name) for f in own_columns}
        return pa.table(columns | {n: pa.array(v, k) for (n, _, k), v in zip(fields, made, strict=True)})

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "__t", batch_bytes):
                yield from cut(pa.Table.from_batches([batch]), pa.table({})).to_batches()

    out = T.StructType([*own_columns, *(T.StructField(n, t) for n, t, _ in fields)])
    whole = docs.select(*(f.name for f in own_columns), F.col(id_column).cast("long").alias("__id"), F.col(text).alias("__t"))
    marked = dealt(whole.where("__id IS NOT NULL")).groupBy("__part").cogroup(marks.groupBy("__part")).applyInArrow(cut, out)
    return marked.unionByName(whole.where("__id IS NULL").mapInArrow(alone, out))


def _repeated(docs: DataFrame, often: DataFrame, id_column: str, text: str, drop: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows whose ids repeat often: each different text of an id once, its result joined to all rows that hold it."""
    of_id = F.col(id_column).cast("long") == F.col("__o")
    many, rest = docs.join(often, of_id, "left_semi"), docs.join(often, of_id, "left_anti")
    once = many.select(F.col(id_column).cast("long").alias(id_column), text).distinct()
    slim = rest.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias(id_column), text)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    done = write_table(drop(slim.unionByName(once)), "results-once")
    own = [c for c in docs.columns if c.lower() not in made]
    results = done.select(F.col(id_column).alias("__i"), F.xxhash64(text).alias("__h"), F.col(text).alias("__x"), *made).dropDuplicates(["__i", "__h", "__x"])
    same = (F.col(id_column).cast("long") == F.col("__i")) & (F.xxhash64(text) == F.col("__h")) & F.col(text).eqNullSafe(F.col("__x"))
    joined = docs.where(F.col(id_column).isNotNull()).select(*own).join(results, same).select(*own, *made)
    return joined.unionByName(drop(docs.where(F.col(id_column).isNull())).select(*own, *made))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

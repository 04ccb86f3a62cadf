"""Best-fit packing: best-two-fit over the lengths of all pieces, each piece then finding its place by its rank."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.batches import by_bytes
from traceloom.llm.store import write_table
from traceloom.llm.subwords import BYTES, encoder
from traceloom.llm.token_files import binaries, with_end


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """counts[n]: pieces of length n, up to the capacity. -> (lengths of a sequence, number of such sequences).

    A sequence starts with the longest piece left and is filled greedily with the longest that fits; then its
    smallest piece gives way to the two unpacked pieces that fill the larger gap most, if they fill it better.
    A pattern is used as often as all its lengths last, so there are few more patterns than lengths.
    """
    left, room, patterns = counts.astype(np.int64).copy(), len(counts) - 1, []
    sizes = np.arange(room + 1)
    upto = np.maximum.accumulate(np.where(left > 0, sizes, 0))

    def longest(most: int, taken: dict[int, int]) -> int:
        n = int(upto[most])
        while n and left[n] - taken.get(n, 0) <= 0:
            n = int(upto[n - 1])
        return n

    while upto[room]:
        pattern, taken, gap = [], {}, room
        while n := longest(gap, taken):
            pattern.append(n)
            taken[n] = taken.get(n, 0) + 1
            gap -= n
        if gap and len(pattern) > 1:
            small = pattern[-1]
            wide = gap + small
            first = np.flatnonzero(left[: wide // 2 + 1] > 0)
            first = first[[left[a] > taken.get(int(a), 0) for a in first]] if len(first) else first
            best, pair = small, None
            if len(first):
                second = upto[wide - first]
                for i in np.argsort(-(first + second), kind="stable"):
                    a = int(first[i])
                    if a + second[i] <= best:
                        break
                    b = longest(wide - a, taken | {a: taken.get(a, 0) + 1})
                    if b and a + b > best:
                        best, pair = a + b, (a, b)
                        if best == wide:
                            break
            if pair:
                pattern = pattern[:-1] + [max(pair), min(pair)]
        used, times = np.unique(pattern, return_counts=True)
        repeat = int((left[used] // times).min())
        left[used] -= repeat * times
        patterns.append((pattern, repeat))
        if not left[used].all():
            upto = np.maximum.accumulate(np.where(left > 0, sizes, 0))
    return patterns


def places(patterns: list[tuple[list[int], int]], room: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, the first ranks of its runs of places, and the first sequence and the offset of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used, base = np.zeros(room + 1, np.int64), 0
    for lengths, repeat in patterns:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((int(used[n]), base, offset))
            used[n] += repeat
            offset += n
        base += repeat
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def token_pieces(docs: DataFrame, room: int, id_column: str, text: str, model_path: str, end_id: int, with_ids: bool, batch_bytes: int = 4 << 20, part_pieces: int = 1 << 16, part_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], part): a document's ids and the end id, cut into pieces of `room`
    ids if there are more; the first piece has the rest of the division. A part is a run of about `part_pieces`
    pieces of a task; with ids, of so few that `part_bytes` hold them at full length."""
    if with_ids:
        part_pieces = max(1, min(part_pieces, part_bytes // (4 * room)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, held = encoder(model_path), TaskContext.get().partitionId() << 24, 0
        for whole in batches:
            for batch in by_bytes(whole, "t", batch_bytes):
                ids, n = with_end(*model.encode(batch.column("t")), end_id)
                raw = ids.astype("<u4", copy=False)
                times = -(-n // room)
                row = np.repeat(np.arange(len(n)), times)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                end = (n - (times - 1) * room)[row] + piece * room
                start = np.maximum(end - room, 0)
                at = (np.cumsum(n) - n)[row] + start
                data = memoryview(raw.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + end - start).tolist(), strict=True)]
                for lo in range(0, len(row), part_pieces):
                    some = slice(lo, lo + part_pieces)
                    made = [batch.column("doc_id").take(pa.array(row[some])), pa.array(piece[some].astype(np.int32)), pa.array(start[some]), pa.array((end - start)[some]), pa.array(crc[some], pa.int64())]
                    if with_ids:
                        made.append(binaries(raw[int(at[lo]) : int((at + end - start)[some][-1])], (end - start)[some]))
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(made)]
                    if held and held + len(made[1]) > part_pieces:
                        part, held = part + 1, 0
                    held += len(made[1])
                    yield pa.RecordBatch.from_arrays([*made, pa.array(np.full(len(made[1]), part))], names=[*names, "part"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", part long")


def pack_documents(docs: DataFrame, room: int = 2048, id_column: str = "doc_id", text: str = "text", model_path: str = BYTES, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row per piece, in as few sequences of
    at most `room` ids as best-two-fit finds.

    Only documents of over `room` ids (with the end id) are cut. Pieces of one length are alike, so the number
    of pieces of each length, at most `room` numbers, decides all sequences; a piece takes the place of its
    rank among those of its length, which is counted within the pieces of a written part and then over the
    parts, so no length, however common, meets in one task: each part, of a bounded number of pieces, is read
    together with its own at most `room` first ranks. Null and empty texts hold the end id alone; rows that
    repeat an id are packed each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = write_table(token_pieces(docs, room, id_column, text, model_path, end_id, with_ids), "pieces")
    per_part = write_table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(room + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[r["length"]] = r["n"]
    held = spark.sparkContext.broadcast(places(best_two_fit(counts), room))  # bounded by the lengths, not by the pieces
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per part
    first = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(group: pa.Table, ranks: pa.Table) -> pa.Table:
        length = group.column("length").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = pc.sort_indices(group, [(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")]).to_numpy().astype(np.int64)
        starts = dict(zip(ranks.column("length").to_pylist(), ranks.column("first").to_pylist(), strict=True))
        cuts = np.append(np.flatnonzero(np.diff(length[order], prepend=-1)), len(order))
        for a, b in zip(cuts, cuts[1:], strict=False):
            at, n = order[a:b], int(length[order[a]])
            begin, base, off = held.value[n]
            rank = starts[n] + np.arange(b - a)
            run = np.searchsorted(begin, rank, side="right") - 1
            sequence[at], offset[at] = base[run] + rank - begin[run], off[run]
        return group.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    names = [*keys, *(["ids"] if with_ids else [])]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return pieces.select(*names, "part").groupBy("part").cogroup(first.groupBy("part")).applyInArrow(place, f"{kinds}, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)

"""Token-id files: Huffman-coded ids in blocks that decode on their own, documents in order of id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.llm.batches import by_bytes
from traceloom.llm.huffman import canonical, code_lengths, pack, tables, unpack
from traceloom.llm.store import new_path, write_table
from traceloom.llm.subwords import WORDS, encoder

BLOCKS = "part long, start long, n long, doc_ids array<long>, n_tokens array<long>, checkpoints array<long>, bits binary"
#: Ranges of ids that are sorted at once; Spark's range sampler still takes over a hundred rows for each.
MOST_PARTS = 1 << 13


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to each document's ids."""
    return (ids, n) if end_id is None else (np.insert(ids, np.cumsum(n), end_id), n + 1)


def binaries(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary value for each document."""
    offsets = np.append(0, np.cumsum(n)) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def encode_ids(docs: DataFrame, id_column: str, text: str, model_path: str, end_id: int | None, batch_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n, ids, at, times): ids of the whole text (null: empty) and the end id, as little-endian unsigned 16-bit
    integers, or 32-bit ones for a vocabulary of over 65536 ids. The last row of a task has null ids, and the
    different ids of the task with their counts in at and times."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path)
        most = max(model.size, (end_id or 0) + 1)
        kind, total = "<u2" if most <= 65536 else "<u4", np.zeros(most, np.int64)
        names, none = ["doc_id", "n", "ids", "at", "times"], lambda n: pa.nulls(n, pa.list_(pa.int64()))
        for whole in batches:
            for batch in by_bytes(whole, "t", batch_bytes):
                ids, n = with_end(*model.encode(batch.column("t")), end_id)
                total += np.bincount(ids, minlength=most)
                made = [batch.column("doc_id"), pa.array(n), binaries(ids.astype(kind), n), none(len(n)), none(len(n))]
                yield pa.RecordBatch.from_arrays(made, names=names)
        at = np.flatnonzero(total)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([at], longs), pa.array([total[at]], longs)], names=names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(encode, "doc_id long, n long, ids binary, at array<long>, times array<long>")


def write_token_files(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", model_path: str = WORDS, end_id: int | None = 2, limit: int = 18, step: int = 256, part_ids: int = 4_000_000, block_ids: int = 1 << 20) -> None:
    """Writes all documents' ids under path, in ascending order of id (null ids first), file by file.

    path/codes: (id, bits), the code lengths, at most `limit`, from the counts of all ids; codes are canonical.
    path/blocks: (part, start, n, doc_ids, n_tokens, checkpoints, bits): a block holds documents of up to
    `block_ids` ids, or one longer one; start counts the ids of its part before it; a document's bits begin at a
    byte, and a checkpoint has the bit at which each `step`-th id of a document begins, so a block, and a document or
    a stretch of one, decodes on its own. path/parts: (part, base), the ids of all parts before it. Parts are ranges
    of (doc_id, length, hash), so rows that share an id, or have none, are dealt out too; of about `part_ids` ids
    each, and of more where there would be over MOST_PARTS of them. Null and empty texts hold the end id alone. Rows
    that repeat an id follow each other.
    """
    spark = docs.sparkSession
    encoded = write_table(encode_ids(docs, id_column, text, model_path, end_id), "token-ids")
    tallies = encoded.where("ids IS NULL").select(F.explode(F.arrays_zip("at", "times")).alias("x"))
    counted = tallies.groupBy(F.col("x.at").alias("id")).agg(F.sum("x.times").alias("n")).toArrow()  # a row per id of the vocabulary
    counts = np.zeros(int(max(counted.column("id").to_pylist(), default=0)) + 1, np.int64)
    counts[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": used, "bits": lengths[used].astype(np.int32)})).coalesce(1).write.parquet(f"{path}/codes")
    held = spark.sparkContext.broadcast((canonical(lengths), lengths))  # vocabulary x 9 bytes

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            raw = batch.column("ids")
            lo, total = 0, np.append(0, np.cumsum(n))
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + block_ids, side="right")) - 1)
                own = b"".join(raw.slice(lo, hi - lo).to_pylist())
                bits, marks = pack(to_ids(int(total[hi] - total[lo]), own), *held.value, step, n[lo:hi])
                arrays = [[part], [start], [int(total[hi] - total[lo])], [batch.column("doc_id").slice(lo, hi - lo).to_pylist()], [n[lo:hi]], [marks], [bits]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=["part", "start", "n", "doc_ids", "n_tokens", "checkpoints", "bits"])
                start, lo = start + int(total[hi] - total[lo]), hi

    parts = min(MOST_PARTS, max(1, -(-int(counts.sum()) // part_ids)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("h")]
    rows = encoded.where("ids IS NOT NULL").select("doc_id", "n", F.xxhash64("ids").alias("h"), "ids")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").option("maxRecordsPerFile", max(1, part_ids // block_ids)).parquet(f"{path}/blocks")
    per_part = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    base = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # over a row per part
    per_part.select("part", base.alias("base")).write.parquet(f"{path}/parts")


def to_ids(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u2").astype(np.int64)


def read_token_files(spark: SparkSession, path: str, step: int = 256) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents of token files; ids: little-endian unsigned 32-bit integers."""
    codes = spark.read.schema("id long, bits int").parquet(f"{path}/codes").toArrow()  # a row per id of the vocabulary
    lengths = np.zeros(int(max(codes.column("id").to_pylist(), default=0)) + 1, np.uint8)
    lengths[codes.column("id").to_numpy()] = codes.column("bits").to_numpy()
    parts = spark.read.schema("part long, base long").parquet(f"{path}/parts").toArrow()  # MOST_PARTS rows at most
    base = np.zeros(int(max(parts.column("part").to_pylist(), default=0)) + 1, np.int64)
    base[parts.column("part").to_numpy()] = parts.column("base").to_numpy()
    held = spark.sparkContext.broadcast((lengths, base))  # vocabulary bytes, and 64 KB at most

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = tables(held.value[0]), held.value[1]
        for batch in batches:
            for row in range(batch.num_rows):
                docs, n, marks = (batch.column(c)[row].values for c in ("doc_ids", "n_tokens", "checkpoints"))
                n = n.to_numpy()
                segments = -(-n // step)
                last = np.cumsum(segments)
                counts = np.full(int(segments.sum()), step, np.int64)
                counts[last[segments > 0] - 1] = (n - (segments - 1) * step)[segments > 0]
                ids = unpack(batch.column("bits")[row].as_py(), marks.to_numpy(), counts, *table).astype("<u4")
                end = np.cumsum(n)
                start = base[batch.column("part")[row].as_py()] + batch.column("start")[row].as_py() + end - n
                for lo in range(0, len(n), 2000):
                    some = slice(lo, lo + 2000)
                    raw = binaries(ids[int(end[lo] - n[lo]) : int(end[some][-1])], n[some])
                    yield pa.RecordBatch.from_arrays([docs[some], pa.array(start[some]), pa.array(n[some]), raw], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.batches import added, by_bytes, with_columns

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: A single space between two characters that are no white space: no piece of the model spans its left side.
SAFE = re.compile(r"(?<=[^\s▁᠎]) (?=[^\s▁᠎])")


@lru_cache(maxsize=2)
def load(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether a text may be cut at SAFE: a cut drops the space, as the model puts one before each text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    whole = model.encode("a b c", out_type=str) == model.encode("a", out_type=str) + model.encode("b", out_type=str) + model.encode("c", out_type=str)
    return model, whole and not inner


def cut(text: str, limit: int) -> list[str]:
    """Pieces of at least `limit` characters whose token counts add up to those of the whole text."""
    pieces, start = [], 0
    while len(text) - start > limit and (m := SAFE.search(text, start + limit)):
        pieces.append(text[start : m.start()])
        start = m.end()
    return [*pieces, text[start:]]


def token_counts(docs: DataFrame, model_path: str = MODEL, text: str = "text", batch_bytes: int = 1 << 20, split_chars: int = 1 << 16) -> DataFrame:
    """Appends n_bytes (UTF-8) and n_tokens of the whole text, without begin, end or added special tokens.

    Null and empty texts count 0 and 0. Input columns named n_bytes or n_tokens are replaced. Rows, repeated
    or not, stay as they are; an empty table gives an empty table. No shuffle: Spark's file splits balance
    the tasks by bytes, batches of `batch_bytes` balance the calls, and texts over `split_chars` are cut at
    safe boundaries, so memory in a task stays bounded by a text and a batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, safe = load(model_path)
        for whole in batches:
            for batch in by_bytes(whole, text, batch_bytes):
                column = batch.column(text)
                sizes = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
                pieces, owner = [], []
                for i, t in enumerate(column.to_pylist()):
                    own = cut(t, split_chars) if safe and t else [t or ""]
                    pieces += own
                    owner += [i] * len(own)
                counts = [0] * batch.num_rows
                for i, ids in zip(owner, model.encode(pieces, num_threads=1), strict=True):
                    counts[i] += len(ids)
                yield with_columns(batch, {"n_bytes": sizes, "n_tokens": pa.array(counts, pa.int64())})

    return docs.mapInArrow(count, added(docs, [("n_bytes", T.LongType()), ("n_tokens", T.LongType())]))


def op2_token_counts(spark, sf_dir: str, max_tokens: int = 4096) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))

"""Ordered folds over keys: rows of a key come to one task in order, and only the fold's state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold:
    """State of one key. add() and end() give finished rows as dicts."""

    def __init__(self, key: tuple):
        self.key = key

    def add(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def end(self) -> list[dict]:
        return []

    def idle(self) -> list[dict]:
        """What a pause alone ends, in a stream; at the end of a log it is `end`."""
        return self.end()


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple], Fold], schema: StructType) -> DataFrame:
    """Folds each key's rows in order. One shuffle by key; the sort spills, so a key of any size fits."""
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or state.key != key:
                    out += state.end() if state else []
                    state = make(key)
                out += state.add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        out = state.end() if state else []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

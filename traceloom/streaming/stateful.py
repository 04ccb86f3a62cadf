"""Streaming twins of the ordered folds: the same fold of a key, its rows of a micro-batch in order of time, closed by
event time. Open folds live in the state store; what comes later than the watermark is dropped by Spark."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from traceloom.operators import tooluse
from traceloom.operators.fold import Fold
from traceloom.operators.spans import IDLE_NS as SPAN_IDLE
from traceloom.operators.spans import KEYS, SPAN, Span, calls
from traceloom.operators.sse import IDLE_NS, OUT, Message, sse_input
from traceloom.operators.sse import KEYS as SSE_KEYS


def fold_stream(df: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple], Fold], schema: StructType, idle_ns: int, delay: str = "1 minute") -> DataFrame:
    """A fold over a stream: it ends when the watermark is idle_ns past its last row."""
    rows = df.withColumn("__at", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("bigint"))).withWatermark("__at", delay)
    names = [f.name for f in schema.fields]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else make(key)
        if state.hasTimedOut:
            out = fold.end()
            state.remove()
        else:
            out, last = [], 0
            new = pd.concat(list(frames)).sort_values(order)
            for row in new.astype(object).where(new.notna(), None).to_dict("records"):
                out += fold.add(row)
                last = max(last, row["timestamp_ns"])
            state.update((pickle.dumps(fold),))
            state.setTimeoutTimestamp(max(last + idle_ns, state.getCurrentWatermarkMs() * 1_000_000 + 1_000_000) // 1_000_000)
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(step, schema, "fold binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_sse(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    return fold_stream(sse_input(events)[0], SSE_KEYS, ["timestamp_ns", "stream_seq"], Message, OUT, IDLE_NS, delay)


def stream_spans(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    return fold_stream(calls(events), KEYS, ["timestamp_ns", "stream_seq"], Span, SPAN, SPAN_IDLE, delay)


def stream_dedup_opens(opens: DataFrame, delay: str = "1 minute", gap: str = "60 seconds", by: tuple[str, ...] = ("pid", "filepath")) -> DataFrame:
    """Opens of one file by one process, a row for each session of pauses under the gap. opens: event_time, pid, filepath."""
    w = F.session_window("event_time", gap)
    out = opens.withWatermark("event_time", delay).groupBy(w, *by).agg(F.count("*").alias("count"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    return out.drop("session_window")


def stream_resources(system: DataFrame, delay: str = "1 minute", width: str = "5 seconds") -> DataFrame:
    w = F.window("event_time", width)
    out = system.withWatermark("event_time", delay).groupBy(w, "session_id", "pid", "comm").agg(F.avg("cpu_percent").alias("avg_cpu_percent"), F.max("cpu_percent").alias("max_cpu_percent"), F.count("*").alias("sample_count"), F.bool_or("sys_alert").alias("has_alert"))
    return out.select(F.col("window.start").alias("bucket"), "session_id", "pid", "comm", "avg_cpu_percent", "max_cpu_percent", "sample_count", "has_alert")


def open_folds(spark: SparkSession, checkpoint: str, schema: StructType) -> DataFrame:
    """What the folds that a stopped stream left open would give at its end, from the state under its checkpoint."""
    names = [f.name for f in schema.fields]

    def end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([row for raw in frame["fold"] for row in pickle.loads(raw).end()], columns=names)

    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("value.groupState.fold").alias("fold")).where("fold IS NOT NULL").mapInPandas(end, schema)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, as far as the query's recent progress tells."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def stream_rate_limit(events: DataFrame, delay: str = "1 minute", most: int = 30) -> DataFrame:
    """Seconds of a process with over `most` events: how many there were and how many are over. events: event_time, pid."""
    w = F.window("event_time", "1 second")
    per = events.withWatermark("event_time", delay).groupBy(w, "pid").agg(F.count("*").alias("count"))
    return per.where(F.col("count") > most).select("pid", F.col("window.start").alias("second"), "count", (F.col("count") - most).alias("dropped"))


def stream_tool_uses(events: DataFrame, delay: str = "1 minute", within: str = "30 seconds") -> DataFrame:
    """Tool uses and their results as they meet, by a stream-stream join within the timeout; a use without a result comes
    with nulls once the watermark, that of the slower of uses and results, is past it. events: envelopes with session_id."""
    at = lambda c: F.timestamp_micros(F.floor(F.col(c) / 1000).cast("bigint"))
    u = tooluse.uses(events).withColumn("start", at("start_ns")).withWatermark("start", delay)
    r = tooluse.results(events).withColumnsRenamed({"session_id": "s2", "tool_use_id": "u2"}).withColumn("end", at("end_ns")).withWatermark("end", delay)
    met = u.join(r, F.expr(f"session_id = s2 AND tool_use_id = u2 AND end >= start AND end <= start + INTERVAL {within}"), "left_outer")
    status = F.when(F.col("end_ns").isNull(), "timeout").otherwise("success")
    return met.select("session_id", "tool_use_id", "tool_name", "pid", "comm", "start_ns", "end_ns", "result_summary", status.alias("status"))

"""Streams of stateful operators that need their rows in order of time: tracking, runs of opens, rate limits, tool uses, folds.

Rows of a session (and of a bucket of its keys, where an operator works key by key) wait in the state until the
watermark has passed them, so any order of arrival within the delay gives the result of the batch. A row for which
`ends` holds goes to all buckets of its session and closes what is open there: the end of a stream, in the stream.
"""

from __future__ import annotations

import heapq
import json
import pickle
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from traceloom.functions import payload as P
from traceloom.operators import tooluse
from traceloom.operators.fold import Fold
from traceloom.operators.process import WINDOW_NS
from traceloom.operators.spans import IDLE_NS as SPAN_IDLE
from traceloom.operators.spans import KEYS as SPAN_KEYS
from traceloom.operators.spans import SPAN, Span, calls
from traceloom.operators.sse import IDLE_NS as SSE_IDLE
from traceloom.operators.sse import KEYS as SSE_KEYS
from traceloom.operators.sse import OUT, Message, sse_input

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELPERS = ["at__", "bucket__", "end__"]
#: Rows of a session that a task holds at once, of a page of those that it puts aside, and of what it gives at once.
HELD, PAGE, GIVEN = 10_000, 256, 10_000


class Cells:
    """The map state of a session and bucket: read when asked for, written back once a batch."""

    def __init__(self, state):
        self.state, self.seen, self.changed = state, {}, set()

    def get(self, key: str):
        if key not in self.seen:
            self.seen[key] = pickle.loads(self.state.getValue((key,))[0]) if self.state.containsKey((key,)) else None
        return self.seen[key]

    def set(self, key: str, value) -> None:  # noqa: ANN001
        self.seen[key] = value
        self.changed.add(key)

    def items(self) -> list[tuple[str, object]]:
        for (key,), (value,) in list(self.state.iterator()):
            self.seen.setdefault(key, pickle.loads(value))
        return [(k, v) for k, v in self.seen.items() if v is not None]

    def save(self) -> None:
        for key in self.changed:
            if self.seen[key] is not None:
                self.state.updateValue((key,), (pickle.dumps(self.seen[key]),))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))


class Machine:
    """What an operator does with the rows of a session in order; its state is in `cells`."""

    def __init__(self, cells: Cells):
        self.cells = cells

    def feed(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def until(self, ns: int) -> list[dict]:
        """What ends because time has come to ns."""
        return []

    def due(self) -> int | None:
        """When something ends next."""
        return None

    def end(self) -> list[dict]:
        """The session is over: what is open ends, and the state is empty."""
        return []


class Run:
    """Rows in order, in pages of the state from `first` up to `end`; one page at a time is read."""

    def __init__(self, pages, first: int, end: int, last: int):  # noqa: ANN001
        self.pages, self.first, self.end, self.last = pages, first, end, last
        self.rows: list[dict] = []  # the page that is read, from its end
        self.taken = False

    def head(self) -> dict | None:
        if not self.rows and self.first < self.end:
            self.rows = pickle.loads(zlib.decompress(self.pages.getValue((self.first,))[0]))[::-1]
        return self.rows[-1] if self.rows else None

    def take(self) -> None:
        self.rows.pop()
        self.taken = bool(self.rows)
        if not self.rows:
            self.pages.removeKey((self.first,))
            self.first += 1

    def save(self) -> None:
        if self.taken:
            self.pages.updateValue((self.first,), (zlib.compress(pickle.dumps(self.rows[::-1]), 1),))


class InOrder(StatefulProcessor):
    """Rows of a session are sorted in parts of HELD at most, which are put aside in the state as runs, and come back merged: however
    many there are, a task holds one part, and a page of each run."""

    def __init__(self, make: Callable[[Cells], Machine], names: list[str], order: list[str], by_event_time: bool, whole: list[str]):
        self.make, self.names, self.order, self.by_event_time, self.whole = make, names, order, by_event_time, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page bigint", "rows binary")
        self.runs = handle.getValueState("runs", "runs binary")  # (first page, page after the last, latest time) of each
        self.state = handle.getMapState("cells", "key string", "value binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        runs, ended, held = self._runs(), False, []
        for frame in rows:
            ended |= bool(frame["end__"].any())
            frame = frame[~frame["end__"].astype(bool)].drop(columns=HELPERS)
            made = frame.astype(object).where(frame.notna(), None).to_dict("records")
            for row in made:  # whole numbers come as floats where some are null
                row.update({c: int(row[c]) for c in self.whole if row[c] is not None})
            held += made
            while len(held) >= HELD:
                self._put(runs, held[:HELD])
                held = held[HELD:]
        if held:
            self._put(runs, held)
        del held
        yield from self.go(runs, timerValues, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        yield from self.go(self._runs(), timerValues, False)

    def _runs(self) -> list[Run]:
        known = self.runs.get() if self.runs.exists() else None
        return [Run(self.pages, *run) for run in pickle.loads(known[0])] if known else []

    def _key(self, row: dict) -> tuple:
        return tuple((row[c] is None, row[c]) for c in self.order)

    def _put(self, runs: list[Run], rows: list[dict]) -> None:
        rows.sort(key=self._key)
        first = end = max((run.end for run in runs), default=0)
        for at in range(0, len(rows), PAGE):
            self.pages.updateValue((end,), (zlib.compress(pickle.dumps(rows[at : at + PAGE]), 1),))
            end += 1
        runs.append(Run(self.pages, first, end, max(r["timestamp_ns"] for r in rows)))

    def go(self, runs: list[Run], timers, ended: bool) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        """Feeds the rows that no row to come can stand before, and sets the next timer."""
        now = timers.getCurrentWatermarkInMs() if self.by_event_time else timers.getCurrentProcessingTimeInMs()
        machine, out = self.make(Cells(self.state)), []
        heads = [(self._key(run.head()), i) for i, run in enumerate(runs)]
        heapq.heapify(heads)
        while heads:
            run = runs[heads[0][1]]
            row = run.head()
            if not ended and self.by_event_time and row["timestamp_ns"] // 1000 > now * 1000:
                break
            run.take()
            if run.head() is None:
                heapq.heappop(heads)
            else:
                heapq.heapreplace(heads, (self._key(run.head()), heads[0][1]))
            out += machine.feed(row if self.by_event_time else row | {"clock__": now * 1_000_000})
            if len(out) >= GIVEN:
                yield pd.DataFrame(out, columns=self.names)
                out = []
        out += machine.end() if ended else machine.until(now * 1_000_000)
        machine.cells.save()
        later = [run for run in runs if run.head() is not None]
        for run in later:
            run.save()
        if later:
            self.runs.update((pickle.dumps([(run.first, run.end, run.last) for run in later]),))
        else:
            self.runs.clear()
        next_ = [max(run.last for run in later)] if later else []
        next_ += [machine.due()] if machine.due() is not None else []
        for ns in next_:
            self.handle.registerTimer(max(ns // 1_000_000 + 1, now + 1))
        yield pd.DataFrame(out, columns=self.names)


def in_order(rows: DataFrame, make: Callable[[Cells], Machine], schema: StructType | str, by: list[str] | None = None, buckets: int = 32, order: tuple[str, ...] = ("timestamp_ns", "stream_seq"), delay: str = "1 minute", time: str = "event") -> DataFrame:
    """Runs a machine over a stream. rows: session_id, timestamp_ns, the columns of `order` and what the machine reads, and end__ (names end in underscores, as the rows come as named tuples).

    order: begins with timestamp_ns. by: a machine sees the rows of a session whose keys share one of `buckets` buckets; without it, all of a session.
    time "event": in order of time, by the watermark; "processing": as they come, in order inside a micro-batch, and
    what is idle ends by the clock. The state store is set to RocksDB, which such states need.
    """
    spark = rows.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    rows = rows.withColumn("at__", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("bigint")))
    own = F.array(F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")) if by else F.array(F.lit(0))
    every = F.sequence(F.lit(0), F.lit(buckets - 1)) if by else F.array(F.lit(0))
    rows = rows.withColumn("end__", F.coalesce("end__", F.lit(False))).withColumn("bucket__", F.explode(F.when(F.col("end__"), every).otherwise(own)))
    rows = rows.withWatermark("at__", delay) if time == "event" else rows
    whole = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long") and f.name not in HELPERS]
    processor = InOrder(make, names, list(order), time == "event", whole)
    return rows.groupBy("session_id", "bucket__").transformWithStateInPandas(processor, schema, "Append", "eventTime" if time == "event" else "processingTime")


def ends_of(events: DataFrame, ends: Column | None) -> Column:
    return F.lit(False) if ends is None else F.coalesce(ends, F.lit(False))


# --- processes ----------------------------------------------------------------------------------------------------


class Tracker(Machine):
    """Which processes are tracked now: a cell each, from the event that made them so to their EXIT."""

    def __init__(self, cells: Cells, mode: int, comms: frozenset, pids: frozenset):
        super().__init__(cells)
        self.mode, self.comms, self.pids = mode, comms, pids

    def feed(self, row: dict) -> list[dict]:
        own, kind = str(row["pid"]), row["kind__"]
        is_on = self.cells.get(own) is not None
        if row["comm"] in self.comms or row["pid"] in self.pids or (kind == "EXEC" and row["ppid__"] is not None and self.cells.get(str(row["ppid__"])) is not None):
            if not is_on:
                self.cells.set(own, row["timestamp_ns"])
            is_on = True
        if kind == "EXIT" and is_on:
            self.cells.set(own, None)
        return [row] if is_on or (self.mode == 1 and kind in ("EXEC", "EXIT", "BASH_READLINE")) else []

    def end(self) -> list[dict]:
        for key, _ in self.cells.items():
            self.cells.set(key, None)
        return []


def stream_track(events: DataFrame, mode: int = 2, comms: list[str] | None = None, pids: list[int] | None = None, delay: str = "1 minute", ends: Column | None = None) -> DataFrame:
    """process.track over a stream: process events of tracked processes (mode 1: and all starts and ends of processes).
    Other sources pass beside it. events: envelopes with session_id."""
    v = P.parsed()
    rows = events.where((F.col("source") == "process") | ends_of(events, ends))
    rows = rows.withColumns({"kind__": F.coalesce(P.text(v, "$.event"), F.lit("")), "ppid__": P.integer(v, "$.ppid"), "end__": ends_of(events, ends)})
    make = partial(Tracker, mode=mode, comms=frozenset(comms or ()), pids=frozenset(pids or ()))
    return in_order(rows, make, events.schema, delay=delay)


class Opens(Machine):
    """Runs of opens by file of each process, ended by a pause or by the process's EXIT."""

    def __init__(self, cells: Cells, gap: int):
        super().__init__(cells)
        self.gap = gap

    def _out(self, pid: int, path: str, run: tuple, reason: str) -> dict:
        return {"session_id": run[3], "pid": pid, "filepath": path, "first_seen": run[0], "last_seen": run[1], "count": run[2], "reason": reason}

    def feed(self, row: dict) -> list[dict]:
        key, now = str(row["pid"]), row["timestamp_ns"]
        runs, out = self.cells.get(key) or {}, []
        if row["filepath"] is None:  # an EXIT
            out = [self._out(row["pid"], p, r, "process_exit" if now - r[1] <= self.gap else "window_expired") for p, r in runs.items()]
            self.cells.set(key, None)
            return out
        run = runs.get(row["filepath"])
        if run and now - run[1] > self.gap:
            out, run = [self._out(row["pid"], row["filepath"], run, "window_expired")], None
        self.cells.set(key, runs | {row["filepath"]: (run[0] if run else now, now, run[2] + 1 if run else 1, row["session_id"])})
        return out

    def until(self, ns: int) -> list[dict]:
        out = []
        for key, runs in self.cells.items():
            over = {p: r for p, r in runs.items() if ns - r[1] > self.gap}
            if over:
                out += [self._out(int(key), p, r, "window_expired") for p, r in over.items()]
                self.cells.set(key, {p: r for p, r in runs.items() if p not in over} or None)
        return out

    def due(self) -> int | None:
        return min((r[1] + self.gap for _, runs in self.cells.items() for r in runs.values()), default=None)

    def end(self) -> list[dict]:
        out = [self._out(int(key), p, r, "window_expired") for key, runs in self.cells.items() for p, r in runs.items()]
        for key, _ in self.cells.items():
            self.cells.set(key, None)
        return out


def stream_opens(events: DataFrame, gap: int = WINDOW_NS, delay: str = "1 minute", ends: Column | None = None, buckets: int = 32) -> DataFrame:
    """process.opens_by_process over a stream: a row for each run of opens, when its pause is over, at the EXIT of its process, or at
    the end of the stream; with the reason. events: envelopes with session_id."""
    v = P.parsed()
    kind, path, over = P.text(v, "$.event"), P.text(v, "$.filepath"), ends_of(events, ends)
    wanted = over | ((F.col("source") == "process") & (((kind == "FILE_OPEN") & path.isNotNull()) | (kind == "EXIT")))
    rows = events.where(F.coalesce(wanted, F.lit(False))).select("session_id", "timestamp_ns", "stream_seq", "pid", F.when(kind == "FILE_OPEN", path).alias("filepath"), over.alias("end__"))
    schema = "session_id string, pid bigint, filepath string, first_seen bigint, last_seen bigint, count bigint, reason string"
    return in_order(rows, partial(Opens, gap=gap), schema, ["pid"], buckets, delay=delay)


class Limits(Machine):
    """The first events of each second of a process; (second, events, whether the last second before had too many)."""

    def __init__(self, cells: Cells, most: int):
        super().__init__(cells)
        self.most = most

    def feed(self, row: dict) -> list[dict]:
        key, second = str(row["pid"]), row["timestamp_ns"] // 1_000_000_000
        held = self.cells.get(key)
        if row["kind__"] == "EXIT":
            self.cells.set(key, None)
            return [row | {"rate_limit_warning": bool(held and held[1] > self.most)}]
        warn = bool(held and held[0] != second and held[1] > self.most)
        n = held[1] + 1 if held and held[0] == second else 1
        self.cells.set(key, (second, n))
        return [row | {"rate_limit_warning": warn}] if n <= self.most else []

    def end(self) -> list[dict]:
        for key, _ in self.cells.items():
            self.cells.set(key, None)
        return []


def stream_limits(events: DataFrame, most: int = 30, delay: str = "1 minute", ends: Column | None = None, buckets: int = 32) -> DataFrame:
    """Process events under the limit of `most` opens a second and process, and the EXITs, with rate_limit_warning: on the first
    open of a second after one with too many, and on the EXIT after one. Events of other kinds pass beside it."""
    v = P.parsed()
    kind, over = F.coalesce(P.text(v, "$.event"), F.lit("")), ends_of(events, ends)
    rows = events.where(over | ((F.col("source") == "process") & kind.isin("FILE_OPEN", "EXIT"))).withColumns({"kind__": kind, "end__": over})
    schema = StructType(events.schema.fields).add("rate_limit_warning", "boolean")
    return in_order(rows, partial(Limits, most=most), schema, ["pid"], buckets, delay=delay)


# --- tool uses and folds ------------------------------------------------------------------------------------------


class ToolUses(Machine):
    """Pending uses of a session, each with what the system did since, until its result or the timeout."""

    def __init__(self, cells: Cells, timeout_ns: int):
        super().__init__(cells)
        self.timeout_ns = timeout_ns

    def _close(self, use: dict, end: int | None, summary: str | None) -> dict:
        ms = self.timeout_ns // 1_000_000 if end is None else (end - use["start_ns"]) // 1_000_000
        own = {k: use[k] for k in ("session_id", "tool_use_id", "tool_name", "tool_input", "pid", "comm", "start_ns")}
        return own | {"result_summary": summary, "status": "timeout" if end is None else "success", "duration_ms": ms, "activities": json.dumps(use["seen"]) if use["seen"] else None}

    def feed(self, row: dict) -> list[dict]:
        now = row["timestamp_ns"]
        out, open_ = self._expired(now), self.cells.get("open") or []
        if row["kind"] == "use":
            for u in open_:
                u["closed"] |= u["tool_use_id"] == row["tool_use_id"]
            open_ = [*open_, row | {"start_ns": now, "seen": [], "closed": False}]
        elif row["kind"] == "activity":
            for u in open_:
                u["seen"].append(json.loads(row["activity"]))
        else:
            met = next((u for u in open_ if u["tool_use_id"] == row["tool_use_id"] and not u["closed"]), None)
            if met:
                out.append(self._close(met, now, row["result_summary"]))
                open_ = [u for u in open_ if u is not met]
        self.cells.set("open", open_ or None)
        return out

    def _expired(self, ns: int) -> list[dict]:
        open_ = self.cells.get("open") or []
        over = [u for u in open_ if ns - u["start_ns"] > self.timeout_ns]
        if over:
            self.cells.set("open", [u for u in open_ if u not in over] or None)
        return [self._close(u, None, None) for u in over]

    def until(self, ns: int) -> list[dict]:
        return self._expired(ns)

    def due(self) -> int | None:
        return min((u["start_ns"] + self.timeout_ns for u in self.cells.get("open") or []), default=None)

    def end(self) -> list[dict]:
        out = [self._close(u, None, None) for u in self.cells.get("open") or []]
        self.cells.set("open", None)
        return out


def stream_tool_calls(events: DataFrame, timeout_ms: int = tooluse.TIMEOUT_MS, delay: str = "1 minute", ends: Column | None = None) -> DataFrame:
    """tooluse.tool_uses over a stream, with os_activities: one row a use, at its result or when its time is over. An id that is
    used again starts anew. events: envelopes with session_id."""
    null = F.lit(None).cast("string")
    names = ["session_id", "timestamp_ns", "stream_seq", "kind", "tool_use_id", "tool_name", "tool_input", "pid", "comm", "result_summary", "activity", "end__"]

    def part(df: DataFrame, kind: str, at: Column, **more: Column) -> DataFrame:
        made = {"timestamp_ns": at, "stream_seq": F.lit({"use": 0, "activity": 1, "result": 2}.get(kind, 3)), "kind": F.lit(kind), "end__": F.lit(kind == "end")} | more
        return df.select(*((made.get(c) if c in made else F.col(c) if c in df.columns else null).cast({"pid": "bigint", "timestamp_ns": "bigint", "end__": "boolean"}.get(c, "string" if c != "stream_seq" else "int")).alias(c) for c in names))

    rows = part(tooluse.uses(events), "use", F.col("start_ns")).unionByName(part(tooluse.results(events), "result", F.col("end_ns")))
    rows = rows.unionByName(part(tooluse.activities(events), "activity", F.col("activity.timestamp_ns"), activity=F.to_json("activity")))
    rows = rows if ends is None else rows.unionByName(part(events.where(ends), "end", F.col("timestamp_ns")))
    schema = "session_id string, tool_use_id string, tool_name string, tool_input string, pid bigint, comm string, start_ns bigint, result_summary string, status string, duration_ms bigint, activities string"
    found = in_order(rows, partial(ToolUses, timeout_ns=timeout_ms * 1_000_000), schema, delay=delay)
    item = "array<struct<timestamp_ns:bigint,event_type:string,pid:bigint,comm:string,filepath:string,command:string>>"
    return found.withColumn("os_activities", F.array_sort(F.from_json("activities", item))).drop("activities")


class Folds(Machine):
    """The folds of many keys, a cell each; one that is idle ends."""

    def __init__(self, cells: Cells, keys: list[str], make: Callable[[tuple], Fold], idle_ns: int):
        super().__init__(cells)
        self.keys, self.make_fold, self.idle_ns = keys, make, idle_ns

    def feed(self, row: dict) -> list[dict]:
        key = tuple(row[k] for k in self.keys)
        fold = (self.cells.get(repr(key)) or (self.make_fold(key), 0))[0]
        out = fold.add(row)
        self.cells.set(repr(key), (fold, row.get("clock__", row["timestamp_ns"])))
        return out

    def until(self, ns: int) -> list[dict]:
        over = [(k, fold) for k, (fold, last) in self.cells.items() if ns - last > self.idle_ns]
        for k, _ in over:
            self.cells.set(k, None)
        return [row for _, fold in over for row in fold.idle()]

    def due(self) -> int | None:
        return min((last + self.idle_ns for _, (_, last) in self.cells.items()), default=None)

    def end(self) -> list[dict]:
        found = self.cells.items()
        for k, _ in found:
            self.cells.set(k, None)
        return [row for _, (fold, _) in found for row in fold.end()]


def _folds(rows: DataFrame, keys: list[str], make: Callable[[tuple], Fold], schema: StructType, idle_ns: int, events: DataFrame, ends: Column | None, delay: str, time: str, buckets: int) -> DataFrame:
    rows = rows.withColumn("end__", F.lit(False))
    if ends is not None:
        more = events.where(ends).select(*(F.col(c) if c in ("session_id", "timestamp_ns") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "end__"), F.lit(True).alias("end__"))
        rows = rows.unionByName(more)
    return in_order(rows, partial(Folds, keys=keys, make=make, idle_ns=idle_ns), schema, [k for k in keys if k != "session_id"], buckets, delay=delay, time=time)


def stream_messages(events: DataFrame, delay: str = "1 minute", ends: Column | None = None, time: str = "event", buckets: int = 32) -> DataFrame:
    """The messages of merge_sse over a stream: at their stop, after their silence, or at the end of the stream (`ends`).
    events: envelopes with session_id. time "processing": silence by the clock, without a watermark."""
    return _folds(sse_input(events)[0], SSE_KEYS, Message, OUT, SSE_IDLE, events, ends, delay, time, buckets)


def stream_tool_spans(events: DataFrame, delay: str = "1 minute", ends: Column | None = None, time: str = "event", buckets: int = 32) -> DataFrame:
    """The spans of spans.spans over a stream; a span whose pause is over ends as idle_gap, one that the end of the stream closes as flush."""
    return _folds(calls(events), SPAN_KEYS, Span, SPAN, SPAN_IDLE, events, ends, delay, time, buckets)

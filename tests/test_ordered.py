"""Streams in order of time against the batch operators, over shuffled micro-batches."""

import json
import random
import tracemalloc

import pandas as pd
import pytest
from events import frame
from pyspark.sql import functions as F
from test_transforms import CHUNK1, CHUNK2, opened, result, ssl, use

from traceloom.operators import process
from traceloom.operators.spans import spans
from traceloom.operators.sse import merge_sse
from traceloom.operators.tooluse import tool_uses
from traceloom.streaming import ordered

S = 1_000_000_000
DAY = 86_400 * S
ENDS = "source = 'control'"


def shuffled(spark, path, df, seed, parts=4, window=20 * S, ends=None):
    """A stream of df in micro-batches whose rows come out of order, by up to `window`; at last a control row of each session, at `ends`."""
    rng = random.Random(seed)
    rows = sorted(df.collect(), key=lambda r: r["timestamp_ns"] + rng.randrange(window))
    cuts = [len(rows) * i // parts for i in range(parts + 1)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    if ends:
        last = df.schema.fieldNames()
        batches.append([tuple({"session_id": s, "source": "control", "timestamp_ns": ends, "data": "{}"}.get(c) for c in last) for s in {r["session_id"] for r in rows}])
    for i, part in enumerate(batches):
        spark.createDataFrame([tuple(r) for r in part], df.schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def drained(df, path, **trigger):
    writer = df.writeStream.option("checkpointLocation", f"{path}/cp").trigger(**(trigger or {"availableNow": True}))
    writer.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{path}/out/{i}")).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out/*")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def busy(spark, seed, n=160):
    """Process events of a few processes that start each other, open files, end and come again."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        pid, kind = rng.randrange(1, 9), rng.choice(["EXEC", "EXEC", "FILE_OPEN", "FILE_OPEN", "FILE_OPEN", "EXIT", "BASH_READLINE"])
        data = {"event": kind} | ({"ppid": rng.randrange(1, 9)} if kind == "EXEC" else {"filepath": rng.choice(["/a", "/b"])} if kind == "FILE_OPEN" else {})
        rows.append(("process", pid, "agent" if rng.random() < 0.04 else "sh", DAY + i * S // 2 + rng.randrange(S // 4), data))
    df = frame(spark, rows, True)
    return df.unionByName(df.where("pid < 4").withColumn("session_id", F.lit("s2")))


@pytest.mark.parametrize("mode", [1, 2])
def test_tracking(spark, tmp_path, mode):
    df = busy(spark, mode)
    stream = shuffled(spark, f"{tmp_path}/in", df, mode, ends=2 * DAY)
    got = drained(ordered.stream_track(stream, mode, ["agent"], [3], ends=F.expr(ENDS)), str(tmp_path))
    assert rows_of(got, "session_id", "stream_seq", "data") == rows_of(process.track(df, mode, ["agent"], [3]), "session_id", "stream_seq", "data")


def test_opens(spark, tmp_path):
    df = busy(spark, 5)
    kind, path = F.get_json_object("data", "$.event"), F.get_json_object("data", "$.filepath")
    rows = df.select("session_id", "pid", "timestamp_ns", kind.alias("kind"), path.alias("filepath"))
    want = process.opens_by_process(rows.where("kind = 'FILE_OPEN'"), rows.where("kind = 'EXIT'"), ["session_id", "pid"], gap=8 * S)
    names = ["session_id", "pid", "filepath", "first_seen", "last_seen", "count", "reason"]
    got = drained(ordered.stream_opens(shuffled(spark, f"{tmp_path}/in", df, 5, ends=2 * DAY), 8 * S, ends=F.expr(ENDS), buckets=3), str(tmp_path))
    found = rows_of(got, *names)
    assert found == rows_of(want, *names) and {r[-1] for r in found} == {"process_exit", "window_expired"}


def test_limits(spark, tmp_path):
    rng = random.Random(3)
    rows = [("process", rng.randrange(3), "a", DAY + rng.randrange(40 * S), {"event": "FILE_OPEN", "filepath": "/x"}) for _ in range(250)] + [("process", p, "a", DAY + (13 + 9 * p) * S, {"event": "EXIT"}) for p in range(3)]
    df = frame(spark, rows, True)
    kind = F.get_json_object("data", "$.event")
    opens, exits = df.where(kind == "FILE_OPEN"), df.where(kind == "EXIT")
    second, by = F.floor(F.col("timestamp_ns") / S), ["session_id", "pid"]
    # the batch's rate limit knows no EXIT, so a life is a process of its own there
    life = F.when((F.col("timestamp_ns") > DAY + (13 + 9 * F.col("pid")) * S), 1).otherwise(0)
    kept = process.rate_limit(opens.withColumn("life", life), second, [*by, "life"], ["timestamp_ns", "stream_seq"], 3)
    want = rows_of(kept, "stream_seq", "rate_limit_warning") + rows_of(process.exit_warnings(opens, exits, second, by, "timestamp_ns", 3), "stream_seq", "rate_limit_warning")
    got = drained(ordered.stream_limits(shuffled(spark, f"{tmp_path}/in", df, 3, ends=2 * DAY), 3, ends=F.expr(ENDS), buckets=2), str(tmp_path))
    found = rows_of(got, "stream_seq", "rate_limit_warning")
    assert found == sorted(want, key=repr) and {w for _, w in found} == {True, False}


def test_tool_calls_with_activities(spark, tmp_path):
    rows = [opened(DAY - S), use(DAY, "t1", "t2"), opened(DAY + S), result(DAY + 2 * S, "t1"), opened(DAY + 3 * S), use(DAY + 4 * S, "t2"), opened(DAY + 5 * S), result(DAY + 6 * S, "t2"), result(DAY + 7 * S, "t1"), use(DAY + 8 * S, "t3"), opened(DAY + 38 * S), opened(DAY + 39 * S), result(DAY + 50 * S, "t3"), use(DAY + 60 * S, "t1")]
    df = frame(spark, rows, True)
    names = ["session_id", "tool_use_id", "tool_name", "pid", "start_ns", "status", "duration_ms", "result_summary", "os_activities"]
    got = drained(ordered.stream_tool_calls(shuffled(spark, f"{tmp_path}/in", df, 1, ends=2 * DAY), ends=F.expr(ENDS)), str(tmp_path))
    assert rows_of(got, *names) == rows_of(tool_uses(df), *names) and got.count() == 5


def test_folds_end_with_a_control_row(spark, tmp_path):
    """A message without its end comes in the stream itself; spans end as the batch ends them."""
    rows = [ssl(CHUNK1, DAY + 1), ssl(CHUNK2, DAY + 20), ssl(CHUNK1, DAY + 3 * S, tid=7)]
    df = frame(spark, rows, True)
    got = drained(ordered.stream_messages(shuffled(spark, f"{tmp_path}/in", df, 1, 2, ends=2 * DAY), ends=F.expr(ENDS), buckets=3), str(tmp_path))
    want = merge_sse(df).where("source = 'sse_processor'")
    text = lambda d: sorted(json.dumps(json.loads(r["data"]), sort_keys=True) for r in d.collect())
    assert text(got) == text(want) and len(text(got)) == 2
    df = busy(spark, 9)
    keys = ["session_id", "pid", "tool_name", "key_field", "start_ns", "end_ns", "calls", "status"]
    got = drained(ordered.stream_tool_spans(shuffled(spark, f"{tmp_path}/in2", df, 2, ends=2 * DAY), ends=F.expr(ENDS)), f"{tmp_path}/spans")
    assert rows_of(got, *keys) == rows_of(spans(df), *keys) and {"idle_gap", "flush"} <= {r["reason"] for r in got.collect()}


def test_folds_by_the_clock(spark, tmp_path):
    """Processing time: what is idle ends some time after it came, whatever its own time says."""
    df = frame(spark, [ssl(CHUNK1, 5), ("process", 1, "a", 7, {"event": "FILE_OPEN", "filepath": "/x", "flags": 0})], True)
    df.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
    out = ordered.stream_tool_spans(stream, time="processing")
    query = out.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}")).start()
    found = []
    for _ in range(60):
        query.awaitTermination(1)
        found = spark.read.schema(out.schema).parquet(f"{tmp_path}/out/*").collect() if list((tmp_path / "out").glob("*")) else []
        if found:
            break
    query.stop()
    assert [(r["key_field"], r["reason"]) for r in found] == [("/x", "idle_gap")]


class States(dict):
    """A session's states, as dicts."""

    def getMapState(self, name, *_):
        states = self.setdefault(name, {})

        class Map:
            getValue, containsKey = staticmethod(lambda k: states[k]), staticmethod(lambda k: k in states)
            updateValue, removeKey, iterator = staticmethod(states.__setitem__), staticmethod(states.pop), staticmethod(lambda: iter(states.items()))

        return Map

    def getValueState(self, name, *_):
        class Value:
            exists, get = staticmethod(lambda: name in self), staticmethod(lambda: self.get(name))
            update, clear = staticmethod(lambda v: self.__setitem__(name, v)), staticmethod(lambda: self.pop(name, None))

        return Value

    def getListState(self, name, *_):
        rows = self.setdefault(name, [])

        class Waiting:
            get, clear, appendValue = staticmethod(lambda: iter(list(rows))), staticmethod(rows.clear), staticmethod(rows.append)

        return Waiting

    def registerTimer(self, ms):
        pass


class Echo(ordered.Machine):
    def feed(self, row):
        return [row]


def test_a_large_session_is_not_held_in_whole():
    """120,000 rows of a session in shuffled frames, in three micro-batches: they come in order, and a task's memory stays small."""
    rng = random.Random(1)
    times = list(range(120_000))
    rng.shuffle(times)
    names = ["timestamp_ns", "stream_seq", "data"]

    def frames(part):
        for at in range(0, len(part), 2000):
            yield pd.DataFrame({"timestamp_ns": [t * S for t in part[at : at + 2000]], "stream_seq": 1, "data": [f"{t:0>300}" for t in part[at : at + 2000]], "at__": 0, "bucket__": 0, "end__": False})

    end = pd.DataFrame({"timestamp_ns": [0], "stream_seq": [None], "data": [None], "at__": 0, "bucket__": 0, "end__": True})
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.ms})()
    found, states = [], States()
    processor = ordered.InOrder(Echo, names, names[:2], True, names[:2])
    processor.init(states)
    tracemalloc.start()
    for i, (ms, more) in enumerate(((-1, []), (50_000_000, []), (50_000_000, [end]))):
        clock.ms = ms
        # what is late does not come: parts hold times that the watermark has not passed
        part = [t for t in times if (t <= 60_000 if i == 0 else t > 60_000 and t % 2 == i - 1)]
        tracemalloc.reset_peak()
        for frame_ in processor.handleInputRows(("s",), iter([*frames(part), *more]), clock):
            assert len(frame_) <= 10_000
            found += [t // S for t in frame_["timestamp_ns"].astype("int64")]
        kept = sum(len(v[0]) for v in states["pages"].values()) if "pages" in states else 0
        assert tracemalloc.get_traced_memory()[1] - kept < 50e6
        assert len(found) == [0, 50_001, 120_000][i]
    tracemalloc.stop()
    assert found == sorted(times) and not states.get("pages")

import json

from events import frame
from test_transforms import CHUNK1, CHUNK2, result, ssl, use

from traceloom.operators.spans import spans
from traceloom.operators.http import parse_http
from traceloom.operators.sse import OUT, merge_sse
from traceloom.plans.chains import Pipeline
from traceloom.streaming.sink import read_tables, stream_tables
from traceloom.streaming.stateful import late_rows, open_folds, stream_spans, stream_sse, stream_tool_uses


DAY = 86_400_000_000_000


def as_stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_streamed_messages_are_those_of_the_batch(spark, tmp_path):
    rows = [ssl(CHUNK1, DAY + 1), ssl(CHUNK2, DAY + 20)]
    df = frame(spark, rows)
    got = drain(stream_sse(as_stream(spark, df, str(tmp_path / "in"))), "messages").collect()
    want = merge_sse(df).where("source = 'sse_processor'").collect()
    assert [json.loads(r["data"]) for r in got] == [json.loads(r["data"]) for r in want] and len(got) == 1


def test_open_folds_end_after_the_stream(spark, tmp_path):
    """A message without its end stays open in the state; it is read out afterwards. Two micro-batches, one row late."""
    rows = [ssl(CHUNK1, DAY + 1), ssl(CHUNK1, 2 * DAY), ssl(CHUNK1, 5)]
    for i, part in enumerate((rows[:2], rows[2:])):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = stream_sse(source).writeStream.format("memory").queryName("open").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    given = spark.table("open").count()
    left = open_folds(spark, str(tmp_path / "cp"), OUT)
    assert given + left.count() == 2 and late_rows(query) == 1
    assert {r["pid"] for r in left.collect()} == {0}


def test_pipeline_over_a_stream(spark, tmp_path):
    df, got = frame(spark, [ssl("GET /x HTTP/1.1\r\nHost: a\r\n\r\n", 1), ssl("plain", 2)]), []
    pipe = Pipeline([as_stream(spark, df, str(tmp_path / "in"))]).with_transforms(parse_http).with_sinks(lambda d: got.extend(r["source"] for r in d.collect()))
    pipe.run_stream(str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    assert sorted(got) == ["http_parser", "ssl"]


def test_streamed_tool_uses(spark, tmp_path):
    """A use with its result, and one without, which comes as a timeout once the watermark is past it."""
    s = 1_000_000_000
    rows = [use(DAY, "t1"), result(DAY + 2 * s, "t1"), use(DAY + 3 * s, "t2"), use(DAY + 900 * s, "t3"), result(DAY + 900 * s, "x"), use(DAY + 1800 * s, "t4"), result(DAY + 1800 * s, "x")]
    for i, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        frame(spark, part, True).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(frame(spark, rows, True).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r["tool_use_id"]: r["status"] for r in drain(stream_tool_uses(source), "uses").collect()}
    assert got["t1"] == "success" and got["t2"] == "timeout"


def test_streamed_spans_are_those_of_the_batch(spark, tmp_path):
    ex = lambda ns: ("process", 1, "a", ns, {"event": "EXEC", "filename": "/x", "full_command": "x"})
    df = frame(spark, [ex(DAY + 1), ex(DAY + 5_000_000)], True)
    got = drain(stream_spans(as_stream(spark, df, str(tmp_path / "in"))), "spans").collect()
    want = spans(df).collect()
    key = lambda r: (r["start_ns"], r["end_ns"], r["status"], r["reason"], r["calls"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 2


def test_tables_of_a_stream(spark, tmp_path):
    rows = [("process", 1, "a", 1_000_000, {"event": "EXEC", "filename": "/x"}), ("system", 1, "a", 2_000_000, {"cpu": {"percent": "1"}}), ("stdio", 1, "a", 3_000_000, {})]
    df = frame(spark, rows, True)
    stream_tables(as_stream(spark, df, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    t = read_tables(spark, str(tmp_path / "out"))
    assert {n: d.count() for n, d in t.items() if d.count()} == {"events_process": 1, "events_system": 1}

"""Binary records against struct; ids from one sequence; texts of the viewer; small writers and filters."""

import json
import random
import struct
from datetime import datetime

import pytest
from events import frame, payloads
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceloom.operators import process, project, security, textual
from traceloom.operators.filters import changed_credentials, comma_list, ssl_filter
from traceloom.plans import api
from traceloom.sources import logs, records
from traceloom.streaming import sink
from traceloom.streaming.stateful import stream_dedup_opens, stream_rate_limit, stream_resources


def process_record(kind, pid=7, ppid=3, code=0, duration=0, ns=5_000_001, comm=b"sh", command=b"", union=b"", ended=0):
    return struct.pack("<IiiIQQ16s256s256sB7x", kind, pid, ppid, code, duration, ns, comm, command, union, ended)


def test_process_records(spark, tmp_path):
    cred = lambda uid: struct.pack("<8I5Q", uid, 1, 2, 3, 4, 5, 6, 7, 1 << 40, 0, (1 << 64) - 1, 0, 9)
    path = lambda p, flags, op: struct.pack("<127sxIiI", p, 4, flags, op)
    raw = [
        process_record(0, command=b"ls -l\0junk", union=b"/bin/ls"), process_record(0, code=1 << 31, duration=2_500_000, ended=1), process_record(1, union="echo é\xff".encode("latin-1")), process_record(2, union=path(b"/a", -1, 0)),
        process_record(2, union=path(b"/b", 5, 2)), process_record(2, union=path(b"/c", 5, 1)), process_record(3, union=cred(10) + cred(0)), process_record(4, union=struct.pack("<HHI", 2, 443, 0x0100007F)),
        process_record(4, union=struct.pack("<HH16s", 10, 80, bytes.fromhex("20010db8000000000000000000000001"))), process_record(4, union=struct.pack("<HH", 1, 2)), process_record(5, union=b"/old".ljust(127, b"\0") + b"/new"), process_record(6, union=b"/d".ljust(128, b"\0") + struct.pack("<i", 493)), process_record(99),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.bin").write_bytes(b"".join(raw))
    base = {"timestamp": 5_000_001, "comm": "sh", "pid": 7}
    caps = {"gid": 1, "suid": 2, "sgid": 3, "euid": 4, "egid": 5, "fsuid": 6, "fsgid": 7, "cap_inheritable": 1 << 40, "cap_permitted": 0, "cap_effective": (1 << 64) - 1, "cap_bset": 0, "cap_ambient": 9}
    want = [
        {"event": "EXEC", "ppid": 3, "filename": "/bin/ls", "full_command": "ls -l"}, {"event": "EXIT", "ppid": 3, "exit_code": 1 << 31, "duration_ms": 2}, {"event": "BASH_READLINE", "command": "echo ��"}, {"event": "FILE_OPEN", "filepath": "/a", "flags": -1, "count": 1},
        {"event": "FILE_DELETE", "filepath": "/b", "flags": 5}, {"event": "CRED_CHANGE", "ppid": 3, "old": {"uid": 10, **caps}, "new": {"uid": 0, **caps}}, {"event": "NET_CONNECT", "family": 2, "port": 443, "ip": "127.0.0.1"}, {"event": "NET_CONNECT", "family": 10, "port": 80, "ip": "2001:db8::1"},
        {"event": "NET_CONNECT", "family": 1, "port": 2}, {"event": "FILE_RENAME", "oldpath": "/old", "newpath": "/new"}, {"event": "DIR_CREATE", "path": "/d", "mode": 493},
    ]
    key = lambda d: json.dumps(d, sort_keys=True)
    got = records.read_records(spark, str(tmp_path / "a"), "process", boot_ms=100)
    assert sorted((json.loads(r["data"]) for r in got.collect()), key=key) == sorted((base | w for w in want), key=key)
    assert {(r["timestamp_ns"], r["timestamp_unix_ms"], r["pid"], r["comm"], r["source"]) for r in got.collect()} == {(5_000_001, 105, 7, "sh", "process")}
    # many records, cut into splits anywhere; and a file whose last record is cut off
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "many.bin").write_bytes(b"".join(process_record(0, pid=i, union=b"/x") for i in range(5000)))
    assert {r["pid"] for r in records.read_records(spark, str(tmp_path / "b"), "process").collect()} == set(range(5000))
    (tmp_path / "b" / "cut.bin").write_bytes(raw[0] + raw[1][:300])
    assert records.read_records(spark, str(tmp_path / "b"), "process").count() == 5001
    out = records.stream_records(spark, str(tmp_path / "a"), "process")
    out.writeStream.format("memory").queryName("recorded").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("recorded").count() == len(want)


def test_ssl_and_stdio_records(spark):
    def ssl(data, size=None, filled=1, rw=1, delta=1_500_000, handshake=None):
        head = struct.pack("<QQIIIIIii16s", 9, delta, 1, 2, 3, len(data) if size is None else size, len(data), filled, rw, b"curl")
        return head + data + (b"" if handshake is None else bytes(512 * 1024 - len(data)) + struct.pack("<i4x", handshake))

    rows = spark.createDataFrame([(bytearray(x),) for x in (ssl(b"GET /\x01"), ssl(b"ab", 10, rw=7, delta=0), ssl(b"", filled=0), ssl(b"x", handshake=1), ssl(b"x", handshake=0), b"short")], "value binary")
    got = [json.loads(r["data"]) for r in records.decode_ssl(rows).collect()]
    assert [(g["function"], g.get("data"), g["truncated"], g.get("bytes_lost"), g["latency_ms"], g["len"]) for g in got] == [("WRITE/SEND", "GET /\\u0001", False, None, 1.5, 6), ("UNKNOWN", "ab", True, 8, 0.0, 10), ("WRITE/SEND", None, False, None, 1.5, 0), ("WRITE/SEND", "x", False, None, 1.5, 1)]
    assert records.decode_ssl(rows, handshakes=True).count() == 5
    stdio = struct.pack("<QQIIIiIIB16s", 9, 0, 1, 2, 3, -1, 4, 4, 1, b"sh") + b"data" + b"more"
    (r,) = records.decode_stdio(spark.createDataFrame([(bytearray(stdio),)], "value binary")).collect()
    assert json.loads(r["data"]) == {"timestamp_ns": 9, "comm": "sh", "pid": 1, "tid": 2, "uid": 3, "fd": -1, "len": 4, "direction": "read", "data": "data", "buf_size": 4}


def test_alert_ids_do_not_depend_on_the_rules(spark):
    """One rule or twelve, an alert of a known rule has one id; own rules have ids that meet no other."""
    rows = [("process", 1, "a", i + 1, {"event": "CRED_CHANGE"}) for i in range(3)]
    df = frame(spark, rows, True)
    own = [security.Rule(f"own{i}", "low", lambda v: F.lit("x"), lambda comm, d: comm) for i in range(12)]
    known = security.rules()
    ids = lambda rules: {(r["alert_type"], r["source_event_id"]): r["id"] for r in project.typed(security.alerts(df, rules), "events_security").collect()}
    many, few = ids([*own, *known]), ids([known[2]])
    assert few.items() <= many.items() and len(set(many.values())) == len(many) == 39
    assert not set(many.values()) & {r["id"] for r in project.typed(df, "events_process").collect()}


def test_dense_ids_stay_when_a_batch_is_written_again(spark, tmp_path):
    rows = [("process", i, "a", 1_000_000 * (i + 1), {"event": "CRED_CHANGE"}) for i in range(10)] + [("system", 1, "a", 3_500_000, {"cpu": {"percent": "1"}})]
    events = security.analyze(frame(spark, rows, True))
    first, rest = events.where("timestamp_ns < 5000000"), events.where("timestamp_ns >= 5000000")
    found = []
    for batch, part in ((3, first), (7, rest), (3, first), (7, rest)):
        sink.write_tables(part, str(tmp_path), batch, dense=True)
        t = sink.read_tables(spark, str(tmp_path))
        found.append(sorted((n, r["id"], r["timestamp_ns"]) for n in t for r in t[n].collect()))
    assert found[1] == found[2] == found[3] and sorted(i for _, i, _ in found[3]) == list(range(1, 22))
    a = t["events_security"].join(t["events_process"].select(F.col("id").alias("source_event_id"), F.col("pid").alias("p")), "source_event_id")
    assert a.count() == 10 and a.where("pid <> p").count() == 0


def test_dense_ids_are_not_sent_through_the_driver(spark):
    """The numbers have a row per event, so no join of theirs is a broadcast, however small their file is."""
    events = security.analyze(frame(spark, [("process", i, "a", i + 1, {"event": "CRED_CHANGE"}) for i in range(20)], True))
    made, last = sink.dense_ids({t: project.typed(events, t) for t in ("events_process", "events_security")})
    assert last == 40 and sorted(r["id"] for t in made.values() for r in t.collect()) == list(range(1, 41))
    for t in made.values():
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


# --- texts --------------------------------------------------------------------------------------------------------


def plain_chunks(text):
    """One character after another."""
    out, start, depth, inside, escaped = [], -1, 0, False, False
    for i, c in enumerate(text):
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}":
            depth -= 1
            if depth == 0 and start >= 0:
                out.append(text[start : i + 1])
                start = -1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text('{}"\\ab:\n', max_size=40))
def test_chunks_are_those_of_a_plain_scan(text):
    assert textual.chunks_of(text) == plain_chunks(text)


def test_damaged_json():
    assert textual.chunks_of('{"a":"}"}{"b":{"c":1}} x {"d":"\\q",}') == ['{"a":"}"}', '{"b":{"c":1}}', '{"d":"\\q",}']
    assert textual.chunks_of("} {a} {{}}") == ["{}"] and textual.chunks_of('{"open') == []
    assert textual.unescaped('a\\n\\t\\"\\\\\\/\\q\\u00e9\\ud83d\\ude00\\u12') == 'a\n\t"\\/qé😀u12'
    assert textual.raw_field('{"x":1,"content" :\t"a\\"b\\q","y":2}', "content") == 'a\\"b\\q'
    assert textual.raw_field('{"content":"cut off \\', "content") == "cut off \\" and textual.raw_field('{"content":5}', "content") is None and textual.raw_field("{}", "content") is None
    assert textual.content_of('{"file_path":"/f","content":" x "}') == f"[/f]\n{'─' * 4}\nx"
    assert textual.content_of('{"content":"a\\qb","file_path":"/\\u0066"}') == f"[/f]\n{'─' * 4}\naqb"
    assert textual.content_of('{"a":1.0,"b":[]}{"c":NaN}') == '=== PART 1 ===\n{\n  "a": 1,\n  "b": []\n}\n\n=== PART 2 ===\n{"c":NaN}'
    assert textual.content_of('"{\\"content\\":\\"in a string\\"}"') == "in a string" and textual.content_of(" plain ") == "plain"


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcd"), max_size=25))
def test_changes_are_shortest_and_whole(a, b):
    runs = list(textual.changes(a, b))
    assert [x for s, r in runs for x in r if s != "+"] == a and [x for s, r in runs for x in r if s != "-"] == b
    assert sum(len(r) for s, r in runs if s == " ") == plain_lcs(a, b)


def test_changes_of_long_texts_are_bounded():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 3000), rng.integers(0, 50, 3000)
    pairs = textual.matched(a, b, most=100)
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False)) and len(pairs) > 500


def test_prompt_diffs():
    say = lambda *texts: json.dumps({"body": json.dumps({"messages": [{"role": "user", "content": t} for t in texts]})})
    d = lambda x, y: textual.diff_of(textual.prompt_text(textual.prompt_of(x)), textual.prompt_text(textual.prompt_of(y)))
    assert d(say("a\nb"), say("a\nc", "d")) == "  [0] USER:\n  a\n- b\n+ c\n+ ---\n+ [1] USER:\n+ d\n"
    long = "\n".join(f"line {i}" for i in range(12))
    assert d(say(long + "\nold"), say(long + "\nnew")) == "  [0] USER:\n  line 0\n  line 1\n  ...\n  line 9\n  line 10\n  line 11\n- old\n+ new\n"
    assert textual.prompt_of("no json") is None and textual.prompt_of('{"x":1}') is None and textual.prompt_of('{"prompt":"p"}') == {"prompt": "p"}
    assert textual.prompt_text({"messages": [{"role": "a", "content": [{"type": "text", "text": "x"}, {"type": "image"}]}, {"content": {"k": 1}}]}) == '[0] A:\nx\n\n---\n\n[1] UNKNOWN: {"k":1}'


# --- writers, filters, streams ------------------------------------------------------------------------------------


def test_console_and_logs(spark, tmp_path):
    df, lines = frame(spark, [("ssl", 1, "a", 5, {"data": "x\u0001"}), ("ssl", 1, "a", 2, {"data": "y"})]), []
    assert sink.console(df, lines.append) == 2 and json.loads(json.loads(lines[1])["data"])["data"] == "HEX:7801" and json.loads(lines[0])["timestamp_ns"] == 2
    sink.write_log(df, str(tmp_path / "log"), 1)
    good, bad = logs.read_jsonl(spark, str(tmp_path / "log"))
    assert good.count() == 2 and bad.count() == 0 and sum(p.stat().st_size > 0 for p in (tmp_path / "log").glob("part-*")) == 2
    for i in range(4):
        (tmp_path / "logs" / f"l{i}").mkdir(parents=True)
        import os

        os.utime(tmp_path / "logs" / f"l{i}", (i + 1, i + 1))
    assert sorted(sink.keep_logs(spark, str(tmp_path / "logs"), 2)) == ["l0", "l1"] and sorted(p.name for p in (tmp_path / "logs").iterdir()) == ["l2", "l3"]


def test_sinks_of_a_stream_and_alerts(spark, tmp_path):
    df = frame(spark, [("process", 1, "a", 1_000_000, {"event": "CRED_CHANGE"})], True)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sink.fan_out(stream, str(tmp_path / "cp"), lambda d, i: seen.append(("a", i, d.count())), lambda d, i: seen.append(("b", i, d.count())), trigger={"availableNow": True}).awaitTermination()
    assert seen == [("a", 0, 1), ("b", 0, 1)]
    project.typed(security.alerts(df), "events_security").write.parquet(str(tmp_path / "alerts"))
    assert sink.clear_alerts(spark, str(tmp_path / "alerts")) == 1 and spark.read.parquet(str(tmp_path / "alerts")).count() == 0
    rows = project.typed(logs.demo_alerts(spark, datetime(2024, 1, 1, 12)), "events_security").collect()
    assert sorted(r["alert_type"] for r in rows) == ["dangerous_command", "sensitive_file_access", "suspicious_network"]


def test_small_things(spark):
    assert comma_list(" a, ,b ,") == ["a", "b"]
    assert api.to_maps(spark.createDataFrame([(1, "x")], "a int, b string")) == {"data": [{"a": 1, "b": "x"}], "count": 1}
    df = frame(spark, [("ssl", 1, "a", 3_000_000, {}), ("ssl", 1, "a", 3_000_001, {"x": 1}), ("ssl", 1, "a", 1_000_000, {}), ("process", 1, "a", 3_000_000, {})])
    assert [r["event_id"] for r in logs.numbered(df).collect()] == ["ssl-1-0", "ssl-3-0", "process-3-0", "ssl-3-1"]
    cred = [("process", 1, "a", 1, {"event": "CRED_CHANGE", "old": {"uid": 1, "gid": 2}, "new": {"uid": 1, "gid": 2}}), ("process", 1, "a", 2, {"event": "CRED_CHANGE", "old": {"uid": 1}}), ("process", 1, "a", 3, "x")]
    assert [r["timestamp_ns"] for r in changed_credentials(frame(spark, cred)).collect()] == [2, 3]
    (one,) = payloads(logs.synthetic(spark, 1))[:1]
    assert one["function"] == "WRITE/SEND"


def test_filter_counts(spark):
    """The metrics of a filter reach a listener's observation."""
    from pyspark.sql import Observation

    df = frame(spark, [("ssl", 1, "a", i, {"len": i}) for i in range(5)] + [("process", 1, "a", 9, {})])
    seen = Observation("ssl")
    hit = F.col("source") == "ssl"
    counted = ssl_filter(df, ["len>2"], metric="named")
    assert counted.observe(seen, F.count("*").alias("left"), F.count_if(hit).alias("ssl")).count() == 4 and seen.get == {"left": 4, "ssl": 3}


def test_thread_exits_are_no_exits(spark):
    rows = [("process", 5, "a", 1, {"event": "EXIT", "tid": 5}), ("process", 5, "a", 2, {"event": "EXIT", "tid": 6}), ("process", 5, "a", 3, {"event": "EXIT"}), ("ssl", 5, "a", 4, {"tid": 6})]
    assert [r["timestamp_ns"] for r in process.without_thread_exits(frame(spark, rows)).orderBy("timestamp_ns").collect()] == [1, 3, 4]


@pytest.mark.parametrize("name", ["dedup", "resources", "limit"])
def test_windowed_streams(spark, tmp_path, name):
    at = lambda s: datetime(2024, 1, 1, 0, 0, 0).replace(second=s % 60, minute=s // 60)
    rng = random.Random(1)
    rows = [(at(s), 1, "/a", "s1", "c", float(s), s > 8) for s in (1, 2, 3, 9, 200, 201)] + [(at(3000 + rng.randrange(2)), 2, "/b", "s1", "c", 1.0, False)]
    df = spark.createDataFrame(rows, "event_time timestamp, pid long, filepath string, session_id string, comm string, cpu_percent double, sys_alert boolean")
    df.where("pid = 1").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    df.where("pid = 2").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    made = {"dedup": stream_dedup_opens, "resources": stream_resources, "limit": lambda s: stream_rate_limit(s, most=0)}[name](stream)
    made.writeStream.format("memory").queryName(f"w_{name}").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [r for r in spark.table(f"w_{name}").collect() if r["pid"] == 1]
    want = {"dedup": [2, 4], "limit": [1] * 6}.get(name)
    if name == "resources":
        assert sorted((r["sample_count"], r["max_cpu_percent"]) for r in got) == [(1, 9.0), (2, 201.0), (3, 3.0)]
    else:
        assert sorted(r["count"] for r in got) == want

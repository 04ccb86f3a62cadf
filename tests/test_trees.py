"""Trees, timelines and ranks against plain Python."""

import json
import random
import time
from collections import defaultdict
from statistics import quantiles

import pytest
from events import frame
from pyspark.sql import functions as F

from traceloom.operators import process, project, viewer
from traceloom.operators.ranks import percentiles, row_numbers, running_sum
from traceloom.operators.trees import climbed, linked


def plain_tree(parents):
    """depth of each node (None where its parents run in a circle), and the nodes at and below each, links of circles cut."""
    up = {n: p if p in parents and p != n else None for n, p in parents.items()}

    def path(n, links):
        seen = [n]
        while links[seen[-1]] is not None:
            if links[seen[-1]] in seen:
                return seen, seen[seen.index(links[seen[-1]]) :]
            seen.append(links[seen[-1]])
        return seen, None

    depth, circle = {}, set()
    for n in up:
        way, loop = path(n, up)
        depth[n] = None if loop else len(way) - 1
        circle |= set(loop or ())
    cut = {n: None if n in circle else p for n, p in up.items()}
    below = defaultdict(set)
    for n in up:
        for a in path(n, cut)[0]:
            below[a].add(n)
    reach = defaultdict(set)
    for n in up:
        for a in path(n, up)[0]:
            reach[a].add(n)
    return depth, below, reach


@pytest.mark.parametrize("seed", range(4))
def test_climbed(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 30, 80])
    parents = {i: rng.choice([rng.randrange(n + 5), max(0, i - 1), i, None]) for i in range(n)}
    value = {i: rng.choice([None, rng.randrange(100)]) for i in parents}
    df = spark.createDataFrame([("s", i, p, value[i]) for i, p in parents.items()] + [("other", i, i - 1, 1) for i in range(3)], "session_id string, pid long, ppid long, v long")
    df = df.withColumn("low", F.col("v")).withColumn("high", F.col("v"))
    got = climbed(linked(df, ["session_id"], keep=("v", "low", "high")), ["session_id"], {"v": "sum", "low": "min", "high": "max"}).where("session_id = 's'").collect()
    depth, below, reach = plain_tree(parents)
    held = lambda nodes: [value[x] for x in nodes if value[x] is not None]
    want = {i: (depth[i], sum(held(below[i])) if held(below[i]) else None) for i in parents}
    assert {r["node"]: (r["depth"], r["v"]) for r in got} == want and len(got) == n
    open_ = {i for i in parents if depth[i] is not None}
    assert {r["node"]: (r["low"], r["high"]) for r in got if r["node"] in open_} == {i: (min(held(reach[i]), default=None), max(held(reach[i]), default=None)) for i in open_}


def test_empty_trees(spark):
    none = spark.createDataFrame([], "session_id string, pid long, ppid long")
    assert climbed(linked(none, ["session_id"]), ["session_id"]).count() == 0
    assert process.with_children(spark.createDataFrame([], "session_id string, pid long, mem_rss_kb long"), none).count() == 0
    assert viewer.tree_matches(none, none.select("session_id", "pid")).count() == 0


def test_long_chain_is_tracked_in_few_rounds(spark):
    """A chain of 5000 processes: rounds hold about one edge a process, not all pairs."""
    rows = [("s", i, "agent" if i == 1 else "sh", i * 10, i, "EXEC", i - 1) for i in range(1, 5001)]
    df = spark.createDataFrame(rows, "session_id string, pid long, comm string, timestamp_ns long, stream_seq long, __kind string, ppid long")
    sizes, write = [], process.write_table

    def spy(table, label):
        done = write(table, label)
        if label == "edges":
            sizes.append(done.count())
        return done

    process.write_table = spy
    began = time.perf_counter()
    try:
        found = process.tracked_lives(df, F.col("comm") == "agent").collect()
    finally:
        process.write_table = write
    assert {r["pid"]: r["since"] for r in found} == {i: i * 10 for i in range(1, 5001)}
    assert max(sizes) <= 5000
    assert time.perf_counter() - began < 60


def plain_track(rows, hit):
    """Lives that are tracked and since when, until nothing changes; rows: (pid, comm, ns, kind, ppid) in order."""
    life, events = defaultdict(int), []
    for pid, comm, ns, kind, ppid in rows:
        events.append((pid, life[pid], comm, ns, kind, ppid, life[ppid]))
        life[pid] += kind == "EXIT"
    since = {}
    while True:
        before = dict(since)
        for pid, n, comm, ns, kind, ppid, up in events:
            if comm == hit or (kind == "EXEC" and (pid, n) != (ppid, up) and since.get((ppid, up), ns + 1) <= ns):
                since[pid, n] = min(since.get((pid, n), ns), ns)
        if since == before:
            return since


@pytest.mark.parametrize("seed", range(5))
def test_tracked_lives_are_those_of_plain_rules(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(250):
        kind = rng.choice(["EXEC", "EXEC", "EXEC", "EXIT", "FILE_OPEN"])
        rows.append((rng.randrange(25), "agent" if rng.random() < 0.02 else "sh", i * 10, kind, rng.randrange(25) if kind == "EXEC" else None))
    df = spark.createDataFrame([("s", p, c, ns, i, k, u) for i, (p, c, ns, k, u) in enumerate(rows)], "session_id string, pid long, comm string, timestamp_ns long, stream_seq long, __kind string, ppid long")
    found = process.tracked_lives(df, F.col("comm") == "agent").collect()
    assert {(r["pid"], r["life"]): r["since"] for r in found} == plain_track(rows, "agent")


def plain_timeline(rows):
    """The viewer's tree, built one event at a time; rows: (source, pid, comm, ns, data)."""
    nodes, events = {}, defaultdict(list)
    for seq, (source, pid, comm, ns, data) in enumerate(rows, 1):
        kind = str(data.get("type", "")).lower()
        if source.lower().strip() in ("system", "ssl", "http_parser") or "system" in kind:
            continue
        node = nodes.setdefault(pid, {"comm": comm or "unknown", "ppid": None, "children": []})
        events[pid].append((ns // 1_000_000, seq))
        if source == "process" and data.get("ppid"):
            node["ppid"] = data["ppid"]
    for pid, node in nodes.items():
        if node["ppid"] in nodes and node["ppid"] != pid:
            nodes[node["ppid"]]["children"].append(pid)
    child = {c for n in nodes.values() for c in n["children"]}

    def earliest(pid):
        return min([at for at, _ in events[pid]] + [earliest(c) for c in nodes[pid]["children"]])

    def mixed(own, children):
        items = [(at, "event", seq) for at, seq in own] + [(earliest(c), "process", c) for c in children]
        return [(n, what, at, x) for n, (at, what, x) in enumerate(sorted(items, key=lambda x: x[0]), 1)]

    out = {pid: mixed(events[pid], n["children"]) for pid, n in nodes.items()}
    out[None] = mixed([], [p for p in nodes if p not in child])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_process_timeline_is_the_viewers(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        pid, ns = rng.randrange(1, 15), 1_000_000 * (i // 3 + 1)
        source = rng.choice(["process", "process", "tool_call", "stdio", "system", "ssl", "http_parser", "sse_processor", " System "])
        data = rng.choice([{"event": "EXEC", "ppid": rng.randrange(0, pid)}, {"event": "FILE_OPEN", "filepath": "/x"}, {"type": "x_System_y"}, {"ppid": 0}, {"event": "EXIT", "ppid": 99}])
        rows.append((source, pid, rng.choice(["a", "", "b"]), ns, data))
    got = defaultdict(list)
    for r in viewer.process_timeline(frame(spark, rows, True)).orderBy("place").collect():
        got[r["pid"]].append((r["place"], r["item"], r["at_ms"], r["child"] if r["item"] == "process" else r["stream_seq"]))
    assert dict(got) == {k: v for k, v in plain_timeline(rows).items() if v}


def test_process_timeline_of_circles_and_nothing(spark):
    rows = [("process", 1, "a", 5_000_000, {"event": "EXEC", "ppid": 2}), ("process", 2, "b", 3_000_000, {"event": "EXEC", "ppid": 1}), ("process", 3, "c", 9_000_000, {"event": "EXEC", "ppid": 1}), ("process", 4, "d", 1_000_000, {"event": "EXEC", "ppid": 4}), ("process", None, "e", 1, {})]
    found = viewer.shown_processes(frame(spark, rows, True)).collect()
    assert {r["pid"]: (r["depth"], r["since_ms"]) for r in found} == {1: (None, 3), 2: (None, 3), 3: (None, 9), 4: (0, 1)}
    items = viewer.process_timeline(frame(spark, rows, True)).collect()
    assert [r["child"] for r in items if r["pid"] is None] == [4] and len(items) == 4 + 4
    assert viewer.process_timeline(frame(spark, rows, True).limit(0)).collect() == []


def test_titles(spark):
    cases = [
        ("http_parser", {"message_type": "response", "status_code": 404, "headers": {"host": "h"}}, "UNKNOWN h/ (404)"), ("ssl", {"method": "GET", "host": "a.b", "path": "/x"}, "GET a.b/x"), ("http_parser", {"method": "GET", "status_code": 0, "path": ""}, "GET unknown/"),
        ("http_parser", {"model": "m0", "body": json.dumps({"model": "m1"}), "method": "PUT"}, "PUT m1"), ("http_parser", {"messages": [1], "body": "no json"}, "POST AI Request"), ("sse_processor", {"sse_events": [{"x": 1}, {"parsed_data": {"message": {"model": "m2"}}}]}, "m2"),
        ("sse_processor", {}, "AI Response"), ("process", {"event": "EXEC", "filename": "/bin/ls", "full_command": "ls -l"}, "EXEC: /bin/ls"), ("process", {"event": "EXIT"}, "EXIT event"), ("process", {}, "process event"),
        ("process", {"event": "FILE_RENAME", "oldpath": "/a"}, "FILE_RENAME unknown"), ("file", {"operation": "open", "path": "/p", "filepath": "/f"}, "open /p"), ("x", {"fd": 1}, "file op unknown"), ("tool_call", {"tool_name": "fs.read", "key_field": "/k"}, "fs.read /k"),
        ("tool_call", {"tool_name": "proc.exec", "key_field": "/k"}, "proc.exec: /k"), ("tool_call", {}, "tool_call event"), ("system", {"type": "system_metrics"}, "system event"), ("security", {"alert_type": "x"}, "UNKNOWN unknown/"), ("stdio", {"data": "x"}, "stdio event"),
    ]
    rows = viewer.classified(frame(spark, [(s, 1, "a", i + 1, d) for i, (s, d, _) in enumerate(cases)])).orderBy("timestamp_ns").collect()
    assert [r["title"] for r in rows] == [t for _, _, t in cases]


# --- ranks --------------------------------------------------------------------------------------------------------


def many(spark, seed, n=600):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, rng.randrange(40), 7]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v long, i long").repartition(5)


def test_running_sums_of_hot_keys(spark):
    rows, df = many(spark, 1)
    got = {(r["k"], r["i"]): r["s"] for r in running_sum(df.where("v IS NOT NULL"), ["k"], ["v", "i"], F.col("v"), "s").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        total = 0
        for _, v, i in sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: r[1:]):
            total += v
            want[k, i] = total
    assert got == want
    places = row_numbers(df, ["k"], ["i"], "n").collect()
    for k in {r[0] for r in rows}:
        own = sorted((r["i"], r["n"]) for r in places if r["k"] == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_percentiles_by_ranks(spark):
    rows, df = many(spark, 2)
    got = {r["k"]: (r["p50"], r["p95"], r["p100"]) for r in percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for k in {r[0] for r in rows}:
        own = sorted(v for key, v, _ in rows if key == k and v is not None)
        cuts = quantiles(own, n=100, method="inclusive")
        assert got[k] == (pytest.approx(cuts[49]), pytest.approx(cuts[94]), own[-1])
    one = spark.createDataFrame([("a", 3), ("b", None)], "k string, v long")
    assert [tuple(r) for r in percentiles(one, ["k"], "v", {"m": 0.5}).collect()] == [("a", 3.0)]


def test_depths_of_a_tree_of_any_shape(spark):
    rows = [("s", i, i - 1 if i % 3 else 0) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "session_id string, pid long, ppid long")
    depth = plain_tree({i: p for _, i, p in rows})[0]
    assert {r["pid"]: r["depth"] for r in project.depths(df).collect()} == depth


# --- spans --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_spans_are_those_of_the_fold(spark, seed):
    """Calls in bursts that last long, pauses of any kind, and calls that are over at once, against one call after another."""
    from functools import partial

    from traceloom.operators.fold import fold_sorted
    from traceloom.operators.spans import EXTRACTORS, KEYS, SPAN, Extractor, Span, calls, spans, used

    rng, rows, now = random.Random(seed), [], 0
    for _ in range(400):
        now += rng.choice([0, 1, 40, 90, 100, 101, 130, 200])
        kind = rng.choice(["FILE_OPEN"] * 6 + ["EXEC", "TOUCH"])
        rows.append(("process", rng.choice([1, 1, 1, 2]), rng.choice("ab"), now + 1, {"event": kind, "filepath": rng.choice(["/x", "/x", "/y"]), "filename": "/bin/z", "flags": 0}))
    once = Extractor("process", lambda f: F.when(f("event") == "TOUCH", used(F.lit("fs.read"), f("filepath"), F.lit("t"), at_once=True)))
    df, kinds = frame(spark, rows, seed % 2 == 0), [*EXTRACTORS, once]
    for idle, most in ((100, 300), (250, 1000), (10**15, 777), (10**15, 1 << 62)):
        names = [f.name for f in SPAN.fields]
        got = spans(df, kinds, idle, most).select(*names)
        want = fold_sorted(calls(df, kinds), KEYS, ["timestamp_ns", "stream_seq"], partial(Span, idle_ns=idle, most_ns=most), SPAN).select(*names)
        rows_of = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
        assert rows_of(got) == rows_of(want)


def steps_below(parents):
    """(root, pid) -> least number of steps, by walking down from each root."""
    children = defaultdict(list)
    for n, p in parents.items():
        if p != n:
            children[p].append(n)
    found = {}
    for root in {*parents, *parents.values()}:
        depth, level = 0, [root]
        while level:
            depth, level = depth + 1, [c for n in level for c in children[n] if (root, c) not in found]
            found |= {(root, c): depth for c in level}
    return found


@pytest.mark.parametrize("seed", range(3))
def test_descendants(spark, seed, monkeypatch):
    """Trees, circles and parents that are no nodes; arrays and tasks of a few."""
    monkeypatch.setattr(project, "BLOCK", 4)
    monkeypatch.setattr(project, "PAIRS", 50)
    rng = random.Random(seed)
    parents = {n: rng.randrange(max(n - 4, -2), n) for n in range(1, 60)} | {n: rng.randrange(100, 140) for n in range(100, 130)}
    nodes = spark.createDataFrame([("s", n, p) for n, p in parents.items()], "session_id string, pid bigint, ppid bigint")
    roots = spark.createDataFrame([("s", n) for n in {*parents, *parents.values(), 999}], "session_id string, pid bigint")
    got = {(r["root"], r["pid"]): r["depth"] for r in project.descendants(nodes, roots).collect()}
    assert got == steps_below(parents) and project.descendants(nodes, roots).count() == len(got)


def test_descendants_with_several_parents(spark):
    nodes = spark.createDataFrame([("s", 2, 1), ("s", 3, 2), ("s", 3, 1), ("s", 4, 3)], "session_id string, pid bigint, ppid bigint")
    got = sorted((r["root"], r["pid"], r["depth"]) for r in project.descendants(nodes, nodes.select("session_id", "pid").unionByName(nodes.limit(1).selectExpr("session_id", "1L AS pid"))).collect())
    assert got == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 3, 1), (2, 4, 2), (3, 4, 1)]


def test_descendants_shuffle_no_pairs(spark):
    """A chain of 1500 has 1124250 pairs; before, each was shuffled and written. Every table that is written stays far below."""
    nodes = spark.range(1, 1500).selectExpr("'s' AS session_id", "id AS pid", "id - 1 AS ppid")
    sent = []
    written = project.write_table

    def seen(df, label):
        out = written(df, label)
        sent.append(out.count())
        return out

    project.write_table = seen
    try:
        found = project.descendants(nodes, spark.range(1500).selectExpr("'s' AS session_id", "id AS pid"))
    finally:
        project.write_table = written
    assert found.count() == 1500 * 1499 // 2 and max(sent) <= 1500
    plan = found._jdf.queryExecution().executedPlan().toString()
    made = plan.index("Generate explode(slice")
    assert "Exchange" not in plan[:made] and "BroadcastExchange" not in plan[made:].split("SortMergeJoin")[0]

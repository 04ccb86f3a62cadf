"""What the viewer derives from events: kinds, models, titles, JSON-RPC messages, prompts' differences, counts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions import payload as P
from traceloom.operators.ranks import row_numbers
from traceloom.operators.textual import prompt_diff
from traceloom.operators.trees import climbed, linked
from traceloom.store import write_table


def kind(v: Column, source: str = "source") -> Column:
    """system, stdio, prompt, response, file, process or ssl; the first test that holds decides."""
    name, s = F.coalesce(F.col(source), F.lit("")), F.lower(F.trim(F.coalesce(F.col(source), F.lit(""))))
    text = lambda k: F.coalesce(P.text(v, f"$.{k}"), F.lit(""))
    event, path, message = text("event"), text("path"), text("message_type")
    is_file_event = event.contains("FILE_")
    system = (s == "system") | F.lower(F.coalesce(P.string(v, "$.type"), F.lit(""))).contains("system")
    prompt = P.truthy(v, "$.model", "$.messages", "$.prompt", "$.inputs", "$.query") | ((text("method") == "POST") & (message == "request") & (path.contains("/v1/") | path.contains("/api/")))
    response = P.truthy(v, "$.choices", "$.completion", "$.response", "$.sse_events", "$.delta", "$.content_block") | ((message == "response") & P.truthy(v, "$.model", "$.usage"))
    file = (name == "file") | P.defined(v, "$.fd") | text("operation").isin("open", "read", "write", "close") | is_file_event | P.defined(v, "$.filepath")
    process = ((name == "process") & ~is_file_event) | P.defined(v, "$.exec") | P.defined(v, "$.exit") | event.isin("EXEC", "EXIT") | (P.defined(v, "$.ppid") & ~is_file_event)
    c = F.when(system, "system").when(s == "stdio", "stdio").when(prompt, "prompt").when(response, "response").when(file, "file").when(process, "process")
    c = c.when(F.lower(name).contains("ssl") | (name == "http_parser"), "ssl").when(s == "sse_processor", "response")
    return c.when((s == "tool_call") & text("tool_name").startswith("fs."), "file").when(s == "tool_call", "process").otherwise("ssl")


def model(v: Column) -> Column:
    """The model named in a request's body, in the payload, or in the first started message of a stream that names one."""
    body = F.try_parse_json(P.text(v, "$.body"))
    named = F.transform(F.try_variant_get(v, "$.sse_events", "array<variant>"), lambda x: F.try_variant_get(x, "$.parsed_data.message.model", "string"))
    return F.coalesce(P.text(body, "$.model"), P.text(v, "$.model"), F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0)))


def prompt_title(v: Column) -> Column:
    """`METHOD model`: the model that the body names, else the payload."""
    named = lambda x, path: F.nullif(P.string(x, path), F.lit(""))
    body = F.try_parse_json(P.text(v, "$.body"))
    return F.concat(F.coalesce(named(v, "$.method"), F.lit("POST")), F.lit(" "), F.coalesce(named(body, "$.model"), named(v, "$.model"), F.lit("AI Request")))


def response_title(v: Column) -> Column:
    """The model that the first started message of a stream names, else the payload's."""
    events = F.transform(F.try_variant_get(v, "$.sse_events", "array<variant>"), lambda x: F.try_variant_get(x, "$.parsed_data.message.model", "string"))
    return F.coalesce(F.get(F.filter(events, lambda x: x.isNotNull() & (x != "")), F.lit(0)), F.nullif(P.string(v, "$.model"), F.lit("")), F.lit("AI Response"))


def title(v: Column, source: str = "source") -> Column:
    """The title of an event, by its kind: `METHOD host/path (status)`, `operation path` or `event: file`.

    Prompts and responses are titled by their own rules (prompt_title, response_title), stdio messages by json_rpc.
    """
    filled = lambda *paths: F.coalesce(*(F.nullif(P.string(v, f"$.{p}"), F.lit("")) for p in paths))
    tool, k = F.col(source) == "tool_call", kind(v, source)
    status = F.when(P.truthy(v, "$.status_code"), F.concat(F.lit(" ("), P.string(v, "$.status_code"), F.lit(")"))).otherwise("")
    web = F.concat(F.coalesce(filled("method"), F.lit("UNKNOWN")), F.lit(" "), F.coalesce(filled("host", "headers.host"), F.lit("unknown")), F.coalesce(filled("path"), F.lit("/")), status)
    used = F.coalesce(filled("tool_name", "event_type"), F.lit("tool_call"))
    file = F.concat(F.when(tool, used).otherwise(F.coalesce(filled("operation", "event"), F.lit("file op"))), F.lit(" "), F.coalesce(filled("path", "filepath", "key_field"), F.lit("unknown")))
    what, of = F.when(tool, used).otherwise(F.coalesce(filled("event"), F.lit("process"))), filled("filename", "key_field")
    process = F.when(of.isNotNull(), F.concat(what, F.lit(": "), of)).otherwise(F.concat(what, F.lit(" event")))
    return F.when(k == "file", file).when(k == "process", process).when(k == "prompt", prompt_title(v)).when(k == "response", response_title(v)).when(k == "ssl", web).otherwise(F.concat(F.col(source), F.lit(" event")))


def classified(events: DataFrame) -> DataFrame:
    v = P.parsed()
    return events.select("*", kind(v).alias("event_kind"), model(v).alias("model"), title(v).alias("title"))


def shortened(text: Column, limit: int = 96) -> Column:
    """In one line, and at most `limit` characters."""
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 3), F.lit("..."))).otherwise(clean)


def json_rpc(events: DataFrame) -> DataFrame:
    """stdio events with the kind, method, id, tool, preview, title and summary of the JSON-RPC message that they hold."""
    v = P.parsed()
    raw = F.coalesce(P.text(v, "$.data"), F.lit(""))
    m = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(m).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    filled = lambda path: F.nullif(P.text(m, path), F.lit(""))
    method, id_, tool = filled("$.method"), F.when(~F.is_variant_null(F.try_variant_get(m, "$.id", "variant")), P.string(m, "$.id")), filled("$.params.name")
    k = F.when(~is_object, F.when(F.trim(raw) != "", "text").otherwise("unknown")).when(method.isNotNull() & (F.coalesce(id_, F.lit("")) != ""), "request").when(method.isNotNull(), "notification")
    k = k.when(P.defined(m, "$.result"), "response").when(P.defined(m, "$.error"), "error").otherwise("unknown")
    rows = events.where("source = 'stdio'").withColumns({"rpc_kind": k, "method": F.when(is_object, method), "tool": tool, "rpc_id": F.when(is_object, id_)})
    kind_, asks = F.col("rpc_kind"), F.col("rpc_kind").isin("request", "notification")
    asked = F.when(filled("$.params.arguments.text").isNotNull(), shortened(P.text(m, "$.params.arguments.text"))).when((F.col("method") == "tools/call") & P.text(m, "$.params.name").isNotNull(), P.text(m, "$.params.name"))
    asked = asked.when(F.col("method") == "tools/list", "list tools").when(F.col("method") == "initialize", F.coalesce(filled("$.params.clientInfo.name"), F.lit("initialize")))
    tools = F.try_variant_get(m, "$.result.tools", "array<variant>")
    answered = F.coalesce(shortened(P.text(m, "$.result.content[0].text")), F.concat(F.size(tools).cast("string"), F.lit(" tools")), P.text(m, "$.result.protocolVersion"))
    preview = F.when(asks, asked).when(kind_ == "response", answered).when(kind_ == "error", shortened(P.text(m, "$.error.message"))).when(m.isNull(), shortened(raw))
    rows = rows.withColumn("preview", preview)
    with_id = lambda word: F.when(F.coalesce("rpc_id", F.lit("")) != "", F.concat(F.lit(f"{word} #"), F.col("rpc_id"))).otherwise(f"stdio {word}")
    named = lambda word: F.when(F.col("method").isNotNull(), F.concat(F.lit(f"{word} "), F.col("method"))).otherwise(f"stdio {word}")
    calls = (F.col("method") == "tools/call") & F.col("tool").isNotNull()
    title = F.when((kind_ == "request") & calls, F.concat(F.lit("tools/call "), F.col("tool"))).when(kind_ == "request", named("request")).when(kind_ == "notification", named("notification"))
    title = title.when(kind_ == "response", with_id("response")).when(kind_ == "error", with_id("error")).when(kind_ == "text", "stdio text").otherwise("stdio event")
    role = F.when(P.truthy(v, "$.fd_role"), P.string(v, "$.fd_role")).when(P.defined(v, "$.fd"), F.concat(F.lit("fd "), P.string(v, "$.fd"))).otherwise("stdio")
    head = F.concat(F.coalesce(F.nullif(F.upper(P.string(v, "$.direction")), F.lit("")), F.lit("STDIO")), F.lit(" "), role)
    more = F.when(F.coalesce("preview", F.lit("")) != "", F.concat(F.lit(" · "), F.col("preview"))).otherwise("")
    ask = F.concat(F.lit(" "), F.coalesce("method", F.lit("message")), F.when(calls, F.concat(F.lit(" "), F.col("tool"))).otherwise(""), F.when(F.col("preview").eqNullSafe(F.col("tool")), "").otherwise(more))
    reply = F.concat(F.lit(" "), kind_, F.when(F.coalesce("rpc_id", F.lit("")) != "", F.concat(F.lit(" #"), F.col("rpc_id"))).otherwise(""), more)
    rest = F.when(more != "", more).when(F.trim(raw) != "", F.concat(F.lit(" · "), shortened(raw))).otherwise("")
    return rows.withColumn("title", title).withColumn("summary", F.concat(head, F.when(asks, ask).when(kind_.isin("response", "error"), reply).otherwise(rest)))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def leaves(docs: pd.Series) -> pd.Series:
    """Path -> JSON text of each leaf; empty objects and lists have none."""

    def walk(value, path: str, out: dict) -> None:
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if items is None:
            out[path] = json.dumps(value, ensure_ascii=False)
            return
        for k, x in items:
            walk(x, f"{path}[{k}]" if isinstance(value, list) else f"{path}.{k}" if path else str(k), out)

    def one(text: str | None) -> dict | None:
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return None
        out: dict = {}
        walk(value, "", out)
        return out

    return docs.map(one)


def compare(old: Column, new: Column) -> dict[str, Column]:
    """Leaves added, removed, modified and unchanged, as arrays of paths."""
    a, b = F.map_keys(old), F.map_keys(new)
    both = F.array_intersect(a, b)
    same = lambda k: F.element_at(old, k).eqNullSafe(F.element_at(new, k))
    return {
        "added": F.array_sort(F.array_except(b, a)), "removed": F.array_sort(F.array_except(a, b)), "modified": F.array_sort(F.filter(both, lambda k: ~same(k))), "unchanged": F.array_sort(F.filter(both, same)),
    }


def prompt_changes(prompts: DataFrame, by: list[str], order: list[str], text: str = "data") -> DataFrame:
    """Each prompt with the one before it of its process, and the paths that differ."""
    before = F.lag(text).over(Window.partitionBy(*by).orderBy(*order))
    rows = prompts.withColumn("previous", before).withColumn("__new", leaves(text)).withColumn("__old", leaves("previous"))
    empty = F.create_map().cast("map<string,string>")
    made = compare(F.coalesce("__old", empty), F.coalesce("__new", empty))
    return rows.select(*prompts.columns, "previous", *(c.alias(n) for n, c in made.items()))


def prompt_diffs(prompts: DataFrame, by: list[str], order: list[str], text: str = "data") -> DataFrame:
    """Each prompt but the first of its process with the lines that differ from the one before: payloads whose body, or who
    themselves, hold messages, as blocks of their roles."""
    before = F.lag(text).over(Window.partitionBy(*by).orderBy(*order))
    rows = prompts.withColumn("__before", before).where("__before IS NOT NULL")
    return rows.withColumn("diff", prompt_diff("__before", text)).drop("__before")


def change_summary(c: dict[str, Column] | None = None) -> Column:
    part = lambda n, word: F.when(F.size(n) > 0, F.format_string(f"{word} %d fields.", F.size(n)))
    return F.coalesce(F.nullif(F.concat_ws(" ", part("added", "Added"), part("removed", "Removed"), part("modified", "Modified")), F.lit("")), F.lit("No changes."))


def options(events: DataFrame) -> DataFrame:
    """What there is to choose from, sorted, in one row."""
    sets = {"kinds": "event_kind", "models": "model", "sources": "source", "commands": "comm"}
    return classified(events).agg(*(F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()))


def facets(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(F.col(column).alias("facet")).agg(F.count("*").alias("n"))


def resource_stats(system: DataFrame) -> DataFrame:
    return system.groupBy("pid", "comm").agg(
        F.round(F.avg("cpu_percent"), 6).alias("avg_cpu"), F.max("cpu_percent").alias("max_cpu"), F.round(F.avg(F.col("mem_rss_kb") / 1024.0), 6).alias("avg_rss_mb"), F.max(F.col("mem_rss_kb") / 1024.0).alias("max_rss_mb"),
        F.count_if("sys_alert").alias("alerts"), F.count("*").alias("samples"),
    )


def timeline_groups(events: DataFrame, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    at = F.col("timestamp_unix_ms")
    rows = events if since_ms is None else events.where(at >= since_ms)
    rows = rows if until_ms is None else rows.where(at <= until_ms)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.min(at).alias("first_ms"), F.max(at).alias("last_ms"))


def tree_matches(tree: DataFrame, hits: DataFrame) -> DataFrame:
    """The nodes of a process tree that match or have a match below. tree: (session_id, pid, ppid); hits: (session_id, pid)."""
    hit = hits.select("session_id", "pid").distinct().withColumn("hit", F.lit(1))
    links = linked(tree.select("session_id", "pid", "ppid").join(hit, ["session_id", "pid"], "left"), ["session_id"], keep=("hit",))
    found = climbed(links, ["session_id"], {"hit": "max"}).where("hit = 1").select("session_id", F.col("node").alias("pid"))
    return tree.join(found, ["session_id", "pid"], "left_semi")


def shown_processes(events: DataFrame) -> DataFrame:
    """(session_id, pid, ppid, comm, first, since_ms, depth): a row for each process that a tree of events shows.

    comm is that of its first event; ppid the last that its process events name, and a parent only where it is shown too;
    since_ms the time of the earliest event of the process and all below it. depth is null below a circle of parents.
    events: envelopes with session_id; those of the system, of TLS and of HTTP are not shown.
    """
    return _processes(write_table(_shown(events).drop("title"), "shown"))


def _processes(e: DataFrame) -> DataFrame:
    named = F.max(F.when((F.col("source") == "process") & (F.col("__ppid") != 0), F.struct("timestamp_ns", "stream_seq", "__ppid")))["__ppid"]
    first = F.min(F.struct("timestamp_ns", "stream_seq", "comm"))
    nodes = e.groupBy("session_id", "pid").agg(named.alias("ppid"), first.alias("first"), F.min("at_ms").alias("since_ms"))
    nodes = write_table(nodes.withColumn("comm", F.coalesce(F.nullif(F.col("first.comm"), F.lit("")), F.lit("unknown"))), "processes")
    found = climbed(linked(nodes, ["session_id"], keep=("since_ms",)), ["session_id"], {"since_ms": "min"}).withColumnRenamed("node", "pid")
    return nodes.drop("since_ms").join(found, ["session_id", "pid"]).select("session_id", "pid", "ppid", "comm", F.struct("first.timestamp_ns", "first.stream_seq").alias("first"), "since_ms", "depth")


def _shown(events: DataFrame) -> DataFrame:
    v = P.parsed()
    system = (F.lower(F.trim("source")) == "system") | F.lower(F.trim(F.coalesce(P.string(v, "$.type"), F.lit("")))).contains("system")
    keep = ~F.coalesce(system, F.lit(False)) & ~F.coalesce(F.lower(F.trim("source")).isin("ssl", "http_parser"), F.lit(False)) & F.col("pid").isNotNull()
    at = F.coalesce("timestamp_unix_ms", F.floor(F.col("timestamp_ns") / 1_000_000).cast("bigint"))
    return events.where(keep).select("session_id", "pid", "comm", "source", "timestamp_ns", "stream_seq", at.alias("at_ms"), title(v).alias("title"), P.integer(v, "$.ppid").alias("__ppid"))


def process_timeline(events: DataFrame) -> DataFrame:
    """(session_id, pid, place, item, at_ms, stream_seq, child, title): the timeline of each process, its events and its
    children mixed, a child at the earliest time of all below it; and that of each session, pid null, of the processes at the top.

    At one time events come before children, and both in order of arrival. As many rows as there are events and processes, so
    the tree is put together from them by child. Places are counted by ranges, so a process may hold most events.
    """
    e = write_table(_shown(events), "shown")
    shown = write_table(_processes(e), "processes")
    own = e.select("session_id", "pid", F.lit("event").alias("item"), "at_ms", "timestamp_ns", "stream_seq", F.lit(None).cast("bigint").alias("child"), "title")
    known = shown.select("session_id", F.col("pid").alias("ppid")).withColumn("__known", F.lit(True))
    below = shown.join(known, ["session_id", "ppid"], "left").withColumn("__up", F.when(F.col("__known") & (F.col("ppid") != F.col("pid")), F.col("ppid")))
    child = below.select("session_id", F.col("__up").alias("pid"), F.lit("process").alias("item"), F.col("since_ms").alias("at_ms"), F.col("first.timestamp_ns").alias("timestamp_ns"), F.lit(None).cast("bigint").alias("stream_seq"), F.col("pid").alias("child"), F.col("comm").alias("title"), F.col("first.stream_seq").alias("__seq"))
    items = own.withColumn("__seq", F.col("stream_seq")).unionByName(child)
    order = ["at_ms", "item", "timestamp_ns", "__seq", "child", "title"]
    return row_numbers(items, ["session_id", "pid"], order, "place").select("session_id", "pid", "place", "item", "at_ms", "stream_seq", "child", "title")


def evidence(security: DataFrame) -> DataFrame:
    """Alerts with their evidence as an array; other texts give an empty one."""
    item = "array<struct<source_table:string,event_type:string,pid:bigint,comm:string,timestamp_ns:bigint,detail:string>>"
    return security.withColumn("evidence", F.coalesce(F.from_json("evidence_json", item), F.array().cast(item)))

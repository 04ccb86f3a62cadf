"""Views over the typed tables. Where the known behaviour has a defect, `corrected` gives what was meant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.ranks import percentiles

Tables = dict[str, DataFrame]
#: Short name of each event table, in the order of a timeline.
SOURCES = {"process": "events_process", "tool_call": "events_tool_call", "system": "events_system", "ssl": "events_ssl", "http": "events_http", "sse": "events_sse", "security": "events_security"}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def session_overview(t: Tables, corrected: bool = True) -> DataFrame:
    """Events of each session by source, first and last time. Not corrected: sums count once for each source of
    the session, as counts and times are joined on the session alone."""
    per = _union([t[table].select("session_id", "event_time", F.lit(s).alias("source")) for s, table in SOURCES.items()])
    per = per.groupBy("session_id", "source").agg(F.count("*").alias("cnt"), F.min("event_time").alias("et"), F.max("event_time").alias("lt"))
    fan = F.lit(1) if corrected else F.count("*")
    sums = [(F.sum(F.when(F.col("source") == s, F.col("cnt"))) * fan).alias(f"{s}_events") for s in SOURCES]
    out = per.groupBy("session_id").agg((F.sum("cnt") * fan).alias("total_events"), F.min("et").alias("first_event"), F.max("lt").alias("last_event"), *sums)
    span = F.unix_micros(F.col("last_event").cast("timestamp")) - F.unix_micros(F.col("first_event").cast("timestamp"))
    return out.withColumn("duration_us", span)


def with_quantiles(rows: DataFrame, by: list[str], column: str, *aggregates: Column) -> DataFrame:
    """Aggregates of each group, and p50_ms, p95_ms, p99_ms of a column by ranks: no task holds a group's values."""
    found = percentiles(rows, by, column, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    found = found.select(*(F.col(c).alias(f"__{c}") for c in by), *(F.round(f"p{n}", 6).alias(f"p{n}_ms") for n in (50, 95, 99)))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return rows.groupBy(*by).agg(*aggregates).join(found, on, "left").drop(*(f"__{c}" for c in by))


def tool_call_stats(t: Tables) -> DataFrame:
    ok = F.count_if(F.col("tool_status") == "success")
    return with_quantiles(
        t["events_tool_call"], ["session_id", "tool_name"], "duration_ms", F.count("*").alias("call_count"), ok.alias("success_count"), F.count_if(F.col("tool_status") == "timeout").alias("timeout_count"),
        F.round(ok * F.lit(100.0).cast("double") / F.count("*"), 2).alias("success_rate_pct"), F.sum("tool_bytes").alias("total_bytes"),
    )


def process_lifecycle(t: Tables, corrected: bool = True) -> DataFrame:
    """Each EXEC with its EXIT. Not corrected: with every EXIT of its pid. Corrected: with the first EXIT from it on
    and before the pid's next EXEC, by one window over the pid's events."""
    p = t["events_process"].where(F.col("event_type").isin("EXEC", "EXIT"))
    keep = ["session_id", "pid", "comm", "ppid", "filename", "full_command"]
    if corrected:
        order = Window.partitionBy("session_id", "pid").orderBy("event_time", "id")
        after = {c: F.lead(c).over(order) for c in ("event_type", "event_time", "exit_code", "duration_ms")}
        ended = after["event_type"] == "EXIT"
        rows = p.select(*keep, "event_type", F.col("event_time").alias("exec_time"), F.when(ended, after["event_time"]).alias("exit_time"), F.when(ended, after["exit_code"]).alias("exit_code"), F.when(ended, after["duration_ms"]).alias("duration_ms")).where("event_type = 'EXEC'").drop("event_type")
    else:
        exits = p.where("event_type = 'EXIT'").select("session_id", "pid", F.col("event_time").alias("exit_time"), "exit_code", "duration_ms")
        rows = p.where("event_type = 'EXEC'").select(*keep, F.col("event_time").alias("exec_time")).join(exits, ["session_id", "pid"], "left")
    return rows.withColumn("abnormal_exit", F.coalesce(F.col("exit_code") != 0, F.lit(False)))


def security_alerts(t: Tables) -> DataFrame:
    return t["events_security"].select("id", "session_id", "event_time", "pid", "comm", "alert_type", "risk_level", "description", "source_table", "source_event_id", "evidence_json", "data_json")


def resource_timeseries(t: Tables, width: str = "5 seconds") -> DataFrame:
    by = [F.window("event_time", width).alias("w"), "session_id", "pid", "comm"]
    out = t["events_system"].groupBy(*by).agg(
        F.round(F.avg("cpu_percent"), 6).alias("avg_cpu_percent"), F.max("cpu_percent").alias("max_cpu_percent"), F.round(F.avg("mem_rss_kb"), 6).alias("avg_mem_rss_kb"), F.max("mem_rss_kb").alias("max_mem_rss_kb"),
        F.round(F.avg("mem_vsz_kb"), 6).alias("avg_mem_vsz_kb"), F.round(F.avg("thread_count"), 6).alias("avg_threads"), F.max("thread_count").alias("max_threads"), F.count("*").alias("sample_count"), F.bool_or("sys_alert").alias("has_alert"),
    )
    return out.withColumn("bucket", F.col("w.start").cast("timestamp_ntz")).drop("w")


def network_analysis(t: Tables) -> DataFrame:
    return t["events_process"].where("event_type = 'NET_CONNECT'").groupBy("session_id", "net_ip", "net_port", "net_family").agg(
        F.count("*").alias("connection_count"), F.count_distinct("pid").alias("unique_pids"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.array_sort(F.collect_set("comm")).alias("comms"),
    )


def hot_files(t: Tables) -> DataFrame:
    p = t["events_process"].where(F.col("event_type").isin("FILE_OPEN", "FILE_DELETE") & F.col("filepath").isNotNull())
    p = p.select("session_id", F.col("filepath").alias("file_path"), F.when(F.col("event_type") == "FILE_OPEN", "open").otherwise("delete").alias("op"))
    c = t["events_tool_call"].where(F.col("tool_name").isin("fs.read", "fs.write") & F.col("tool_key_field").isNotNull())
    c = c.select("session_id", F.col("tool_key_field").alias("file_path"), F.when(F.col("tool_name") == "fs.read", "read").otherwise("write").alias("op"))
    return p.unionByName(c).groupBy("session_id", "file_path").agg(F.count("*").alias("access_count"), *(F.count_if(F.col("op") == o).alias(f"{o}_count") for o in ("read", "write", "open", "delete")))


def exfiltration_risk(t: Tables) -> DataFrame:
    rows = t["events_security"].where(F.col("alert_type").isin("sensitive_file_access", "exfiltration_risk"))
    return rows.select("session_id", F.col("event_time").alias("alert_time"), "pid", "comm", "alert_type", "risk_level", "description", "evidence_json")


#: For each source, its timeline columns that are no column of the same name.
TIMELINE = {
    "process": {"event_type": "event_type", "filepath": "filepath", "net_ip": "net_ip", "net_port": "net_port", "full_command": "full_command"},
    "tool_call": {"tool_event_type": "tool_event_type", "tool_name": "tool_name", "tool_status": "tool_status", "filepath": "tool_key_field"},
    "system": {"event_type": "sys_type"},
    "ssl": {},
    "http_parser": {"filepath": "http_path", "full_command": "http_method"},
    "sse_processor": {},
    "security": {"event_type": "alert_type", "tool_status": "risk_level", "filepath": "description"},
}
TIMELINE_TYPES = {"event_type": "string", "tool_event_type": "string", "tool_name": "string", "tool_status": "string", "filepath": "string", "net_ip": "string", "net_port": "int", "full_command": "string"}


def timeline(t: Tables, source: str | None = None) -> DataFrame | None:
    """All tables in one set of columns; only the branch of `source` if it is given, None if that is unknown."""
    names = {"http_parser": "events_http", "sse_processor": "events_sse"}
    parts = []
    for s, columns in TIMELINE.items():
        if source in (None, "", s):
            own = t[names.get(s, f"events_{s}")]
            mapped = [(F.col(columns[c]) if c in columns else F.lit(None)).cast(k).alias(c) for c, k in TIMELINE_TYPES.items()]
            parts.append(own.select("id", "session_id", "event_time", F.lit(s).alias("source"), "pid", "comm", *mapped, "data_json"))
    return _union(parts) if parts else None

"""Queries over an agent's traffic, and over operators that need more than the driver's events; with the same in DuckDB's SQL."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import payload as P
from traceloom.functions import scalar
from traceloom.operators import filters, process, project, security, textual, tooluse, viewer
from traceloom.operators.http import parse_http, remove_auth
from traceloom.operators.spans import spans
from traceloom.operators.sse import merge_sse
from traceloom.plans import api, views
from traceloom.queries import BASE, FIRST, SQL, query
from traceloom.sources import adapter, logs, records, traffic
from traceloom.store import new_path, write_table
from traceloom.streaming import ordered, sink

# --- SQL of the traffic -------------------------------------------------------------------------------------------

TRAFFIC = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, md5(coalesce(text, '')) AS m, (conv_id * 1000 + turn) * 1000000000 AS ns, (conv_id * 1000 + turn) * 1000 + 1 AS ms, make_timestamp(((conv_id * 1000 + turn) * 1000 + 1) * 1000) AS event_time,
         CAST(5000 + conv_id AS BIGINT) AS pid, 'agent' || (conv_id % 3) AS comm, 'v' || (conv_id % 10) AS session_id, (conv_id * 100 + turn) * 4 + 1 AS seq, 'm' || (conv_id % 3) AS model FROM conversations
), ssl AS (
  SELECT *, seq AS own_seq, ns AS own_ns FROM c WHERE role IN ('user', 'assistant')
  UNION ALL SELECT *, seq + 1, ns FROM c WHERE role = 'user'
  UNION ALL SELECT *, seq + 1, ns + 5000000 FROM c WHERE role = 'assistant' AND conv_id % 2 = 1
), request AS (
  SELECT *, 'POST /v1/messages?turn=' || turn || ' HTTP/1.1' AS line, '{"model":"' || model || '","messages":[{"role":"user","content":[{"type":"tool_result","tool_use_id":"t' || conv_id || '_' || (turn - 1) || '","content":"' || m || '"}]}]}' AS body FROM c WHERE role = 'user'
), answer AS (
  SELECT *, '{"model":"' || model || '","content":[{"type":"tool_use","id":"t' || conv_id || '_' || turn || '","name":"Read","input":{"path":"/w/' || turn || '"}}]}' AS body FROM c WHERE role = 'assistant' AND conv_id % 2 = 0
), http AS (
  SELECT seq * 16 + 4 AS id, session_id, event_time, pid, comm, turn, ms, m, 'request' AS http_message_type, 'POST' AS http_method, '/v1/messages?turn=' || turn AS http_path, CAST(NULL AS INTEGER) AS http_status_code,
         CAST(strlen(line) + 4 + (4 + 15 + 4) + (13 + 7 + strlen(m) + 4) + (12 + 16 + 4) + strlen(body) AS BIGINT) AS http_total_size FROM request
  UNION ALL SELECT seq * 16 + 4, session_id, event_time, pid, comm, turn, ms, m, 'response', NULL, NULL, 200, CAST(15 + 4 + (12 + 16 + 4) + (10 + 2 + strlen(m) + 4) + strlen(body) AS BIGINT) FROM answer
), sse AS (
  SELECT session_id, event_time, pid, comm, turn, m, pid || ':' || turn || ':' || (ns // 600000000000) AS sse_connection_id, 5000000 AS sse_duration_ns, 3 AS sse_event_count, CAST(strlen(m) AS BIGINT) AS sse_total_size FROM c WHERE role = 'assistant' AND conv_id % 2 = 1
), opened AS (
  SELECT conv_id, turn, session_id, event_time, pid + 4000 AS pid, comm, seq + 2 AS seq, ns + 500000000 AS ns, '/w/' || turn || '/.env' AS path FROM c WHERE role = 'assistant' AND conv_id % 2 = 0
), cred AS (
  SELECT conv_id, turn, session_id, event_time, pid + 4000 AS pid, comm, seq + 3 AS seq, ns, ms FROM c WHERE role = 'assistant' AND conv_id % 5 = 0
), alert AS (
  SELECT seq * 16 + 6 AS id, session_id, event_time, pid, comm, 'sensitive_file_access' AS alert_type, 'high' AS risk_level, comm || ' accessed sensitive file: ' || path AS description, 'events_process' AS source_table, seq * 16 AS source_event_id FROM opened
  UNION ALL SELECT seq * 16 + 8, session_id, event_time, pid, comm, 'credential_change', 'high', comm || ' triggered credential change', 'events_process', seq * 16 FROM cred
), tooluse AS (
  SELECT a.session_id, 't' || a.conv_id || '_' || a.turn AS tool_use_id, 'Read' AS tool_name, a.pid, a.comm, a.ns AS start_ns, CASE WHEN u.m IS NULL THEN 'timeout' ELSE 'success' END AS status, CASE WHEN u.m IS NULL THEN 30000 ELSE 1000 END AS duration_ms, u.m AS result_summary,
         (SELECT count(*) FROM opened o WHERE o.session_id = a.session_id AND o.ns BETWEEN a.ns AND a.ns + CASE WHEN u.m IS NULL THEN 30000000000 ELSE 1000000000 END) AS activities
  FROM answer a LEFT JOIN c u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user'
)
"""

ALERT = "id, session_id, event_time, pid, comm, alert_type, risk_level, description, source_table, source_event_id"


@query(TRAFFIC + "SELECT own_seq * 16 + 3 AS id, session_id, event_time, pid, comm, CASE role WHEN 'user' THEN 'WRITE/SEND' ELSE 'READ/RECV' END AS ssl_function, CAST(32 + turn AS BIGINT) AS ssl_len, CAST(turn AS BIGINT) AS ssl_tid FROM ssl")
def ssl_table(spark, sf):
    return project.typed(traffic.envelopes(spark, sf), "events_ssl").select("id", "session_id", "event_time", "pid", "comm", "ssl_function", "ssl_len", "ssl_tid")


@query(TRAFFIC + "SELECT id, session_id, event_time, pid, comm, http_message_type, http_method, http_path, http_status_code, http_total_size, CAST(0 AS BIGINT) + turn AS http_tid FROM http")
def http_table(spark, sf):
    rows = project.typed(parse_http(traffic.envelopes(spark, sf)), "events_http")
    return rows.drop("timestamp_ns", "timestamp_unix_ms", "data_json")


@query(TRAFFIC + "SELECT session_id, event_time, pid, comm, sse_connection_id, sse_duration_ns, sse_event_count, sse_total_size, m AS text_content, 'xt' || (pid - 5000) || '_' || turn AS message_id FROM sse")
def sse_table(spark, sf):
    """Each message's two chunks put together."""
    rows = project.typed(merge_sse(traffic.envelopes(spark, sf)), "events_sse")
    found = [F.get_json_object("data_json", f"$.{k}").alias(k) for k in ("text_content", "message_id")]
    return rows.select("session_id", "event_time", "pid", "comm", "sse_connection_id", "sse_duration_ns", "sse_event_count", "sse_total_size", *found)


@query(TRAFFIC + "SELECT own_seq AS seq, session_id FROM ssl WHERE role = 'user' OR conv_id % 2 = 0")
def sse_passes(spark, sf):
    """TLS events that hold no server-sent event pass as they are."""
    return merge_sse(traffic.envelopes(spark, sf)).where("source = 'ssl'").select(F.col("stream_seq").alias("seq"), "session_id")


@query(TRAFFIC + "SELECT session_id, tool_use_id, tool_name, pid, comm, start_ns, status, CAST(duration_ms AS BIGINT) AS duration_ms, result_summary, activities FROM tooluse")
def tool_uses(spark, sf):
    found = tooluse.tool_uses(parse_http(traffic.envelopes(spark, sf)))
    return found.select("session_id", "tool_use_id", "tool_name", "pid", "comm", "start_ns", "status", "duration_ms", "result_summary", F.coalesce(F.size("os_activities"), F.lit(0)).cast("long").alias("activities"))


@query(TRAFFIC + "SELECT session_id, pid, comm, 'tool_call_complete' AS tool_event_type, tool_name, status AS tool_status, CAST(duration_ms AS BIGINT) AS duration_ms FROM tooluse")
def tool_call_table(spark, sf):
    """Tool uses as rows of the tool-call table."""
    rows = project.typed(tooluse.correlate(parse_http(traffic.envelopes(spark, sf))), "events_tool_call")
    return rows.select("session_id", "pid", "comm", "tool_event_type", "tool_name", "tool_status", "duration_ms")


PER = """, per AS (
  SELECT session_id, 'tool_call' AS source, count(*) AS cnt, min(make_timestamp(start_ns // 1000)) AS et, max(make_timestamp(start_ns // 1000)) AS lt FROM tooluse GROUP BY 1
  UNION ALL SELECT session_id, 'process', count(*), min(event_time), max(event_time) FROM (SELECT session_id, event_time FROM opened UNION ALL SELECT session_id, event_time FROM cred) GROUP BY 1
  UNION ALL SELECT session_id, 'ssl', count(*), min(event_time), max(event_time) FROM c WHERE role = 'user' GROUP BY 1
  UNION ALL SELECT session_id, 'http', count(*), min(event_time), max(event_time) FROM http GROUP BY 1
  UNION ALL SELECT session_id, 'sse', count(*), min(event_time), max(event_time) FROM sse GROUP BY 1
  UNION ALL SELECT session_id, 'security', count(*), min(event_time), max(event_time) FROM alert GROUP BY 1
)"""


@query(TRAFFIC + PER + "SELECT session_id, CAST(sum(cnt) AS BIGINT) AS total_events, min(et) AS first_event, max(lt) AS last_event, epoch_us(max(lt)) - epoch_us(min(et)) AS duration_us," + ", ".join(f"CAST(sum(cnt) FILTER (WHERE source = '{s}') AS BIGINT) AS {s}_events" for s in ("process", "tool_call", "system", "ssl", "http", "sse", "security")) + " FROM per GROUP BY 1")
def traffic_overview(spark, sf):
    return views.session_overview(traffic.tables(spark, sf))


@query(TRAFFIC + """SELECT session_id, event_time, 'http_parser' AS source, pid, comm, CAST(NULL AS VARCHAR) AS event_type, http_path AS filepath, http_method AS full_command, CAST(NULL AS VARCHAR) AS tool_status FROM http
  UNION ALL SELECT session_id, event_time, 'sse_processor', pid, comm, NULL, NULL, NULL, NULL FROM sse UNION ALL SELECT session_id, event_time, 'ssl', pid, comm, NULL, NULL, NULL, NULL FROM c WHERE role = 'user'
  UNION ALL SELECT session_id, event_time, 'process', pid, comm, 'FILE_OPEN', path, NULL, NULL FROM opened UNION ALL SELECT session_id, event_time, 'process', pid, comm, 'CRED_CHANGE', NULL, NULL, NULL FROM cred
  UNION ALL SELECT session_id, make_timestamp(start_ns // 1000), 'tool_call', pid, comm, NULL, NULL, NULL, status FROM tooluse UNION ALL SELECT session_id, event_time, 'security', pid, comm, alert_type, description, NULL, risk_level FROM alert""")
def traffic_timeline(spark, sf):
    return views.timeline(traffic.tables(spark, sf)).select("session_id", "event_time", "source", "pid", "comm", "event_type", "filepath", "full_command", "tool_status")


@query(TRAFFIC + f"SELECT {ALERT} FROM alert WHERE alert_type = 'sensitive_file_access'")
def sensitive_file_access(spark, sf):
    found = security.alerts(traffic.envelopes(spark, sf))
    return project.typed(found, "events_security").where("alert_type = 'sensitive_file_access'").select(*ALERT.split(", "))


@query(TRAFFIC + f"SELECT {ALERT} FROM alert WHERE alert_type = 'credential_change'")
def credential_change(spark, sf):
    chosen = [r for r in security.rules() if r.name == "credential_change"]
    rows = project.typed(security.alerts(traffic.envelopes(spark, sf), chosen), "events_security")
    return rows.select(*ALERT.split(", "))


@query(TRAFFIC + "SELECT session_id, event_time AS alert_time, pid, comm, alert_type, risk_level, description FROM alert WHERE alert_type = 'sensitive_file_access' AND session_id = 'v4'")
def sensitive_access(spark, sf):
    """The endpoint, for one session; evidence as an array in another query."""
    t = {"events_security": project.typed(security.alerts(traffic.envelopes(spark, sf)), "events_security")}
    return api.sensitive_access(t, "v4").drop("evidence_json")


@query(TRAFFIC + "SELECT o.seq * 16 + 6 AS id, 'FILE_OPEN' AS event_type, o.pid AS of_pid, o.path AS detail, o.ns AS at_ns FROM opened o UNION ALL SELECT seq * 16 + 8, 'CRED_CHANGE', pid, NULL, ns FROM cred")
def alert_evidence(spark, sf):
    rows = viewer.evidence(project.typed(security.alerts(traffic.envelopes(spark, sf)), "events_security"))
    return rows.select("id", F.explode("evidence").alias("e")).select("id", "e.event_type", F.col("e.pid").alias("of_pid"), "e.detail", F.col("e.timestamp_ns").alias("at_ns"))


@query(TRAFFIC + "SELECT seq AS seq FROM c WHERE role = 'assistant' AND conv_id % 2 = 0 UNION ALL SELECT seq + 0 FROM c WHERE FALSE")
def tool_use_blocks(spark, sf):
    """The responses that hold a tool use."""
    found = tooluse.uses(parse_http(traffic.envelopes(spark, sf)))
    at = F.split(F.substring("tool_use_id", 2, 40), "_")
    return found.select(((at[0].cast("long") * 100 + at[1].cast("long")) * 4 + 1).alias("seq"))


@query(TRAFFIC + "SELECT ms, turn, CASE http_message_type WHEN 'request' THEN 'content-type,host' ELSE 'content-type' END AS kept, FALSE AS left_in, TRUE AS has_body FROM http")
def auth_removed(spark, sf):
    """Headers without secrets; the secret, the turn's digest, is nowhere but in the body."""
    rows = remove_auth(parse_http(traffic.envelopes(spark, sf))).where("source = 'http_parser'")
    headers = F.get_json_object("data", "$.headers")
    names = F.array_join(F.array_sort(F.map_keys(F.from_json(headers, "map<string,string>"))), ",")
    secret = headers.contains("Bearer") | headers.contains("s=")
    return rows.select(F.col("timestamp_unix_ms").alias("ms"), F.get_json_object("data", "$.tid").cast("bigint").alias("turn"), names.alias("kept"), secret.alias("left_in"), F.get_json_object("data", "$.body").isNotNull().alias("has_body"))


@query(TRAFFIC + "SELECT seq, m, '{\"n\":1.5,\"q\":\"a&b\"}' AS rest FROM c")
def auth_of_any_spelling(spark, sf):
    """Payloads of another writer: spaces, escapes, numbers, headers in capitals."""
    c = traffic.envelopes(spark, sf).where("stream_seq % 4 = 1").withColumn("m", F.md5("data"))
    own = spark.read.parquet(f"{sf}/conversations.parquet").select(((F.col("conv_id") * 100 + F.col("turn")) * 4 + 1).alias("stream_seq"), F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    text = F.concat(F.lit('{ "n" : 1.5, "q": "a\\u0026b", "headers" : { "Host": "'), F.col("m"), F.lit('", "AUTHORIZATION" : "Bearer x\\u0026y", "Set-Cookie": "1.0" } }'))
    e = c.drop("m").join(own, "stream_seq").withColumn("source", F.lit("http_parser")).withColumn("data", text)
    out = remove_auth(e.select(*c.drop("m").columns))
    safe = ~F.col("data").contains("Bearer") & ~F.col("data").contains("1.0")
    rest = F.to_json(F.struct(F.get_json_object("data", "$.n").cast("double").alias("n"), F.get_json_object("data", "$.q").alias("q")))
    return out.select(F.col("stream_seq").alias("seq"), F.when(safe, F.get_json_object("data", "$.headers.Host")).alias("m"), rest.alias("rest"))


# --- viewer -------------------------------------------------------------------------------------------------------


@query(TRAFFIC + """, r AS (SELECT *, conv_id % 5 AS k FROM c WHERE role = 'system')
  SELECT seq, ['request', 'notification', 'response', 'error', 'text'][k + 1] AS rpc_kind, CASE k WHEN 0 THEN 'tools/call' WHEN 1 THEN 'initialized' END AS method, CASE WHEN k = 0 THEN 'Read' END AS tool, CASE WHEN k IN (0, 2, 3) THEN CAST(conv_id AS VARCHAR) END AS rpc_id,
  CASE k WHEN 0 THEN m WHEN 2 THEN repeat(m, 2) || left(m, 29) || '...' WHEN 3 THEN m WHEN 4 THEN 'log line ' || m END AS preview,
  CASE k WHEN 0 THEN 'tools/call Read' WHEN 1 THEN 'notification initialized' WHEN 2 THEN 'response #' || conv_id WHEN 3 THEN 'error #' || conv_id ELSE 'stdio text' END AS title,
  'WRITE stdout' || CASE k WHEN 0 THEN ' tools/call Read · ' || m WHEN 1 THEN ' initialized' WHEN 2 THEN ' response #' || conv_id || ' · ' || repeat(m, 2) || left(m, 29) || '...' WHEN 3 THEN ' error #' || conv_id || ' · ' || m ELSE ' · log line ' || m END AS summary FROM r""")
def json_rpc(spark, sf):
    rows = viewer.json_rpc(traffic.envelopes(spark, sf))
    return rows.select(F.col("stream_seq").alias("seq"), "rpc_kind", "method", "tool", "rpc_id", "preview", "title", "summary")


@query(TRAFFIC + """SELECT source, event_kind, count(*) AS n FROM (
  SELECT 'ssl' AS source, 'ssl' AS event_kind FROM c WHERE role = 'user' UNION ALL SELECT 'http_parser', 'prompt' FROM request UNION ALL SELECT 'http_parser', 'ssl' FROM answer UNION ALL SELECT 'sse_processor', 'response' FROM sse
  UNION ALL SELECT 'process', 'file' FROM opened UNION ALL SELECT 'process', 'process' FROM cred UNION ALL SELECT 'stdio', 'stdio' FROM c WHERE role = 'system' UNION ALL SELECT 'tool_call', 'process' FROM tooluse UNION ALL SELECT 'security', 'ssl' FROM alert) GROUP BY 1, 2""")
def viewer_kinds(spark, sf):
    return viewer.classified(traffic.traced(spark, sf)).groupBy("source", "event_kind").agg(F.count("*").alias("n"))


@query(TRAFFIC + "SELECT source, model, count(*) AS n FROM (SELECT 'http_parser' AS source, model FROM request UNION ALL SELECT 'http_parser', model FROM answer UNION ALL SELECT 'sse_processor', model FROM c WHERE role = 'assistant' AND conv_id % 2 = 1) GROUP BY 1, 2")
def viewer_models(spark, sf):
    rows = viewer.classified(traffic.traced(spark, sf)).where("model IS NOT NULL")
    return rows.groupBy("source", "model").agg(F.count("*").alias("n"))


@query(TRAFFIC + """SELECT seq, 'http_parser' AS source, 'POST ' || model AS title FROM request UNION ALL SELECT seq, 'http_parser', 'UNKNOWN unknown/ (200)' FROM answer UNION ALL SELECT seq, 'process', 'FILE_OPEN ' || path FROM opened
  UNION ALL SELECT seq, 'process', 'CRED_CHANGE event' FROM cred UNION ALL SELECT seq, 'stdio', 'stdio event' FROM c WHERE role = 'system' UNION ALL SELECT NULL, 'sse_processor', model FROM c WHERE role = 'assistant' AND conv_id % 2 = 1
  UNION ALL SELECT seq + 1, 'ssl', 'UNKNOWN unknown/' FROM c WHERE role = 'user'""")
def viewer_titles(spark, sf):
    """The titles of parsed traffic: prompts and responses by their model, other events by what they hold."""
    rows = viewer.classified(parse_http(merge_sse(traffic.envelopes(spark, sf))))
    return rows.select(F.col("stream_seq").alias("seq"), "source", "title")


@query(BASE + """SELECT event_id AS seq, CASE WHEN kind = 'click' THEN CASE WHEN k % 4 < 2 THEN ['fs.read', 'fs.write'][k % 4 + 1] || ' /data/f' || (k % 20) ELSE ['proc.exec', 'net.http'][k % 4 - 1] || ': /data/f' || (k % 20) END
  WHEN kind = 'view' THEN CASE WHEN k % 10 = 0 THEN 'FILE_DELETE' ELSE 'FILE_OPEN' END || ' /data/f' || (k % 20) WHEN kind = 'purchase' THEN 'NET_CONNECT event' WHEN kind = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'EXEC: /usr/bin/tool' ELSE 'EXIT event' END ELSE 'system event' END AS title FROM e""")
def viewer_event_titles(spark, sf):
    """The titles of tool calls, file, process and system events."""
    return viewer.classified(adapter.envelopes(spark, sf)).select(F.col("stream_seq").alias("seq"), "title")


#: The shown processes of the events: the parent of each by its last EXEC, and the earliest time of all below it.
SHOWN = """, shown AS (SELECT event_id, session_id, pid, timestamp_ns, epoch_ms(event_time) AS ms, kind, comm, CASE WHEN kind = 'signup' AND event_id % 2 = 0 THEN pid - (k % 3 + 1) * 10 END AS ppid FROM e WHERE kind <> 'error'),
  nodes AS (SELECT session_id, pid, arg_max(ppid, (timestamp_ns, event_id)) FILTER (WHERE ppid IS NOT NULL) AS ppid, arg_min(comm, (timestamp_ns, event_id)) AS comm, min((timestamp_ns, event_id)) AS first, min(ms) AS own_ms FROM shown GROUP BY 1, 2),
  up AS (SELECT n.* REPLACE (p.pid AS ppid) FROM nodes n LEFT JOIN nodes p ON p.session_id = n.session_id AND p.pid = n.ppid AND p.pid <> n.pid),
  below AS (SELECT session_id, pid AS root, pid, own_ms FROM up UNION ALL SELECT b.session_id, b.root, u.pid, u.own_ms FROM below b JOIN up u ON u.session_id = b.session_id AND u.ppid = b.pid),
  since AS (SELECT session_id, root AS pid, min(own_ms) AS since_ms FROM below GROUP BY 1, 2) """


@query(BASE.replace("WITH e AS", "WITH RECURSIVE e AS") + SHOWN + """, items AS (SELECT session_id, pid, 0 AS later, ms AS at_ms, timestamp_ns AS ns, event_id AS seq, event_id AS stream_seq, CAST(NULL AS BIGINT) AS child FROM shown
    UNION ALL SELECT u.session_id, u.ppid, 1, s.since_ms, first[1], first[2], NULL, u.pid FROM up u JOIN since s ON s.session_id = u.session_id AND s.pid = u.pid)
  SELECT session_id, pid, row_number() OVER (PARTITION BY session_id, pid ORDER BY at_ms, later, ns, seq) AS place, CASE later WHEN 0 THEN 'event' ELSE 'process' END AS item, at_ms, stream_seq, child FROM items""")
def process_timeline(spark, sf):
    """The process tree with the mixed timeline of each process, and the processes at the top (pid null)."""
    return viewer.process_timeline(adapter.envelopes(spark, sf)).drop("title")


@query(BASE.replace("WITH e AS", "WITH RECURSIVE e AS") + SHOWN + """, deep AS (SELECT session_id, pid, 0 AS depth FROM up WHERE ppid IS NULL UNION ALL SELECT d.session_id, u.pid, d.depth + 1 FROM deep d JOIN up u ON u.session_id = d.session_id AND u.ppid = d.pid)
  SELECT n.session_id, n.pid, n.ppid, n.comm, s.since_ms, d.depth FROM nodes n JOIN since s USING (session_id, pid) JOIN deep d USING (session_id, pid)""")
def shown_processes(spark, sf):
    """The processes of the viewer's tree: parent, name, depth, and the earliest time of all below each."""
    return viewer.shown_processes(adapter.envelopes(spark, sf)).drop("first")


PROMPTS = """WITH p AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS m, turn % 4 = 0 AS extra FROM conversations WHERE role = 'user'), q AS (SELECT *, lag(turn) OVER w AS before, lag(m) OVER w AS m0, lag(extra) OVER w AS extra0 FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, before IS NULL AS is_first, before IS NOT NULL AND m = m0 AS same FROM q) """


@query(PROMPTS + """, s AS (SELECT conv_id, turn, CASE WHEN is_first THEN CASE WHEN extra THEN ['a.b', 'a.c[0]', 'k', 'x'] ELSE ['a.b', 'a.c[0]', 'k'] END WHEN extra AND NOT extra0 THEN ['x'] ELSE [] END AS added, CASE WHEN NOT is_first AND extra0 AND NOT extra THEN ['x'] ELSE [] END AS removed,
  CASE WHEN is_first THEN [] WHEN same THEN ['a.b'] ELSE ['a.b', 'a.c[0]'] END AS modified, CASE WHEN is_first THEN [] ELSE list_sort(list_concat(['k'], list_concat(CASE WHEN same THEN ['a.c[0]'] ELSE [] END, CASE WHEN extra AND extra0 THEN ['x'] ELSE [] END))) END AS unchanged FROM r)
  SELECT conv_id, turn, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed, array_to_string(modified, ',') AS modified, array_to_string(unchanged, ',') AS unchanged,
  coalesce(nullif(trim(concat_ws(' ', CASE WHEN len(added) > 0 THEN 'Added ' || len(added) || ' fields.' END, CASE WHEN len(removed) > 0 THEN 'Removed ' || len(removed) || ' fields.' END, CASE WHEN len(modified) > 0 THEN 'Modified ' || len(modified) || ' fields.' END)), ''), 'No changes.') AS said FROM s""")
def prompt_changes(spark, sf):
    """Each user's turn with the one before it: leaves added, removed, modified and unchanged."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    data = F.to_json(F.struct(F.struct(F.col("turn").alias("b"), F.array(F.md5(F.coalesce("text", F.lit("")))).alias("c")).alias("a"), F.lit("same").alias("k"), F.when(F.col("turn") % 4 == 0, 1).alias("x")))
    found = viewer.prompt_changes(c.select("conv_id", "turn", data.alias("data")), ["conv_id"], ["turn"]).withColumn("said", viewer.change_summary())
    return found.select("conv_id", "turn", *(F.array_join(x, ",").alias(x) for x in ("added", "removed", "modified", "unchanged")), "said")


@query("""SELECT conv_id, turn, lag(md5(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user'""")
def prompt_lag(spark, sf):
    """The prompt before each of its process."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", F.to_json(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("m"))).alias("data"))
    return viewer.prompt_changes(c, ["conv_id"], ["turn"]).select("conv_id", "turn", F.get_json_object("previous", "$.m").alias("previous"))


@query("""WITH c AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS m FROM conversations) SELECT conv_id, turn, 0 AS at, '{"t":' || turn || ',"s":"}{"}' AS part FROM c UNION ALL SELECT conv_id, turn, 1, '{"m":"\\q' || m || '",}' FROM c UNION ALL SELECT conv_id, turn, 2, '{"z":{}}' FROM c WHERE turn % 2 = 0
  UNION ALL SELECT conv_id, turn, 2, '{}' FROM c WHERE turn % 2 = 1""")
def json_parts(spark, sf):
    """Objects that stand one after another in a text with other things between, unsound ones too; a closing brace too many
    (odd turns) makes the next object's inner one the first at depth 0."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    text = F.concat(F.lit('x {"t":'), F.col("turn").cast("string"), F.lit(',"s":"}{"} [1] {"m":"\\q'), F.md5(F.coalesce("text", F.lit(""))), F.lit('",}'), F.when(F.col("turn") % 2 == 1, " } ").otherwise(" "), F.lit('{"z":{}} y'))
    return c.select("conv_id", "turn", F.posexplode(textual.json_chunks(text)).alias("at", "part"))


@query("""WITH c AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS m FROM conversations) SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[/f/' || turn || ']' || chr(10) || repeat('─', 5 + length(CAST(turn AS VARCHAR))) || chr(10) || m WHEN 1 THEN '=== PART 1 ===' || chr(10) || m || chr(10) || chr(10) || '=== PART 2 ===' || chr(10) || '[/g]' || chr(10) || '────' || chr(10) || 'a' || chr(10) || m
  WHEN 2 THEN '{' || chr(10) || '  "n": ' || turn || ',' || chr(10) || '  "m": "' || m || '"' || chr(10) || '}' ELSE 'no json ' || m END AS content FROM c""")
def json_contents(spark, sf):
    """What is read of JSON that is sound, comes in parts, is damaged, or is none."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("m", F.md5(F.coalesce("text", F.lit(""))))
    turn, m = F.col("turn").cast("string"), F.col("m")
    sound = F.concat(F.lit('{"file_path":"/f/'), turn, F.lit('","content":" '), m, F.lit(' "}'))
    parts = F.concat(F.lit('{"content":"'), m, F.lit('"}{"content":"a\\n'), m, F.lit('","file_path":"\\/g","x":"\\q"}'))
    plain = F.concat(F.lit('{"n":'), turn, F.lit('.0,"m":"'), m, F.lit('"}'))
    kind = F.col("turn") % 4
    return c.select("conv_id", "turn", textual.json_content(F.when(kind == 0, sound).when(kind == 1, parts).when(kind == 2, plain).otherwise(F.concat(F.lit("no json "), m))).alias("content"))


@query("""WITH c AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS m, lag(md5(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS m0, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS t0 FROM conversations WHERE role = 'user')
  SELECT conv_id, turn, array_to_string(['  [0] SYSTEM:', '  be brief', '  ---', '  be brief', '  ---', '  [1] USER:', '- ' || m0, '+ ' || m, ''], chr(10)) AS diff FROM c WHERE t0 IS NOT NULL AND m <> m0""")
def prompt_diffs(spark, sf):
    """Each user's turn as a prompt of two messages, against the one before, where they differ."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    said = F.concat(F.lit('{"messages":[{"role":"system","content":"be brief"},{"role":"user","content":[{"type":"text","text":"'), F.md5(F.coalesce("text", F.lit(""))), F.lit('"},{"type":"image"}]}]}'))
    found = viewer.prompt_diffs(c.select("conv_id", "turn", F.to_json(F.struct(said.alias("body"))).alias("data")), ["conv_id"], ["turn"])
    return found.where(F.col("diff").contains("- ")).select("conv_id", "turn", "diff")


@query(TRAFFIC + """, k AS (SELECT 'ssl' AS source, ms FROM c WHERE role = 'user' UNION ALL SELECT 'http_parser', ms FROM http UNION ALL SELECT 'stdio', ms FROM c WHERE role = 'system')
  SELECT source, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM k WHERE ms BETWEEN 2000 AND 60000 GROUP BY 1""")
def timeline_groups(spark, sf):
    rows = parse_http(merge_sse(traffic.envelopes(spark, sf))).where("source IN ('ssl', 'http_parser', 'stdio')")
    return viewer.timeline_groups(rows, 2000, 60_000)


@query(TRAFFIC + "SELECT 'file,process,prompt,response,ssl,stdio' AS kinds, (SELECT string_agg(x, ',') FROM (SELECT DISTINCT model AS x FROM c WHERE role <> 'system' ORDER BY 1)) AS models, 'http_parser,process,sse_processor,ssl,stdio' AS sources, (SELECT string_agg(x, ',') FROM (SELECT DISTINCT comm AS x FROM c ORDER BY 1)) AS commands")
def viewer_options(spark, sf):
    rows = viewer.options(parse_http(merge_sse(traffic.envelopes(spark, sf))))
    return rows.select(*(F.array_join(x, ",").alias(x) for x in ("kinds", "models", "sources", "commands")))


@query(TRAFFIC + "SELECT seq FROM request WHERE comm = 'agent1' AND model = 'm1' AND ms BETWEEN 3000 AND 90000000 AND contains(lower(body), 'a')")
def tree_filtered(spark, sf):
    rows = viewer.classified(parse_http(traffic.envelopes(spark, sf)))
    return filters.tree_filter(rows, ["prompt"], ["http_parser"], ["agent1"], ["m1"], 3000, 90_000_000, "A").select(F.col("stream_seq").alias("seq"))


@query(BASE.replace("WITH e AS", "WITH RECURSIVE e AS") + FIRST + """, walk AS (SELECT session_id, pid AS root, pid FROM firsts UNION SELECT w.session_id, w.root, n.pid FROM walk w JOIN firsts n ON n.session_id = w.session_id AND n.ppid = w.pid AND n.pid <> w.pid)
  SELECT DISTINCT w.session_id, w.root AS pid FROM walk w JOIN firsts f ON f.session_id = w.session_id AND f.pid = w.pid WHERE f.pid % 5 = 2""")
def tree_matches(spark, sf):
    """Processes that match (a pid that leaves 2 when divided by 5), or have one below them."""
    nodes = project.process_tree(adapter.table(spark, sf, "events_process")).select("session_id", "pid", "ppid")
    return viewer.tree_matches(nodes, nodes.where("pid % 5 = 2")).select("session_id", "pid")


# --- processes ----------------------------------------------------------------------------------------------------

EVENTS = BASE.replace("WITH e AS", "WITH RECURSIVE e AS") + """, ev AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'EXIT' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, pid ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM proc)"""


@query(EVENTS + """, edge AS (SELECT x.session_id, x.pid, x.life, x.timestamp_ns AS ts, x.ppid, (SELECT count(*) FROM proc p WHERE p.session_id = x.session_id AND p.pid = x.ppid AND p.event_type = 'EXIT' AND (p.timestamp_ns, p.event_id) < (x.timestamp_ns, x.event_id)) AS plife FROM ev x WHERE x.event_type = 'EXEC'),
  r AS (SELECT session_id, pid, life, min(timestamp_ns) AS since FROM ev WHERE comm = 'c1' GROUP BY 1, 2, 3 UNION SELECT g.session_id, g.pid, g.life, g.ts FROM r JOIN edge g ON g.session_id = r.session_id AND g.ppid = r.pid AND g.plife = r.life AND r.since <= g.ts AND (g.pid <> g.ppid OR g.life <> g.plife)),
  t AS (SELECT session_id, pid, life, min(since) AS since FROM r GROUP BY 1, 2, 3)
  SELECT ev.event_id AS seq FROM ev JOIN t ON t.session_id = ev.session_id AND t.pid = ev.pid AND t.life = ev.life WHERE ev.timestamp_ns >= t.since""")
def track(spark, sf):
    """What processes of one name do, and those that they start, until each one's EXIT."""
    rows = adapter.envelopes(spark, sf).where("source = 'process'")
    return process.track(rows, comms=["c1"]).select(F.col("stream_seq").alias("seq"))


@query(BASE.replace("WITH e AS", "WITH RECURSIVE e AS") + FIRST + """, walk AS (SELECT session_id, pid AS root, pid FROM firsts UNION SELECT w.session_id, w.root, n.pid FROM walk w JOIN firsts n ON n.session_id = w.session_id AND n.ppid = w.pid AND n.pid <> w.pid)
  SELECT w.session_id, w.root AS pid, CAST(sum(s.mem_rss_kb) AS BIGINT) AS mem_rss_kb, count(*) AS processes FROM walk w JOIN (SELECT session_id, pid, max(mem_rss_kb) AS mem_rss_kb FROM sys GROUP BY 1, 2) s ON s.session_id = w.session_id AND s.pid = w.pid GROUP BY 1, 2""")
def memory_with_children(spark, sf):
    nodes = project.process_tree(adapter.table(spark, sf, "events_process")).select("session_id", "pid", "ppid")
    samples = adapter.table(spark, sf, "events_system").groupBy("session_id", "pid").agg(F.max("mem_rss_kb").alias("mem_rss_kb"))
    return process.with_children(samples, nodes)


@query(BASE + """, o AS (SELECT p.session_id, p.pid, p.filepath, p.timestamp_ns, (SELECT count(*) FROM proc x WHERE x.session_id = p.session_id AND x.pid = p.pid AND x.event_type = 'EXIT' AND x.timestamp_ns < p.timestamp_ns) AS life,
    (SELECT min(x.timestamp_ns) FROM proc x WHERE x.session_id = p.session_id AND x.pid = p.pid AND x.event_type = 'EXIT' AND x.timestamp_ns >= p.timestamp_ns) AS ends FROM proc p WHERE p.event_type = 'FILE_OPEN'),
  n AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w <= 7200000000000 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY session_id, pid, filepath, life ORDER BY timestamp_ns)), r AS (SELECT *, sum(new) OVER (PARTITION BY session_id, pid, filepath, life ORDER BY timestamp_ns ROWS UNBOUNDED PRECEDING) AS run FROM n)
  SELECT session_id, pid, filepath, min(timestamp_ns) AS first_seen, max(timestamp_ns) AS last_seen, count(*) AS count, CASE WHEN min(ends) - max(timestamp_ns) <= 7200000000000 THEN 'process_exit' ELSE 'window_expired' END AS reason FROM r GROUP BY session_id, pid, filepath, life, run""")
def process_opens(spark, sf):
    rows = adapter.table(spark, sf, "events_process")
    return process.opens_by_process(rows.where("event_type = 'FILE_OPEN'"), rows.where("event_type = 'EXIT'"), ["session_id", "pid"], gap=7_200_000_000_000)


@query(BASE + """, h AS (SELECT pid, timestamp_ns // 86400000000000 AS day, count(*) AS n, max(timestamp_ns) AS last_ns FROM proc WHERE event_type <> 'EXIT' GROUP BY 1, 2), b AS (SELECT pid, last_ns AS timestamp_ns, n > 1 AS over_limit, 0 AS is_exit, 0 AS event_id FROM h UNION ALL SELECT pid, timestamp_ns, NULL, 1, event_id FROM proc WHERE event_type = 'EXIT'),
  l AS (SELECT *, lag(over_limit) OVER (PARTITION BY pid ORDER BY timestamp_ns, is_exit) AS before FROM b) SELECT pid, timestamp_ns, coalesce(before, FALSE) AS rate_limit_warning FROM l WHERE is_exit = 1""")
def exit_warnings(spark, sf):
    """By days instead of seconds, as these events are rare."""
    rows = adapter.table(spark, sf, "events_process")
    day = F.floor(F.col("timestamp_ns") / 86_400_000_000_000)
    return process.exit_warnings(rows.where("event_type <> 'EXIT'"), rows.where("event_type = 'EXIT'").select("pid", "timestamp_ns"), day, ["pid"], "timestamp_ns", 1)


@query("""WITH s AS (SELECT l_orderkey AS tid, l_linenumber * 1000 AS ts, CASE WHEN l_linenumber % 2 = 1 THEN 'enter' ELSE 'exit' END AS phase FROM lineitem), b AS (SELECT *, lag(ts) OVER w AS t0, lag(phase) OVER w AS p0 FROM s WINDOW w AS (PARTITION BY tid ORDER BY ts)) SELECT tid, ts AS timestamp_ns, (ts - t0) / 1000000.0 AS latency_ms FROM b WHERE phase = 'exit' AND p0 = 'enter'""")
def syscall_latency(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("tid"), (F.col("l_linenumber") * 1000).alias("timestamp_ns"), F.when(F.col("l_linenumber") % 2 == 1, "enter").otherwise("exit").alias("phase"))
    return process.pair_syscalls(rows).select("tid", "timestamp_ns", "latency_ms")


# --- filters ------------------------------------------------------------------------------------------------------


@query(BASE + "SELECT event_id AS seq FROM proc WHERE comm = 'c3' AND pid <> 1003")
def kept_events(spark, sf):
    rows = adapter.envelopes(spark, sf).where("source = 'process'")
    return filters.keep(rows, comm="c3").where("pid <> 1003").select(F.col("stream_seq").alias("seq"))


@query(BASE + "SELECT event_id AS seq FROM proc WHERE event_type <> 'EXEC' AND (event_type <> 'EXIT' OR exit_code * 10 >= 10)")
def long_lived(spark, sf):
    """With a least lifetime; exit codes stand for lifetimes here."""
    e = adapter.envelopes(spark, sf).where("source = 'process'")
    life = F.replace("data", F.lit('"exit_code":'), F.lit('"duration_ms":1'))
    return filters.min_lifetime(e.withColumn("data", F.when(F.get_json_object("data", "$.exit_code") != "0", life).otherwise(F.col("data"))), 10).select(F.col("stream_seq").alias("seq"))


@query(TRAFFIC + "SELECT seq FROM opened UNION ALL SELECT seq FROM cred WHERE turn % 4 <> 1")
def credentials_changed(spark, sf):
    return filters.changed_credentials(traffic.envelopes(spark, sf).where("source = 'process'")).select(F.col("stream_seq").alias("seq"))


@query("""WITH p AS (SELECT p_partkey, ['/proc/', '/usr/lib/', '/etc/', '/etc/ld.so.', '/home/u/', '/opt/node_modules/', '/x/.git/objects/'][p_partkey % 7 + 1] || p_partkey || ['', '.so', '.lock', '.txt'][p_partkey % 4 + 1] AS path FROM part)
  SELECT p_partkey, path FROM p WHERE NOT CASE WHEN path LIKE '/etc/%' THEN path LIKE '/etc/ld.so%' ELSE path LIKE '/proc/%' OR path LIKE '/usr/lib/%' OR path LIKE '%/node_modules/%' OR path LIKE '%/.git/objects/%' OR path LIKE '%.so' OR path LIKE '%.lock' END""")
def quiet_paths(spark, sf):
    k = F.col("p_partkey").cast("int")
    starts, ends = ["/proc/", "/usr/lib/", "/etc/", "/etc/ld.so.", "/home/u/", "/opt/node_modules/", "/x/.git/objects/"], ["", ".so", ".lock", ".txt"]
    path = F.concat(F.element_at(F.array(*map(F.lit, starts)), k % 7 + 1), k.cast("string"), F.element_at(F.array(*map(F.lit, ends)), k % 4 + 1))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", path.alias("path")).where(~filters.is_noise(F.col("path")))


# --- sources and sinks --------------------------------------------------------------------------------------------


def _lines(spark, sf: str) -> DataFrame:
    """Events as lines of a log; some are cut, some lack a field."""
    e = adapter.envelopes(spark, sf).drop("session_id")
    whole = F.to_json(F.struct("stream_seq", "timestamp_ns", "timestamp_unix_ms", "source", "pid", "comm", F.parse_json("data").alias("data")))
    bad = F.when(F.col("stream_seq") % 50 == 1, F.substring(whole, 1, 30)).when(F.col("stream_seq") % 50 == 2, '{"timestamp_ns":1,"data":{}}').when(F.col("stream_seq") % 50 == 3, '{"source":"ssl","data":{}}').when(F.col("stream_seq") % 50 == 4, '{"timestamp_ns":1,"source":"ssl"}')
    return e.select(F.coalesce(bad, whole).alias("value"))


@query(BASE + "SELECT event_id AS seq, CASE kind WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'system' ELSE 'process' END AS source, pid FROM e WHERE event_id % 50 NOT IN (1, 2, 3, 4)")
def log_import(spark, sf):
    return logs.split_lines(_lines(spark, sf))[0].select(F.col("stream_seq").alias("seq"), "source", "pid")


@query(BASE + "SELECT error, count(*) AS n FROM (SELECT ['invalid JSON', 'missing source', 'missing timestamp', 'missing data'][event_id % 50] AS error FROM e WHERE event_id % 50 IN (1, 2, 3, 4)) GROUP BY 1")
def log_errors(spark, sf):
    return logs.split_lines(_lines(spark, sf))[1].groupBy("error").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS m FROM conversations) SELECT make_timestamp((1700000000 + conv_id * 10 + turn) * 1000000) AS time, CASE WHEN turn % 2 = 0 THEN 'warn' ELSE 'info' END AS level, m AS message FROM c")
def app_log(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 10 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(at.alias("ts"), F.when(F.col("turn") % 2 == 0, "WARN").alias("severity"), F.md5(F.coalesce("text", F.lit(""))).alias("msg")))
    return logs.app_log(c.select(line.alias("value"))).select(F.col("time").cast("timestamp_ntz").alias("time"), "level", "message")


@query(BASE + """SELECT timestamp_ns, pid, comm, event_type AS event, filepath, net_ip AS ip, net_port AS port, ppid, filename, full_command, exit_code, CASE event_type WHEN 'FILE_OPEN' THEN 0 WHEN 'FILE_DELETE' THEN 0 END AS flags FROM proc""")
def record_events(spark, sf):
    """Process events as binary records of a capture, decoded again."""
    e = adapter.table(spark, sf, "events_process")

    def number(c: F.Column, size: int) -> F.Column:
        text = F.lpad(F.hex(F.coalesce(c, F.lit(0)).cast("bigint")), 2 * size, "0")
        return F.concat(*(F.substring(text, 2 * (size - i) - 1, 2) for i in range(size)))

    field = lambda c, size: F.rpad(F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), 2 * size, "0")
    kind = F.col("event_type")
    code = F.when(kind.isin("EXEC", "EXIT"), 0).when(kind == "NET_CONNECT", 4).otherwise(2)
    path = F.concat(field(F.coalesce("filepath", "filename"), 127), F.lit("00" * 5), number(F.lit(0), 4), number(F.when(kind == "FILE_DELETE", 2).otherwise(0), 4), F.lit("00" * 116))
    address = F.concat(*(F.lpad(F.hex(F.split("net_ip", "[.]")[i].cast("bigint")), 2, "0") for i in range(4)))
    net = F.concat(number(F.col("net_family"), 2), number(F.col("net_port"), 2), address, F.lit("00" * 248))
    head = [number(code, 4), number(F.col("pid"), 4), number(F.col("ppid"), 4), number(F.col("exit_code"), 4), number(F.lit(0), 8), number(F.col("timestamp_ns"), 8), field(F.col("comm"), 16), field(F.col("full_command"), 256)]
    raw = F.unhex(F.concat(*head, F.when(kind == "NET_CONNECT", net).otherwise(path), F.when(kind == "EXIT", "01").otherwise("00"), F.lit("00" * 7)))
    rows, v = records.decode_process(write_table(e.select(raw.alias("value")), "records")), P.parsed()
    of = lambda name, c: F.when(P.text(v, "$.event").isin(*name.split()), c)
    return rows.select(
        "timestamp_ns", "pid", "comm", P.text(v, "$.event").alias("event"), P.text(v, "$.filepath").alias("filepath"), P.text(v, "$.ip").alias("ip"), P.integer(v, "$.port", "int").alias("port"), of("EXEC", P.integer(v, "$.ppid")).alias("ppid"),
        P.text(v, "$.filename").alias("filename"), P.text(v, "$.full_command").alias("full_command"), P.integer(v, "$.exit_code", "int").alias("exit_code"), P.integer(v, "$.flags", "int").alias("flags"),
    )


@query(TRAFFIC + "SELECT own_seq AS seq, CASE WHEN role = 'user' AND own_seq > seq THEN 'HEX:' || lower(hex(encode('plain ' || m || chr(1)))) END AS text FROM ssl")
def log_lines(spark, sf):
    """Payloads that hold a control character are written as HEX."""
    e = traffic.envelopes(spark, sf).where("source = 'ssl'")
    binary = F.when(F.col("data").contains('"plain '), F.regexp_replace("data", r'("data":"plain [0-9a-f]+)"', r'$1\\u0001"')).otherwise(F.col("data"))
    lines = sink.log_lines(e.withColumn("data", binary))
    seq, data = F.get_json_object("value", "$.stream_seq").cast("bigint"), F.get_json_object(F.get_json_object("value", "$.data"), "$.data")
    return lines.select(seq.alias("seq"), F.when(data.startswith("HEX:"), data).alias("text"))


@query(BASE + "SELECT table_name, session_id, count(*) AS n FROM (SELECT 'events_process' AS table_name, session_id FROM proc UNION ALL SELECT 'events_tool_call', session_id FROM tool UNION ALL SELECT 'events_system', session_id FROM sys) GROUP BY 1, 2")
def written_tables(spark, sf):
    """Typed tables, written in two batches, one of them twice, and read back."""
    path, e = new_path(spark, "tables"), adapter.envelopes(spark, sf)
    for batch in (0, 1, 1):
        sink.write_tables(e.where(F.col("stream_seq") % 2 == batch), path, batch)
    read = sink.read_tables(spark, path)
    parts = [read[t].select(F.lit(t).alias("table_name"), "session_id") for t in ("events_process", "events_tool_call", "events_system")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("table_name", "session_id").agg(F.count("*").alias("n"))


@query(BASE + """, r AS (SELECT id, session_id, timestamp_ns, event_id % 2 AS batch FROM proc UNION ALL SELECT t.id, t.session_id, e.timestamp_ns, e.event_id % 2 FROM tool t JOIN e ON t.id = e.event_id * 16 + 1 UNION ALL SELECT s.id, s.session_id, e.timestamp_ns, e.event_id % 2 FROM sys s JOIN e ON s.id = e.event_id * 16 + 2
    UNION ALL SELECT s.id, s.session_id, e.timestamp_ns, e.event_id % 2 FROM sec s JOIN e ON s.source_event_id = e.event_id * 16),
  n AS (SELECT id AS old_id, session_id, row_number() OVER (ORDER BY batch, timestamp_ns, id) AS id FROM r) SELECT n.id, n.session_id, (SELECT m.id FROM sec JOIN n m ON m.old_id = sec.source_event_id WHERE sec.id = n.old_id) AS of_id FROM n""")
def dense_ids(spark, sf):
    """Ids from one sequence over all tables, in two batches, the second of them written twice; alerts name the new id of their event."""
    path, e = new_path(spark, "tables"), adapter.envelopes(spark, sf)
    e = security.analyze(e)
    for batch in (0, 1, 1):
        sink.write_tables(e.where(F.col("stream_seq") % 2 == batch), path, batch, ["events_process", "events_tool_call", "events_system", "events_security"], dense=True)
    read = sink.read_tables(spark, path, ["events_process", "events_tool_call", "events_system", "events_security"])
    none = F.lit(None).cast("bigint")
    parts = [read[t].select("id", "session_id", (F.col("source_event_id") if t == "events_security" else none).alias("of_id")) for t in ("events_process", "events_tool_call", "events_system", "events_security")]
    return reduce(DataFrame.unionByName, parts)


def _as_stream(spark, df: DataFrame) -> DataFrame:
    path = new_path(spark, "stream")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _ended(events: DataFrame) -> DataFrame:
    """events and, a day after each session's last one, a row that ends it."""
    last = events.groupBy("session_id").agg((F.max("timestamp_ns") + 86_400_000_000_000).alias("timestamp_ns"))
    return events.unionByName(last.withColumns({"source": F.lit("control"), "data": F.lit("{}")}), allowMissingColumns=True)


def _drained(made: DataFrame) -> DataFrame:
    """What a stream gives, written batch by batch, and read back."""
    spark = made.sparkSession
    path = new_path(spark, "streamed")
    made.limit(0).sparkSession.createDataFrame([], made.schema).write.parquet(f"{path}/batch=-1")
    writer = made.writeStream.option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True)
    writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(path).select(*made.columns)


ENDS = "source = 'control'"


@query(TRAFFIC + "SELECT session_id, pid, comm, sse_connection_id, sse_duration_ns, sse_event_count, m AS text_content FROM sse")
def streamed_messages(spark, sf):
    """The messages of sse_table, from a stream that a control row ends."""
    stream = _as_stream(spark, _ended(traffic.envelopes(spark, sf)))
    rows = project.typed(_drained(ordered.stream_messages(stream, ends=F.expr(ENDS))), "events_sse")
    return rows.select("session_id", "pid", "comm", "sse_connection_id", "sse_duration_ns", "sse_event_count", F.get_json_object("data_json", "$.text_content").alias("text_content"))


@query(SQL["track"])
def streamed_tracking(spark, sf):
    """`track` over a stream."""
    stream = _as_stream(spark, _ended(adapter.envelopes(spark, sf).where("source = 'process'")))
    return _drained(ordered.stream_track(stream, 2, ["c1"], ends=F.expr(ENDS))).select(F.col("stream_seq").alias("seq"))


@query(SQL["process_opens"])
def streamed_opens(spark, sf):
    """`process_opens` over a stream."""
    stream = _as_stream(spark, _ended(adapter.envelopes(spark, sf).where("source = 'process'")))
    return _drained(ordered.stream_opens(stream, 7_200_000_000_000, ends=F.expr(ENDS)))


@query(BASE + """, h AS (SELECT event_id, session_id, pid, event_type, timestamp_ns, timestamp_ns // 1000000000 AS second, coalesce(sum(CASE event_type WHEN 'EXIT' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, pid ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life
    FROM proc WHERE event_type IN ('FILE_OPEN', 'EXIT')),
  n AS (SELECT *, row_number() OVER (PARTITION BY session_id, pid, life, second ORDER BY timestamp_ns, event_id) AS n FROM h WHERE event_type = 'FILE_OPEN'),
  c AS (SELECT session_id, pid, life, second, count(*) > 1 AS over_limit, lag(count(*) > 1) OVER (PARTITION BY session_id, pid, life ORDER BY second) AS before FROM n GROUP BY 1, 2, 3, 4)
  SELECT n.event_id AS seq, n.n = 1 AND coalesce(c.before, FALSE) AS rate_limit_warning FROM n JOIN c USING (session_id, pid, life, second) WHERE n.n <= 1
  UNION ALL SELECT h.event_id, coalesce((SELECT arg_max(c.over_limit, c.second) FROM c WHERE c.session_id = h.session_id AND c.pid = h.pid AND c.life = h.life), FALSE) FROM h WHERE h.event_type = 'EXIT'""")
def streamed_limits(spark, sf):
    """Opens under a limit of one a second and process, and EXITs, over a stream."""
    stream = _as_stream(spark, _ended(adapter.envelopes(spark, sf).where("source = 'process'")))
    return _drained(ordered.stream_limits(stream, 1, ends=F.expr(ENDS))).select(F.col("stream_seq").alias("seq"), "rate_limit_warning")


@query(SQL["tool_uses"])
def streamed_tool_calls(spark, sf):
    """`tool_uses` over a stream, with what the system did meanwhile."""
    stream = _as_stream(spark, _ended(parse_http(traffic.envelopes(spark, sf))))
    found = _drained(ordered.stream_tool_calls(stream, ends=F.expr(ENDS)))
    return found.select("session_id", "tool_use_id", "tool_name", "pid", "comm", "start_ns", "status", "duration_ms", "result_summary", F.coalesce(F.size("os_activities"), F.lit(0)).cast("long").alias("activities"))


@query(BASE + "SELECT table_name, session_id, count(*) AS n FROM (SELECT 'events_process' AS table_name, session_id FROM proc UNION ALL SELECT 'events_tool_call', session_id FROM tool UNION ALL SELECT 'events_system', session_id FROM sys) GROUP BY 1, 2")
def streamed_tables(spark, sf):
    """Typed tables written by a stream's micro-batches, and read back."""
    path = new_path(spark, "tables")
    sink.stream_tables(_as_stream(spark, adapter.envelopes(spark, sf)), path, new_path(spark, "checkpoint"), {"availableNow": True}).awaitTermination()
    read = sink.read_tables(spark, path)
    parts = [read[t].select(F.lit(t).alias("table_name"), "session_id") for t in ("events_process", "events_tool_call", "events_system")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("table_name", "session_id").agg(F.count("*").alias("n"))


@query(BASE + """, o AS (SELECT session_id, pid, filepath, timestamp_ns, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w <= 21600000000000 THEN 0 ELSE 1 END AS new FROM proc WHERE event_type = 'FILE_OPEN' WINDOW w AS (PARTITION BY session_id, pid, filepath ORDER BY timestamp_ns, event_id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY session_id, pid, filepath ORDER BY timestamp_ns ROWS UNBOUNDED PRECEDING) AS run, max(timestamp_ns) OVER (PARTITION BY session_id, pid, filepath) AS last_ns FROM o)
  SELECT session_id, pid, filepath AS key_field, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns, count(*) AS calls, CASE WHEN max(timestamp_ns) = max(last_ns) THEN 'flush' ELSE 'idle_gap' END AS reason, (max(timestamp_ns) - min(timestamp_ns)) // 1000000 AS duration_ms FROM r GROUP BY session_id, pid, filepath, run""")
def tool_span_runs(spark, sf):
    """Spans of several calls: a pause of six hours ends one here, as these events are rare."""
    found = spans(adapter.envelopes(spark, sf), idle_ns=21_600_000_000_000, most_ns=1 << 62).where("tool_name = 'fs.read'")
    return found.select("session_id", "pid", "key_field", "start_ns", "end_ns", "calls", "reason", "duration_ms")


@query(BASE.replace("WITH e AS", "WITH RECURSIVE e AS") + """, o AS (SELECT session_id, pid, filepath, timestamp_ns AS ts, row_number() OVER (PARTITION BY session_id, pid, filepath ORDER BY timestamp_ns, event_id) AS n FROM proc WHERE event_type = 'FILE_OPEN'),
  f AS (SELECT *, ts AS start_ns, 0 AS cut FROM o WHERE n = 1 UNION ALL SELECT o.*, CASE WHEN o.ts - f.ts > 864000000000000 OR o.ts > f.start_ns + 1296000000000000 THEN o.ts ELSE f.start_ns END, CASE WHEN o.ts - f.ts > 864000000000000 THEN 1 WHEN o.ts > f.start_ns + 1296000000000000 THEN 2 ELSE 0 END
    FROM f JOIN o ON o.session_id = f.session_id AND o.pid = f.pid AND o.filepath = f.filepath AND o.n = f.n + 1),
  s AS (SELECT session_id, pid, filepath, start_ns, max(ts) AS end_ns, count(*) AS calls, max(cut) AS cut, max(n) AS n FROM f GROUP BY 1, 2, 3, 4)
  SELECT session_id, pid, filepath AS key_field, start_ns, end_ns, calls, CASE lead(cut) OVER (PARTITION BY session_id, pid, filepath ORDER BY n) WHEN 1 THEN 'idle_gap' WHEN 2 THEN 'max_span' ELSE 'flush' END AS reason FROM s""")
def tool_span_splits(spark, sf):
    """Spans that last too long are split: pauses of ten days and spans of fifteen here, as these events are rare."""
    found = spans(adapter.envelopes(spark, sf), idle_ns=864_000_000_000_000, most_ns=1_296_000_000_000_000).where("tool_name = 'fs.read'")
    return found.select("session_id", "pid", "key_field", "start_ns", "end_ns", "calls", "reason")


# --- scalar functions ---------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 9000 + l_orderkey < 1000 THEN (l_linenumber * 9000 + l_orderkey) || 'ms' WHEN l_linenumber * 9000 + l_orderkey < 60000 THEN printf('%.2fs', floor((l_linenumber * 9000 + l_orderkey) / 10.0 + 0.5) / 100) ELSE printf('%dm %ds', (l_linenumber * 9000 + l_orderkey) // 60000, (l_linenumber * 9000 + l_orderkey) % 60000 // 1000) END AS took,
  CASE WHEN l_orderkey * l_linenumber < 1024 THEN printf('%d B', l_orderkey * l_linenumber) WHEN l_orderkey * l_linenumber < 1048576 THEN printf('%.1f KB', floor(l_orderkey * l_linenumber / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(l_orderkey * l_linenumber / 1048576.0 * 10 + 0.5) / 10) END AS size, CASE WHEN (l_linenumber & 3) = 0 THEN 'fs.read' ELSE 'fs.write' END AS tool,
  CAST(l_orderkey & 255 AS VARCHAR) || '.' || ((l_orderkey >> 8) & 255) || '.' || ((l_orderkey >> 16) & 255) || '.' || ((l_orderkey >> 24) & 255) AS ip, greatest(0, CAST(floor((l_linenumber - 3) * 1500000 / 1000000.0) AS BIGINT)) AS ms FROM lineitem""")
def scalar_texts(spark, sf):
    """Durations, sizes, tools of open flags, addresses, milliseconds."""
    n, k = F.col("l_linenumber").cast("long"), F.col("l_orderkey")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", scalar.duration_text(n * 9000 + k).alias("took"), scalar.size_text(k * n).alias("size"), scalar.file_tool(F.col("l_linenumber")).alias("tool"), scalar.ipv4_text(k).alias("ip"), scalar.ns_to_ms((n - 3) * 1_500_000).alias("ms"))


@query("""SELECT c_custkey, printf('%x', list_reduce(list_prepend(CAST(14695981039346656037 AS UBIGINT), list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda h, b: CAST((CAST(xor(h, b) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS UBIGINT))) AS hash FROM customer""")
def fnv_hashes(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", scalar.fnv1a64("c_name").alias("hash"))


ADDRESSES = ["10.1.2.3", "172.32.0.1", "8.8.8.8", "::1", "fd00::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:db8::1", "fe80::1", "1:2:3", "256.1.1.1", "0:0:0:0:0:0:0:1", "169.254.9.9", ":::1", "FC00::"]
IS_PRIVATE = [1, 0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 1, 1, 0, 1]


@query(f"SELECT s_suppkey, {ADDRESSES}[s_suppkey % {len(ADDRESSES)} + 1] AS ip, {IS_PRIVATE}[s_suppkey % {len(ADDRESSES)} + 1] = 1 AS private FROM supplier")
def private_addresses(spark, sf):
    ip = F.element_at(F.array(*map(F.lit, ADDRESSES)), (F.col("s_suppkey") % len(ADDRESSES) + 1).cast("int"))
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", ip.alias("ip")).withColumn("private", scalar.is_private(F.col("ip")))


@query("""WITH n AS (SELECT s_suppkey, (s_suppkey * 40503001) % 16777216 AS n FROM supplier), o AS (SELECT s_suppkey, [10, 127, 172, 192, 169, 8][s_suppkey % 6 + 1] AS a, CASE s_suppkey % 6 WHEN 3 THEN 167 + n // 65536 % 3 WHEN 4 THEN 253 + n // 65536 % 3 WHEN 2 THEN n // 65536 % 40 ELSE n // 65536 END AS b, n // 256 % 256 AS c, n % 256 AS d FROM n)
  SELECT s_suppkey, a || '.' || b || '.' || c || '.' || d AS ip, a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) AS private FROM o""")
def private_networks(spark, sf):
    """Addresses in and beside the private networks; SQL decides by their numbers."""
    key = F.col("s_suppkey").cast("bigint")
    n, kind = F.pmod(key * 40503001, F.lit(16777216)), F.col("s_suppkey") % 6
    b = F.floor(n / 65536)
    b = F.when(kind == 3, b % 3 + 167).when(kind == 4, b % 3 + 253).when(kind == 2, b % 40).otherwise(b)
    a = F.element_at(F.array(*map(F.lit, [10, 127, 172, 192, 169, 8])), (kind + 1).cast("int"))
    ip = F.concat_ws(".", *(x.cast("bigint").cast("string") for x in (a, b, F.floor(n / 256) % 256, n % 256)))
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", ip.alias("ip")).withColumn("private", scalar.is_private(F.col("ip")))


# --- endpoints for one session ------------------------------------------------------------------------------------


@query(TRAFFIC + PER + "SELECT session_id, CAST(sum(cnt) AS BIGINT) AS total_events FROM per WHERE session_id = 'v3' GROUP BY 1")
def overview_endpoint(spark, sf):
    return api.overview(traffic.tables(spark, sf), "v3").select("session_id", "total_events")


@query(BASE + "SELECT tool_name, count(*) AS call_count, count(*) FILTER (WHERE tool_status = 'success') AS success_count FROM tool WHERE session_id = 's4' GROUP BY 1")
def tool_call_stats_endpoint(spark, sf):
    return api.tool_call_stats({"events_tool_call": adapter.table(spark, sf, "events_tool_call")}, "s4").select("tool_name", "call_count", "success_count")


@query(BASE + "SELECT time_bucket(INTERVAL '5 seconds', event_time) AS bucket, pid, round(avg(cpu_percent), 6) AS avg_cpu_percent, count(*) AS sample_count FROM sys WHERE session_id = 's2' GROUP BY 1, 2")
def resources_endpoint(spark, sf):
    return api.resources({"events_system": adapter.table(spark, sf, "events_system")}, "s2").select("bucket", "pid", "avg_cpu_percent", "sample_count")


@query(BASE + "SELECT net_ip, net_port, count(*) AS connection_count FROM proc WHERE event_type = 'NET_CONNECT' AND session_id = 's1' GROUP BY 1, 2")
def network_endpoint(spark, sf):
    return api.network_connections({"events_process": adapter.table(spark, sf, "events_process")}, "s1").select("net_ip", "net_port", "connection_count")


@query(BASE + "SELECT id, alert_type, description FROM sec WHERE id = (SELECT min(id) FROM sec)")
def alert_by_id(spark, sf):
    t = {"events_security": adapter.table(spark, sf, "events_security")}
    first = t["events_security"].agg(F.min("id")).first()[0]
    return api.security_alerts(t, id=first).select("id", "alert_type", "description")


@query(BASE + ", s AS (SELECT session_id, min(event_time) AS start_time FROM e GROUP BY 1) SELECT session_id, start_time, CASE WHEN session_id = 's5' THEN TIMESTAMP '2030-01-01' END AS end_time FROM s")
def session_records(spark, sf):
    """Sessions from a log; one that is added again stays as it is, one is closed."""
    rows = adapter.envelopes(spark, sf).withColumn("t", project.event_time()).groupBy("session_id").agg(F.min("t").alias("start_time")).withColumn("end_time", F.lit(None).cast("timestamp_ntz"))
    again = rows.where("session_id = 's1'").withColumn("start_time", F.lit(datetime(2040, 1, 1)).cast("timestamp_ntz"))
    return api.sessions({"sessions": sink.close_session(sink.add_sessions(rows, again), "s5", datetime(2030, 1, 1))})

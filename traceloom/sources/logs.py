"""Sources: envelope logs as JSON lines or Parquet, in batch or streaming, application logs, and made-up events."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.schema import ENVELOPE


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, lines that are none with the error of each). `data` keeps its JSON text. A line needs a time, a source and data."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return split_lines(lines)


def split_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events of lines of JSON, and the lines that are none, with the error of each."""
    read = lines.select(F.col(column).alias("line"), F.from_json(column, ENVELOPE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    error = F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "invalid JSON").when(F.coalesce("e.timestamp_unix_ms", "e.timestamp_ns").isNull(), "missing timestamp")
    error = error.when(F.col("e.source").isNull(), "missing source").when(F.col("e.data").isNull(), "missing data")
    names = [x.strip().split(" ")[0] for x in ENVELOPE.split(",")]
    return read.where(error.isNull()).select(*(f"e.{n}" for n in names)), read.where(error.isNotNull()).select("line", error.alias("error"))


def numbered(events: DataFrame) -> DataFrame:
    """Events in order of time, with an id of source, time and place among those of both; for logs that have none."""
    at = F.coalesce("timestamp_unix_ms", F.floor(F.col("timestamp_ns") / 1_000_000).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("source", at).orderBy("stream_seq", "pid", "data")) - 1
    return events.withColumn("event_id", F.concat_ws("-", "source", at.cast("string"), place.cast("string"))).orderBy("timestamp_ns", "stream_seq")


def stream_jsonl(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return split_lines(lines)[0]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_parquet(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", per_trigger).parquet(path)


def app_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(time, level, message, raw) of application log lines of JSON; the message is the first known key that is set."""
    v = F.try_parse_json(column)
    get = lambda *keys: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys))
    time = F.coalesce(F.try_to_timestamp(get("timestamp", "time", "ts")), F.timestamp_millis(F.try_variant_get(v, "$.timestamp", "bigint")))
    rows = lines.where(v.isNotNull()).select(time.alias("time"), F.lower(F.coalesce(get("level", "severity"), F.lit("info"))).alias("level"), F.coalesce(get("message", "msg", "event", "text", "error"), F.col(column)).alias("message"), F.col(column).alias("raw"))
    return rows.orderBy("time")


def synthetic(spark: SparkSession, count: int = 5, delay_ms: int = 100, start_ms: int = 1_700_000_000_000) -> DataFrame:
    """`count` pairs of an HTTP request and its response as ssl events."""
    n = spark.range(2 * count).withColumn("pair", F.floor(F.col("id") / 2)).withColumn("answer", F.col("id") % 2 == 1)
    request = F.concat(F.lit("GET /item/"), F.col("pair").cast("string"), F.lit(" HTTP/1.1\r\nHost: example.com\r\nUser-Agent: synthetic\r\n\r\n"))
    response = F.lit("HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nContent-Length: 2\r\n\r\n{}")
    data = F.to_json(F.struct(F.when(F.col("answer"), "READ/RECV").otherwise("WRITE/SEND").alias("function"), F.when(F.col("answer"), response).otherwise(request).alias("data"), F.lit(1).alias("tid")))
    at = F.lit(start_ms) + F.col("id") * delay_ms
    return n.select((F.col("id") + 1).alias("stream_seq"), (at * 1_000_000).alias("timestamp_ns"), at.alias("timestamp_unix_ms"), F.lit("ssl").alias("source"), F.lit(1234).cast("bigint").alias("pid"), F.lit("synthetic").alias("comm"), data.alias("data"))


def merge(*frames: DataFrame | None) -> DataFrame:
    """One stream of several sources; absent ones are left out."""
    first, *rest = [f for f in frames if f is not None]
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def demo_alerts(spark: SparkSession, now: datetime, session_id: str = "demo", pid: int = 4242, comm: str = "mock-proc") -> DataFrame:
    """A session of three alerts, one a minute up to now, to try a view with."""
    #: Type, risk, table and event of each.
    samples = [("sensitive_file_access", "high", "read of a sensitive path", "events_process", 1001), ("dangerous_command", "medium", "command that may destroy data", "events_process", 1002), ("suspicious_network", "low", "unusual connection", "events_ssl", 1003)]
    rows = []
    for i, (kind, risk, text, table, event) in enumerate(samples):
        at = int((now - timedelta(minutes=len(samples) - i) - datetime(1970, 1, 1)).total_seconds())
        evidence = {"source_table": table, "event_type": "MOCK", "pid": pid + i, "comm": comm, "timestamp_ns": at * 10**9, "detail": "made up"}
        data = {"alert_type": kind, "risk_level": risk, "description": text, "source_table": table, "source_event_id": event, "evidence": [evidence]}
        rows.append((None, at * 10**9, at * 1000, "security", pid + i, comm, json.dumps(data), session_id))
    return spark.createDataFrame(rows, ENVELOPE + ", session_id string")

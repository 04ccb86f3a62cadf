"""The driver's `conversations` table as an agent's traffic: TLS payloads, stdio messages and what the system did meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators.http import parse_http
from traceloom.operators.project import SLOTS, typed
from traceloom.operators.security import alerts
from traceloom.operators.sse import merge_sse
from traceloom.operators.tooluse import correlate
from traceloom.store import write_table

END = "\r\n"


def _text(*lines) -> F.Column:
    return F.concat_ws(END, *(F.lit(x) if isinstance(x, str) else x for x in lines))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn is an HTTP request with a tool's result, and a payload that is no HTTP; an assistant's is a response
    with a tool use and an open of a file (even conversations), or two chunks of server-sent events (odd ones); one in
    five also changes credentials. A system's turn is a stdio message, of a kind that goes by the conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    id_, turn, m, even = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("m"), F.col("conv_id") % 2 == 0
    model = F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"))
    use, before = F.concat(F.lit("t"), id_, F.lit("_"), turn), F.concat(F.lit("t"), id_, F.lit("_"), (F.col("turn") - 1).cast("string"))
    asked = F.to_json(F.struct(model.alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), before.alias("tool_use_id"), m.alias("content"))).alias("content"))).alias("messages")))
    request = _text(F.concat(F.lit("POST /v1/messages?turn="), turn, F.lit(" HTTP/1.1")), "Host: api.example.com", F.concat(F.lit("Authorization: Bearer "), m), "Content-Type: application/json", "", asked)
    answer = F.to_json(F.struct(model.alias("model"), F.array(F.struct(F.lit("tool_use").alias("type"), use.alias("id"), F.lit("Read").alias("name"), F.struct(F.concat(F.lit("/w/"), turn).alias("path")).alias("input"))).alias("content")))
    response = _text("HTTP/1.1 200 OK", "Content-Type: application/json", F.concat(F.lit("Set-Cookie: s="), m), "", answer)
    started = F.to_json(F.struct(F.struct(F.concat(F.lit("x"), use).alias("id"), model.alias("model")).alias("message")))
    delta = F.to_json(F.struct(F.struct(F.lit("text_delta").alias("type"), m.alias("text")).alias("delta")))
    chunk = _text("1a", "event: message_start", "1a", F.concat(F.lit("data: "), started), "1", "", "1a", "event: content_block_delta", "1a", F.concat(F.lit("data: "), delta), "0", "", "")
    stop = _text("1a", "event: message_stop", "1a", "data: {}", "0", "", "")
    call = F.to_json(F.struct(F.col("conv_id").alias("id"), F.lit("tools/call").alias("method"), F.struct(F.lit("Read").alias("name"), F.struct(m.alias("text")).alias("arguments")).alias("params")))
    said = F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct(F.array(F.struct(F.repeat(m, 4).alias("text"))).alias("content")).alias("result")))
    failed = F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct(m.alias("message")).alias("error")))
    kind = F.col("conv_id") % 5
    message = F.when(kind == 0, call).when(kind == 1, F.lit('{"method":"initialized"}')).when(kind == 2, said).when(kind == 3, failed).otherwise(F.concat(F.lit("log  line "), m))
    role, answers = F.col("role"), F.col("role") == "assistant"
    ssl = lambda function, text: F.to_json(F.struct(F.lit(function).alias("function"), (F.length(m) + F.col("turn")).alias("len"), F.col("turn").alias("tid"), text.alias("data")))
    row = lambda when, j, source, data, later=0, pid=5000: F.when(when, F.struct(F.lit(j).alias("j"), F.lit(source).alias("source"), data.alias("data"), F.lit(later).cast("bigint").alias("later"), F.lit(pid).alias("base")))
    made = F.array_compact(F.array(
        row(role == "user", 0, "ssl", ssl("WRITE/SEND", request)), row(role == "user", 1, "ssl", ssl("WRITE/SEND", F.concat(F.lit("plain "), m))),
        row(answers & even, 0, "ssl", ssl("READ/RECV", response)), row(answers & ~even, 0, "ssl", ssl("READ/RECV", chunk)), row(answers & ~even, 1, "ssl", ssl("READ/RECV", stop), 5_000_000),
        row(answers & even, 2, "process", F.to_json(F.struct(F.lit("FILE_OPEN").alias("event"), F.concat(F.lit("/w/"), turn, F.lit("/.env")).alias("filepath"), F.lit(0).alias("flags"))), 500_000_000, 9000),
        row(answers & (F.col("conv_id") % 5 == 0), 3, "process", F.to_json(F.struct(F.lit("CRED_CHANGE").alias("event"), F.struct(F.lit(1).alias("uid")).alias("old"), F.struct((F.col("turn") % 4).alias("uid")).alias("new"))), 0, 9000),
        row(role == "system", 0, "stdio", F.to_json(F.struct(F.lit("write").alias("direction"), F.lit(1).alias("fd"), F.lit("stdout").alias("fd_role"), message.alias("data")))),
    ))
    at = F.col("conv_id") * 1000 + F.col("turn")
    e = c.select("*", F.explode(made).alias("e"))
    return e.select(
        ((F.col("conv_id") * 100 + F.col("turn")) * 4 + F.col("e.j") + 1).alias("stream_seq"), (at * 1_000_000_000 + F.col("e.later")).alias("timestamp_ns"), (at * 1000 + 1).alias("timestamp_unix_ms"), F.col("e.source").alias("source"),
        (F.col("e.base") + F.col("conv_id")).alias("pid"), F.concat(F.lit("agent"), (F.col("conv_id") % 3).cast("string")).alias("comm"), F.col("e.data").alias("data"), F.concat(F.lit("v"), (F.col("conv_id") % 10).cast("string")).alias("session_id"),
    )


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traffic after the chain of an observer: messages, HTTP, tool uses, alerts. Messages are put together once, and HTTP
    is parsed once: what reads them twice reads a table."""
    e = envelopes(spark, sf_dir)
    messages = write_table(merge_sse(e), "messages")
    return correlate(write_table(parse_http(messages), "traffic")).unionByName(alerts(e))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    seen = traced(spark, sf_dir)
    return {t: typed(seen, t) for t in SLOTS}

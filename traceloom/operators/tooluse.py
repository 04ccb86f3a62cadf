"""Tool uses of a model, from its answer to the result that is sent back, with what the system did meanwhile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import payload as P
from traceloom.functions.scalar import let, ns_to_ms
from traceloom.store import write_table

TIMEOUT_MS = 30_000


def _session(events: DataFrame):
    return F.col("session_id") if "session_id" in events.columns else F.lit("").alias("session_id")


def summary(text: Column, most: int = 200) -> Column:
    """A text of over `most` bytes cut there, with three dots; each byte of a character that the cut breaks is a U+FFFD."""

    def shortened(t: Column) -> Column:
        return let(F.substring(F.encode(t, "utf-8"), 1, most).cast("string"), lambda c: let(F.when(F.is_valid_utf8(c), c).otherwise(F.regexp_replace(F.make_valid_utf8(c), "(?s).$", "")), ended))

    def ended(whole: Column) -> Column:
        return F.concat(whole, F.repeat(F.lit("\ufffd"), (F.lit(most) - F.octet_length(whole)).cast("int")), F.lit("..."))

    return let(text, lambda t: F.when(F.octet_length(t) > most, shortened(t)).otherwise(t))


def uses(events: DataFrame) -> DataFrame:
    """(session_id, tool_use_id, tool_name, tool_input, pid, comm, start_ns) of the tool_use blocks of responses."""
    body = F.try_parse_json(P.text(P.parsed(), "$.body"))
    blocks = F.from_json(F.try_variant_get(body, "$.content", "string"), "array<struct<type:string,id:string,name:string,input:string>>")
    rows = events.where(F.col("source") == "http_parser").where(P.text(P.parsed(), "$.message_type") == "response")
    rows = rows.select(_session(events).alias("session_id"), "pid", "comm", F.col("timestamp_ns").alias("start_ns"), "stream_seq", F.posexplode(blocks).alias("at", "b"))
    return rows.where("b.type = 'tool_use' AND b.id <> '' AND b.name <> ''").select("session_id", F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("tool_name"), F.col("b.input").alias("tool_input"), "pid", "comm", "start_ns")


def results(events: DataFrame) -> DataFrame:
    """(session_id, tool_use_id, end_ns, result_summary) of the tool_result blocks of requests."""
    body = F.try_parse_json(P.text(P.parsed(), "$.body"))
    messages = F.from_json(F.try_variant_get(body, "$.messages", "string"), "array<struct<role:string,content:string>>")
    rows = events.where(F.col("source") == "http_parser").where(P.text(P.parsed(), "$.message_type") == "request")
    rows = rows.select(_session(events).alias("session_id"), F.col("timestamp_ns").alias("end_ns"), F.explode(messages).alias("m")).where("m.role = 'user'")
    rows = rows.select("session_id", "end_ns", F.explode(F.from_json("m.content", "array<struct<type:string,tool_use_id:string,content:string>>")).alias("b"))
    first = F.coalesce(F.get_json_object("b.content", "$[0].text"), F.col("b.content"))
    return rows.where("b.type = 'tool_result' AND b.tool_use_id <> ''").select("session_id", F.col("b.tool_use_id").alias("tool_use_id"), "end_ns", summary(first).alias("result_summary"))


def activities(events: DataFrame) -> DataFrame:
    v = P.parsed()
    kind = P.text(v, "$.event")
    path = F.when(kind == "FILE_RENAME", F.concat_ws(" -> ", P.text(v, "$.oldpath"), P.text(v, "$.newpath"))).when(kind == "NET_CONNECT", F.concat_ws(":", P.text(v, "$.ip"), P.integer(v, "$.port").cast("string"))).otherwise(P.text(v, "$.filepath"))
    rows = events.where((F.col("source") == "process") & kind.isin("FILE_OPEN", "FILE_DELETE", "FILE_RENAME", "EXEC", "NET_CONNECT"))
    return rows.select(_session(events).alias("session_id"), F.struct(F.col("timestamp_ns"), kind.alias("event_type"), F.col("pid"), F.col("comm"), F.when(kind != "EXEC", path).alias("filepath"), P.text(v, "$.full_command").alias("command")).alias("activity"))


def tool_uses(events: DataFrame, bucket_ns: int = 10_000_000_000, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """A row a tool use: status success with its first result from then on, else timeout after timeout_ms (30 s), without a result.

    An id that is used again in its session starts anew. Activities are those of the session from the answer to
    the result (or timeout): an equi-join on slots of time, so neither side meets in whole.
    """
    # answers, results and activities are read from one table: what made the events is not worked out three times
    needed = [c for c in ("session_id", "source", "pid", "comm", "timestamp_ns", "stream_seq", "data") if c in events.columns]
    events = write_table(events.where(F.col("source").isin("http_parser", "process")).select(*needed), "tool-events")
    u = uses(events)
    again = Window.partitionBy("session_id", "tool_use_id").orderBy("start_ns")
    u = u.withColumn("next_ns", F.lead("start_ns").over(again))
    r = results(events).withColumnsRenamed({"session_id": "s2", "tool_use_id": "u2"})
    met = u.join(r, (F.col("session_id") == F.col("s2")) & (F.col("tool_use_id") == F.col("u2")) & (F.col("end_ns") >= F.col("start_ns")) & (F.col("next_ns").isNull() | (F.col("end_ns") < F.col("next_ns"))), "left")
    keys = ["session_id", "tool_use_id", "tool_name", "tool_input", "pid", "comm", "start_ns"]
    met = met.groupBy(*keys).agg(F.min(F.struct("end_ns", "result_summary")).alias("r")).select(*keys, "r.end_ns", "r.result_summary")
    late = F.col("end_ns").isNull() | (F.col("end_ns") - F.col("start_ns") > timeout_ms * 1_000_000)
    met = met.withColumn("status", F.when(late, "timeout").otherwise("success")).withColumn("result_summary", F.when(~late, F.col("result_summary"))).withColumn("until", F.when(late, F.col("start_ns") + timeout_ms * 1_000_000).otherwise(F.col("end_ns")))
    slot = lambda c: F.floor(F.col(c) / bucket_ns)
    a = activities(events).withColumn("slot", F.floor(F.col("activity.timestamp_ns") / bucket_ns)).withColumnRenamed("session_id", "s3")
    open_slots = met.select("session_id", "tool_use_id", "start_ns", "until", F.explode(F.sequence(slot("start_ns"), slot("until"))).alias("slot2"))
    during = open_slots.join(a, (F.col("session_id") == F.col("s3")) & (F.col("slot") == F.col("slot2")) & F.col("activity.timestamp_ns").between(F.col("start_ns"), F.col("until")))
    during = during.groupBy("session_id", "tool_use_id", "start_ns").agg(F.array_sort(F.collect_list("activity")).alias("os_activities"))
    out = met.join(during, ["session_id", "tool_use_id", "start_ns"], "left")
    return out.withColumn("duration_ms", F.when(F.col("status") == "timeout", F.lit(timeout_ms).cast("bigint")).otherwise(ns_to_ms(F.col("end_ns") - F.col("start_ns")))).drop("until", "end_ns")


def correlate(events: DataFrame, **limits: int) -> DataFrame:
    """All events, and a tool_call_complete event for each tool use."""
    found = tool_uses(events, **limits)
    names = ["tool_use_id", "tool_name", "tool_input", "result_summary", "status", "duration_ms", "os_activities"]
    data = F.to_json(F.struct(F.lit("tool_call_complete").alias("event_type"), *names))
    made = found.select("session_id", F.lit(None).cast("bigint").alias("stream_seq"), F.col("start_ns").alias("timestamp_ns"), F.lit(None).cast("bigint").alias("timestamp_unix_ms"), F.lit("tool_call").alias("source"), "pid", "comm", data.alias("data"))
    return events.unionByName(made.select(*events.columns))

"""Server-sent events of a connection put together to messages."""

from __future__ import annotations

import json
import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions import payload as P
from traceloom.operators.fold import Fold, fold_sorted

HEX = re.compile(r"[0-9a-fA-F]+")
#: Nanoseconds of a connection's time slot, nanoseconds of silence that end a message, bytes that do.
SLOT_NS, IDLE_NS, FULL = 600_000_000_000, 30_000_000_000, 50_000
OUT = T.StructType([T.StructField(n, k) for n, k in (("session_id", T.StringType()), ("stream_seq", T.LongType()), ("timestamp_ns", T.LongType()), ("timestamp_unix_ms", T.LongType()), ("source", T.StringType()), ("pid", T.LongType()), ("comm", T.StringType()), ("data", T.StringType()))])


def is_sse(text: Column) -> Column:
    has = text.contains
    named, data = has("event:"), has("data:")
    return (named & data) | has("text/event-stream") | (has("Transfer-Encoding: chunked") & (named | data)) | (data & (has("\r\n\r\n") | has("\n\n")))


def chunks(text: str) -> list[str]:
    """The line after each line of hexadecimal digits, up to a chunk of size 0; other lines are no content."""
    found, lines = [], iter(text.split("\r\n"))
    for line in lines:
        size = line.strip()
        if size == "0":
            break
        if HEX.fullmatch(size) and (content := next(lines, None)) is not None:
            found.append(content)
    return found


def sse_events(text: str) -> list[dict]:
    """{event, data, id, parsed} of the blocks of a chunked body."""
    events = []
    for block in "\n".join(chunks(text)).split("\n\n"):
        fields: dict[str, list[str]] = {"event": [], "data": [], "id": []}
        for line in map(str.strip, block.split("\n")):
            name, colon, value = line.partition(":")
            if colon and name in fields:
                fields[name].append(value.strip())
        event = {"event": (fields["event"] or [""])[-1], "data": "\n".join(fields["data"]), "id": (fields["id"] or [""])[-1], "parsed": None}
        try:
            parsed = json.loads(event["data"])
            event["parsed"] = parsed if isinstance(parsed, dict) else None
        except ValueError:
            pass
        if event["event"] or event["data"]:
            events.append(event)
    return events


def is_metadata(event: dict) -> bool:
    return event["event"] in ("ping", "heartbeat") or event["data"].strip() in ("", ":")


class Message(Fold):
    """A connection's slot: events gather until message_stop, error, a full buffer or 30 s of silence."""

    def __init__(self, key: tuple, idle_ns: int = IDLE_NS, full: int = FULL):
        super().__init__(key)
        self.events: list[dict] = []
        self.idle_ns, self.full = idle_ns, full

    def add(self, row: dict) -> list[dict]:
        out = self.flush(timed_out=True) if self.events and row["timestamp_ns"] - self.last["timestamp_ns"] > self.idle_ns else []
        new = sse_events(row["text"])
        if not new:  # ordinary traffic
            return [*out, {k: row[k] for k in ("session_id", "stream_seq", "timestamp_ns", "timestamp_unix_ms", "pid", "comm", "data")} | {"source": "ssl"}]
        if all(map(is_metadata, new)):
            return out
        if not self.events:
            self.first, self.text, self.json, self.id = row, "", "", ""
        self.last = row
        for event in new:
            self.events.append(event)
            parsed = event["parsed"] or {}
            delta = parsed.get("delta") if event["event"] == "content_block_delta" else None
            if isinstance(delta, dict):
                part = {"text_delta": delta.get("text"), "thinking_delta": delta.get("thinking")}.get(delta.get("type"))
                self.text += part if isinstance(part, str) else ""
                self.json += delta["partial_json"] if isinstance(delta.get("partial_json"), str) else ""
            message = parsed.get("message") if event["event"] == "message_start" else None
            if not self.id and isinstance(message, dict) and isinstance(message.get("id"), str):
                self.id = message["id"]
        if any(e["event"] in ("message_stop", "error") for e in new) or max(len(self.text.encode()), len(self.json.encode())) > self.full:
            out += self.flush()
        return out

    def flush(self, timed_out: bool = False) -> list[dict]:
        events, self.events = self.events, []
        started = any(e["event"] == "message_start" for e in events)
        if not events or not (started or self.json.strip() or self.text.strip()):
            return []
        content = self.json
        try:
            value = json.loads(content)
            content = json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else content
        except ValueError:
            pass
        first, last = self.first, self.last
        data = {
            "connection_id": f"{first['pid']}:{first['tid']}:{first['slot']}", "message_id": self.id or None, "start_time": first["timestamp_ns"], "end_time": last["timestamp_ns"], "duration_ns": last["timestamp_ns"] - first["timestamp_ns"],
            "original_source": "ssl", "function": first["function"] or "unknown", "tid": first["tid"], "json_content": content, "text_content": self.text, "total_size": len(content.encode()) + len(self.text.encode()),
            "event_count": len(events), "has_message_start": started, "sse_events": [{k: e[k] for k in ("event", "data", "id") if e[k]} | ({"parsed_data": e["parsed"]} if e["parsed"] is not None else {}) for e in events],
        }
        # a message without an end belongs to no process any more
        own = {"pid": 0, "comm": ""} if timed_out else {"pid": last["pid"], "comm": last["comm"]}
        return [{"session_id": first["session_id"], "stream_seq": None, "timestamp_ns": last["timestamp_ns"], "timestamp_unix_ms": last["timestamp_unix_ms"], "source": "sse_processor", **own, "data": json.dumps(data, ensure_ascii=False)}]

    def end(self) -> list[dict]:
        return self.flush(timed_out=True)


KEYS = ["session_id", "pid", "tid", "slot"]


def sse_input(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for the fold, the other events): what can be server-sent events, and what can't."""
    v = P.parsed()
    text = P.text(v, "$.data")
    lines = F.transform(F.split(text, "\r\n"), lambda x: F.trim(x))
    decodes = F.exists(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike("^[0-9a-fA-F]+$") & (x != "0")) & (text.contains("event:") | text.contains("data:"))
    chosen = (F.col("source") == "ssl") & F.coalesce(is_sse(text) & decodes, F.lit(False))
    session = F.col("session_id") if "session_id" in events.columns else F.lit(None).cast("string")
    rows = events.where(chosen).select(session.alias("session_id"), "stream_seq", "timestamp_ns", "timestamp_unix_ms", "pid", "comm", F.coalesce(P.integer(v, "$.tid"), F.lit(0)).alias("tid"), P.text(v, "$.function").alias("function"), text.alias("text"), "data", F.floor(F.col("timestamp_ns") / SLOT_NS).cast("bigint").alias("slot"))
    return rows, events.where(~chosen)


def merge_sse(events: DataFrame, idle_ns: int = IDLE_NS, full: int = FULL) -> DataFrame:
    """ssl events with server-sent events become one sse_processor event a message; all others pass, also those whose
    body turns out to hold no event. Sessions are kept apart.

    Silence is judged in event time, so a log always gives the same messages.
    """
    rows, others = sse_input(events)
    merged = fold_sorted(rows, KEYS, ["timestamp_ns", "stream_seq"], partial(Message, idle_ns=idle_ns, full=full), OUT)
    merged = merged if "session_id" in events.columns else merged.drop("session_id")
    return others.unionByName(merged, allowMissingColumns=True)

"""Tool-call spans: repeated use of one tool on one thing by one thread, until it pauses or lasts too long."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.scalar import file_tool, fnv1a64, ns_to_ms
from traceloom.operators.filters import is_noise
from traceloom.operators.fold import Fold
from traceloom.store import write_table

IDLE_NS, MOST_NS = 1_000_000_000, 60_000_000_000
KEYS = ["session_id", "pid", "tid", "tool_name", "key_field"]
SPAN = T.StructType([T.StructField(n, k) for n, k in (("session_id", T.StringType()), ("pid", T.LongType()), ("comm", T.StringType()), ("tid", T.LongType()), ("tool_name", T.StringType()), ("key_field", T.StringType()), ("args_summary", T.StringType()), ("start_ns", T.LongType()), ("end_ns", T.LongType()), ("calls", T.LongType()), ("status", T.StringType()), ("reason", T.StringType()))])


FIELDS = "event string, filename string, full_command string, filepath string, flags bigint, message_type string, method string, path string, tid bigint, headers map<string,string>"


@dataclass(frozen=True)
class Extractor:
    """Which events of a source are uses of a tool: `use` gets a getter of the payload's fields (texts, "" where absent;
    raw=True for the value itself) and gives what `used` makes, or null. fields: more fields that it reads, as a schema."""

    source: str
    use: Callable[[Callable[..., Column]], Column]
    fields: str = ""


def used(tool: Column, key: Column, args: Column, tid: Column | None = None, at_once: bool = False) -> Column:
    """A use of a tool on a thing; at_once: it is over at once."""
    return F.struct(tool.alias("tool_name"), key.alias("key_field"), (F.lit(0).cast("bigint") if tid is None else tid).alias("tid"), args.alias("args_summary"), F.lit(at_once).alias("at_once"))


def _executed(f: Callable[..., Column]) -> Column:
    args = F.coalesce(F.nullif(f("full_command"), F.lit("")), f("filename"))
    return F.when((f("event") == "EXEC") & (f("filename") != ""), used(F.lit("proc.exec"), f("filename"), args, at_once=True))


def _opened(f: Callable[..., Column]) -> Column:
    flags = F.coalesce(f("flags", raw=True), F.lit(0).cast("bigint"))
    return F.when((f("event") == "FILE_OPEN") & (f("filepath") != "") & ~is_noise(f("filepath")), used(file_tool(flags), f("filepath"), F.format_string("path=%s flags=%d", f("filepath"), flags)))


def _requested(f: Callable[..., Column]) -> Column:
    host = F.coalesce(f("headers", raw=True)["host"], F.lit(""))
    args = F.concat(F.lit("method="), f("method"), F.lit(" host="), host, F.lit(" path="), f("path"))
    return F.when((f("message_type") == "request") & (F.concat(host, f("path")) != ""), used(F.lit("net.http"), F.concat(host, f("path")), args, F.coalesce(f("tid", raw=True), F.lit(0).cast("bigint"))))


#: What counts as a use of a tool; pass a longer list to calls, spans or aggregate_calls for more.
EXTRACTORS = [Extractor("process", _executed), Extractor("process", _opened), Extractor("http_parser", _requested)]


def _fields(extractors: list[Extractor]) -> str:
    return ", ".join([FIELDS, *(x.fields for x in extractors if x.fields)])


def _used(c: str, extractors: list[Extractor]) -> Column:
    """The use of a tool in an event whose payload's fields are in column c, else null."""
    f = lambda name, raw=False: F.col(f"{c}.{name}") if raw else F.coalesce(F.col(f"{c}.{name}").cast("string"), F.lit(""))
    return F.coalesce(*(F.when(F.col("source") == x.source, x.use(f)) for x in extractors))


def calls(events: DataFrame, extractors: list[Extractor] | None = None) -> DataFrame:
    """The tool uses in a log: EXEC, opens of files that are no noise, HTTP requests, or what else extractors tell. One row each."""
    extractors = extractors or EXTRACTORS
    session = F.col("session_id") if "session_id" in events.columns else F.lit(None).cast("string")
    e = events.where(F.col("source").isin(*{x.source for x in extractors})).select(session.alias("session_id"), "timestamp_ns", "stream_seq", "pid", "comm", "source", F.from_json("data", _fields(extractors)).alias("p"))
    e = e.withColumn("c", F.explode(F.array_compact(F.array(_used("p", extractors)))))
    return e.select("session_id", "timestamp_ns", "stream_seq", "pid", "comm", "c.tool_name", "c.key_field", "c.tid", "c.args_summary", "c.at_once")


class Span(Fold):
    """The calls of a key, one after another, as a stream sees them; over a whole log `spans` gives the same."""

    def __init__(self, key: tuple, idle_ns: int = IDLE_NS, most_ns: int = MOST_NS):
        super().__init__(key)
        self.open: dict | None = None
        self.idle_ns, self.most_ns = idle_ns, most_ns

    def _close(self, status: str, reason: str) -> list[dict]:
        span, self.open = self.open, None
        return [span | {"status": status, "reason": reason}] if span else []

    def add(self, row: dict) -> list[dict]:
        now, out = row["timestamp_ns"], []
        if self.open and (row["at_once"] or now - self.open["end_ns"] > self.idle_ns):
            out = self._close("timeout", "idle_gap")
        elif self.open and now > self.open["start_ns"] + self.most_ns:
            out = self._close("timeout", "max_span")
        if not self.open:
            self.open = {k: row[k] for k in (*KEYS, "comm", "args_summary")} | {"start_ns": now, "end_ns": now, "calls": 0}
        self.open |= {"end_ns": now, "calls": self.open["calls"] + 1}
        return out + (self._close("success", "exec") if row["at_once"] else [])

    def end(self) -> list[dict]:
        return self._close("timeout", "flush")

    def idle(self) -> list[dict]:
        return self._close("timeout", "idle_gap")


def _split(long: DataFrame, most_ns: int) -> DataFrame:
    """(island, n): the first calls of the spans of each island, but its first one. long: (island, n, timestamp_ns), n in order.

    From each call a pointer leads to the first call over most_ns later, where the next span would start if one started
    here; the starts are those that pointers reach from call 1. Pointers double and starts with them, so as many
    rounds are needed as the number of spans has digits.
    """
    calls = long.select("island", "n", F.col("timestamp_ns").alias("at"), F.lit(0).alias("ask"))
    asks = long.select("island", "n", (F.col("timestamp_ns") + most_ns).alias("at"), F.lit(1).alias("ask"))
    after = Window.partitionBy("island").orderBy(F.desc("at"), F.desc("ask"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    next_ = F.last(F.when(F.col("ask") == 0, F.col("n")), ignorenulls=True).over(after)
    jump = write_table(calls.unionByName(asks).withColumn("next", next_).where("ask = 1 AND next IS NOT NULL").select("island", "n", "next"), "span-jumps")
    starts = write_table(jump.where("n = 1").select("island", F.col("next").alias("n")), "span-starts")
    while True:
        jump = write_table(jump.join(jump.select("island", F.col("n").alias("next"), F.col("next").alias("__far")), ["island", "next"]).select("island", "n", F.col("__far").alias("next")), "span-jumps")
        # with the pointers of 2^k spans, from call 1 and from the starts known
        here = starts.unionByName(jump.where("n = 1").select("island", "n"))
        more = write_table(here.join(jump, ["island", "n"]).select("island", F.col("next").alias("n")), "span-starts")
        if more.isEmpty():
            return starts
        starts = starts.unionByName(more)


def spans(events: DataFrame, extractors: list[Extractor] | None = None, idle_ns: int = IDLE_NS, most_ns: int = MOST_NS) -> DataFrame:
    """A row a span. A pause of over idle_ns (1 s) of event time ends it, or over most_ns (60 s) since its start; an EXEC is one at once.

    Pauses cut a key's calls into islands by a window; only islands that last over most_ns are searched for the starts of
    further spans.
    """
    order = Window.partitionBy(*KEYS).orderBy("timestamp_ns", "stream_seq")
    new = F.col("at_once") | F.coalesce(F.lag("at_once").over(order) | (F.col("timestamp_ns") - F.lag("timestamp_ns").over(order) > idle_ns), F.lit(True))
    cut = calls(events, extractors).withColumn("__new", new.cast("int")).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    table = write_table(cut, "calls")
    own = [*KEYS, "__island"]
    lasts = table.groupBy(*own).agg((F.max("timestamp_ns") - F.min("timestamp_ns")).alias("__ns")).where(F.col("__ns") > most_ns).drop("__ns")
    long = write_table(lasts.select(*(F.col(c).alias(f"k_{c}") for c in own), F.monotonically_increasing_id().alias("island")), "long-islands")
    numbered = table.withColumn("__span", F.lit(0))
    if not long.isEmpty():
        same = reduce(lambda a, b: a & b, [table[c].eqNullSafe(long[f"k_{c}"]) for c in own])
        place = F.row_number().over(Window.partitionBy("island").orderBy("timestamp_ns", "stream_seq"))
        rows = write_table(table.join(long, same).withColumn("n", place).select(*table.columns, "island", "n"), "long-calls")
        starts = _split(rows.select("island", "n", "timestamp_ns"), most_ns).withColumn("__start", F.lit(1))
        upto = Window.partitionBy("island").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.join(starts, ["island", "n"], "left").withColumn("__span", F.sum(F.coalesce("__start", F.lit(0))).over(upto))
        numbered = table.join(long, same, "left_anti").withColumn("__span", F.lit(0).cast("bigint")).unionByName(rows.select(*table.columns, "__span"))
    first = F.min(F.struct("timestamp_ns", "stream_seq", "comm", "args_summary"))
    found = numbered.groupBy(*own, "__span").agg(first.alias("f"), F.max("timestamp_ns").alias("end_ns"), F.count("*").alias("calls"), F.max("at_once").alias("__once"))
    after = F.lead("__island").over(Window.partitionBy(*KEYS).orderBy("__island", "__span"))
    reason = F.when(F.col("__once"), "exec").when(after == F.col("__island"), "max_span").when(after.isNotNull(), "idle_gap").otherwise("flush")
    found = found.select(*KEYS, "f.comm", "f.args_summary", F.col("f.timestamp_ns").alias("start_ns"), "end_ns", "calls", F.when(F.col("__once"), "success").otherwise("timeout").alias("status"), reason.alias("reason"))
    found = found.select(*(f.name for f in SPAN.fields))
    return found.withColumn("duration_ms", ns_to_ms(F.col("end_ns") - F.col("start_ns"))).withColumn("args_hash", fnv1a64("args_summary"))


def span_events(found: DataFrame) -> DataFrame:
    """The start and the end event of each span, as tool_call envelopes."""
    common = {"tool_name": F.col("tool_name"), "bytes": F.lit(0), "args_hash": F.col("args_hash"), "key_field": F.col("key_field"), "tid": F.col("tid")}
    begin = F.to_json(F.struct(F.lit("tool_call_start").alias("event_type"), *(c.alias(n) for n, c in common.items()), F.col("args_summary")))
    end = F.to_json(F.struct(F.lit("tool_call_end").alias("event_type"), *(c.alias(n) for n, c in common.items()), F.col("status"), F.col("reason"), F.col("duration_ms")))
    both = F.explode(F.array(F.struct(F.col("start_ns").alias("at"), begin.alias("data")), F.struct(F.col("end_ns").alias("at"), end.alias("data"))))
    rows = found.withColumn("__e", both)
    return rows.select("session_id", F.lit(None).cast("bigint").alias("stream_seq"), F.col("__e.at").alias("timestamp_ns"), F.lit(None).cast("bigint").alias("timestamp_unix_ms"), F.lit("tool_call").alias("source"), "pid", "comm", "__e.data")


def aggregate_calls(events: DataFrame, mode: str = "replace", extractors: list[Extractor] | None = None, **limits: int) -> DataFrame:
    """spans_only: the spans' events alone; replace: instead of the events that they come from; append: beside all."""
    made = span_events(spans(events, extractors, **limits))
    made = made if "session_id" in events.columns else made.drop("session_id")
    if mode == "spans_only":
        return made
    if mode == "append":
        return events.unionByName(made)
    extractors = extractors or EXTRACTORS
    others = events.withColumn("__p", F.from_json("data", _fields(extractors))).where(_used("__p", extractors).isNull()).drop("__p")
    return others.unionByName(made)

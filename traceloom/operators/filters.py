"""Filters. The two expression languages name what is dropped: an event that any expression matches goes; an event
whose payload is no JSON stays. Expressions become Columns, so Catalyst can push and fold them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import payload as P
from traceloom.functions.scalar import is_binary

OPERATORS = [">=", "<=", "!=", "=", ">", "<", "~"]
ESCAPES = {r"\r": "\r", r"\n": "\n", r"\t": "\t", r"\\": "\\", r"\"": '"'}


def no() -> Column:
    return F.lit(False)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _split(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside of parentheses."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == mark and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def _compare(value: Column, op: str, wanted) -> Column:
    return {"=": value == wanted, "!=": value != wanted, ">": value > wanted, "<": value < wanted, ">=": value >= wanted, "<=": value <= wanted}.get(op, no())


def _words(value: Column, op: str, wanted: str) -> Column:
    return {"=": value == wanted, "!=": value != wanted, "~": value.contains(wanted)}.get(op, no())


def _ssl_leaf(text: str, v: Column) -> Column:
    op = next((o for o in OPERATORS if o in text), None)
    if op is None:
        return no()
    field, _, wanted = (x.strip() for x in text.partition(op))
    wanted = re.sub(r"\\[rnt\\\"]", lambda m: ESCAPES[m[0]], wanted)
    if field == "data.type":
        return _words(F.when(is_binary(P.text(v, "$.data")), "binary").otherwise(F.when(P.text(v, "$.data").isNotNull(), "text")), op, wanted)
    if field in ("data", "function", "comm"):
        return _words(P.text(v, f"$.{field}"), op, wanted)
    if field in ("is_handshake", "truncated"):
        return P.boolean(v, f"$.{field}").cast("string") == wanted
    if field in ("len", "pid", "tid", "uid", "timestamp_ns"):
        return _compare(P.integer(v, f"$.{field}"), op, int(wanted)) if re.fullmatch(r"[+-]?\d+", wanted) else no()
    if field == "latency_ms":
        try:
            return _compare(P.double(v, "$.latency_ms"), op, float(wanted))
        except ValueError:
            return no()
    return no()


def ssl_expression(text: str, v: Column) -> Column:
    """`|` binds least, then `&`, then parentheses, then `field op value`."""
    text = text.strip()
    if len(parts := _split(text, "|")) > 1:
        return _any([ssl_expression(p, v) for p in parts])
    if len(parts := _split(text, "&")) > 1:
        return _all([ssl_expression(p, v) for p in parts])
    if text.startswith("(") and text.endswith(")"):
        return ssl_expression(text[1:-1], v)
    return _ssl_leaf(text, v) if text else no()


def _http_leaf(text: str, v: Column) -> Column:
    request = P.string(v, "$.message_type") == "request"
    path = P.string(v, "$.path")
    key, eq, wanted = (x.strip() for x in text.partition("="))
    if not eq:
        return request & path.contains(key)
    side, dot, name = key.partition(".")
    name = name if dot else key
    has = lambda c: c.contains(wanted)
    if dot and side.strip() in ("response", "resp", "res"):
        if name in ("status_code", "status", "code"):
            found = P.integer(v, "$.status_code") == int(wanted) if re.fullmatch(r"\d+", wanted) else no()
        elif name in ("status_text", "status_message"):
            found = F.lower(P.string(v, "$.status_text")).contains(wanted.lower())
        elif name in ("content_type", "content-type", "server"):
            found = has(F.try_variant_get(v, "$.headers['" + name.replace("_", "-") + "']", "string"))
        elif name in ("body", "body_contains"):
            found = F.coalesce(P.text(v, "$.body"), F.lit("")).contains(wanted)
        else:
            found = has(F.try_variant_get(v, f"$.headers['{name}']", "string")) if "'" not in name else no()
        return (P.string(v, "$.message_type") == "response") & found
    found = {
        "method": F.upper(P.string(v, "$.method")) == wanted.upper(), "verb": F.upper(P.string(v, "$.method")) == wanted.upper(), "path": path == wanted, "path_exact": path == wanted,
        "path_prefix": path.startswith(wanted), "path_starts_with": path.startswith(wanted), "path_contains": has(path), "path_includes": has(path),
        "host": F.try_variant_get(v, "$.headers.host", "string") == wanted, "hostname": F.try_variant_get(v, "$.headers.host", "string") == wanted,
        "body": has(F.coalesce(P.text(v, "$.body"), F.lit(""))), "body_contains": has(F.coalesce(P.text(v, "$.body"), F.lit(""))),
    }.get(name)
    if found is None:
        found = F.regexp_extract(path, r"(?s)\?(.*)$", 1).contains(f"{name}={wanted}")
    return request & found


def http_expression(text: str, v: Column) -> Column:
    """`|`, then `&`; no parentheses; empty parts count for nothing."""
    groups = [[x.strip() for x in g.split("&") if x.strip()] for g in text.split("|")]
    return _any([_all([_http_leaf(x, v) for x in g]) for g in groups if g])


def _dropping(events: DataFrame, source: str, matches: Column, metric: str | None) -> DataFrame:
    hit = (F.col("source") == source) & F.coalesce(matches, no())
    if metric:
        events = events.observe(metric, F.count("*").alias("total"), F.count_if(hit).alias("filtered"), F.count_if(~hit).alias("passed"))
    return events.where(~hit)


def ssl_filter(events: DataFrame, expressions: list[str], metric: str | None = None) -> DataFrame:
    return _dropping(events, "ssl", _any([ssl_expression(x, P.parsed()) for x in expressions]), metric)


def http_filter(events: DataFrame, expressions: list[str], metric: str | None = None) -> DataFrame:
    return _dropping(events, "http_parser", _any([http_expression(x, P.parsed()) for x in expressions]), metric)


#: Paths that are noise; of /etc/ only the linker's cache is.
NOISE_STARTS = ["/proc/", "/sys/", "/dev/", "/usr/lib/", "/lib/", "/usr/share/", ".git/objects/"]
NOISE_PARTS = [".so.", ".cursor-server/", "/node_modules/", "/.git/objects/"]
NOISE_ENDS = [".so", ".lock", ".pid"]


def is_noise(path: Column) -> Column:
    other = _any([path.startswith(x) for x in NOISE_STARTS] + [path.contains(x) for x in NOISE_PARTS] + [path.endswith(x) for x in NOISE_ENDS])
    return F.when(path.startswith("/etc/"), path.startswith("/etc/ld.so")).otherwise(other)


def keep(events: DataFrame, comm: str | None = None, pid: int | None = None, uid: int | None = None, fds: list[int] | None = None, handshakes: bool = False) -> DataFrame:
    """Exact filters of the collectors; without `handshakes`, ssl handshakes go."""
    v = P.parsed()
    tests = [F.col("comm") == comm if comm else None, F.col("pid") == pid if pid else None, P.integer(v, "$.uid") == uid if uid is not None else None, P.integer(v, "$.fd").isin(fds) if fds else None]
    tests.append(None if handshakes else ~((F.col("source") == "ssl") & F.coalesce(P.boolean(v, "$.is_handshake"), no())))
    return events.where(_all([t for t in tests if t is not None] or [F.lit(True)]))


def min_lifetime(events: DataFrame, ms: int) -> DataFrame:
    """With a least lifetime all EXECs go, and EXITs that are shorter or of unknown start."""
    v = P.parsed()
    kind = F.coalesce(P.text(v, "$.event"), F.lit(""))
    long = F.coalesce(P.integer(v, "$.duration_ms") >= ms, no())
    return events.where((F.col("source") != "process") | ((kind != "EXEC") & ((kind != "EXIT") | long))) if ms > 0 else events


def changed_credentials(events: DataFrame) -> DataFrame:
    """CRED_CHANGE events whose old and new credentials are the same go."""
    v = P.parsed()
    same = (P.text(v, "$.event") == "CRED_CHANGE") & P.string(v, "$.old").eqNullSafe(P.string(v, "$.new"))
    return events.where(~F.coalesce(same, no()))


def comma_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def search(events: DataFrame, text: str = "", source: str | None = None, comm: str | None = None, pid: int | None = None) -> DataFrame:
    """The viewer's filter: equal source, comm and pid, and a text anywhere, whatever its case."""
    tests = [F.col(c) == x for c, x in (("source", source), ("comm", comm), ("pid", pid)) if x not in (None, "")]
    if text:
        tests.append(F.lower(F.concat_ws(" ", "source", "comm", F.col("pid").cast("string"), "data")).contains(text.lower()))
    return events.where(_all(tests)) if tests else events


def tree_filter(events: DataFrame, kinds: list[str] | None = None, sources: list[str] | None = None, commands: list[str] | None = None, models: list[str] | None = None, since: int | None = None, until: int | None = None, text: str = "") -> DataFrame:
    """The process tree's filter over classified events (event_kind, model)."""
    tests = [F.col(c).isin(x) for c, x in (("event_kind", kinds), ("source", sources), ("comm", commands), ("model", models)) if x]
    tests += [F.col("timestamp_unix_ms") >= since] if since is not None else []
    tests += [F.col("timestamp_unix_ms") <= until] if until is not None else []
    events = events.where(_all(tests)) if tests else events
    return search(events, text)

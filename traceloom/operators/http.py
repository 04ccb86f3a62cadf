"""HTTP messages from ssl events, and redaction of their headers; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import payload as P

#: Request methods, header spellings that tell HTTP, headers that carry secrets.
METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT", "TRACE"]
TELLING = ["Content-Type:", "content-type:", "Host:", "host:", "User-Agent:", "user-agent:"]
SECRET = ["authorization", "x-api-key", "x-auth-token", "bearer", "token", "x-access-token", "x-session-token", "cookie", "set-cookie"]


def is_http(text: Column) -> Column:
    method = F.lit(False)
    for m in METHODS:
        method = method | text.contains(f"{m} ")
    telling = F.lit(False)
    for h in TELLING:
        telling = telling | text.contains(h)
    return (text.contains("HTTP/1.") & method) | text.startswith("HTTP/1.") | text.contains("\r\nHTTP/1.") | telling


def parse_http(events: DataFrame, raw: bool = False) -> DataFrame:
    """ssl events that hold an HTTP message become http_parser events; all others pass."""
    v = P.parsed()
    text = P.text(v, "$.data")
    http = (F.col("source") == "ssl") & F.coalesce(is_http(text), F.lit(False))
    lines = F.split(text, "\r\n")
    first = F.element_at("__lines", 1)
    response = first.startswith("HTTP/")
    parts = F.split(first, " ", 3)
    whole = F.size(parts) == 3
    empty = F.array_position("__lines", "").cast("int")
    head = F.when(empty > 0, F.slice("__lines", 2, F.greatest(empty - 2, F.lit(0)))).otherwise(F.slice("__lines", 2, F.greatest(F.size("__lines") - 1, F.lit(0))))
    pairs = F.transform(F.filter(head, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("v")))
    # the last of equal keys wins
    keys = F.array_distinct(F.transform("__pairs", lambda p: p["k"]))
    value = lambda k: F.element_at(F.filter("__pairs", lambda p: p["k"] == k), -1)["v"]
    headers = F.map_from_arrays(keys, F.transform(keys, value))
    body = F.when(empty > 0, F.array_join(F.slice("__lines", empty + 1, F.size("__lines")), "\r\n"))
    body = F.when(F.trim(F.regexp_replace(body, r"\s", "")) != "", body)
    length = F.col("__headers")["content-length"].try_cast("bigint")
    sizes = F.aggregate(F.transform(F.map_entries("__headers"), lambda e: F.octet_length(e["key"]) + F.octet_length(e["value"]) + 4), F.lit(0), lambda a, b: a + b)
    found = events.where(http).withColumn("__text", text).withColumn("__lines", lines).withColumn("__pairs", pairs).withColumn("__headers", headers).withColumn("__body", body)
    message = {
        "tid": F.coalesce(P.integer(v, "$.tid"), F.lit(0)), "message_type": F.when(response, "response").otherwise("request"), "first_line": first,
        "method": F.when(~response & whole, parts[0]), "path": F.when(~response & whole, parts[1]), "protocol": F.when(response, parts[0]).otherwise(F.when(whole, parts[2])),
        "status_code": F.when(response, F.get(parts, F.lit(1)).try_cast("int")), "status_text": F.when(response, F.get(parts, F.lit(2))), "headers": F.col("__headers"), "body": F.col("__body"),
        "total_size": F.octet_length(first) + 4 + sizes + F.coalesce(F.octet_length("__body"), F.lit(0)), "has_body": F.col("__body").isNotNull(),
        "is_chunked": F.coalesce(F.lower(F.col("__headers")["transfer-encoding"]).contains("chunked"), F.lit(False)), "content_length": F.when(length >= 0, length), "original_source": F.lit("ssl"),
    }
    if raw:
        message["raw_data"] = F.col("__text")
    made = found.withColumn("data", F.to_json(F.struct(*(c.alias(n) for n, c in message.items())))).withColumn("source", F.lit("http_parser"))
    return events.where(~http).unionByName(made.select(*events.columns))


def remove_auth(events: DataFrame) -> DataFrame:
    """http_parser events without the headers that carry secrets; bodies stay as they are.

    The payload is built anew from its parsed fields, whatever its spelling. Headers that are no object stay, as
    they name none; a payload that is no JSON object but tells of headers is dropped, as nothing can be taken out of it.
    """
    fields = F.from_json("data", "map<string,variant>")
    headers = F.from_json(F.try_variant_get(F.col("__f")["headers"], "$", "string"), "map<string,variant>")
    kept = F.map_filter(F.col("__h"), lambda k, _: ~F.lower(k).isin(SECRET))
    redacted = F.to_json(F.map_concat(F.map_filter("__f", lambda k, _: k != "headers"), F.create_map(F.lit("headers"), F.parse_json(F.to_json(kept)))))
    http = F.coalesce(F.col("source") == "http_parser", F.lit(False))
    rows = events.withColumn("__f", F.when(http, fields)).withColumn("__h", F.when(http, headers))
    unread = http & F.col("__f").isNull() & F.lower("data").contains("headers")
    data = F.when(F.col("__h").isNotNull(), redacted).when(unread, "{}").otherwise(F.col("data"))
    return rows.withColumn("data", data).drop("__f", "__h")

"""Scalar functions shared by the operators."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trim_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_binary(c: Column) -> Column:
    """Holds a control character other than line feed, return and tab."""
    return c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def hex_text(c: Column) -> Column:
    """Text as it is; binary as HEX: and its bytes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_binary(c), F.concat(F.lit("HEX:"), F.lower(F.hex(F.encode(c, "UTF-8"))))).otherwise(c)


def ns_to_ms(ns: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(ns / 1_000_000)).cast("bigint")


def file_tool(flags: Column) -> Column:
    """fs.read for read-only opens, else fs.write."""
    return F.when(flags.bitwiseAND(3) == 0, "fs.read").otherwise("fs.write")


def ipv4_text(n: Column) -> Column:
    """An address kept in network order in a little-endian integer."""
    return F.concat_ws(".", *(F.shiftright(n, 8 * i).bitwiseAND(255).cast("string") for i in range(4)))


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.2fs", ms / 1000)).otherwise(F.format_string("%dm %ds", F.floor(ms / 60_000), F.floor(F.pmod(ms, F.lit(60_000)) / 1000)))


def size_text(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


@F.pandas_udf(T.StringType())
def fnv1a64(s: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, 64 bits, as hexadecimal without leading zeros; all texts at once, byte by byte."""
    raw = [x.encode() if isinstance(x, str) else b"" for x in s]
    size = np.array([len(x) for x in raw])
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    data, start = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    for i in range(int(size.max()) if len(size) else 0):
        on = order[: np.searchsorted(-size[order], -i, side="left")]
        h[on] = (h[on] ^ data[start[on] + i]) * np.uint64(0x100000001B3)
    return pd.Series([None if x is None or x is pd.NA else f"{int(v):x}" for x, v in zip(s, h, strict=True)])


@F.pandas_udf(T.StringType())
def sanitize(raw: pd.Series) -> pd.Series:
    """Bytes as text: valid UTF-8, tabs and line ends stay; any other byte becomes \\u00 and two digits."""
    odd = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\udc80-\udcff]")
    return raw.map(lambda b: None if b is None else odd.sub(lambda m: f"\\u00{ord(m[0]) & 0xFF:02x}", bytes(b).decode("utf-8", "surrogateescape")))


#: Networks whose addresses count as private.
PRIVATE = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "::1/128", "fc00::/7"]


V4 = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"


def _v4(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    return sum((F.get(octets, F.lit(i)).try_cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hextets(ip: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address, which may end in an IPv4 one; null for other texts."""
    tail = lambda x: let(_v4(F.regexp_extract(x, rf":({V4})$", 1)), lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535)))))
    whole = let(F.lower(ip), lambda x: F.when(x.rlike(rf":{V4}$"), F.concat(F.regexp_replace(x, rf"{V4}$", ""), tail(x))).otherwise(x))
    groups = lambda half: F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def numbers(halves: Column, left: Column, right: Column) -> Column:
        n = F.size(left) + F.size(right)
        sound = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(F.size(halves) == 2, n < 8).otherwise((F.size(halves) == 1) & (n == 8))
        all_ = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
        return F.when(sound, F.transform(all_, lambda g: F.conv(g, 16, 10).cast("int")))

    return let(F.split(whole, "::"), lambda h: let(groups(F.get(h, F.lit(0))), lambda a: let(groups(F.get(h, F.lit(1))), lambda b: numbers(h, a, b))))


def ipv6_text(words: Column) -> Column:
    """Eight 16-bit numbers as text: lower case, without leading zeros, the longest run of two or more zeros as ::."""

    def short(full: Column) -> Column:
        out = full
        for n in range(2, 9):  # the longest, and of these the first
            zeros = ":".join("0" * n)
            out = F.when(full.rlike(rf"(?:^|:){zeros}(?:$|:)"), F.regexp_replace(full, rf"^(.*?)(?:^|:){zeros}(?:$|:)(.*)$", "$1::$2")).otherwise(out)
        return out

    return let(F.array_join(F.transform(words, lambda w: F.lower(F.hex(w))), ":"), short)


def is_private(ip: Column) -> Column:
    """In a private network; what is no address is not. An IPv6 address that wraps an IPv4 one counts as that."""
    ranges = [(int(x.network_address), int(x.broadcast_address)) for x in map(ipaddress.ip_network, PRIVATE) if x.version == 4]
    inside = lambda n: reduce(lambda a, b: a | b, (n.between(lo, hi) for lo, hi in ranges))

    def six(h: Column) -> Column:
        at = lambda i: F.get(h, F.lit(i))
        mapped = F.forall(F.slice(h, 1, 5), lambda x: x == 0) & (at(5) == 65535)
        loop = F.forall(F.slice(h, 1, 7), lambda x: x == 0) & (at(7) == 1)
        return F.when(mapped, let(at(6).cast("bigint") * 65536 + at(7), inside)).otherwise((at(0).bitwiseAND(0xFE00) == 0xFC00) | loop)

    return F.coalesce(F.when(ip.contains(":"), let(hextets(ip), six)).when(ip.rlike(f"^{V4}$"), let(_v4(ip), inside)), F.lit(False))

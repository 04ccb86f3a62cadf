"""Getters over the JSON payload of an event, parsed once to VARIANT; null where a value is absent or of another kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(data: str = "data") -> Column:
    return F.try_parse_json(data)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def string(v: Column, path: str) -> Column:
    """A JSON string as it is, any other value as its JSON text."""
    return F.try_variant_get(v, path, "string")


def text(v: Column, path: str) -> Column:
    """JSON strings only."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def double(v: Column, path: str) -> Column:
    """A number, or a string that parses as one."""
    return F.try_variant_get(v, path, "double")


def integer(v: Column, path: str, kind: str = "bigint") -> Column:
    """Numbers only, truncated; strings give null."""
    number = _kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    whole = F.coalesce(F.try_variant_get(v, path, "bigint"), F.try_variant_get(v, path, "double").try_cast("bigint"))
    return F.when(number, whole).try_cast(kind)


def unsigned16(v: Column, path: str) -> Column:
    return F.pmod(integer(v, path), F.lit(65536)).cast("int")


def boolean(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def sequence(v: Column, path: str) -> Column:
    """A stream sequence: a number or its text."""
    return F.trim(F.try_variant_get(v, path, "string")).try_cast("decimal(20,0)").try_cast("bigint")


def defined(v: Column, path: str) -> Column:
    """The path is there, be it a JSON null."""
    return F.coalesce(F.try_variant_get(v, path, "variant").isNotNull(), F.lit(False))


def truthy(v: Column, *paths: str) -> Column:
    """One of the values is there and is no null, false, 0 or empty text."""
    found = F.lit(False)
    for path in paths:
        kind = F.coalesce(_kind(v, path), F.lit("VOID"))
        one = F.when(kind == "VOID", False).when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean")).when(kind == "STRING", F.try_variant_get(v, path, "string") != "")
        one = one.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double") != 0).otherwise(True)
        found = found | F.coalesce(one, F.lit(False))
    return found

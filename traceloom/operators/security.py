"""Security rules over process events: each event gives the alerts of the rules that it meets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import payload
from traceloom.functions.scalar import is_private

#: Parts of paths that are sensitive, in lower case.
SENSITIVE = ["/etc/passwd", "/etc/shadow", "/etc/sudoers", ".env", ".ssh/", "id_rsa", "id_ed25519", "credentials", "secret", ".aws/", ".kube/config", "/proc/self/"]
#: Patterns of dangerous commands.
DANGEROUS = [r"\brm\s+(-[^\s]*)?-r", r"\bchmod\s+777\b", r"\bcurl\b.*\|\s*\bbash\b", r"\bwget\b.*\|\s*\bbash\b", r"\bmkfifo\b", r"\bnc\s+-[^\s]*l", r"/dev/tcp/", r"\bdd\s+.*of=/dev/", r">\s*/etc/"]
#: Ports that raise no alert.
COMMON_PORTS = [22, 53, 80, 443, 1080, 3000, 3001, 3306, 5000, 5173, 5174, 5432, 6379, 7890, 7891, 7892, 7893, 7897, 8000, 8080, 8443, 8888, 9090, 9200, 9300, 10808, 10809]
#: What strict=True adds: recursive removal in any order of flags, and pipes into any shell.
STRICT = [r"\brm\s+(?:-\S+\s+)*-\w*[rR]", r"\brm\s+.*--recursive", r"\b(?:curl|wget)\b.*\|\s*(?:\w*/)*(?:ba|z|da|k)?sh\b"]


@dataclass(frozen=True)
class Rule:
    """detail: over the parsed payload `v` and `comm`, the text of what meets the rule, else null."""

    name: str
    risk: str
    detail: Callable[[Column], Column]
    description: Callable[[Column, Column], Column]


def sensitive(path: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SENSITIVE)), lambda p: F.contains(F.lower(path), p))


def dangerous(command: Column, strict: bool = False) -> Column:
    """(?d): a line ends at a line feed alone."""
    return command.rlike("(?d)" + "|".join(DANGEROUS + (STRICT if strict else [])))


def _event(v: Column) -> Column:
    return payload.text(v, "$.event")


def _file_detail(v: Column) -> Column:
    paths = F.array(*(payload.text(v, f"$.{k}") for k in ("filepath", "oldpath", "newpath")))
    hit = F.filter(paths, lambda p: p.isNotNull() & (p != "") & sensitive(p))
    return F.when(_event(v).isin("FILE_OPEN", "FILE_DELETE", "FILE_RENAME"), F.get(hit, F.lit(0)))


def _command_detail(v: Column, strict: bool = False) -> Column:
    command = payload.text(v, "$.full_command")
    return F.when((_event(v) == "EXEC") & (command != "") & dangerous(command, strict), command)


def _port_detail(v: Column) -> Column:
    ip, port = F.coalesce(payload.text(v, "$.ip"), F.lit("")), payload.integer(v, "$.port")
    return F.when((_event(v) == "NET_CONNECT") & (port != 0) & ~port.isin(COMMON_PORTS) & ~is_private(ip), F.concat(ip, F.lit(":"), port.cast("string")))


def rules(strict: bool = False) -> list[Rule]:
    return [
        Rule("sensitive_file_access", "high", _file_detail, lambda comm, d: F.concat(comm, F.lit(" accessed sensitive file: "), d)),
        Rule("dangerous_command", "critical", lambda v: _command_detail(v, strict), lambda comm, d: F.concat(comm, F.lit(" executed dangerous command: "), d)),
        Rule("credential_change", "high", lambda v: F.when(_event(v) == "CRED_CHANGE", F.lit("")), lambda comm, d: F.concat(comm, F.lit(" triggered credential change"))),
        Rule("suspicious_network", "medium", _port_detail, lambda comm, d: F.concat(comm, F.lit(" connected to unusual port "), d)),
    ]


def alerts(events: DataFrame, chosen: list[Rule] | None = None) -> DataFrame:
    """The alerts alone, as envelopes of source `security` that carry the time, pid, comm and sequence of their event.

    A rule gives at most one alert an event; events of other sources than `process` give none.
    """
    chosen = chosen if chosen is not None else rules()
    base = events.where("source = 'process'").withColumn("__v", payload.parsed())
    comm = F.coalesce("comm", F.lit(""))
    details = base.select("*", *(rule.detail(F.col("__v")).alias(f"__d{i}") for i, rule in enumerate(chosen)))
    hits = F.array_compact(F.array(*(F.when(F.col(f"__d{i}").isNotNull(), F.struct(F.lit(r.name).alias("alert_type"), F.lit(r.risk).alias("risk_level"), r.description(comm, F.col(f"__d{i}")).alias("description"), F.col(f"__d{i}").alias("detail"))) for i, r in enumerate(chosen))))
    found = details.withColumn("__hit", F.explode(hits))
    evidence = F.array(F.struct(F.lit("events_process").alias("source_table"), _event(F.col("__v")).alias("event_type"), F.col("pid"), F.col("comm"), F.col("timestamp_ns"), F.when(F.col("__hit.detail") != "", F.col("__hit.detail")).alias("detail")))
    data = F.to_json(F.struct("__hit.alert_type", "__hit.risk_level", "__hit.description", F.lit("events_process").alias("source_table"), F.col("stream_seq").cast("string").alias("source_stream_seq"), evidence.alias("evidence")))
    return found.withColumn("data", data).withColumn("source", F.lit("security")).select(*events.columns)


def analyze(events: DataFrame, chosen: list[Rule] | None = None) -> DataFrame:
    """All events as they are, and the alerts."""
    return events.unionByName(alerts(events, chosen))

"""The query API: what the endpoints answer, as DataFrames; and free SQL that only reads."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.plans import views
from traceloom.plans.views import Tables

CAP = 10_000


def parse_limit(text: str | int | None, default: int) -> int:
    """Blank, wrong or not positive: the default; never over the cap."""
    try:
        n = int(str(text).strip())
    except ValueError:
        return default
    return default if n <= 0 else min(n, CAP)


def _of(df: DataFrame, session_id: str | None) -> DataFrame:
    return df.where(F.col("session_id") == session_id) if session_id else df


def overview(t: Tables, session_id: str | None = None, corrected: bool = True) -> DataFrame:
    return _of(views.session_overview(t, corrected), session_id)


def tool_call_stats(t: Tables, session_id: str | None = None) -> DataFrame:
    return _of(views.tool_call_stats(t), session_id)


def tool_call_latency(t: Tables, session_id: str | None = None) -> DataFrame:
    rows = _of(t["events_tool_call"].where("duration_ms IS NOT NULL"), session_id)
    d = "duration_ms"
    out = views.with_quantiles(rows, ["session_id", "tool_name"], d, F.round(F.avg(d), 6).alias("avg_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), F.count("*").alias("sample_count"))
    return out.orderBy(F.desc("p99_ms"), "session_id", "tool_name")


def process_tree(t: Tables, session_id: str | None = None) -> DataFrame:
    rows = _of(t["events_process"].where(F.col("event_type").isin("EXEC", "EXIT")), session_id)
    return rows.select("pid", "ppid", "comm", "filename", "full_command", "event_time", "exit_code", "duration_ms", "event_type", "session_id").orderBy("event_time", "pid")


def resources(t: Tables, session_id: str | None = None) -> DataFrame:
    """CPU and memory; the session is filtered before the sort."""
    return _of(views.resource_timeseries(t), session_id).orderBy("bucket", "session_id", "pid")


def hot_files(t: Tables, session_id: str | None = None, limit: str | int | None = None) -> DataFrame:
    return _of(views.hot_files(t), session_id).orderBy(F.desc("access_count"), "session_id", "file_path").limit(parse_limit(limit, 100))


def network_connections(t: Tables, session_id: str | None = None) -> DataFrame:
    return _of(views.network_analysis(t), session_id).orderBy(F.desc("connection_count"), "session_id", "net_ip", "net_port")


def security_alerts(t: Tables, session_id: str | None = None, limit: str | int | None = None, id: str | int | None = None) -> DataFrame:  # noqa: A002
    """By id: that alert, or LookupError; an id that is no number: ValueError."""
    rows = views.security_alerts(t)
    if id is not None and str(id).strip():
        if not re.fullmatch(r"\d+", str(id).strip()):
            raise ValueError("invalid id")
        found = rows.where(F.col("id") == int(str(id).strip()))
        if found.isEmpty():
            raise LookupError("alert not found")
        return found
    return _of(rows, session_id).orderBy(F.desc("event_time"), "id").limit(parse_limit(limit, 1000))


def sensitive_access(t: Tables, session_id: str | None = None) -> DataFrame:
    return _of(views.exfiltration_risk(t), session_id).orderBy("alert_time", "session_id", "pid")


def sessions(t: Tables) -> DataFrame:
    return t["sessions"].select("session_id", "start_time", "end_time").orderBy(F.desc("start_time"), "session_id")


def timeline(t: Tables, session_id: str | None = None, source: str | None = None, limit: str | int | None = None) -> DataFrame:
    rows = views.timeline(t, source)
    if rows is None:
        return views.timeline(t, "ssl").limit(0)
    return _of(rows, session_id).orderBy(F.desc("event_time"), "id").limit(parse_limit(limit, 1000))


#: What a statement may consist of, as parsed and as analysed; anything else is refused.
PARSED = set("""Project Filter Join LateralJoin Aggregate Sort GlobalLimit LocalLimit Offset Union Intersect Except Distinct Window Generate Pivot Unpivot Sample SubqueryAlias OneRowRelation LocalRelation
  UnresolvedRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith UnresolvedHaving UnresolvedHint UnresolvedSubqueryAlias WithWindowDefinition""".split())
ANALYSED = set("""Project Filter Join LateralJoin Aggregate Sort GlobalLimit LocalLimit Offset Union Intersect Except Distinct Deduplicate Window Generate Pivot Unpivot Expand Sample SubqueryAlias OneRowRelation LocalRelation
  Range ResolvedHint WithCTE CTERelationDef CTERelationRef""".split())
#: Table functions that make rows of their arguments alone.
TABLE_FUNCTIONS = set("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
#: Built-in functions that call into the JVM by name or tell of files, users and the host.
CALLS = set("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user from_avro to_avro from_protobuf to_protobuf".split())


def _nodes(spark: SparkSession, plan, known: Callable[[str, object], bool]) -> Iterator[tuple[str, object, bool]]:  # noqa: ANN001
    """Name, node and whether it is a plan, of all plans and expressions of a statement, those of subqueries and WITH too;
    below a relation that is known by name nothing is looked at."""
    kind = lambda name: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")
    logical, query = kind("plans.logical.LogicalPlan"), kind("expressions.PlanExpression")
    todo = [plan]
    while todo:
        node = todo.pop()
        name, is_plan = node.getClass().getSimpleName(), logical.isInstance(node)
        if is_plan and known(name, node):
            continue
        yield name, node, is_plan
        lists = [node.children(), node.innerChildren()] + ([node.expressions()] if is_plan else [])
        todo += [x.apply(i) for x in lists for i in range(x.size())]
        if query.isInstance(node):
            todo.append(node.plan())


def _refuse(why: str) -> None:
    raise PermissionError(why)


def _check_parsed(spark: SparkSession, plan) -> None:  # noqa: ANN001
    builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for name, node, is_plan in _nodes(spark, plan, lambda *_: False):
        if "UnresolvedIdentifier" in name or name in ("NamedParameter", "IdentifierClause"):
            _refuse("names must stand in the statement itself")
        if is_plan and name not in PARSED:
            _refuse(f"{name} is not allowed")
        parts = [node.nameParts().apply(i) for i in range(node.nameParts().size())] if name == "UnresolvedFunction" else []
        if name == "UnresolvedFunction" and (len(parts) > 1 or parts[0].lower() in CALLS or not builtin.functionExists(identifier(parts[0].lower()))):
            _refuse(f"function {'.'.join(parts)} is not allowed")
        if name == "UnresolvedTableValuedFunction" and (node.name().size() > 1 or node.name().apply(0).lower() not in TABLE_FUNCTIONS):
            _refuse("this table function is not allowed")
        if name == "UnresolvedRelation":
            parts = [node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())]
            if node.isStreaming() or (len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{x.replace('`', '``')}`" for x in parts))):
                _refuse("only known tables can be read")


def _registered(name: str, node) -> bool:  # noqa: ANN001
    """A view, or a relation that the catalog holds as a table."""
    return name == "View" or (name == "LogicalRelation" and node.catalogTable().isDefined()) or name == "HiveTableRelation"


def free_sql(spark: SparkSession, sql: str, params: list | None = None) -> DataFrame:
    """A single SELECT or WITH, with ? for params, over views and tables known by name.

    What a statement may consist of is listed, first as it is parsed (nothing is resolved or run before that), then as it is
    analysed: relational operators, built-in functions that only compute, and registered relations. Anything else is
    refused: scripts of TRANSFORM, names made by IDENTIFIER, files read by path, user-defined functions, calls into the JVM.
    """
    if not re.match(r"\s*(SELECT|WITH)\b", sql, re.I):
        raise PermissionError("only SELECT and WITH are allowed")
    _check_parsed(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))
    out = spark.sql(sql, args=params or [])
    for name, _, is_plan in _nodes(spark, out._jdf.queryExecution().analyzed(), _registered):
        if (is_plan and name not in ANALYSED) or name.endswith("UDF") or "Reflect" in name or name == "PythonUDAF":
            _refuse(f"{name} is not allowed")
    return out


def register(t: Tables) -> None:
    """Tables and views by their names, for free SQL."""
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    made = {
        "v_session_overview": views.session_overview, "v_tool_call_stats": views.tool_call_stats, "v_process_lifecycle": views.process_lifecycle, "v_security_alerts": views.security_alerts,
        "v_resource_timeseries": views.resource_timeseries, "v_network_analysis": views.network_analysis, "v_hot_files": views.hot_files, "v_exfiltration_risk": views.exfiltration_risk,
    }
    for name, view in made.items():
        view(t).createOrReplaceTempView(name)


def to_maps(df: DataFrame) -> dict:
    """{data, count}, row by row."""
    data = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    return {"data": data, "count": len(data)}

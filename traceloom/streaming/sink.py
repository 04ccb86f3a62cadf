"""Writers of typed tables: a batch, or each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from traceloom.functions.scalar import hex_text, is_binary
from traceloom.functions import payload as P
from traceloom.operators.project import SLOTS, typed
from traceloom.operators.ranks import row_numbers
from traceloom.schema import TABLES
from traceloom.store import write_table

BATCH = "batch_id bigint, last_id bigint"


def write_tables(events: DataFrame, path: str, batch_id: int = 0, tables: list[str] | None = None, dense: bool = False) -> None:
    """Appends each table's rows under path/<table>/batch=<id>/session_id=<id>; a batch that is written again replaces
    itself, and path/_batches gets its id last, so readers can tell complete batches.

    dense: ids are 1, 2, 3 ... over all tables and batches, in the order of the sparse ones; path/_batches holds how far
    each batch came, a batch begins after those of smaller id, and one that is written again gets the same ids.
    """
    spark = events.sparkSession
    events = events.persist()
    try:
        made, last = {t: typed(events, t) for t in tables or list(SLOTS)}, None
        if dense:
            before = _batches(spark, path).where(F.col("batch_id") < batch_id).agg(F.max("last_id")).first()[0] or 0
            made, last = dense_ids(made, before)
        for table, rows in made.items():
            rows.write.mode("overwrite").partitionBy("session_id").parquet(f"{path}/{table}/batch={batch_id}")
        spark.createDataFrame([(batch_id, last)], BATCH).coalesce(1).write.mode("overwrite").parquet(f"{path}/_batches/batch={batch_id}")
    finally:
        events.unpersist()


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """A row per complete batch; none if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_batches")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(BATCH).parquet(f"{path}/_batches") if there else spark.createDataFrame([], BATCH)


def dense_ids(tables: dict[str, DataFrame], before: int = 0) -> tuple[dict[str, DataFrame], int]:
    """The tables with ids before + 1, before + 2, ... in order of time and id, and the last of them; rows that share an id share the new
    one. Numbers come from counts by ranges, so no task holds all ids. Links of alerts follow where their event is among the tables.
    The numbers have a row per event and a small file, which Spark would take for small enough to broadcast: all joins are merged."""
    keys = reduce(DataFrame.unionByName, [t.select("id", "timestamp_ns") for t in tables.values()]).groupBy("id").agg(F.min("timestamp_ns").alias("at"))
    numbers = write_table(row_numbers(keys, [], ["at", "id"], "n").select("id", (F.col("n") + before).alias("__new")), "dense-ids")
    last = numbers.agg(F.max("__new")).first()[0] or before
    numbers, out = numbers.hint("merge"), {}
    for name, t in tables.items():
        rows = t.join(numbers, "id").withColumn("id", F.col("__new")).drop("__new")
        if "source_event_id" in t.columns:
            of = numbers.select(F.col("id").alias("source_event_id"), F.col("__new").alias("__of")).hint("merge")
            rows = rows.join(of, "source_event_id", "left").withColumn("source_event_id", F.coalesce("__of", "source_event_id")).drop("__of")
        out[name] = rows.select(*t.columns)
    return out, last


def read_tables(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The rows of complete batches; Spark prunes sessions and batches by their folders."""
    done = _batches(spark, path).select(F.col("batch_id").alias("batch")).distinct()
    out = {}
    for table in tables or list(SLOTS):
        rows = spark.read.schema(f"{TABLES[table]}, batch bigint").option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
        out[table] = rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")  # a row per batch
    return out


def stream_tables(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Typed tables of a stream, every 5 seconds unless told otherwise; exactly once by the batch's id."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"}))
    return writer.foreachBatch(lambda df, i: write_tables(df, path, i)).start()


def fan_out(events: DataFrame, checkpoint: str, *sinks, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch to several writers of (DataFrame, batch id)."""

    def each(df: DataFrame, i: int) -> None:
        df.persist()
        try:
            for sink in sinks:
                sink(df, i)
        finally:
            df.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).foreachBatch(each).start()


def log_lines(events: DataFrame) -> DataFrame:
    """Events as lines of JSON; a payload whose `data` is binary has it as HEX, built anew from its fields."""
    fields, text = F.from_json("data", "map<string,variant>"), P.text(P.parsed(), "$.data")
    rest = F.map_filter("__f", lambda k, _: k != "data")
    made = F.to_json(F.map_concat(rest, F.create_map(F.lit("data"), F.parse_json(F.concat(F.lit('"'), hex_text("__t"), F.lit('"'))))))
    rows = events.withColumn("__t", text).withColumn("__f", F.when(is_binary(text), fields))
    rows = rows.withColumn("data", F.when(F.col("__f").isNotNull(), made).otherwise(F.col("data")))
    return rows.select(F.to_json(F.struct(*events.columns)).alias("value"))


def console(events: DataFrame, write: Callable[[str], object] = print) -> int:
    """Writes events as lines, in order of time, as they come from the executors; returns how many there were."""
    n = 0
    for row in log_lines(events.orderBy("timestamp_ns", "stream_seq")).toLocalIterator():
        write(row["value"])
        n += 1
    return n


def write_log(events: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    log_lines(events).write.mode("append").option("maxRecordsPerFile", per_file).text(path)


def keep_logs(spark: SparkSession, root: str, most: int = 5) -> list[str]:
    """Removes all but the `most` latest logs (folders under root, by their time); returns the names of those removed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(path) if s.isDirectory()), reverse=True)
    for _, name in found[most:]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
    return [name for _, name in found[most:]]


def new_session(spark: SparkSession, pid: int, started: datetime, **columns: str) -> DataFrame:
    row = {"session_id": f"{started:%Y%m%d-%H%M%S}-{pid}", "start_time": started, "end_time": None} | dict.fromkeys(("comm_filter", "binary_path", "hostname", "kernel_version", "labels")) | columns
    return spark.createDataFrame([row], TABLES["sessions"])


def add_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New sessions beside the old; one that is there already stays as it is."""
    return old.unionByName(new.join(old, "session_id", "left_anti"))


def close_session(sessions: DataFrame, session_id: str, ended: datetime) -> DataFrame:
    return sessions.withColumn("end_time", F.when(F.col("session_id") == session_id, F.lit(ended).cast("timestamp_ntz")).otherwise(F.col("end_time")))


def clear_alerts(spark: SparkSession, path: str) -> int:
    """Removes all alerts under a table's path; returns how many there were."""
    n = spark.read.parquet(path).count()
    spark.createDataFrame([], TABLES["events_security"]).write.mode("overwrite").parquet(path)
    return n

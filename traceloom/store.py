"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a temporary one, in a session of one machine only."""
    folder = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if folder:
        return folder
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="traceloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/traceloom/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    return read_table(df.sparkSession, save_table(df, label), df)


def save_table(df: DataFrame, label: str) -> str:
    """Spark drops the shuffle files of this write when it ends: later plans read the table instead."""
    conf, path = df.sparkSession.conf, new_path(df.sparkSession, label)
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return path


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table of this module that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables(spark: SparkSession) -> None:
    """Removes all intermediate tables under the session's shared folder; call it when no result is read any more."""
    drop_table(spark, f"{shared_dir(spark).rstrip('/')}/traceloom")

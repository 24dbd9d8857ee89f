"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="panel-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    The result has no lineage and a known size, so a lost executor costs a
    re-read and the adaptive planner sees real statistics.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/panel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._panel_path = path
    return table


def kept_table(df: DataFrame, path: str) -> DataFrame:
    """Rows written under a name of their own, so that a later session finds them; read back like ``materialized``."""
    df.write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._panel_path = path
    return table


def latest_table(spark: SparkSession, folder: str, schema) -> tuple[DataFrame, int] | None:
    """The last complete table ``round-<number>`` in a folder, and its number; None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(place):
        return None
    found = [str(f.getPath().toString()) for f in files.listStatus(place)]
    done = [f for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
    if not done:
        return None
    path = max(done, key=lambda f: int(f.rsplit("-", 1)[1]))
    table = spark.read.schema(schema).parquet(path)
    table._panel_path = path
    return table, int(path.rsplit("-", 1)[1])


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialized`` wrote and that nothing will read any more."""
    for table in tables:
        path = getattr(table, "_panel_path", None)
        if path:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)

"""Tables and settings that the text operators share."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.sources.storage import shared_folder


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this library where it lies beside the driver's; a cluster has it installed."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    held = environment.get("PYTHONPATH", "")
    if root not in held.split(":"):
        environment["PYTHONPATH"] = f"{root}:{held}".rstrip(":")


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id and text of all documents, and the named further columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *more)


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: no lineage, a known size."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/text-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sha256_hex(text) -> F.Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)

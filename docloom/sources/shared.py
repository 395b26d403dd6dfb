"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local default only where it is unset, as in local mode."""
    return spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

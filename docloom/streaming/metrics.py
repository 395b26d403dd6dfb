"""Streaming counterparts: tumbling metrics, sessions, first rows of a key, and appending new documents.

Late rows are dropped once the watermark has passed them.  Each function takes a
streaming or a batch DataFrame; on a batch it gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of events as a stream; ``ts`` becomes a timestamp in the session's zone, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of each window."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): events of a user less than ``gap`` apart; the end is the last event's time plus the gap."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first row of each key inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def append_new(batch: DataFrame, path: str, key: str) -> None:
    """For ``foreachBatch``: appends rows whose key the table at ``path`` lacks."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    known = spark._jvm.org.apache.hadoop.fs.Path(path)
    if known.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(known):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)

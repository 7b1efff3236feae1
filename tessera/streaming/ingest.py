"""Structured Streaming ingest for the append-only history tables.

New record files landing in a folder are appended to a Parquet table with
exactly-once semantics (the checkpoint records which files were committed),
so a restarted or partially failed job neither loses nor duplicates
history rows. ``available_now`` processes everything present and stops,
which is how a scheduled batch job would run it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ingest(spark: SparkSession, landing_dir: str, schema: T.StructType | str, table_path: str,
           checkpoint_path: str, fmt: str = "json", partition_by: list[str] | None = None,
           available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    src = spark.readStream.format(fmt).schema(schema).load(landing_dir)
    w = (src.writeStream.format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def ingest_now(spark: SparkSession, landing_dir: str, schema, table_path: str, checkpoint_path: str,
               fmt: str = "json", partition_by: list[str] | None = None, timeout_s: int = 600) -> DataFrame:
    """Process every landed file once, then read the table."""
    q = ingest(spark, landing_dir, schema, table_path, checkpoint_path, fmt, partition_by, True)
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(table_path)

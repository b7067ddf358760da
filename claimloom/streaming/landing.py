"""An extension: bundles that arrive in a landing folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, ddl: str, time: str = "arrived", late: str = "1 hour") -> DataFrame:
    """New JSON lines of a folder, each document's hash once within the watermark."""
    return spark.readStream.schema(ddl).json(path).withWatermark(time, late).dropDuplicatesWithinWatermark(["sha256"])


def issue_counts(issues: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Issues for each window and severity."""
    return issues.withWatermark(time, late).groupBy(F.window(time, window), "severity").agg(F.count("*").alias("n"))


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there now to a Parquet folder, each row once."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

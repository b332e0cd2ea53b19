"""Run logs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_name, value), one row per line of every file the path or glob
    names. Large files are split over tasks by Spark."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")

"""The run summary, kept up to date while runs finish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evenkeel.operators.runs import label_runs, parse_results, result_lines


def follow_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value) of every log that appears under a path or glob. A log
    is picked up once, so move it there when its run is over."""
    lines = spark.readStream.text(path)
    return lines.select(F.col("_metadata.file_name").alias("file_name"), "value")


def follow_summary(
    logs: DataFrame, path: str, checkpoint: str, until_caught_up: bool = False
) -> StreamingQuery:
    """Append the results of new logs to the summary table at ``path``. The
    checkpoint makes a restart go on where the query stopped, with no line
    lost or written twice."""
    results = parse_results(label_runs(result_lines(logs))).drop("file_name")
    writer = (
        results.writeStream.outputMode("append")
        .partitionBy("variant")
        .option("checkpointLocation", checkpoint)
    )
    if until_caught_up:
        writer = writer.trigger(availableNow=True)
    return writer.start(path, format="parquet")

"""Benchmark run logs: result lines, labels, parsed results, summaries.

Logs are (file_name, value) rows, one per line, as ``read_logs`` returns them.
All but the summaries work row by row, on streams as well as on tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The mark of a result line, the shape of such a line, and the
# shape of a log's file name, <benchmark>.PG-<version>[-<library>].<iteration>.log
# (the version holds dots; the mark PG- keeps other logs of a run out).
RESULT_MARK = "TEST RESULT :"
RESULT_SHAPE = r"Vuser (\d+):TEST RESULT : System achieved (\d+) NOPM from (\d+) (.+) TPM"
LOG_NAME_SHAPE = r"^([^.]+)[.](PG-.+)[.]([0-9]+)[.]log$"


def result_lines(logs: DataFrame) -> DataFrame:
    """The lines that hold a result (fixed text, not a pattern)."""
    return logs.filter(F.col("value").contains(RESULT_MARK))


def _labels() -> list[Column]:
    part = lambda i: F.regexp_extract("file_name", LOG_NAME_SHAPE, i)
    return [
        part(1).alias("benchmark"),
        part(2).alias("variant"),
        part(3).try_cast("long").alias("iteration"),
    ]


def label_runs(logs: DataFrame) -> DataFrame:
    """Lines of run logs with (benchmark, variant, iteration) from the file
    name. Lines of other files drop out."""
    runs = logs.filter(F.col("file_name").rlike(LOG_NAME_SHAPE))
    return runs.select(*_labels(), *logs.columns)


def parse_results(lines: DataFrame) -> DataFrame:
    """Adds (vuser, nopm, tpm, system) of a result line; all NULL, and the line
    kept, when it does not have the shape. A number too large is NULL too."""
    fits = F.col("value").rlike(RESULT_SHAPE)
    part = lambda i: F.when(fits, F.regexp_extract("value", RESULT_SHAPE, i))
    return lines.select(
        *lines.columns,
        part(1).try_cast("long").alias("vuser"),
        part(2).try_cast("long").alias("nopm"),
        part(3).try_cast("long").alias("tpm"),
        part(4).alias("system"),
    )


def run_summary(logs: DataFrame) -> DataFrame:
    """(benchmark, variant, iteration, vuser, nopm, tpm, system, value): every
    result line of every run, variant after variant and by iteration.

    Lines of one run keep the order in which they were read. That position also
    lets the sort cut a run with very many lines into several ranges.
    """
    results = parse_results(label_runs(result_lines(logs)))
    ordered = results.withColumn("_line", F.monotonically_increasing_id()).orderBy(
        "benchmark", "variant", "iteration", "_line"
    )
    return ordered.select(
        "benchmark", "variant", "iteration", "vuser", "nopm", "tpm", "system", "value"
    )


def summary_listing(summary: DataFrame) -> DataFrame:
    """(variant, value): a summary as text to show, each variant under a header
    line ``<benchmark>.summary.<variant>.log``."""
    parts = ["benchmark", "variant"]
    name = F.concat("benchmark", F.lit(".summary."), "variant", F.lit(".log"))
    heads = summary.select(*parts).distinct().select(
        *parts, F.lit(-1).cast("long").alias("iteration"), F.lit(-1).cast("long").alias("_line"),
        name.alias("value"),
    )
    lines = summary.withColumn("_line", F.monotonically_increasing_id())
    both = heads.unionByName(lines.select(*heads.columns))
    return both.orderBy(*parts, "iteration", "_line").select("variant", "value")


def missing_results(logs: DataFrame, iterations: int | None = None) -> DataFrame:
    """(benchmark, variant, iteration) of the runs whose log has no result line
    and which therefore do not show in the summary. With ``iterations``, the number
    of runs that each variant should have, runs without any log are given too.

    Lines are folded to one row per file before a file name is looked at. The
    name's test sits in a CASE with the result of the folding, because Catalyst
    would push a test of the name alone below it, to every line.
    """
    has = F.bool_or(F.col("value").contains(RESULT_MARK))
    files = logs.groupBy("file_name").agg(F.coalesce(has, F.lit(False)).alias("has"))
    without = F.when(F.col("has"), False).otherwise(F.col("file_name").rlike(LOG_NAME_SHAPE))
    if iterations is None:
        return files.filter(without).select(*_labels()).distinct()
    runs = files.withColumn("run", F.when(F.col("file_name").rlike(LOG_NAME_SHAPE), F.struct(*_labels())))
    runs = runs.filter(F.col("run").isNotNull()).select("run.*", "has")
    by = ["benchmark", "variant", "iteration"]
    wanted = runs.select(*by[:2]).distinct().withColumn(
        "iteration", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(iterations).cast("long")))
    )
    seen = runs.groupBy(*by).agg(F.bool_or("has").alias("has"))
    everything = wanted.unionByName(runs.select(*by)).distinct()
    return everything.join(seen.filter("has"), by, "left_anti")


def _stored(summary: DataFrame) -> DataFrame:
    """A summary's rows by variant, each run's lines in their order."""
    by = ["benchmark", "variant"]
    lines = summary.withColumn("line_no", F.monotonically_increasing_id())
    # The hint lets AQE split a variant with many lines over several tasks.
    return lines.hint("rebalance", *by).sortWithinPartitions(*by, "iteration", "line_no")


def write_summary(summary: DataFrame, path: str, append: bool = False) -> None:
    """Store a summary as Parquet, one folder per benchmark and variant, with the
    place of each line (``line_no``). A new run replaces the summary of its own variants and
    leaves all others; ``append`` adds to it."""
    writer = _stored(summary).write.option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if append else "overwrite").partitionBy("benchmark", "variant").parquet(path)


def write_summary_text(summary: DataFrame, path: str, append: bool = False) -> None:
    """The same as plain result lines, in their order within each file."""
    lines = _stored(summary).select("benchmark", "variant", "value")
    writer = lines.write.option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if append else "overwrite").partitionBy("benchmark", "variant").text(path)


def throughput(
    events: DataFrame,
    rampup: float,
    duration: float,
    order_type: str,
    ts: str = "ts",
    event_type: str = "event_type",
    start: datetime | None = None,
) -> DataFrame:
    """Events per minute in the window that opens ``rampup`` minutes after the
    first event and lasts ``duration`` minutes: (total_events, order_events,
    tpm, nopm), over all events and over those of ``order_type``.

    Without ``start`` the time of the first event is a scan of ``ts`` of its own.
    """
    if duration <= 0:
        raise ValueError(f"duration must be positive, got {duration}")
    if start is None:
        first = events.agg(F.min(ts).alias("t0")).scalar()
    else:
        first = F.lit(start).cast(events.schema[ts].dataType)
    opens = first + F.lit(timedelta(minutes=rampup))
    closes = first + F.lit(timedelta(minutes=rampup + duration))
    window = events.filter((F.col(ts) >= opens) & (F.col(ts) < closes))
    counts = window.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col(event_type) == order_type).alias("order_events"),
    )
    minutes = F.lit(float(duration))
    return counts.select(
        "total_events",
        "order_events",
        (F.col("total_events") / minutes).alias("tpm"),
        (F.col("order_events") / minutes).alias("nopm"),
    )


def throughput_per_run(
    events: DataFrame,
    run_starts: DataFrame,
    rampup: float,
    duration: float,
    order_type: str,
    ts: str = "ts",
    event_type: str = "event_type",
    run: str = "run",
    start: str = "start",
) -> DataFrame:
    """Events per minute of every run in a window of its own, which opens ``rampup`` minutes after
    the run's ``start`` and lasts ``duration`` minutes: (run, total_events, order_events, tpm, nopm).

    Runs may overlap; an event counts in each window that holds it. A run without events has
    zeros, a run without start NULLs. Several starts under one run (NULL is one) are windows that are added up,
    equal rows of ``run_starts`` are one. Events without time count nowhere.

    Time is cut into bins as long as a window, so that a window meets two bins (one more at a change of the clock) and an event one: the
    join is by equal bins. Events are folded by time before it, so a hot minute is few rows, and
    counts are folded by run in each task behind it.
    """
    if duration <= 0:
        raise ValueError(f"duration must be positive, got {duration}")
    width = max(1, round(duration * 60_000_000))
    bin_of = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / F.lit(width))
    starts = run_starts.select(F.col(run).alias("run"), F.col(start).cast(events.schema[ts].dataType).alias("begins")).distinct()
    windows = starts.select(
        "run",
        (F.col("begins") + F.lit(timedelta(minutes=rampup))).alias("opens"),
        (F.col("begins") + F.lit(timedelta(minutes=rampup + duration))).alias("closes"),
    ).filter("opens IS NOT NULL")
    windows = windows.select("*", F.explode(F.sequence(bin_of("opens"), bin_of("closes"))).alias("bin"))
    is_order = F.coalesce(F.col(event_type) == order_type, F.lit(False))
    times = events.filter(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("at")).agg(F.count("*").alias("n"), F.count_if(is_order).alias("n_order"))
    times = times.select("*", bin_of("at").alias("bin"))
    met = times.join(windows, "bin").filter("at >= opens AND at < closes")
    sums = met.groupBy("run").agg(F.sum("n").alias("total"), F.sum("n_order").alias("orders"))
    runs = starts.groupBy("run").agg(F.count("begins").alias("n_windows")).withColumnRenamed("run", "_run")
    all_runs = runs.join(sums, F.col("_run").eqNullSafe(F.col("run")), "left")
    counted = lambda c: F.when(F.col("n_windows") > 0, F.coalesce(c, F.lit(0)))
    counts = all_runs.select(F.col("_run").alias("run"), counted("total").alias("total_events"), counted("orders").alias("order_events"))
    minutes = F.lit(float(duration))
    return counts.select("*", (F.col("total_events") / minutes).alias("tpm"), (F.col("order_events") / minutes).alias("nopm"))

"""Column statistics of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def analyze_tables(tables: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    """(table_name, column_name, rows, nulls, distinct_values, min_value,
    max_value, avg_width), one row per column of every table.

    Minimum and maximum are given as text, widths in bytes. Everything but the
    distinct count is one pass without a shuffle of rows. For exact distinct
    counts each column is read once more, by itself, and the values of all
    columns share one shuffle after repeats have been dropped in each task.
    With ``exact=False`` the counts are estimated within the first pass.
    Columns without an order (nested types, variants) have rows and nulls, and
    NULL for the rest.
    """
    if not tables:
        raise ValueError("no table to analyse")
    stats = _union([_one_pass(name, t, exact) for name, t in tables.items()])
    columns = [(n, t, f) for n, t in tables.items() for f in t.schema if _ordered(f)]
    if exact and columns:
        by = ["table_name", "column_name"]
        values = _union([_values(n, t, f) for n, t, f in columns])
        counts = values.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        stats = stats.join(counts, by, "left").withColumn(
            "distinct_values",
            F.coalesce("n", F.when(F.col("ordered"), F.lit(0).cast("long"))),
        )
    return stats.select(
        "table_name",
        "column_name",
        "rows",
        "nulls",
        "distinct_values",
        "min_value",
        "max_value",
        "avg_width",
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _one_pass(name: str, t: DataFrame, exact: bool) -> DataFrame:
    fields = list(t.schema)
    aggs = [F.count(F.lit(1)).alias("rows")]
    nothing = F.lit(None).cast("string")
    for i, f in enumerate(fields):
        c = t[f"`{f.name.replace('`', '``')}`"]
        aggs.append(F.count(c).alias(f"filled{i}"))
        if not _ordered(f):
            aggs += [F.max(nothing).alias(f"min{i}"), F.max(nothing).alias(f"max{i}")]
            aggs += [F.max(nothing.cast(k)).alias(f"{n}{i}") for n, k in (("width", "double"), ("distinct", "long"))]
            continue
        aggs += [
            F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"),
            F.avg(_width(c, f.dataType)).alias(f"width{i}"),
        ]
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"distinct{i}"))
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.col("rows").alias("rows"),
            (F.col("rows") - F.col(f"filled{i}")).alias("nulls"),
            (F.lit(None).cast("long") if exact else F.col(f"distinct{i}")).alias("distinct_values"),
            F.col(f"min{i}").alias("min_value"),
            F.col(f"max{i}").alias("max_value"),
            F.col(f"width{i}").alias("avg_width"),
            F.lit(_ordered(f)).alias("ordered"),
        )
        for i, f in enumerate(fields)
    ]
    stats = t.agg(*aggs).select(F.inline(F.array(*rows)))
    return stats.withColumn("table_name", F.lit(name))


def _values(name: str, t: DataFrame, f: T.StructField) -> DataFrame:
    """The values of one column as texts that differ whenever the values do."""
    c, kind = t[f"`{f.name.replace('`', '``')}`"], f.dataType
    if isinstance(kind, T.TimestampType):
        text = F.unix_micros(c).cast("string")  # local times repeat when clocks change
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        text = (c + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    elif isinstance(kind, T.BinaryType):
        text = F.sha2(c, 256)
    elif isinstance(kind, T.StringType):
        text = F.sha2(c.cast("binary"), 256)  # texts of any length travel as a digest
    else:
        text = c.cast("string")
    return t.filter(c.isNotNull()).select(
        F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), text.alias("v")
    )


def _width(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
             T.DateType: 4}
    return F.when(c.isNotNull(), F.lit(fixed.get(type(kind), 8)))


def _ordered(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)

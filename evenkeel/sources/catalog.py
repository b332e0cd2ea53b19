"""Relation inventory of the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog_relations(spark: SparkSession, schema: str) -> DataFrame:
    """(schema, name, kind, bytes) of a database: tables (``r``), partitioned
    tables (``p``), views (``v``) and functions (``f``). Bytes are the catalog's
    statistics, NULL for what has none; ``statements`` makes the commands that
    collect them."""
    quoted = f"`{schema.replace('`', '``')}`"
    info = F.col("information")
    tables = spark.sql(f"SHOW TABLE EXTENDED IN {quoted} LIKE '*'").filter(~F.col("isTemporary"))
    kind = F.when(info.rlike("(?m)^Type: VIEW"), "v").when(
        info.rlike("(?m)^Partition Columns: "), "p"
    )
    size = F.regexp_extract(info, r"(?m)^Statistics: (\d+) bytes", 1)
    found = tables.select(
        F.lit(schema).alias("schema"),
        F.col("tableName").alias("name"),
        kind.otherwise("r").alias("kind"),
        F.nullif(size, F.lit("")).cast("long").alias("bytes"),
    )
    prefix = f"spark_catalog.{schema}."
    functions = spark.sql(f"SHOW USER FUNCTIONS IN {quoted}").filter(
        F.col("function").startswith(prefix)
    )
    return found.unionByName(
        functions.select(
            F.lit(schema).alias("schema"),
            F.substring("function", len(prefix) + 1, 2**31 - 1).alias("name"),
            F.lit("f").alias("kind"),
            F.lit(None).cast("long").alias("bytes"),
        )
    )

"""Queries on an inventory of relations(schema, name, kind, bytes).

Kinds: r table, p partitioned table, v view, m materialised view, S sequence,
f function.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import quote_ident
from evenkeel.operators.sizes import TABLE_KINDS

# The tables of the two known workloads, the name patterns of what
# they leave behind, and the kinds a leftover can have. In a pattern % stands
# for any text and _ for any one character; case does not matter.
TPCC_TABLES = [
    "warehouse", "district", "customer", "history", "new_order", "oorder", "order_line",
    "item", "stock",
]
TPCH_TABLES = [
    "region", "nation", "supplier", "part", "partsupp", "customer", "orders", "lineitem",
]
PREFIX_PATTERNS = ["tpcc%", "tpch%", "hammerdb%"]
ROUTINE_PATTERNS = ["%neword%", "%payment%", "%delivery%", "%ostat%", "%slev%"]
LEFTOVER_KINDS = ["r", "p", "v", "m", "S"]

KNOWN_TABLES = list(dict.fromkeys(TPCC_TABLES + TPCH_TABLES))
VIEW_PATTERNS = PREFIX_PATTERNS + ROUTINE_PATTERNS
FUNCTION_PATTERNS = VIEW_PATTERNS
SEQUENCE_PATTERNS = [f"{name}%" for name in KNOWN_TABLES] + PREFIX_PATTERNS


def name_like(name: Column | str, patterns: Iterable[str]) -> Column:
    """True when a name matches any pattern, whatever its case."""
    c = F.col(name) if isinstance(name, str) else name
    test = F.lit(False)
    for pattern in patterns:
        test = test | c.ilike(pattern)
    return test


def match_relations(
    relations: DataFrame, kind: str, patterns: Iterable[str], schema: str = "public"
) -> DataFrame:
    """Relations of one kind in a schema whose name matches any pattern."""
    mine = (F.col("schema") == schema) & (F.col("kind") == kind)
    return relations.filter(mine & name_like("name", patterns)).select("schema", "name", "kind")


def leftover_relations(relations: DataFrame, schema: str = "public") -> DataFrame:
    """What a workload left in a schema: known tables and anything named after a
    workload, ordered by kind and name."""
    mine = (F.col("schema") == schema) & F.col("kind").isin(LEFTOVER_KINDS)
    named = name_like("name", PREFIX_PATTERNS) | F.col("name").isin(KNOWN_TABLES)
    return relations.filter(mine & named).select("kind", "name").orderBy("kind", "name")


def known_relations(spark: SparkSession) -> DataFrame:
    """(workload, name): the tables of both workloads. One name is in both."""
    names = F.struct(
        F.array(*map(F.lit, TPCC_TABLES)).alias("tpcc"),
        F.array(*map(F.lit, TPCH_TABLES)).alias("tpch"),
    )
    row = spark.range(1).select(names.alias("n"))
    tpcc = row.select(F.lit("tpcc").alias("workload"), F.explode("n.tpcc").alias("name"))
    tpch = row.select(F.lit("tpch").alias("workload"), F.explode("n.tpch").alias("name"))
    return tpcc.unionByName(tpch)


def statements(
    relations: DataFrame,
    template: str = "ANALYZE TABLE %s COMPUTE STATISTICS",
    schema: str = "public",
    kinds: Iterable[str] = TABLE_KINDS,
) -> DataFrame:
    """(schema, name, statement): the template filled with the quoted name of
    every relation of the given kinds."""
    mine = (F.col("schema") == schema) & F.col("kind").isin(list(kinds))
    target = F.concat(quote_ident("schema"), F.lit("."), quote_ident("name"))
    return relations.filter(mine).select(
        "schema", "name", F.format_string(template, target).alias("statement")
    )


def run_statements(made: DataFrame) -> Iterator[str]:
    """Run generated statements one by one, giving each back when it is done.
    They are fetched in pieces, not all at once."""
    for row in made.select("statement").toLocalIterator():
        made.sparkSession.sql(row.statement)
        yield row.statement


def exists(df: DataFrame, condition: Column) -> bool:
    """Whether any row meets a condition; stops at the first one."""
    return not df.filter(condition).isEmpty()


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    """(found, n) in one row: whether any row meets a condition, and how many."""
    n = F.count_if(condition)
    return df.agg((n > 0).alias("found"), n.alias("n"))


def session_context(spark: SparkSession) -> DataFrame:
    """(db, schema) of the session; in Spark both name the current database."""
    return spark.range(1).select(
        F.current_database().alias("db"), F.current_schema().alias("schema")
    )

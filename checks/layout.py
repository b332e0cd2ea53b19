"""The cluster that the registered queries assume over the given tables.

Node and placement metadata are fixed and skewed on purpose; everything else is
derived from the tables by Spark.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.inventory import KNOWN_TABLES
from evenkeel.operators.placement import Distribution
from evenkeel.operators.sizes import key_bytes, shard_bytes

N_SHARDS = 32
# First bucket of each node group.
GROUP_STARTS = {1: 0, 2: 16, 3: 24, 4: 29}

# Declared, so that opening a table is no job of its own.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}

# table -> key column, colocation id, first shard id, bytes per row
# (None: the bytes of the column "text").
TABLES = {
    "customer": ("c_custkey", 1, 102100, 48),
    "orders": ("o_custkey", 1, 102200, 56),
    "supplier": ("s_suppkey", 3, 102300, 40),
    "lineitem": ("l_suppkey", 3, 102400, 96),
    "documents": ("doc_id", 13, 102500, None),
    "labels": ("doc_id", 13, 102600, 16),
}

NAME_PREFIXES = [
    "tpcc_", "TPCH_", "hammerdb_", "x_neword_", "x_payment_", "stock_", "misc_", "part_",
]
KIND_CYCLE = ["r", "p", "v", "m", "S"]
IGNORED_LOGS = [
    "tpcc.cleanup.PG-17.2.1.log",
    "tpcc.maintenance.PG-17.2.1.log",
    "tpcc.summary.PG-17.2.log",
    "tpcc.PG-17.2.prepare.log",
]
IGNORED_LINE = "Vuser 1:TEST RESULT : System achieved 1 NOPM from 2 PostgreSQL TPM"


def _frame(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    # An Arrow table becomes a local relation of known size.
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def group_of(bucket: int) -> int:
    return max(g for g, first in GROUP_STARTS.items() if first <= bucket)


def dist_of(table: str) -> Distribution:
    key, colocation, base, _ = TABLES[table]
    return Distribution(table, key, colocation, base, N_SHARDS)


def distribution(spark: SparkSession) -> DataFrame:
    schema = pa.schema([
        ("table_name", pa.string()), ("dist_column", pa.string()), ("colocation_id", pa.int32()),
        ("shard_base", pa.int64()), ("shard_count", pa.int32()),
    ])
    rows = [(t, key, group, base, N_SHARDS) for t, (key, group, base, _) in TABLES.items()]
    return _frame(spark, schema, rows)


def placements(spark: SparkSession) -> DataFrame:
    schema = pa.schema([("shardid", pa.int64()), ("groupid", pa.int32())])
    rows = [(t[2] + b, group_of(b)) for t in TABLES.values() for b in range(N_SHARDS)]
    return _frame(spark, schema, rows)


def nodes(spark: SparkSession) -> DataFrame:
    schema = pa.schema([
        ("groupid", pa.int32()), ("nodename", pa.string()), ("nodeport", pa.int32()),
        ("noderole", pa.string()),
    ])
    rows = [(g, f"worker-{g}", 5432, "primary") for g in GROUP_STARTS]
    rows += [(g, f"worker-{g}-s", 5433, "secondary") for g in GROUP_STARTS]
    return _frame(spark, schema, rows)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def width_of(name: str) -> Column:
    width = TABLES[name][3]
    return F.octet_length("text") if width is None else F.lit(width).cast("long")


def shard_stats(spark: SparkSession, sf: str) -> DataFrame:
    parts = [key_bytes(table(spark, sf, n), dist_of(n), width_of(n)) for n in TABLES]
    return shard_bytes(reduce(DataFrame.unionByName, parts), placements(spark), nodes(spark))


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (index + 1).cast("int"))


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """A few literal relations, one per part, and one function per supplier."""
    schema = pa.schema([
        ("schema", pa.string()), ("name", pa.string()), ("kind", pa.string()),
        ("bytes", pa.int64()),
    ])
    literal = _frame(spark, schema, literal_relations())
    k = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        F.lit("public").alias("schema"),
        F.concat(_pick(NAME_PREFIXES, k % 8), k.cast("string")).alias("name"),
        _pick(KIND_CYCLE, k % 5).alias("kind"),
        (F.col("p_size") * k * 1024).alias("bytes"),
    )
    k = F.col("s_suppkey")
    functions = table(spark, sf, "supplier").select(
        F.lit("public").alias("schema"),
        F.concat(_pick(NAME_PREFIXES, k % 8), k.cast("string")).alias("name"),
        F.lit("f").alias("kind"),
        F.lit(0).cast("long").alias("bytes"),
    )
    return literal.unionByName(parts).unionByName(functions)


def literal_relations() -> list[tuple]:
    rows = [("public", name, "r", 8192 * (i + 1)) for i, name in enumerate(KNOWN_TABLES)]
    others = [
        ("tpcc_v", "v"), ("TPCH_View", "v"), ("daily_payment_mv", "m"), ("new_order_seq", "S"),
        ("newXorder_seq", "S"), ("my_seq", "S"), ("neword", "f"), ("slev_check", "f"),
        ("shard_tables", "v"),
    ]
    rows += [("public", name, kind, 0) for name, kind in others]
    return rows + [("other", "warehouse", "r", 8192)]


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines made from the events: purchases are result lines."""
    k = F.col("event_id")
    file_name = F.format_string("tpcc.PG-17.%d.%d.log", k % 3, k % 5 + 1)
    result = F.format_string(
        "Vuser 1:TEST RESULT : System achieved %d NOPM from %d PostgreSQL TPM",
        k + 30000, k * 2 + 70000,
    )
    other = F.concat(F.lit("Vuser "), F.col("user_id").cast("string"), F.lit(":"), "event_type")
    lines = table(spark, sf, "events").select(
        file_name.alias("file_name"),
        F.when(F.col("event_type") == "purchase", result).otherwise(other).alias("value"),
    )
    schema = pa.schema([("file_name", pa.string()), ("value", pa.string())])
    ignored = _frame(spark, schema, [(name, IGNORED_LINE) for name in IGNORED_LOGS])
    return lines.unionByName(ignored)

"""Sizes of shards, nodes and tables.

    shard_stats(nodename, nodeport, shardid, table_name, colocation_id, shard_size)
    relations(schema, name, kind, bytes)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import size_pretty, to_blocks
from evenkeel.operators.placement import NODE, Distribution, on_primaries, typed

# Relation kinds that are tables (ordinary, partitioned).
TABLE_KINDS = ["r", "p"]


def _bytes_per_key(t: DataFrame, dist: Distribution, width: Column) -> DataFrame:
    key = t[dist.dist_column]
    rows = t.filter(key.isNotNull()).select(key.alias("dist_value"), width.alias("bytes"))
    return rows.groupBy("dist_value").agg(F.sum("bytes").cast("long").alias("bytes"))


def key_bytes(t: DataFrame, dist: Distribution, width: Column) -> DataFrame:
    """(shardid, table_name, colocation_id, bytes), one row per key of a table:
    ``width``, the bytes of a row, summed. Sums are taken per key before keys
    are hashed; a hot key is one row per task when it is shuffled."""
    sizes = _bytes_per_key(t, dist, width)
    return sizes.select(typed(dist, t).shard("dist_value").alias("shardid"), *_names_of(dist), "bytes")


def shard_bytes(sizes: DataFrame, placements: DataFrame, nodes: DataFrame) -> DataFrame:
    """``shard_stats`` from ``key_bytes`` of any number of tables, put together
    with ``unionByName``. What is shuffled is a row per shard and task."""
    by = ["shardid", "table_name", "colocation_id"]
    sizes = sizes.groupBy(*by).agg(F.sum("bytes").alias("shard_size"))
    placed = on_primaries(sizes, placements, nodes)
    return placed.select(*NODE, *by, "shard_size")


def placed_bytes(t: DataFrame, dist: Distribution, width: Column, placed: DataFrame) -> DataFrame:
    """``shard_stats`` of one table whose keys are already placed, for instance
    after a rebalance."""
    sizes = _bytes_per_key(t, dist, width).join(placed, "dist_value").groupBy(*NODE, "shardid")
    sizes = sizes.agg(F.sum("bytes").alias("shard_size"))
    return sizes.select(*NODE, "shardid", *_names_of(dist), "shard_size")


def _names_of(dist: Distribution) -> list[Column]:
    return [
        F.lit(dist.table_name).alias("table_name"),
        F.lit(dist.colocation_id).cast("int").alias("colocation_id"),
    ]


def sizes_of(
    shard_stats: DataFrame,
    table: str | None = None,
    colocation_id: int = 1,
    include_shard_id: bool = True,
) -> DataFrame:
    """Bytes, blocks and printed size of one colocation group.

    Without ``table`` all tables of the group are added up and ``table_name``
    is NULL; without ``include_shard_id`` the shards of a node are added up and
    ``shardid`` is NULL. So there are four granularities.
    """
    stats = shard_stats.filter(F.col("colocation_id") == colocation_id)
    if table is not None:
        stats = stats.filter(F.col("table_name") == table)
    by = NODE + ["shardid"] * include_shard_id + ["table_name"] * (table is not None)
    sizes = stats.groupBy(*by).agg(F.sum("shard_size").cast("long").alias("shard_size"))
    return sizes.select(
        *NODE,
        F.col("shardid") if include_shard_id else F.lit(None).cast("long").alias("shardid"),
        F.col("table_name") if table is not None else F.lit(None).cast("string").alias("table_name"),
        "shard_size",
        to_blocks("shard_size").alias("shard_nblocks"),
        size_pretty("shard_size").alias("shard_size_pretty"),
    )


def shard_size(
    shard_stats: DataFrame,
    table: str | None = None,
    colocation_id: int = 1,
    include_shard_id: bool = True,
) -> DataFrame:
    """``sizes_of``, in order."""
    sizes = sizes_of(shard_stats, table, colocation_id, include_shard_id)
    return sizes.orderBy(*NODE, "table_name", "shardid")


def top_relations(relations: DataFrame, n: int = 20, schema: str = "public") -> DataFrame:
    """The ``n`` largest tables of a schema, with their printed size."""
    tables = relations.filter((F.col("schema") == schema) & F.col("kind").isin(TABLE_KINDS))
    top = tables.orderBy(F.desc("bytes"), "name").limit(n)
    return top.select(
        "schema",
        F.col("name").alias("table_name"),
        "bytes",
        size_pretty("bytes").alias("total_size"),
    )

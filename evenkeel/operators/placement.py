"""Where keys live: distribution metadata, key placement, key location, and
distinct keys per shard and per node.

Metadata frames
    distribution(table_name, dist_column, colocation_id, shard_base, shard_count)
    placements(shardid, groupid)
    nodes(groupid, nodename, nodeport, noderole)

A table's key belongs to shard ``shard_base + shard_of(key, shard_count)``.

Metadata frames are joined without a broadcast hint: given as tables, files or
Arrow data they have a known size, and Catalyst broadcasts them when that size
is below ``spark.sql.autoBroadcastJoinThreshold``. Frames of unknown size (made
from Python rows or RDDs) should go through ``materialise`` first.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import shard_of
from evenkeel.functions.scalar import hash_of
from evenkeel.operators.ranges import in_ranges

NODE = ["nodename", "nodeport"]


@dataclass(frozen=True)
class Distribution:
    """How one table is spread."""

    table_name: str
    dist_column: str
    colocation_id: int
    shard_base: int
    shard_count: int
    key_type: str | None = None

    def shard(self, key: Column | str) -> Column:
        """Shard id of a key column, -1 (no shard) for a NULL key.

        Never NULL: a join on a nullable shard id would make Catalyst filter
        the scan by ``shard id IS NOT NULL``, and so hash every row of it.
        """
        shard = shard_of(key, self.shard_count, self.key_type) + F.lit(self.shard_base).cast("long")
        return F.coalesce(shard, F.lit(-1).cast("long"))


def resolve_distribution(
    distribution: DataFrame, table: str, column: str | None = None, on_mismatch: str = "raise"
) -> Distribution:
    """Look a table up in the distribution metadata.

    Raises when the table is not distributed. A ``column`` that is not the
    distribution column raises too, or with ``on_mismatch="ignore"`` warns and
    the actual column is used.
    """
    if on_mismatch not in ("raise", "ignore"):
        raise ValueError(f"on_mismatch must be 'raise' or 'ignore', got {on_mismatch!r}")
    row = distribution.filter(F.col("table_name") == table).head()
    if row is None:
        raise ValueError(f"table {table} is not a distributed table")
    found = Distribution(
        row.table_name, row.dist_column, row.colocation_id, row.shard_base, row.shard_count
    )
    if column is not None and column != found.dist_column:
        if on_mismatch == "raise":
            raise ValueError(
                f"column {column} is not the distribution column of table {table}; "
                f"the distribution column is {found.dist_column}"
            )
        warnings.warn(
            f"ignoring column {column}: table {table} is distributed by {found.dist_column}",
            stacklevel=2,
        )
    return found


def colocated_tables(distribution: DataFrame, table: str) -> DataFrame:
    """Names of the tables that share the layout of ``table``, in order."""
    group = resolve_distribution(distribution, table).colocation_id
    same = distribution.filter(F.col("colocation_id") == group)
    return same.select("table_name").orderBy("table_name")


def key_type(t: DataFrame, key: str) -> str:
    """Spark SQL type of a column; raises when the table has no such column."""
    if key not in t.columns:
        raise ValueError(f"could not determine the data type of column {key}")
    return t.schema[key].dataType.simpleString()


def typed(dist: Distribution, t: DataFrame) -> Distribution:
    """``dist`` with the type that its key has in the table."""
    return replace(dist, key_type=key_type(t, dist.dist_column))


def on_primaries(sharded: DataFrame, placements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the primary nodes to rows that have a ``shardid``: two lookups in
    the cluster metadata. Rows without a primary placement drop out."""
    primary = nodes.filter(F.col("noderole") == "primary").select("groupid", *NODE)
    placed = sharded.join(placements.select("shardid", "groupid"), "shardid")
    return placed.join(primary, "groupid").drop("groupid")


def _at_home(keys: DataFrame, key: Column, dist: Distribution, isolated: DataFrame | None, ranges: DataFrame | None = None) -> DataFrame:
    """Adds the ``shardid`` of a key: the shard that it was isolated to, or else that of its hash.
    With ``ranges`` (see ``operators.ranges``) the shard whose range holds the hash. Without either there is no join."""
    if isolated is not None and ranges is not None:
        raise ValueError("give isolated keys or ranges, not both")
    if ranges is not None:
        found = in_ranges(keys, hash_of(key, dist.key_type), ranges)
        return found.withColumn("shardid", F.coalesce("shardid", F.lit(-1).cast("long")))
    if isolated is None:
        return keys.withColumn("shardid", dist.shard(key))
    own = isolated.select(F.col("dist_value").alias("_own_key"), F.col("shardid").alias("_own_shard"))
    joined = keys.withColumn("_hash_shard", dist.shard(key)).join(own, key == own["_own_key"], "left")
    home = F.coalesce("_own_shard", "_hash_shard").alias("shardid")
    return joined.select(*(F.col(f"`{c}`") for c in keys.columns), home)


def sharded_keys(
    t: DataFrame, dist: Distribution, isolated: DataFrame | None = None, ranges: DataFrame | None = None
) -> DataFrame:
    """(dist_value, shardid): the distinct keys of a table and their shards.
    ``isolated`` (dist_value, shardid) has the keys with a shard of their own, as
    ``apply_moves`` gives them; ``ranges`` stands for the same as a directory of hashes.

    The distinct comes first. Its map-side half folds the repeats of a key, hot
    or not, so the shuffle, the hash and all that follows see keys, not rows.
    """
    keys = t.select(t[dist.dist_column].alias("dist_value"))
    keys = keys.filter(F.col("dist_value").isNotNull()).distinct()
    return _at_home(keys, keys["dist_value"], typed(dist, t), isolated, ranges)


def place_keys(
    t: DataFrame,
    dist: Distribution,
    placements: DataFrame,
    nodes: DataFrame,
    isolated: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """(nodename, nodeport, shardid, dist_value): each distinct key with the
    primary node that holds its shard. NULL keys and keys whose shard has no
    primary placement drop out."""
    placed = on_primaries(sharded_keys(t, dist, isolated, ranges), placements, nodes)
    return placed.select(*NODE, "shardid", "dist_value")


def keys_per_shard_global(
    t: DataFrame, dist: Distribution, isolated: DataFrame | None = None, ranges: DataFrame | None = None
) -> DataFrame:
    """(shardid, dist_value_count) from the table alone, without placements."""
    counts = sharded_keys(t, dist, isolated, ranges).groupBy("shardid")
    return counts.agg(F.count(F.lit(1)).alias("dist_value_count"))


def keys_per_shard(
    t: DataFrame,
    dist: Distribution,
    placements: DataFrame,
    nodes: DataFrame,
    isolated: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """(nodename, nodeport, shardid, dist_value_count), exact, in that order.

    Keys are counted per shard before the placements are joined, so the join
    sees one row per shard.
    """
    counts = on_primaries(keys_per_shard_global(t, dist, isolated, ranges), placements, nodes)
    return counts.select(*NODE, "shardid", "dist_value_count").orderBy(*NODE, "shardid")


def keys_per_node(
    t: DataFrame,
    dist: Distribution,
    placements: DataFrame,
    nodes: DataFrame,
    isolated: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """(nodename, nodeport, dist_value_count): the shard counts summed per node."""
    counts = on_primaries(keys_per_shard_global(t, dist, isolated, ranges), placements, nodes)
    sums = counts.groupBy(*NODE).agg(F.sum("dist_value_count").alias("dist_value_count"))
    return sums.orderBy(*NODE)


def placed_per_shard(placed: DataFrame) -> DataFrame:
    """Keys per shard of keys that are already placed (one row per key)."""
    return placed.groupBy(*NODE, "shardid").agg(F.count(F.lit(1)).alias("dist_value_count"))


def placed_per_node(placed: DataFrame) -> DataFrame:
    """Keys per node of keys that are already placed (one row per key)."""
    return placed.groupBy(*NODE).agg(F.count(F.lit(1)).alias("dist_value_count"))


def locate_key(
    distribution: DataFrame,
    placements: DataFrame,
    nodes: DataFrame,
    table: str,
    column: str,
    value: Any,
    value_type: str | None = None,
    isolated: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """(nodename, nodeport, table_name, shard_table_name, shard_id) of one key.

    Works from metadata alone: the table is not read and need not hold the key.
    ``value_type`` (see ``key_type``) casts the value to the key column's type; a value
    that isn't one of it raises. Without it the value has to be of that type.
    """
    dist = replace(resolve_distribution(distribution, table, column), key_type=value_type)
    key = F.lit(value) if value_type is None else F.lit(value).cast(value_type)
    home = dist.shard(key)
    if isolated is not None:
        own = isolated.filter(F.col("dist_value") == key).agg(F.max("shardid")).scalar()
        home = F.coalesce(own, home)
    if ranges is not None:
        holds = hash_of(key, value_type).between(F.col("low"), F.col("high"))
        home = ranges.filter(holds).agg(F.max("shardid")).scalar()
    shard = placements.filter(F.col("shardid") == home).select("shardid").distinct()
    return _located(on_primaries(shard, placements, nodes), table).orderBy(*NODE)


def locate_keys(
    keys: DataFrame,
    column: str,
    distribution: DataFrame,
    placements: DataFrame,
    nodes: DataFrame,
    table: str,
    value_type: str | None = None,
    isolated: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """``locate_key`` for a whole column: each row of ``keys`` with its location
    columns appended, NULL for a NULL key and for one whose shard is nowhere.
    ``value_type`` casts to the key column's type, and a value that isn't one of it raises;
    without it the column has to be of that type. Lookups in the metadata only, no shuffle
    of ``keys`` as long as the metadata is small enough to be sent to all tasks.
    """
    kind = value_type or key_type(keys, column)
    dist = replace(resolve_distribution(distribution, table), key_type=kind)
    held = keys.withColumn("_key", keys[column].cast(kind))
    sharded = _at_home(held, F.col("_key"), dist, isolated, ranges).drop("_key")
    primary = nodes.filter(F.col("noderole") == "primary").select("groupid", *NODE)
    homes = placements.join(primary, "groupid").select(F.col("shardid").alias("_home"), *(F.col(c).alias(f"_{c}") for c in NODE))
    found = sharded.join(homes, sharded["shardid"] == homes["_home"], "left")
    return found.select(
        *(F.col(f"`{c}`") for c in keys.columns),
        *(F.col(f"_{c}").alias(c) for c in NODE),
        F.lit(table).alias("table_name"),
        F.when(F.col("_home").isNotNull(), _shard_name(table, "_home")).alias("shard_table_name"),
        F.col("_home").alias("shard_id"),
    )


def _shard_name(table: str, shard: str) -> Column:
    return F.format_string(f"{table.replace('%', '%%')}_%d", shard)


def _located(placed: DataFrame, table: str, *keep: str) -> DataFrame:
    return placed.select(
        *keep,
        *NODE,
        F.lit(table).alias("table_name"),
        _shard_name(table, "shardid").alias("shard_table_name"),
        F.col("shardid").alias("shard_id"),
    )

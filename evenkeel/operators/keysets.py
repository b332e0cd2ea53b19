"""Distinct keys as bitmaps that merge.

    keysets(shardid, bucket, bits)

The bits of one row are the keys of one shard among 32,768 neighbouring integers. Rows of one table are
merged by OR, so keys that come again, in a later load or in a load that is
stored twice, count once, and counts never read the table again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.placement import NODE, Distribution, key_type, on_primaries, sharded_keys

KEYSETS = "shardid long, bucket long, bits binary"
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def key_bitmaps(t: DataFrame, dist: Distribution) -> DataFrame:
    """(shardid, bucket, bits): the distinct keys of a table. NULL keys are left out; keys that aren't integers raise.

    Distinct keys, not rows, are shuffled by shard and bucket, so a task meets all keys of its bitmaps
    (32,768 at most for each) and no partial bitmaps travel.
    """
    kind = key_type(t, dist.dist_column)
    if kind not in _INTEGERS:
        raise ValueError(f"bitmaps are for integer keys, {dist.dist_column} is {kind}")
    keys, key = sharded_keys(t, dist), F.col("dist_value").cast("long")
    keys = keys.select("shardid", F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit"))
    return keys.repartition("shardid", "bucket").groupBy("shardid", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge_bitmaps(keysets: DataFrame) -> DataFrame:
    """One row per shard and bucket, with the keys of all its rows."""
    return keysets.groupBy("shardid", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def store_keys(t: DataFrame, dist: Distribution, path: str) -> None:
    """Add the keys of new rows to the bitmaps stored at ``path``. Nothing stored is read."""
    key_bitmaps(t, dist).write.mode("append").parquet(path)


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """The stored bitmaps, merged."""
    return merge_bitmaps(spark.read.schema(KEYSETS).parquet(path))


def compact_keys(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged bitmaps of many loads to another folder, one row per shard and bucket."""
    stored_keys(spark, path).write.parquet(target)


def counted_keys(keysets: DataFrame) -> DataFrame:
    """(shardid, dist_value_count) of bitmaps, merged or not."""
    counts = merge_bitmaps(keysets).groupBy("shardid")
    return counts.agg(F.sum(F.bitmap_count("bits")).cast("long").alias("dist_value_count"))


def counted_per_shard(keysets: DataFrame, placements: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``keys_per_shard``, from bitmaps."""
    counts = on_primaries(counted_keys(keysets), placements, nodes)
    return counts.select(*NODE, "shardid", "dist_value_count").orderBy(*NODE, "shardid")


def counted_per_node(keysets: DataFrame, placements: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``keys_per_node``, from bitmaps."""
    counts = on_primaries(counted_keys(keysets), placements, nodes).groupBy(*NODE)
    return counts.agg(F.sum("dist_value_count").alias("dist_value_count")).orderBy(*NODE)

"""The shard directory as ranges of the 32-bit hash.

    ranges(shardid, low, high)

Every hash lies in one range, both ends included. At first a shard owns one range. Isolating
a key cuts its hash out of the range that holds it: the hash becomes a range of
one value, and what is left below and above keeps the number of its shard. So a
directory grows by two rows per isolated key at most, keys that never occurred are covered as well,
and a lookup needs no table of keys.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.functions.scalar import HASHES, hash_of
from evenkeel.sources import materialise

if TYPE_CHECKING:
    from evenkeel.operators.placement import Distribution

# Parts of the hash space in which isolated hashes are put in order, each by itself.
_ORDER_PARTS = 4096


def hash_ranges(spark: SparkSession, dist: Distribution) -> DataFrame:
    """The ranges of a table's shards before any of them is split."""
    n = F.lit(dist.shard_count).cast("long")

    def first(i: Column) -> Column:  # the least hash of shard i: i * HASHES / n, rounded up
        return F.call_function("div", i * HASHES + n - 1, n)

    i = F.col("id")
    return spark.range(dist.shard_count).select(
        (i + dist.shard_base).alias("shardid"), first(i).alias("low"), (first(i + 1) - 1).alias("high")
    )


def in_ranges(keys: DataFrame, hashed: Column, ranges: DataFrame) -> DataFrame:
    """``keys`` with the ``shardid`` whose range holds the hash, NULL for a NULL hash.

    The hash space is cut into at least as many bins of equal width as there are ranges, and a
    range stands in each bin that it touches: three rows per range at most. A hash meets the ranges of its bin
    only, by equality, so the work doesn't depend on how many keys were isolated.
    """
    return _met(keys, hashed, ranges, ["shardid"])


def _met(keys: DataFrame, hashed: Column, ranges: DataFrame, take: list[str], how: str = "left") -> DataFrame:
    bins = 1 << max(1, ranges.count()).bit_length()
    width = max(1, HASHES // bins)
    touched = F.sequence(F.call_function("div", F.col("low"), F.lit(width)), F.call_function("div", F.col("high"), F.lit(width)))
    entries = ranges.select("low", "high", *(F.col(c).alias(f"_of_{c}") for c in take), F.explode(touched).alias("_range_bin"))
    entries = entries.withColumnsRenamed({"low": "_low", "high": "_high"})
    asked = keys.withColumn("_hash", hashed).withColumn("_bin", F.call_function("div", F.col("_hash"), F.lit(width).cast("long")))
    held = (asked["_bin"] == entries["_range_bin"]) & asked["_hash"].between(entries["_low"], entries["_high"])
    met = asked.join(entries, held, how)
    return met.select(*(F.col(f"`{c}`") for c in keys.columns), *(F.col(f"_of_{c}").alias(c) for c in take))


def split_ranges(ranges: DataFrame, isolated: DataFrame, dist: Distribution, folder: str | None = None) -> DataFrame:
    """``ranges`` after the keys in ``isolated`` (dist_value, shardid) got shards of their own, written.

    ``dist`` has the type of the key (see ``typed``). Two isolated keys with one hash share a range: it belongs to the lower of their
    shard numbers, and both keys are found there. A NULL key splits nothing. A key whose hash has its own range already takes it over.
    """
    hashed = isolated.select(hash_of("dist_value", dist.key_type).alias("hash"), "shardid").where(F.col("hash").isNotNull())
    points = hashed.groupBy("hash").agg(F.min("shardid").alias("shardid"))
    cut = materialise(_met(points, F.col("hash"), ranges.withColumnRenamed("shardid", "owner"), ["owner", "low", "high"], "inner"), folder)
    # The next isolated hash: within a part of the hash space, or else the first of the next part that has any.
    part = F.call_function("div", F.col("hash"), F.lit(HASHES // _ORDER_PARTS))
    cut = cut.withColumn("_part", part)
    firsts = cut.groupBy("_part").agg(F.min("hash").alias("_first"))
    firsts = firsts.select("_part", F.lead("_first").over(W.orderBy("_part")).alias("_later"))  # at most _ORDER_PARTS rows
    following = F.lead("hash").over(W.partitionBy("_part").orderBy("hash"))
    cut = cut.withColumn("_next", following).join(firsts, "_part").withColumn("_next", F.coalesce("_next", "_later", F.lit(HASHES)))
    own = cut.select("shardid", F.col("hash").alias("low"), F.col("hash").alias("high"))
    above = cut.select(F.col("owner").alias("shardid"), (F.col("hash") + 1).alias("low"), F.least("high", F.col("_next") - 1).alias("high"))
    below = cut.groupBy("owner", "low").agg((F.min("hash") - 1).alias("high")).select(F.col("owner").alias("shardid"), "low", "high")
    left = above.unionByName(below).where(F.col("low") <= F.col("high"))
    untouched = ranges.join(cut.select("low").distinct(), "low", "left_anti").select("shardid", "low", "high")
    return materialise(untouched.unionByName(left).unionByName(own), folder)

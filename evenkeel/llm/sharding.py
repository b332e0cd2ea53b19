"""Shards of bounded bytes by extendible hashing.

A document's hash gives a string of bits. A bucket is a prefix of bits; only a
bucket over the byte limit is split on another bit. The directory is indexed by the
first bits of the hash and names the bucket of each entry.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import materialise

_KEY_BITS, _ROW_BITS = 60, 64
#: Levels beyond the even share of bits that one round looks at; more rounds follow where they don't suffice.
_SLACK = 4


def _bits() -> Column:
    """Bits of the doc_id, then of the row, so that equal doc_ids can be split as well."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, _KEY_BITS // 4), 16, 2)
    return F.concat(F.lpad(key, _KEY_BITS, "0"), F.lpad(F.bin(F.xxhash64("row")), _ROW_BITS, "0"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``row``, written once so that a lost executor doesn't renumber."""
    return materialise(docs.withColumn("row", F.monotonically_increasing_id()))


def shards(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (row, doc_id, bytes) with ``shard`` (its prefix of bits), ``depth`` (their number) and ``oversized``.

    The bytes of a shard are at most ``limit``, but for a single row that is larger by itself: it
    gets a shard of its own, marked ``oversized``. Rows with equal doc_ids stay together while they fit and are split by
    row beyond that. A null doc_id is a key like others; null bytes are 0.
    """
    held = rows.select("row", "doc_id", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    total = held.agg(F.sum("bytes")).first()[0] or 0
    step = max(1, ceil(log2(max(1.0, total / limit)))) + _SLACK
    left, done, level = held.withColumn("bits", _bits()), None, 0
    while True:
        deep = min(level + step, _KEY_BITS + _ROW_BITS)
        cells = materialise(left.groupBy(F.substring("bits", 1, deep).alias("cell")).agg(F.sum("bytes").alias("bytes")))
        nodes = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(level), F.lit(deep))).alias("depth")).withColumn("node", F.expr("substring(cell, 1, depth)"))
        fits = nodes.groupBy("node", "depth").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("node", "depth")
        # Never sent to all tasks: the levels of all cells are many times the size that Spark knows of the cells' file.
        directory = nodes.join(fits.hint("merge"), ["node", "depth"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        if deep == _KEY_BITS + _ROW_BITS:  # all bits: what is still over the limit is one row
            directory = cells.select("cell").join(directory, "cell", "left").select("cell", F.coalesce("depth", F.lit(deep)).alias("depth"), F.col("depth").isNull().alias("oversized"))
        else:
            directory = directory.withColumn("oversized", F.lit(False))
        directory = materialise(directory)
        placed = left.withColumn("cell", F.substring("bits", 1, deep)).join(directory, "cell")
        found = placed.select("row", "doc_id", "bytes", F.expr("substring(bits, 1, depth)").alias("shard"), "depth", "oversized")
        done = found if done is None else done.unionByName(found)
        if cells.join(directory, "cell", "left_anti").limit(1).count() == 0:
            return done
        over = cells.join(directory, "cell", "left_anti").select("cell")
        left = materialise(left.withColumn("cell", F.substring("bits", 1, deep)).join(over, "cell", "left_semi").drop("cell"))
        level = deep


def shard_documents(docs: DataFrame, limit: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes of its text (null: 0), shard, depth, oversized."""
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return shards(numbered(slim), limit).drop("row")


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """Write ``docs`` as Parquet with one folder per shard: ``shard=b<bits>``, so that names read back as they are.

    A column ``shard`` of the input (in any case) would clash with the folders and raises ValueError. Rows with
    null ids or texts and repeated rows are written like others.
    """
    if any(c.lower() == "shard" for c in docs.columns):
        raise ValueError("the input has a column shard, which the folders' name would hide")
    held = numbered(docs.select(F.struct("*").alias("doc"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    place = shards(held.select("row", "doc_id", "bytes"), limit).select("row", F.concat(F.lit("b"), "shard").alias("place"))
    joined = held.select("row", "doc").join(place, "row")
    joined.select("doc.*", F.col("place").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)

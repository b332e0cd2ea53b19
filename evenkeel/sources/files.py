"""Sizes of stored tables from the file listing alone.

The ``binaryFile`` source with its ``content`` column pruned returns one row
per file and opens none of them, so the work grows with the number of files
and not with their rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_relations(
    spark: SparkSession, root: str, schema: str = "public", glob: str = "*.parquet"
) -> DataFrame:
    """Relation inventory (schema, name, kind, bytes) of a folder, given as an
    absolute path, that holds one file or one sub-folder per table. A folder is
    a partitioned table (kind ``p``), a file an ordinary one (``r``)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    # The part of the path below the root; the root may carry a file-system prefix.
    base = re.sub(r"^\w+:/*(?=/)", "", root).rstrip("/") + "/"
    at = F.locate(base, "path")
    missing = F.raise_error(F.concat(F.lit(f"{base} is not in the path "), "path"))
    below = F.col("path").substr(F.when(at > 0, at).otherwise(missing.cast("int")) + F.lit(len(base)), F.length("path"))
    parts = F.split(below, "/")
    # Only the ending that the glob names is cut off, so sales.v1 and sales.v2 are two tables.
    ending = re.escape(glob[glob.rindex(".") :]) if re.search(r"[.]\w+$", glob) else "(?!)"
    tables = files.select(
        F.regexp_replace(parts[0], f"{ending}$", "").alias("name"),
        F.when(F.size(parts) > 1, "p").otherwise("r").alias("kind"),
        "length",
    )
    sizes = tables.groupBy("name", "kind").agg(F.sum("length").alias("bytes"))
    return sizes.select(F.lit(schema).alias("schema"), "name", "kind", "bytes")


def file_shard_stats(
    spark: SparkSession, root: str, table: str, colocation_id: int, glob: str = "*.parquet"
) -> DataFrame:
    """Shard sizes of a table written by ``relayout``: bytes on disk per
    (nodename, nodeport, shardid) folder. In the default layout, with folders per node
    only, ``shardid`` is NULL. Names are as they were written."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )

    def part(name: str) -> Column:
        raw = F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
        text = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
        return F.when((raw != "") & (raw != "__HIVE_DEFAULT_PARTITION__"), text)

    sizes = files.select(
        part("nodename").alias("nodename"),
        part("nodeport").cast("int").alias("nodeport"),
        part("shardid").cast("long").alias("shardid"),
        "length",
    ).groupBy("nodename", "nodeport", "shardid").agg(F.sum("length").alias("shard_size"))
    return sizes.select(
        "nodename",
        "nodeport",
        "shardid",
        F.lit(table).alias("table_name"),
        F.lit(colocation_id).cast("int").alias("colocation_id"),
        "shard_size",
    )

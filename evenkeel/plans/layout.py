"""A stored table that follows moves by rewriting what they touch.

    <path>/data/unit=<unit>/...      rows, with their shardid
    <path>/manifests/<number>/...    (unit, shardid, nodename, nodeport, n_rows)

A unit is a folder that lies on one node: a shard of the hash, or the keys that one step isolated
for one node. The node of a unit stands in the manifest alone. So a shard that moves as a whole costs a row there, and
a key that is isolated costs the folder that it leaves. Folders are never changed: a step writes new ones and then the next
manifest. The manifest with the highest number that was written to its end is the table; what a failed step
left is in none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.placement import NODE
from evenkeel.sources import materialise

_UNIT = T.StructField("unit", T.StringType())
_SHARD = T.StructField("shardid", T.LongType())
MANIFEST = "unit string, shardid long, nodename string, nodeport int, n_rows long"
#: Rows without a placed key.
_NOWHERE = "none"


def _folder(spark: SparkSession, path: str):
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), here


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The manifests that were written to the end, in order."""
    files, here = _folder(spark, f"{path}/manifests")
    if not files.exists(here):
        return []
    done = [f.getPath() for f in files.listStatus(here)]
    marked = [p for p in done if files.exists(_folder(spark, f"{p.toString()}/_SUCCESS")[1])]
    return sorted(int(p.getName()) for p in marked)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(unit, shardid, nodename, nodeport, n_rows) of the layout as it is now."""
    numbers = _numbers(spark, path)
    if not numbers:
        raise ValueError(f"no layout at {path}")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{numbers[-1]}")


def _data(spark: SparkSession, path: str, schema: T.StructType, units: list[str]) -> DataFrame:
    """The rows of some units; folders of others aren't opened."""
    stored = T.StructType([*schema, _SHARD, _UNIT])
    return spark.read.schema(stored).parquet(f"{path}/data").where(F.col("unit").isin(units))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("unit", "shardid").agg(F.count(F.lit(1)).alias("n_rows"))


def _put(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "unit").sortWithinPartitions("unit", "shardid").write.mode("append").partitionBy("unit").parquet(f"{path}/data")


def write_layout(t: DataFrame, key: str, placed: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Store a table by the shards of ``placed``, a folder for each, and return its reader. ``path`` must not hold a layout yet.

    Rows whose key is NULL or nowhere are kept as well, without a node.
    """
    spark = t.sparkSession
    if _numbers(spark, path):
        raise ValueError(f"there is a layout at {path} already")
    if clash := {"unit", "shardid", *NODE} & set(t.columns):
        raise ValueError(f"the table already has the columns {sorted(clash)}")
    homes = materialise(placed.select(F.col("dist_value").alias("_key"), "shardid", *NODE), folder)
    rows = t.join(homes, t[key] == homes["_key"], "left")
    unit = F.coalesce(F.concat(F.lit("s"), F.col("shardid").cast("string")), F.lit(_NOWHERE))
    _put(rows.select(*(F.col(f"`{c}`") for c in t.columns), "shardid", unit.alias("unit")), path)
    stored = spark.read.schema(T.StructType([_SHARD, _UNIT])).parquet(f"{path}/data")
    nodes = homes.select("shardid", *NODE).distinct()
    manifest = _counted(stored).join(nodes, "shardid", "left")
    manifest.select("unit", "shardid", *NODE, "n_rows").write.parquet(f"{path}/manifests/1")
    return read_layout(spark, path, t.schema)


def read_layout(spark: SparkSession, path: str, schema: T.StructType, nodename: str | None = None) -> DataFrame:
    """The table with nodename, nodeport and shardid; of one node only its folders are read.

    The driver lists the units: a shard or a step has one each, isolated keys have none of their own.
    """
    manifest = read_manifest(spark, path)
    if nodename is not None:
        manifest = manifest.where(F.col("nodename") == nodename)
    homes = manifest.select("unit", *NODE).distinct()
    rows = _data(spark, path, schema, [r.unit for r in homes.select("unit").collect()])
    return rows.join(homes, "unit").select(*(F.col(f"`{c}`") for c in schema.fieldNames()), *NODE, "shardid")


def move_rows(
    spark: SparkSession, path: str, schema: T.StructType, key: str, moved: DataFrame, folder: str | None = None
) -> DataFrame:
    """Bring a stored layout up to date with a plan and return its reader.

    ``moved`` has (dist_value, shardid, needs_isolation, target_node, target_port, new_shard) for each moved key (``moved_keys``). A unit that
    holds a single shard, all of which moves, gets its new node in the manifest. From other units the rows of moved keys
    go to a new unit of their target node, with ``new_shard`` where they are isolated, and the rest to a new unit in place of the
    old one. Other folders are neither read nor written. Old folders stay until ``drop_old_units``.
    """
    moved = materialise(moved, folder)
    number = _numbers(spark, path)[-1]
    old = materialise(read_manifest(spark, path), folder)
    shards = old.groupBy("unit").agg(F.count(F.lit(1)).alias("_shards"))
    touched = old.join(moved.select("shardid").distinct(), "shardid", "left_semi").join(shards, "unit")
    alone = moved.where(~F.col("needs_isolation")).select("shardid", F.col("target_node").alias("_node"), F.col("target_port").alias("_port")).distinct()
    whole = materialise(touched.where(F.col("_shards") == 1).join(alone, "shardid").select("unit", "_node", "_port"), folder)
    split = [r.unit for r in touched.join(whole, "unit", "left_anti").select("unit").distinct().collect()]  # folders, not rows

    rows = _data(spark, path, schema, split)
    go = moved.select(F.col("dist_value").alias("_key"), "target_node", "target_port", "new_shard")
    met = rows.join(go, rows[key] == go["_key"], "left")
    step = F.concat(F.lit(f"m{number + 1}-"), "target_node", F.lit("-"), F.col("target_port").cast("string"))
    stay = F.concat(F.regexp_replace("unit", "[+][0-9]+$", ""), F.lit(f"+{number + 1}"))
    named = met.withColumn("_unit", F.when(F.col("target_node").isNull(), stay).otherwise(step))
    if split:
        _put(named.select(*(F.col(f"`{c}`") for c in schema.fieldNames()), F.coalesce("new_shard", "shardid").alias("shardid"), F.col("_unit").alias("unit")), path)

    # The new units by their names: those left over have the node of the old unit, the others that of the step.
    homes = old.where(F.col("unit").isin(split)).select(stay.alias("unit"), *NODE).distinct()
    goals = moved.select("target_node", "target_port").distinct()
    homes = homes.unionByName(goals.select(step.alias("unit"), F.col("target_node").alias("nodename"), F.col("target_port").alias("nodeport")))
    homes = materialise(homes, folder)
    fresh = spark.read.schema(T.StructType([_SHARD, _UNIT])).parquet(f"{path}/data").where(F.col("unit").isin([r.unit for r in homes.select("unit").collect()]))
    kept = old.where(~F.col("unit").isin(split)).join(whole, "unit", "left")
    kept = kept.select("unit", "shardid", F.coalesce("_node", "nodename").alias("nodename"), F.coalesce("_port", "nodeport").alias("nodeport"), "n_rows")
    new = kept.unionByName(_counted(fresh).join(homes, "unit").select("unit", "shardid", *NODE, "n_rows"))
    new.write.mode("overwrite").parquet(f"{path}/manifests/{number + 1}")
    return read_layout(spark, path, schema)


def moved_keys(plan: DataFrame, last_shard: int) -> DataFrame:
    """The ``moved`` of ``move_rows`` for a plan; isolated keys are numbered as ``apply_plan`` numbers them, above ``last_shard``."""
    new = F.when(F.col("needs_isolation"), F.col("move_no") + last_shard)
    return plan.select("dist_value", "shardid", "needs_isolation", "target_node", "target_port", new.alias("new_shard"))


def drop_old_units(spark: SparkSession, path: str) -> int:
    """Delete the folders that the present manifest doesn't name, and older manifests. No reader of an older state may be at work."""
    numbers = _numbers(spark, path)
    live = {f"unit={r.unit}" for r in read_manifest(spark, path).select("unit").distinct().collect()}
    files, here = _folder(spark, f"{path}/data")
    old = [f.getPath() for f in files.listStatus(here) if f.getPath().getName().startswith("unit=") and f.getPath().getName() not in live]
    old += [_folder(spark, f"{path}/manifests/{n}")[1] for n in numbers[:-1]]
    for folder in old:
        files.delete(folder, True)
    return len(old)

"""Exact row numbers within groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.sources import materialise

# monotonically_increasing_id keeps the row number of a partition in its low bits.
_ROW_BITS = 33


def rank_in_groups(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    name: str = "rank",
    folder: str | None = None,
    k: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by groups order by order)``, without one
    task per group.

    The rows are range-partitioned by (groups, order), so a large group lies in
    many sorted partitions one after the other. They are written once, each
    with its partition and its place in it. A rank is then the place within the
    partition plus the group's rows in earlier partitions, which come from a
    table of one row per (partition, group). ``order`` should have few ties.
    With ``k`` only the first k rows of each group are given; partitions that begin
    beyond them are left out by the same table.
    """
    keys = [F.col(g) for g in groups] + order
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    slots = materialise(ordered.withColumn("_slot", F.monotonically_increasing_id()), folder)
    slots = slots.withColumn("_part", F.shiftright("_slot", _ROW_BITS))

    runs = slots.groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_slot").alias("_first")
    )
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("long"))
    # Written too: Catalyst then knows its size when it chooses the join.
    shift = before - F.col("_first") + 1
    runs = runs.select("_part", *groups, before.alias("_before"), shift.alias("_shift"))
    if k is not None:
        runs = runs.filter(F.col("_before") < k)
    runs = materialise(runs.drop("_before"), folder)
    ranked = slots.join(runs, ["_part", *groups])
    ranked = ranked.select(*df.columns, (F.col("_slot") + F.col("_shift")).alias(name))
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def top_in_groups(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    k: int,
    name: str = "rank",
    folder: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group with their row number.

    No task passes on k rows of every group, and no task gathers a group: the rows are
    ranked over sorted ranges, of which only those that hold a first k are read again.
    """
    return rank_in_groups(df, groups, order, name, folder, k)

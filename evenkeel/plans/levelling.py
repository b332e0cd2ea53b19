"""Level whole shards over the nodes by weight, as one set of moves.

A place is what a shard and those colocated with it have in common: its number above the
table's ``shard_base``, or the shard number itself for the shard of an isolated key. All shards of a
place move together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.operators.placement import NODE
from evenkeel.sources import materialise

_MILLE = 1000


def place_weights(shard_stats: DataFrame, distribution: DataFrame, colocation_id: int) -> DataFrame:
    """(nodename, nodeport, place, weight): the bytes of each place of a colocation group, its tables added up."""
    group = distribution.filter(F.col("colocation_id") == colocation_id).select("table_name", "shard_base", "shard_count")
    stats = shard_stats.filter(F.col("colocation_id") == colocation_id).join(group, "table_name")
    above = F.col("shardid") - F.col("shard_base")
    place = F.when((above >= 0) & (above < F.col("shard_count")), above).otherwise(F.col("shardid"))
    return stats.groupBy(*NODE, place.alias("place")).agg(F.sum("shard_size").alias("weight"))


def shard_moves(
    shard_stats: DataFrame,
    distribution: DataFrame,
    nodes: DataFrame,
    colocation_id: int = 1,
    threshold: float = 0.1,
    folder: str | None = None,
) -> DataFrame:
    """(place, weight, source_node, source_port, target_node, target_port): whole shards to move so that nodes weigh about the same.

    A node may weigh the mean of all primary nodes and ``threshold`` (in thousandths) more. One that weighs more gives its lightest
    places, in order of (weight, place), until it doesn't, and never its last one. Nodes below the mean receive. All
    given places lie on one line, in order of (node, weight, place); the receivers' room up to the limit lies beside it, in order of
    (room falling, node), stretched to the same length. A place goes to the receiver that its middle lies at, so no receiver gets more than its room and one place.

    There is no loop over shards: running sums per node, offsets of nodes, and a join on bins of the line. Nodes without shards receive; without
    rows, or when no node is above its limit, there are no moves.
    """
    if threshold < 0:
        raise ValueError(f"threshold must not be negative, got {threshold}")
    weights = materialise(place_weights(shard_stats, distribution, colocation_id), folder)
    primary = nodes.filter(F.col("noderole") == "primary").select(*NODE).distinct()
    loads = primary.join(weights.groupBy(*NODE).agg(F.sum("weight").alias("load")), NODE, "left")
    loads = loads.select(*NODE, F.coalesce("load", F.lit(0).cast("long")).alias("load"))
    whole = loads.agg(F.sum("load").alias("total"), F.count(F.lit(1)).alias("n"))
    mille = _MILLE + round(threshold * _MILLE)
    limit = F.expr(f"CAST((CAST(total AS DECIMAL(20,0)) * {mille}) DIV (n * {_MILLE}) AS BIGINT)")
    loads = materialise(_with(loads, whole.select("total", "n", limit.alias("limit"))), folder)
    # What each node gives: what still lies on it when a place's turn comes is above the limit.
    turn = W.partitionBy(*NODE).orderBy("weight", "place")
    lying = weights.join(loads.filter(F.col("load") > F.col("limit")), NODE)
    lying = lying.withColumn("_to", F.sum("weight").over(turn)).withColumn("_left", F.col("load") - F.col("_to") + F.col("weight"))
    given = lying.filter((F.col("_left") > F.col("limit")) & (F.col("load") > F.col("_to"))).select(*NODE, "place", "weight", "_to")
    line = W.orderBy(*NODE)  # a row per node
    begins = given.groupBy(*NODE).agg(F.sum("weight").alias("_sum"))
    begins = begins.select(*NODE, (F.sum("_sum").over(line) - F.col("_sum")).alias("_begin"))
    given = materialise(given.join(begins, NODE).withColumn("_middle", 2 * (F.col("_begin") + F.col("_to")) - F.col("weight")), folder)
    room = loads.filter(F.expr("load < (total + n - 1) DIV n")).withColumn("_room", F.col("limit") - F.col("load"))
    end = F.sum("_room").over(W.orderBy(F.desc("_room"), *NODE))
    room = room.filter(F.col("_room") > 0).select(F.col("nodename").alias("target_node"), F.col("nodeport").alias("target_port"), "_room", end.alias("_until"))
    sums = _with(room.agg(F.sum("_room").alias("_rooms"), F.count(F.lit(1)).alias("_n")), given.agg(F.sum("weight").alias("_given")))
    placed = _with(given, sums).withColumn(
        "_at", F.expr("CAST((CAST(_middle AS DECIMAL(19,0)) * CAST(_rooms AS DECIMAL(19,0))) DIV (2 * CAST(_given AS DECIMAL(19,0))) AS BIGINT)")
    )
    width = F.expr("greatest(1, _rooms DIV _n)")
    spans = _with(room, sums.select("_rooms", "_n")).withColumn("_bin", F.explode(F.sequence(F.call_function("div", F.col("_until") - F.col("_room"), width), F.call_function("div", F.col("_until") - 1, width))))
    met = placed.withColumn("_bin", F.call_function("div", F.col("_at"), width)).join(spans.select("_bin", "_room", "_until", "target_node", "target_port"), "_bin")
    met = met.filter((F.col("_at") >= F.col("_until") - F.col("_room")) & (F.col("_at") < F.col("_until")))
    return met.select("place", "weight", F.col("nodename").alias("source_node"), F.col("nodeport").alias("source_port"), "target_node", "target_port")


def _with(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of a single row, as scalar subqueries."""
    return rows.select("*", *(one.select(c).scalar().alias(c) for c in one.columns))


def apply_shard_moves(
    placements: DataFrame, moves: DataFrame, distribution: DataFrame, nodes: DataFrame, colocation_id: int = 1, folder: str | None = None
) -> DataFrame:
    """``placements`` after ``shard_moves``, written: the shards of all the group's tables at a moved place go along."""
    primary = nodes.filter(F.col("noderole") == "primary").select("groupid", F.col("nodename").alias("target_node"), F.col("nodeport").alias("target_port"))
    sent = moves.join(primary, ["target_node", "target_port"]).select("place", F.col("groupid").alias("_group"))
    group = distribution.filter(F.col("colocation_id") == colocation_id).select("shard_base", "shard_count").collect()  # a row per table
    hashed = [sent.filter(F.col("place") < r.shard_count).select((F.col("place") + r.shard_base).alias("shardid"), "_group") for r in group]
    alone = sent.select(F.col("place").alias("shardid"), "_group")
    new = reduce(DataFrame.unionByName, hashed, alone).groupBy("shardid").agg(F.max("_group").alias("_group"))
    return materialise(placements.join(new, "shardid", "left").select("shardid", F.coalesce("_group", "groupid").alias("groupid")), folder)

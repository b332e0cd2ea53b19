"""Even out the keys of a distributed table over its nodes.

``placed`` is always (nodename, nodeport, shardid, dist_value), one row per
key, as ``place_keys`` returns it; each shard lies on one node. A plan is

    (move_no, dist_value, shardid, needs_isolation, source_node, source_port,
     target_node, target_port, source_count, target_count)

with the counts as they stand just before the move.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.placement import (
    NODE,
    Distribution,
    colocated_tables,
    key_type,
    place_keys,
    placed_per_node,
    placed_per_shard,
    resolve_distribution,
)
from evenkeel.operators.ranking import rank_in_groups, top_in_groups
from evenkeel.operators.sizes import placed_bytes, sizes_of
from evenkeel.operators.stats import analyze_tables
from evenkeel.plans.levelling import apply_shard_moves, shard_moves
from evenkeel.plans.moves import legs, matched_legs
from evenkeel.sources import materialise


def balance_status(node_counts: DataFrame) -> DataFrame:
    """One row: fullest and emptiest node (ties: by name, then port), how far
    they are apart, and whether that is at most one."""
    n = F.col("dist_value_count")
    ends = node_counts.agg(
        F.min(F.struct((-n).alias("neg"), *NODE)).alias("full"),
        F.min(F.struct(n.alias("count"), *NODE)).alias("empty"),
    )
    spread = -F.col("full.neg") - F.col("empty.count")
    return ends.select(
        F.col("full.nodename").alias("source_node"),
        F.col("full.nodeport").alias("source_port"),
        (-F.col("full.neg")).alias("source_count"),
        F.col("empty.nodename").alias("target_node"),
        F.col("empty.nodeport").alias("target_port"),
        F.col("empty.count").alias("target_count"),
        spread.alias("spread"),
        (spread <= 1).alias("balanced"),
    )


def move_candidates(placed: DataFrame, k: int = 1, folder: str | None = None) -> DataFrame:
    """The ``k`` keys of each node that would move first as things stand: keys
    alone in their shard, then the others, each by key text."""
    shards = materialise(placed_per_shard(placed), folder)
    counted = placed.join(shards, [*NODE, "shardid"]).withColumn(
        "key_text", F.col("dist_value").cast("string")
    )
    order = [F.when(F.col("dist_value_count") == 1, 0).otherwise(1), F.col("key_text")]
    top = top_in_groups(counted, NODE, order, k, "rank", folder)
    return top.select(*NODE, "rank", "key_text", "shardid", "dist_value_count")


def _last_two(placed: DataFrame) -> DataFrame:
    """(nodename, nodeport, shardid, last_text, prev_text): the largest and the
    second largest key text of each shard. A task passes on no more than the top
    two of a shard, so a shard with many keys is never gathered."""
    by = [*NODE, "shardid"]
    texts = placed.select(*by, F.col("dist_value").cast("string").alias("key_text"))
    falling = W.partitionBy(*by).orderBy(F.desc("key_text"))
    top_two = texts.withColumn("rn", F.row_number().over(falling)).filter(F.col("rn") <= 2)
    return top_two.groupBy(*by).agg(
        F.max(F.when(F.col("rn") == 1, F.col("key_text"))).alias("last_text"),
        F.max(F.when(F.col("rn") == 2, F.col("key_text"))).alias("prev_text"),
    )


def _on_legs(picks: DataFrame, gives: DataFrame) -> DataFrame:
    """Each pick with the leg of its node that its rank lies in.

    A node's ranks are cut into as many bins of equal width as it has legs, and a leg
    stands in each bin that it touches. So a node has at most twice as many
    entries as legs, and all picks together meet about two legs each, however many legs there are.
    """
    wide = gives.groupBy(*NODE).agg(
        F.greatest(F.lit(1).cast("long"), F.expr("max(pick_to) DIV count(*)")).alias("_width")
    )
    bins = F.sequence(F.expr("pick_from DIV _width"), F.expr("pick_to DIV _width"))
    entries = gives.join(wide, NODE).filter(F.col("pick_from") <= F.col("pick_to"))
    entries = entries.withColumn("_bin", F.explode(bins)).drop("_width")
    placed = picks.join(wide, NODE).withColumn("_bin", F.expr("rank DIV _width")).drop("_width")
    met = placed.join(entries, [*NODE, "_bin"]).drop("_bin")
    return met.filter(F.col("rank").between(F.col("pick_from"), F.col("pick_to")))


def rebalance_plan(
    placed: DataFrame,
    max_moves: int | None = None,
    nodes: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """The moves that even out the nodes, as one set: no loop over moves.

    Only nodes that hold keys take part, unless ``nodes`` names the cluster's
    nodes: then primary nodes without keys receive too. ``max_moves`` keeps the
    first moves only. Rows come in no order; ``move_no`` gives it.

    Which key is a node's next one: keys alone in their shard go first, then
    the others, each by text. A key that shares its shard must be isolated, and
    the last one left in a shard no longer has to be: being alone it goes
    directly after the one before it.

    ``placed`` is read three times, so hand in a written table (``materialise``)
    when it comes from a large scan. What depends on nodes and shards only is worked
    out first and written; then the keys of the giving nodes alone are ranked,
    and the moves are looked up by arithmetic, without another shuffle.
    """
    if max_moves is not None and max_moves < 0:
        raise ValueError(f"max_moves must not be negative, got {max_moves}")
    shards = materialise(placed_per_shard(placed), folder)
    held = shards.groupBy(*NODE).agg(F.sum("dist_value_count").alias("held"))
    if nodes is not None:
        primary = nodes.filter(F.col("noderole") == "primary").select(*NODE).distinct()
        held = primary.join(held, NODE, "left").select(
            *NODE, F.coalesce("held", F.lit(0).cast("long")).alias("held")
        )
    walks = materialise(legs(held), folder)
    gives = matched_legs(walks, max_moves)

    # Keys of giving nodes, in the order in which their node lets go of them.
    givers = gives.select(*NODE).distinct()
    by = [*NODE, "shardid"]
    ends = _last_two(placed.join(givers, NODE, "left_semi"))
    # Written, so that both sides of the next join are plain tables: it is then
    # broadcast if small, and otherwise AQE can split a shard with many keys.
    facts = materialise(shards.join(ends, by), folder)
    shared = F.col("dist_value_count") > 1
    is_last = shared & (F.col("key_text") == F.col("last_text"))
    keys = placed.join(facts, by).withColumn("key_text", F.col("dist_value").cast("string"))
    keys = keys.select(
        *NODE,
        "shardid",
        "dist_value",
        (shared & ~is_last).alias("needs_isolation"),
        shared.cast("int").alias("_shared"),
        F.when(is_last, F.col("prev_text")).otherwise(F.col("key_text")).alias("_text"),
        is_last.cast("int").alias("_last"),
    )
    order = [F.col("_shared"), F.col("_text"), F.col("_last")]
    if max_moves is not None:
        picks = top_in_groups(keys, NODE, order, max_moves, "rank", folder)
    else:
        picks = rank_in_groups(keys, NODE, order, "rank", folder)

    # Pick number -> move number -> receiving node and both counts.
    picks = _on_legs(picks, gives)
    step = F.col("rank") - F.col("pick")
    moves = picks.select(
        (F.col("move") + step * F.col("turn")).alias("move_no"),
        "dist_value",
        "shardid",
        "needs_isolation",
        F.col("nodename").alias("source_node"),
        F.col("nodeport").alias("source_port"),
        (F.col("level") - step).alias("source_count"),
        "take_level",
        "take_turn",
        "take_first",
    )
    ahead = F.col("move_no") - F.col("take_first")
    moves = moves.withColumn("place", ahead % F.col("take_turn")).withColumn(
        "target_count", F.col("take_level") + F.call_function("div", ahead, F.col("take_turn"))
    )
    targets = walks.filter(~F.col("gives")).select(
        F.col("level").alias("take_level"),
        "place",
        F.col("nodename").alias("target_node"),
        F.col("nodeport").alias("target_port"),
    )
    moves = moves.filter(F.col("source_count") - F.col("target_count") > 1)
    return moves.join(targets, ["take_level", "place"]).select(
        "move_no",
        "dist_value",
        "shardid",
        "needs_isolation",
        "source_node",
        "source_port",
        "target_node",
        "target_port",
        "source_count",
        "target_count",
    )


def _last_shard(placed: DataFrame, placements: DataFrame) -> Column:
    both = placements.select("shardid").unionByName(placed.select("shardid"))
    return both.agg(F.max("shardid").alias("last_shard")).scalar()


def apply_plan(placed: DataFrame, plan: DataFrame, placements: DataFrame) -> DataFrame:
    """``placed`` after the moves of a plan. An isolated key gets a shard of its
    own, numbered above all shards of the cluster and of ``placed`` by its move; a key that moved
    with its shard keeps the shard; the others stay as they are."""
    last_shard = _last_shard(placed, placements)
    moved = plan.select(
        "dist_value",
        F.col("target_node").alias("new_node"),
        F.col("target_port").alias("new_port"),
        F.when(F.col("needs_isolation"), last_shard + F.col("move_no")).alias("new_shard"),
    )
    joined = placed.join(moved, "dist_value", "left")
    return joined.select(
        F.coalesce("new_node", "nodename").alias("nodename"),
        F.coalesce("new_port", "nodeport").alias("nodeport"),
        F.coalesce("new_shard", "shardid").alias("shardid"),
        "dist_value",
    )


@dataclass(frozen=True)
class Applied:
    """The cluster after a plan: ``placed`` and ``placements`` as before, and
    ``isolated`` (dist_value, shardid), the keys with a shard of their own."""

    placed: DataFrame
    placements: DataFrame
    isolated: DataFrame


def apply_moves(
    placed: DataFrame,
    plan: DataFrame,
    placements: DataFrame,
    nodes: DataFrame,
    isolated: DataFrame | None = None,
    folder: str | None = None,
) -> Applied:
    """``apply_plan`` as a closed step: what it returns is what the lookups, the counts and the
    next plan take (``isolated=``, ``placements``).

    All three are written, so the next step reads tables. ``placements`` and ``isolated``
    grow by a row per isolated key.
    """
    plan = plan.select("move_no", "dist_value", "shardid", "needs_isolation", "target_node", "target_port")
    after = materialise(apply_plan(placed, plan, placements), folder)
    primary = nodes.filter(F.col("noderole") == "primary").select(
        F.col("groupid").alias("_group"), F.col("nodename").alias("target_node"), F.col("nodeport").alias("target_port")
    )
    sent = plan.join(primary, ["target_node", "target_port"])
    whole = sent.filter(~F.col("needs_isolation")).select("shardid", "_group")
    stay = placements.join(whole, "shardid", "left").select("shardid", F.coalesce("_group", "groupid").alias("groupid"))
    number = _last_shard(placed, placements) + F.col("move_no")
    alone = sent.filter("needs_isolation").select("dist_value", number.alias("shardid"), "_group")
    new = materialise(stay.unionByName(alone.select("shardid", F.col("_group").alias("groupid"))), folder)
    own = alone.select("dist_value", "shardid")
    own = materialise(own if isolated is None else isolated.select("dist_value", "shardid").unionByName(own), folder)
    return Applied(after, new, own)


def follow_plan(
    placed: DataFrame, plan: DataFrame, lead: Distribution, follower: Distribution, placements: DataFrame
) -> DataFrame:
    """``placed`` of a colocated table after the plan of ``lead``'s table.

    A key that the plan isolates goes to the same node, in a shard of its own; a shard that
    moves as a whole takes along what the other table has in it. Shards correspond by their place above
    ``shard_base``; a shard of one key (beyond the hash range) by its key.
    """
    if (lead.colocation_id, lead.shard_count) != (follower.colocation_id, follower.shard_count):
        raise ValueError(f"{lead.table_name} and {follower.table_name} are not colocated")
    last_shard = _last_shard(placed, placements)
    target = [F.col("target_node").alias("new_node"), F.col("target_port").alias("new_port")]
    place = F.col("shardid") - lead.shard_base
    hashed = (place >= 0) & (place < lead.shard_count)
    by_key = plan.filter(F.col("needs_isolation") | ~hashed).select(
        "dist_value", *target, F.when(F.col("needs_isolation"), last_shard + F.col("move_no")).alias("new_shard")
    )
    by_shard = plan.filter(~F.col("needs_isolation") & hashed).select(
        (place + follower.shard_base).alias("shardid"), F.col("target_node").alias("with_node"), F.col("target_port").alias("with_port")
    )
    joined = placed.join(by_key, "dist_value", "left").join(by_shard, "shardid", "left")
    return joined.select(
        F.coalesce("new_node", "with_node", "nodename").alias("nodename"),
        F.coalesce("new_port", "with_port", "nodeport").alias("nodeport"),
        F.coalesce("new_shard", "shardid").alias("shardid"),
        "dist_value",
    )


def relayout(
    t: DataFrame,
    key: str,
    placed: DataFrame,
    path: str,
    shard_folders: bool = False,
    folder: str | None = None,
) -> DataFrame:
    """Write a table in the layout of ``placed`` and return a reader of it, with
    the columns nodename, nodeport and shardid added.

    There is one folder per node, with the rows of a file sorted by shard, so
    that filters on the node prune folders and filters on the shard prune pages.
    ``shard_folders`` adds a folder per shard; that is for layouts without many
    isolated keys, each of which has a shard of its own.

    Rows are spread with a rebalance hint: AQE cuts what is larger than its
    target size, be it a node, a shard or one key, over several tasks and
    files. Rows with a NULL or unplaced key are kept, in the default folder.

    ``placed`` is written first. As a plain table it is broadcast if it is
    small; if not, both sides of the join are shuffles, which lets AQE split
    the rows of a hot key.
    """
    by = [*NODE, "shardid"]
    if set(t.columns) & set(by):
        raise ValueError(f"the table already has one of the columns {by}")
    homes = materialise(placed.select(F.col("dist_value").alias("_key"), *by), folder)
    rows = t.join(homes, t[key] == homes["_key"], "left").drop("_key")
    folders = by if shard_folders else NODE
    spread = rows.hint("rebalance", *folders).sortWithinPartitions(*by)
    spread.write.mode("overwrite").partitionBy(*folders).parquet(path)
    schema = T.StructType([*t.schema, *(placed.schema[c] for c in by)])
    return t.sparkSession.read.schema(schema).parquet(path)


def balance_report(before: DataFrame, after: DataFrame, per: str = "shard") -> DataFrame:
    """Keys per shard or per node of two placements, side by side in a
    ``phase`` column, each phase from the fullest down."""
    count = {"shard": placed_per_shard, "node": placed_per_node}[per]
    return _phases(
        count(before), count(after), "dist_value_count", NODE + ["shardid"] * (per == "shard")
    )


def size_report(
    before: DataFrame, after: DataFrame, table: str | None = None, colocation_id: int = 1
) -> DataFrame:
    """``shard_size`` of two sets of shard sizes, as ``balance_report``."""
    sizes = [sizes_of(stats, table, colocation_id) for stats in (before, after)]
    return _phases(*sizes, "shard_size", [*NODE, "table_name", "shardid"])


def _phases(before: DataFrame, after: DataFrame, measure: str, ties: list[str]) -> DataFrame:
    both = before.withColumn("phase", F.lit("before")).unionByName(
        after.withColumn("phase", F.lit("after"))
    )
    return both.select("phase", *before.columns).orderBy(F.desc("phase"), F.desc(measure), *ties)


def follow_placements(
    placements: DataFrame, plan: DataFrame, lead: Distribution, followers: list[Distribution], nodes: DataFrame
) -> DataFrame:
    """``placements`` with the shards of colocated tables at the places where the plan moves a whole shard of ``lead``'s table."""
    primary = nodes.filter(F.col("noderole") == "primary").select(
        F.col("groupid").alias("_group"), F.col("nodename").alias("target_node"), F.col("nodeport").alias("target_port")
    )
    place = F.col("shardid") - lead.shard_base
    whole = plan.filter(~F.col("needs_isolation") & (place >= 0) & (place < lead.shard_count))
    sent = whole.join(primary, ["target_node", "target_port"])
    moved = [sent.select((place + f.shard_base).alias("shardid"), "_group") for f in followers]
    if not moved:
        return placements
    new = placements.join(reduce(DataFrame.unionByName, moved), "shardid", "left")
    return new.select("shardid", F.coalesce("_group", "groupid").alias("groupid"))


@dataclass(frozen=True)
class Rebalanced:
    """What ``rebalance_evenly`` returns. ``placements`` and ``isolated`` are the cluster's after it: counts, lookups and the next
    rebalance take them. ``after`` has the keys of the table as they lie then, ``shard_moves`` the whole shards moved at the end, and
    ``shard_stats`` the sizes of the colocated tables if ``widths`` were given."""

    dist: Distribution
    before: DataFrame
    plan: DataFrame
    after: DataFrame
    statistics: DataFrame | None
    placements: DataFrame
    isolated: DataFrame
    shard_moves: DataFrame | None = None
    shard_stats: DataFrame | None = None


def rebalance_evenly(
    tables: dict[str, DataFrame],
    distribution: DataFrame,
    placements: DataFrame,
    nodes: DataFrame,
    table: str,
    column: str | None = None,
    max_moves: int | None = None,
    analyze_at_end: bool = True,
    folder: str | None = None,
    rebalance_at_end: bool = False,
    isolated: DataFrame | None = None,
    include_empty_nodes: bool = False,
    widths: dict[str, Column] | None = None,
    threshold: float = 0.1,
) -> Rebalanced:
    """Plan and apply a rebalance of one table, from its name. All that is returned is written, so it can be used as it is.

    A wrong ``column`` is ignored with a warning. The shards of colocated tables go along with those of the table. ``rebalance_at_end``
    then levels whole shards of all colocated tables found in ``tables`` (``shard_moves``) by ``widths``, the bytes of a row by
    table, or by rows without them. With ``analyze_at_end`` the statistics of these tables are added. ``isolated`` comes from an earlier rebalance;
    ``include_empty_nodes`` lets nodes without keys receive.
    """
    dist = resolve_distribution(distribution, table, column, on_mismatch="ignore")
    if table not in tables:
        raise ValueError(f"unknown table {table}")
    key_type(tables[table], dist.dist_column)
    names = [r.table_name for r in colocated_tables(distribution, table).collect()]
    group = {name: resolve_distribution(distribution, name) for name in names}
    before = materialise(place_keys(tables[table], dist, placements, nodes, isolated), folder)
    plan = materialise(rebalance_plan(before, max_moves, nodes if include_empty_nodes else None, folder), folder)
    done = apply_moves(before, plan, placements, nodes, isolated, folder)
    followers = [d for name, d in group.items() if name != table]
    new, after, levelled, stats = materialise(follow_placements(done.placements, plan, dist, followers, nodes), folder), done.placed, None, None
    given = {name: tables[name] for name in names if name in tables}
    if (rebalance_at_end or analyze_at_end) and len(given) < len(names):
        warnings.warn(f"the colocated tables {sorted(set(names) - set(given))} are left out of statistics and levelling: they were not given", stacklevel=2)

    def sizes() -> DataFrame:
        parts = []
        for name, t in given.items():
            own = group[name]
            width = F.lit(1).cast("long") if widths is None else widths[name]
            parts.append(placed_bytes(t, own, width, place_keys(t, own, new, nodes, done.isolated)))
        return materialise(reduce(DataFrame.unionByName, parts), folder)

    if rebalance_at_end:
        levelled = materialise(shard_moves(sizes(), distribution, nodes, dist.colocation_id, threshold, folder), folder)
        new = apply_shard_moves(new, levelled, distribution, nodes, dist.colocation_id, folder)
        after = materialise(place_keys(tables[table], dist, new, nodes, done.isolated), folder)
    if widths is not None:
        stats = sizes()
    statistics = analyze_tables(given) if analyze_at_end else None
    return Rebalanced(dist, before, plan, after, statistics, new, done.isolated, levelled, stats)

"""The rebalance plan against a loop that moves one key at a time."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from checks import layout
from evenkeel.operators.placement import place_keys, placed_per_node
from evenkeel.operators.ranking import rank_in_groups, top_in_groups
from evenkeel.operators.sizes import placed_bytes
from evenkeel.plans import (
    apply_plan,
    balance_report,
    balance_status,
    move_candidates,
    rebalance_evenly,
    rebalance_plan,
    relayout,
)
from evenkeel.sources import file_shard_stats, materialise

SF = "/root/testdata/sf0.01"
PLACED = "nodename string, nodeport int, shardid long, dist_value string"

# Settings that a small run would not meet by itself: several partitions per
# group when ranking, no broadcast, no top-k shortcut.
SPREAD = {
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "5",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.optimizer.windowGroupLimitThreshold": "2",
}


@contextmanager
def settings(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def greedy(placed, max_moves=None, empty=()):
    """One move after the other; placed is [(name, port, shard, key)]."""
    nodes = defaultdict(set)
    for node in empty:
        nodes[node] = set()
    shards = defaultdict(set)
    for name, port, shard, key in placed:
        nodes[name, port].add((key, shard))
        shards[shard].add(key)
    moves = []
    while nodes and (max_moves is None or len(moves) < max_moves):
        source = min(nodes, key=lambda n: (-len(nodes[n]), n))
        target = min(nodes, key=lambda n: (len(nodes[n]), n))
        have, lack = len(nodes[source]), len(nodes[target])
        if have - lack <= 1:
            break
        key, shard = min(nodes[source], key=lambda k: (len(shards[k[1]]) != 1, k[0]))
        isolate = len(shards[shard]) > 1
        moves.append((len(moves) + 1, key, shard, isolate, *source, *target, have, lack))
        nodes[source].remove((key, shard))
        new_shard = shard
        if isolate:
            shards[shard].remove(key)
            new_shard = ("own", key)
            shards[new_shard].add(key)
        nodes[target].add((key, new_shard))
    return moves


def random_layout(seed):
    rng = random.Random(seed)
    nodes = [(rng.choice("abc") + str(i % 3), 5432 + i) for i in range(rng.randint(1, 6))]
    shards = [(100 + i, rng.choice(nodes)) for i in range(rng.randint(1, 14))]
    if seed % 2:
        shards = [(s, nodes[0] if rng.random() < 0.5 else node) for s, node in shards]
    hot = rng.choice(shards)
    rows = []
    for key in rng.sample(range(1, 2000), rng.randint(1, 70)):
        shard, (name, port) = hot if rng.random() < 0.34 else rng.choice(shards)
        rows.append((name, port, shard, str(key)))
    return rows


def as_moves(plan):
    return [tuple(r) for r in plan.orderBy("move_no").collect()]


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_the_loop(spark, seed):
    rows = random_layout(seed)
    placed = spark.createDataFrame(rows, PLACED)
    assert as_moves(rebalance_plan(placed)) == greedy(rows)


@pytest.mark.parametrize("seed, max_moves", [(11, None), (12, 3), (13, 10), (14, None)])
def test_plan_is_the_loop_when_spread_out(spark, seed, max_moves):
    rows = random_layout(seed)
    placed = spark.createDataFrame(rows, PLACED)
    with settings(spark, SPREAD):
        assert as_moves(rebalance_plan(placed, max_moves)) == greedy(rows, max_moves)


def test_many_nodes(spark):
    rng = random.Random(5)
    rows, key = [], 0
    for i in range(40):
        for _ in range(rng.choice([1, 2, 2, 7, 19, 30])):
            key += 1
            rows.append((f"n{rng.randint(0, 9)}{i}", 5432, 100 + i * 3 + key % 3, f"k{key}"))
    by_shard = {}
    rows = [(*by_shard.setdefault(s, (n, p)), s, k) for n, p, s, k in rows]
    placed = spark.createDataFrame(rows, PLACED)
    assert as_moves(rebalance_plan(placed)) == greedy(rows)


@pytest.mark.parametrize("max_moves", [0, 1, 7])
def test_limit_is_a_prefix(spark, max_moves):
    rows = random_layout(3)
    placed = spark.createDataFrame(rows, PLACED)
    assert as_moves(rebalance_plan(placed, max_moves)) == greedy(rows)[:max_moves]


def test_limit_must_not_be_negative(spark):
    with pytest.raises(ValueError, match="max_moves"):
        rebalance_plan(spark.createDataFrame([], PLACED), -1)


def test_no_keys_and_one_node(spark):
    assert as_moves(rebalance_plan(spark.createDataFrame([], PLACED))) == []
    one = [("a", 1, 100 + i % 3, str(i)) for i in range(9)]
    assert as_moves(rebalance_plan(spark.createDataFrame(one, PLACED))) == []


def test_equal_counts_need_no_move(spark):
    rows = [("a", 1, 1, "1"), ("a", 1, 1, "2"), ("b", 1, 2, "3"), ("b", 1, 2, "4")]
    assert as_moves(rebalance_plan(spark.createDataFrame(rows, PLACED))) == []


def test_empty_nodes_receive_only_when_named(spark):
    rows = [("a", 1, 1, str(i)) for i in range(5)] + [("b", 1, 2, "x")]
    placed = spark.createDataFrame(rows, PLACED)
    nodes = spark.createDataFrame(
        [(1, "a", 1, "primary"), (2, "b", 1, "primary"), (3, "c", 1, "primary"),
         (3, "d", 1, "secondary")],
        "groupid int, nodename string, nodeport int, noderole string",
    )
    assert as_moves(rebalance_plan(placed)) == greedy(rows)
    assert as_moves(rebalance_plan(placed, nodes=nodes)) == greedy(rows, empty=[("c", 1)])


def test_keys_are_taken_in_text_order(spark):
    rows = [("a", 1, 1, k) for k in ["9", "10", "2", "7"]] + [("b", 1, 2, "x")]
    first = as_moves(rebalance_plan(spark.createDataFrame(rows, PLACED), 1))[0]
    assert first[1] == "10"


@pytest.fixture(scope="module")
def orders(spark):
    t, dist = layout.table(spark, SF, "orders"), layout.dist_of("orders")
    placed = place_keys(t, dist, layout.placements(spark), layout.nodes(spark))
    before = materialise(placed)
    plan = materialise(rebalance_plan(before))
    return t, dist, before, plan, apply_plan(before, plan, layout.placements(spark))


def test_known_plan_of_orders(orders):
    moves = as_moves(orders[3])
    assert len(moves) == 365
    assert moves[0] == (1, 1005, 102204, True, "worker-1", 5432, "worker-4", 5432, 738, 149)
    assert moves[-1] == (365, 1001, 102223, True, "worker-2", 5432, "worker-4", 5432, 376, 374)


def test_applied_plan_is_balanced_and_keeps_every_key(spark, orders):
    _, _, before, _, after = orders
    assert balance_status(placed_per_node(after)).head().spread <= 1
    keys = [sorted(r.dist_value for r in p.collect()) for p in (before, after)]
    assert keys[0] == keys[1]
    assert rebalance_plan(after).count() == 0
    # Isolated keys are alone, above every shard of the cluster.
    last = layout.placements(spark).agg(F.max("shardid")).head()[0]
    own = Counter(r.shardid for r in after.collect() if r.shardid > last)
    assert own and set(own.values()) == {1}


def test_report_sums_agree(orders):
    _, _, before, _, after = orders
    for per in ("shard", "node"):
        rows = balance_report(before, after, per).collect()
        phases = [r.phase for r in rows]
        assert phases == sorted(phases, reverse=True)
        for phase in ("before", "after"):
            counts = [r.dist_value_count for r in rows if r.phase == phase]
            assert sum(counts) == 1500 and counts == sorted(counts, reverse=True)


def test_sizes_follow_the_keys(orders):
    t, dist, before, _, after = orders
    for placed in (before, after):
        sizes = placed_bytes(t, dist, layout.width_of("orders"), placed)
        assert sizes.agg(F.sum("shard_size")).head()[0] == 15000 * 56


def test_candidates_by_both_ways(spark):
    rows = random_layout(7)
    placed = spark.createDataFrame(rows, PLACED)
    keys_of = Counter(s for _, _, s, _ in rows)
    want = defaultdict(list)
    for n, p, s, k in sorted(rows, key=lambda r: (keys_of[r[2]] != 1, r[3])):
        want[n, p].append((k, s, keys_of[s]))
    for k in (1, 2, 5):
        for conf in ({}, SPREAD):
            with settings(spark, conf):
                got = defaultdict(list)
                for r in move_candidates(placed, k).orderBy("rank").collect():
                    got[r.nodename, r.nodeport].append((r.key_text, r.shardid, r.dist_value_count))
            assert got == {n: v[:k] for n, v in want.items()}


def test_ranks_do_not_depend_on_the_partitions(spark):
    lines = layout.table(spark, SF, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"
    )
    order = [F.desc("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")]
    unique = lines.dropDuplicates(["l_returnflag", "l_partkey", "l_orderkey", "l_linenumber"])
    with settings(spark, {**SPREAD, "spark.sql.shuffle.partitions": "13"}):
        ranked = rank_in_groups(unique, ["l_returnflag"], order)
        assert ranked.select(F.spark_partition_id()).distinct().count() > 3
        ranked.createOrReplaceTempView("ranked")
    wrong = spark.sql("""
        SELECT * FROM (SELECT rank, row_number() OVER (PARTITION BY l_returnflag
            ORDER BY l_partkey DESC, l_orderkey, l_linenumber) AS want FROM ranked)
        WHERE rank <> want""")
    assert wrong.count() == 0
    assert ranked.count() == unique.count()
    with settings(spark, SPREAD):
        top = top_in_groups(unique, ["l_returnflag"], order, 4)
        assert sorted(r.rank for r in top.collect()) == sorted([1, 2, 3, 4] * 3)


@pytest.mark.parametrize("shuffled", [False, True])
def test_relayout_keeps_rows_and_splits_a_hot_key(spark, orders, tmp_path, shuffled):
    _, _, before, _, after = orders
    hot = before.head().dist_value
    key = F.when(F.col("o_orderkey") % 3 == 0, hot).when(
        F.col("o_orderkey") % 50 != 1, F.col("o_custkey")
    )
    # Several tasks feed the write, as they do for a large table.
    t = layout.table(spark, SF, "orders").withColumn("o_custkey", key).repartition(8)
    # AQE's limits for a skewed partition, scaled down from hundreds of MB.
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    no_broadcast = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    with settings(spark, small | (no_broadcast if shuffled else {})):
        stored = relayout(t, "o_custkey", after, str(tmp_path / "orders"))
    assert stored.count() == 15000
    assert stored.filter("o_custkey IS NULL").count() == t.filter("o_custkey IS NULL").count()
    assert stored.filter("o_custkey IS NULL AND shardid IS NOT NULL").count() == 0
    home = after.filter(F.col("dist_value") == hot).head()
    rows = stored.filter(F.col("o_custkey") == hot)
    assert {(r.nodename, r.shardid) for r in rows.collect()} == {(home.nodename, home.shardid)}
    assert rows.select(F.col("_metadata.file_name")).distinct().count() > 1
    assert sorted(rows.drop("nodename", "nodeport", "shardid").collect()) == sorted(
        t.filter(F.col("o_custkey") == hot).collect()
    )


def test_relayout_with_shard_folders_has_sizes(spark, orders, tmp_path, capsys):
    t, _, before, _, _ = orders
    path = str(tmp_path / "orders")
    stored = relayout(t, "o_custkey", before, path, shard_folders=True)
    stored.filter(F.col("shardid") == 102204).explain()
    assert re.search(r"PartitionFilters: \[.*shardid", capsys.readouterr().out)
    stats = file_shard_stats(spark, path, "orders", 1)
    assert stats.count() == 32
    assert {r.nodename for r in stats.collect()} == {f"worker-{i}" for i in range(1, 5)}
    assert stats.filter("shard_size <= 0").count() == 0
    with pytest.raises(ValueError, match="already has"):
        relayout(stored, "o_custkey", before, path)


def test_rebalance_by_name(spark):
    tables = {n: layout.table(spark, SF, n) for n in ("orders", "customer")}
    metadata = (layout.distribution(spark), layout.placements(spark), layout.nodes(spark))
    with pytest.warns(UserWarning, match="o_custkey"):
        done = rebalance_evenly(tables, *metadata, "orders", "o_orderkey", max_moves=20)
    assert done.plan.count() == 20
    assert {r.table_name for r in done.statistics.collect()} == {"orders", "customer"}
    with pytest.raises(ValueError, match="not a distributed table"):
        rebalance_evenly(tables, *metadata, "part")
    with pytest.raises(ValueError, match="unknown table"):
        rebalance_evenly(tables, *metadata, "lineitem")

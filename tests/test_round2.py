"""Faults that the fixtures of the registered queries don't bring out."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from checks import layout
from evenkeel.functions import shard_of
from evenkeel.functions.sql import register_functions, register_key_functions
from evenkeel.operators import inventory, placement, runs, stats
from evenkeel.plans import rebalance
from evenkeel.plans.moves import legs, matched_legs
from evenkeel.sources import file_relations, file_shard_stats, materialise, scratch

SF = "/root/testdata/sf0.01"


def test_fixed_values_are_pinned():
    assert inventory.TPCC_TABLES == "warehouse district customer history new_order oorder order_line item stock".split()
    assert inventory.TPCH_TABLES == "region nation supplier part partsupp customer orders lineitem".split()
    assert inventory.VIEW_PATTERNS == ["tpcc%", "tpch%", "hammerdb%", "%neword%", "%payment%", "%delivery%", "%ostat%", "%slev%"]
    assert inventory.LEFTOVER_KINDS == ["r", "p", "v", "m", "S"]
    assert len(inventory.SEQUENCE_PATTERNS) == 19 and "order_line%" in inventory.SEQUENCE_PATTERNS
    assert runs.RESULT_MARK == "TEST RESULT :"


def test_instants_have_one_shard_in_all_time_zones(spark):
    zone, found = spark.conf.get("spark.sql.session.timeZone"), set()
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            df = spark.range(1).select(F.timestamp_micros(F.lit(1_700_000_000_000_000)).alias("k"))
            found.add(df.select(shard_of("k", 1024, "timestamp")).head()[0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(found) == 1


def test_zeros_are_one_key(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "k double")
    assert len({r[0] for r in df.select(shard_of("k", 1024, "double")).collect()}) == 1


def test_a_value_of_another_type_raises(spark):
    meta = layout.distribution(spark), layout.placements(spark), layout.nodes(spark)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        placement.locate_key(*meta, "orders", "o_custkey", "x1", "bigint").collect()


def test_sql_lookup_casts_and_checks(spark):
    register_functions(spark)
    layout.table(spark, SF, "orders").createOrReplaceTempView("t_orders")
    layout.placements(spark).createOrReplaceTempView("t_placements")
    layout.nodes(spark).createOrReplaceTempView("t_nodes")
    dist = layout.dist_of("orders")
    register_key_functions(spark, "t", "t_orders", "o_custkey", "t_placements", "t_nodes", dist.shard_count, dist.shard_base)
    assert spark.sql("SELECT shard_id FROM t_locate_key('0105')").collect() == spark.sql("SELECT shard_id FROM t_locate_key('105')").collect()
    with pytest.raises(ValueError, match="nokey"):
        register_key_functions(spark, "t", "t_orders", "nokey", "t_placements", "t_nodes", 32)


def test_all_rows_of_a_lookup_come_back(spark):
    keys = spark.createDataFrame([(1,), (None,), (2,)], "k long")
    meta = layout.distribution(spark), layout.placements(spark), layout.nodes(spark)
    rows = placement.locate_keys(keys, "k", *meta, "orders").collect()
    assert len(rows) == 3 and [r.nodename is None for r in sorted(rows, key=lambda r: r.k or 0)] == [True, False, False]


def test_lookup_after_a_rebalance_follows_the_moves(spark):
    nodes, dist = layout.nodes(spark), layout.dist_of("orders")
    orders = layout.table(spark, SF, "orders")
    before = materialise(placement.place_keys(orders, dist, layout.placements(spark), nodes))
    plan = materialise(rebalance.rebalance_plan(before, 10))
    done = rebalance.apply_moves(before, plan, layout.placements(spark), nodes)
    move = plan.orderBy("move_no").head()
    home = placement.locate_key(layout.distribution(spark), done.placements, nodes, "orders", "o_custkey", move.dist_value, "bigint", done.isolated).collect()
    assert [(r.nodename, r.nodeport) for r in home] == [(move.target_node, move.target_port)]
    again = placement.place_keys(orders, dist, done.placements, nodes, done.isolated)
    assert again.exceptAll(done.placed).count() == 0 and again.count() == done.placed.count()


def test_legs_of_a_thousand_nodes_agree_with_a_loop(spark):
    n = 1000
    held = [(7 * k * k) % 4001 for k in range(n)]
    df = spark.createDataFrame([(f"n{k:04d}", 1, h) for k, h in enumerate(held)], "nodename string, nodeport int, held long")
    walks = materialise(legs(df))
    gives = materialise(matched_legs(walks, None))
    mean_low = sum(held) // n
    picks = spark.createDataFrame([(f"n{k:04d}", 1, r) for k, h in enumerate(held) if k % 97 == 0 for r in range(1, max(0, h - mean_low) + 1)], "nodename string, nodeport int, rank long")
    got = rebalance._on_legs(picks, gives)
    want = picks.join(gives, ["nodename", "nodeport"]).filter(F.col("rank").between(F.col("pick_from"), F.col("pick_to")))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_columns_without_order_have_a_row(spark):
    df = spark.sql("SELECT parse_json('{\"a\": 1}') AS v, array(1) AS a, CAST(NULL AS map<int, int>) AS m")
    for exact in (True, False):
        rows = {r.column_name: r for r in stats.analyze_tables({"t": df}, exact).collect()}
        assert set(rows) == {"v", "a", "m"} and rows["m"].nulls == 1 and rows["a"].distinct_values is None
    with pytest.raises(ValueError):
        stats.analyze_tables({})


def test_files_keep_their_names(spark, tmp_path):
    df = spark.range(3)
    for name in ("sales.v1", "sales.v2"):
        df.write.parquet(str(tmp_path / "root" / name))
    assert {r.name for r in file_relations(spark, str(tmp_path / "root")).collect()} == {"sales.v1", "sales.v2"}
    stored = df.select("id", F.lit("007").alias("nodename"), F.lit(1).alias("nodeport"))
    stored.write.partitionBy("nodename", "nodeport").parquet(str(tmp_path / "layout"))
    row = file_shard_stats(spark, str(tmp_path / "layout"), "t", 1).head()
    assert (row.nodename, row.nodeport, row.shardid) == ("007", 1, None) and row.shard_size > 0


def test_scratch_is_deleted(spark, tmp_path):
    with scratch(spark, str(tmp_path)) as folder:
        assert materialise(spark.range(5), folder).count() == 5
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_a_missing_colocated_table_is_named(spark):
    tables = {"orders": layout.table(spark, SF, "orders")}
    with pytest.warns(UserWarning, match="customer"):
        rebalance.rebalance_evenly(tables, layout.distribution(spark), layout.placements(spark), layout.nodes(spark), "orders", max_moves=1)

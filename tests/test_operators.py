"""Metadata, sizes, inventory and statistics: errors and edges."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from checks import layout
from evenkeel import Cluster
from evenkeel.functions import quote_ident, shard_of, size_pretty, to_blocks
from evenkeel.functions.sql import (
    register_functions,
    register_key_functions,
    register_shard_size,
)
from evenkeel.operators import inventory as inv
from evenkeel.operators.placement import (
    Distribution,
    colocated_tables,
    key_type,
    keys_per_node,
    keys_per_shard,
    locate_key,
    locate_keys,
    place_keys,
    resolve_distribution,
)
from evenkeel.operators.sizes import shard_size, top_relations
from evenkeel.operators.stats import analyze_tables
from evenkeel.sources import catalog_relations, file_relations, materialise, shared_folder

SF = "/root/testdata/sf0.01"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def metadata(spark):
    return layout.distribution(spark), layout.placements(spark), layout.nodes(spark)


# -- functions


def test_sizes_as_text(spark):
    kb, mb, gb, tb, pb = (1 << s for s in (10, 20, 30, 40, 50))
    want = {
        0: "0 bytes", 1: "1 bytes", 10239: "10239 bytes", 10240: "10 kB", 10751: "10 kB",
        10752: "11 kB", 10 * mb - 513: "10239 kB", 10 * mb - 512: "10 MB", 10 * mb: "10 MB",
        10 * gb - 512 * kb - 1: "10239 MB", 10 * gb - 512 * kb: "10 GB", 10 * gb: "10 GB",
        10 * tb: "10 TB", 10 * pb: "10 PB", 2**63 - 1: "8192 PB", 123456789: "118 MB",
    }
    register_functions(spark)
    sizes = spark.createDataFrame([(s,) for s in want], "s long")
    got = sizes.select("s", size_pretty("s").alias("a"), F.expr("size_pretty(s)").alias("b"))
    assert {r.s: r.a for r in got.collect()} == want
    assert {r.s: r.b for r in got.collect()} == want
    null = spark.sql("SELECT CAST(NULL AS BIGINT) AS s").select(size_pretty("s"), to_blocks("s"))
    assert tuple(null.head()) == (None, None)


def test_blocks_round_half_up(spark):
    sizes = spark.createDataFrame([(s,) for s in (0, 4095, 4096, 8192, 12287, 12288)], "s long")
    assert [r[0] for r in sizes.select(to_blocks("s")).collect()] == [0, 0, 1, 1, 1, 2]


def test_shards_are_equal_ranges(spark):
    keys = spark.range(20000).select(shard_of("id", 8).alias("s")).groupBy("s").count().collect()
    assert sorted(r.s for r in keys) == list(range(8))
    assert all(2200 < r["count"] < 2800 for r in keys)
    one = spark.range(9).select(shard_of("id", 1).alias("s")).distinct().collect()
    assert [r.s for r in one] == [0]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS k").select(shard_of("k", 8)).head()[0] is None
    with pytest.raises(ValueError, match="n_shards"):
        shard_of("k", 0)


def test_quoted_names(spark):
    names = spark.createDataFrame([("plain",), ("a`b",)], "n string")
    assert [r[0] for r in names.select(quote_ident("n")).collect()] == ["`plain`", "`a``b`"]


# -- metadata


def test_resolving_a_table(spark):
    dist = layout.distribution(spark)
    assert resolve_distribution(dist, "orders", "o_custkey") == layout.dist_of("orders")
    with pytest.raises(ValueError, match="table part is not a distributed table"):
        resolve_distribution(dist, "part")
    with pytest.raises(ValueError, match="column o_orderkey .* table orders.* is o_custkey"):
        resolve_distribution(dist, "orders", "o_orderkey")
    with pytest.warns(UserWarning, match="ignoring column o_orderkey"):
        found = resolve_distribution(dist, "orders", "o_orderkey", on_mismatch="ignore")
    assert found.dist_column == "o_custkey"
    with pytest.raises(ValueError, match="on_mismatch"):
        resolve_distribution(dist, "orders", on_mismatch="no")


def test_key_types(spark):
    orders = layout.table(spark, SF, "orders")
    assert key_type(orders, "o_custkey") == "bigint"
    with pytest.raises(ValueError, match="data type of column nope"):
        key_type(orders, "nope")


def test_colocated_tables(spark):
    dist = layout.distribution(spark)
    got = [r.table_name for r in colocated_tables(dist, "labels").collect()]
    assert got == ["documents", "labels"]
    with pytest.raises(ValueError, match="not a distributed table"):
        colocated_tables(dist, "part")


# -- placement


def test_locating_a_key_reads_no_table(spark):
    dist, where, who = metadata(spark)
    home = locate_key(dist, where, who, "orders", "o_custkey", "999999999", "bigint")
    assert "FileScan" not in plan_of(home)
    row = home.head()
    assert row.shard_table_name == f"orders_{row.shard_id}"
    same = locate_key(dist, where, who, "orders", "o_custkey", 999999999).head()
    assert same == row
    with pytest.raises(ValueError, match="not the distribution column"):
        locate_key(dist, where, who, "orders", "o_orderkey", 1)


def test_locating_many_keys_does_not_shuffle_them(spark):
    keys = layout.table(spark, SF, "orders").select("o_custkey", "o_orderkey")
    located = locate_keys(keys, "o_custkey", *metadata(spark), "orders")
    assert located.count() == keys.count()
    assert "Exchange hashpartitioning" not in plan_of(located)
    nulls = spark.sql("SELECT CAST(NULL AS BIGINT) AS o_custkey")
    assert [r.shard_id for r in locate_keys(nulls, "o_custkey", *metadata(spark), "orders").collect()] == [None]  # a NULL key keeps its row


def test_scan_is_not_hashed_row_by_row(spark):
    """Only the key column is read, and the hash comes after the distinct."""
    orders, dist = layout.table(spark, SF, "orders"), layout.dist_of("orders")
    plan = plan_of(keys_per_node(orders, dist, *metadata(spark)[1:]))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan
    assert "md5" not in plan[plan.index("Exchange hashpartitioning(dist_value") :]
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_unplaced_and_null_keys(spark):
    t = spark.createDataFrame([(1,), (1,), (None,), (2,), (3,)], "k int")
    dist = Distribution("t", "k", 1, 100, 4)
    shard = {r.k: r.s for r in t.distinct().select("k", dist.shard("k").alias("s")).collect()}
    assert shard[None] == -1
    where = spark.createDataFrame([(shard[1], 1)], "shardid long, groupid int")
    who = spark.createDataFrame(
        [(1, "a", 1, "primary"), (1, "b", 2, "secondary")],
        "groupid int, nodename string, nodeport int, noderole string",
    )
    placed = place_keys(t, dist, where, who).collect()
    want = {k for k, s in shard.items() if s == shard[1]}
    assert {r.dist_value for r in placed} == want
    assert {r.nodename for r in placed} == {"a"}
    counts = keys_per_shard(t, dist, where, who).collect()
    assert [tuple(r) for r in counts] == [("a", 1, shard[1], len(want))]


def test_cluster_by_name(spark):
    dist, where, who = metadata(spark)
    names = ("orders", "customer")
    tables = {n: layout.table(spark, SF, n) for n in names}
    cluster = Cluster(tables, dist, where, who, layout.shard_stats(spark, SF))
    d = layout.dist_of("orders")
    counts = cluster.keys_per_node("orders", "o_custkey").collect()
    assert counts == keys_per_node(tables["orders"], d, where, who).collect()
    # Any column can be counted over the table's shards.
    keys = cluster.keys_per_shard("orders", "o_orderkey").agg(F.sum("dist_value_count"))
    assert keys.head()[0] == 15000
    home = cluster.locate_key("orders", "o_custkey", "1005")
    assert home.collect() == locate_key(dist, where, who, "orders", "o_custkey", 1005).collect()
    assert cluster.shard_size("orders", 1, False).count() == 4
    assert cluster.rebalance_evenly("orders", max_moves=2, analyze_at_end=False).plan.count() == 2
    with pytest.raises(ValueError, match="unknown table"):
        cluster.keys_per_node("lineitem", "l_suppkey")
    with pytest.raises(ValueError, match="data type of column"):
        cluster.keys_per_node("orders", "nope")
    with pytest.raises(ValueError, match="not a distributed table"):
        cluster.shard_size("part")


# -- sizes


def test_granularities(spark):
    stats = spark.createDataFrame(
        [("a", 1, 7, "x", 1, 100), ("a", 1, 7, "y", 1, 50), ("a", 1, 8, "x", 1, 9000),
         ("b", 1, 9, "x", 2, 1)],
        "nodename string, nodeport int, shardid long, table_name string, colocation_id int, "
        "shard_size long",
    )
    rows = lambda **kw: [tuple(r)[2:6] for r in shard_size(stats, **kw).collect()]
    assert rows() == [(7, None, 150, 0), (8, None, 9000, 1)]
    assert rows(include_shard_id=False) == [(None, None, 9150, 1)]
    assert rows(table="x") == [(7, "x", 100, 0), (8, "x", 9000, 1)]
    assert rows(table="x", include_shard_id=False) == [(None, "x", 9100, 1)]
    assert rows(colocation_id=2) == [(9, None, 1, 0)]
    assert rows(colocation_id=5) == []

    stats.createOrReplaceTempView("stats_view")
    register_functions(spark)
    register_shard_size(spark, "stats_view")
    for args, kw in [
        ("", {}),
        ("'x'", {"table": "x"}),
        ("NULL, 1, false", {"include_shard_id": False}),
        ("p_table => 'x', p_include_shard_id => false", {"table": "x", "include_shard_id": False}),
    ]:
        sql = spark.sql(f"SELECT * FROM shard_size({args})")
        assert sorted(sql.collect(), key=str) == sorted(shard_size(stats, **kw).collect(), key=str)


def test_key_functions_in_sql(spark):
    dist, where, who = metadata(spark)
    orders = layout.table(spark, SF, "orders")
    where.createOrReplaceTempView("placements")
    who.createOrReplaceTempView("nodes")
    orders.createOrReplaceTempView("orders_view")
    register_functions(spark)
    register_key_functions(
        spark, "orders", "orders_view", "o_custkey", "placements", "nodes", 32, 102200
    )
    per_shard = spark.sql("SELECT * FROM orders_keys_per_shard() ORDER BY 1, 2, 3")
    d = layout.dist_of("orders")
    assert per_shard.collect() == keys_per_shard(orders, d, where, who).collect()
    plan = plan_of(per_shard)
    assert "md5" not in plan[plan.index("FileScan parquet") - 200 :]
    per_node = spark.sql("SELECT * FROM orders_keys_per_node() ORDER BY 1, 2")
    assert per_node.collect() == keys_per_node(orders, d, where, who).collect()
    home = spark.sql("SELECT * FROM orders_locate_key('1005')").head()
    assert home == locate_key(dist, where, who, "orders", "o_custkey", 1005).head()


def test_top_relations_breaks_ties_by_name(spark):
    rows = [("public", n, k, b) for n, k, b in
            [("b", "r", 5), ("a", "p", 5), ("v", "v", 99), ("c", "r", 7)]]
    rows.append(("other", "z", "r", 100))
    relations = spark.createDataFrame(rows, "schema string, name string, kind string, bytes long")
    assert [r.table_name for r in top_relations(relations, 2).collect()] == ["c", "a"]
    plan = plan_of(top_relations(relations))
    assert "TakeOrderedAndProject" in plan


def test_inventory_of_files(spark, tmp_path):
    relations = {r.name: r for r in file_relations(spark, SF).collect()}
    assert len(relations) == 14 and relations["lineitem"].kind == "r"
    assert relations["region"].bytes == 1793
    nation = layout.table(spark, SF, "nation")
    nation.write.partitionBy("n_regionkey").parquet(str(tmp_path / "db" / "nation"))
    found = file_relations(spark, str(tmp_path / "db"), "mine").collect()
    assert [(r.schema, r.name, r.kind) for r in found] == [("mine", "nation", "p")]


def test_inventory_of_the_catalog(spark):
    spark.sql("CREATE DATABASE inventory_db")
    nation = layout.table(spark, SF, "nation")
    nation.write.saveAsTable("inventory_db.tpch_plain")
    nation.write.partitionBy("n_regionkey").saveAsTable("inventory_db.tpch_parts")
    spark.sql("CREATE VIEW inventory_db.tpcc_view AS SELECT 1 AS x")
    spark.sql("CREATE FUNCTION inventory_db.slev_one() RETURNS INT RETURN 1")
    nation.createOrReplaceTempView("tpcc_temporary")
    try:
        found = catalog_relations(spark, "inventory_db")
        kinds = {r.name: (r.schema, r.kind, r.bytes) for r in found.collect()}
        assert kinds == {
            "tpch_plain": ("inventory_db", "r", None),
            "tpch_parts": ("inventory_db", "p", None),
            "tpcc_view": ("inventory_db", "v", None),
            "slev_one": ("inventory_db", "f", None),
        }
        assert len(list(inv.run_statements(inv.statements(found, schema="inventory_db")))) == 2
        found = catalog_relations(spark, "inventory_db")
        top = top_relations(found, schema="inventory_db").collect()
        assert {r.table_name for r in top} == {"tpch_plain", "tpch_parts"}
        assert all(r.bytes > 0 for r in top)
        for kind, patterns in [("v", inv.VIEW_PATTERNS), ("f", inv.FUNCTION_PATTERNS)]:
            assert inv.match_relations(found, kind, patterns, "inventory_db").count() == 1
    finally:
        spark.catalog.dropTempView("tpcc_temporary")
        spark.sql("DROP DATABASE inventory_db CASCADE")


# -- inventory


def test_patterns(spark):
    names = ["TPCC", "tpccx", "xtpcc", "MyNewOrd", "neword", "slevel", "plain", None]
    t = spark.createDataFrame([(n,) for n in names], "name string")
    hit = [r.name for r in t.filter(inv.name_like("name", inv.VIEW_PATTERNS)).collect()]
    assert hit == ["TPCC", "tpccx", "MyNewOrd", "neword", "slevel"]
    assert len(inv.SEQUENCE_PATTERNS) == 19 and len(inv.VIEW_PATTERNS) == 8
    seq = spark.createDataFrame([("newXorder1",), ("neworder",)], "name string")
    assert seq.filter(inv.name_like("name", inv.SEQUENCE_PATTERNS)).count() == 1


def test_known_tables(spark):
    known = inv.known_relations(spark)
    assert known.count() == 17 and known.select("name").distinct().count() == 16
    assert known.filter("name = 'customer'").count() == 2


def test_generated_statements_run(spark):
    nation = layout.table(spark, SF, "nation")
    nation.write.mode("overwrite").saveAsTable("default.`2_nations`")
    relations = spark.createDataFrame(
        [("default", "2_nations", "r", 1), ("default", "a_view", "v", 1)],
        "schema string, name string, kind string, bytes long",
    )
    made = inv.statements(relations, schema="default")
    want = "ANALYZE TABLE `default`.`2_nations` COMPUTE STATISTICS"
    assert list(inv.run_statements(made)) == [want]
    details = spark.sql("DESCRIBE EXTENDED default.`2_nations`").collect()
    assert any(r.col_name == "Statistics" and "25 rows" in r.data_type for r in details)
    spark.sql("DROP TABLE default.`2_nations`")


def test_probes(spark):
    orders = layout.table(spark, SF, "orders")
    assert inv.exists(orders, F.col("o_custkey") == 7)
    assert not inv.exists(orders, F.col("o_custkey") == -7)
    assert tuple(inv.count_where(orders, F.col("o_custkey") == -7).head()) == (False, 0)
    assert tuple(inv.session_context(spark).head()) == ("default", "default")


# -- statistics


def test_statistics_with_nulls_and_long_texts(spark):
    long = "x" * 200
    t = spark.createDataFrame(
        [(1, "a", None), (2, long, None), (2, long + "y", None), (None, None, None)],
        "k int, s string, b boolean",
    )
    got = {r.column_name: r for r in analyze_tables({"t": t}).collect()}
    assert tuple(got["k"])[2:] == (4, 1, 2, "1", "2", 4.0)
    assert tuple(got["s"])[2:7] == (4, 1, 3, "a", long + "y")
    assert tuple(got["b"])[2:] == (4, 4, 0, None, None, None)
    near = {r.column_name: r for r in analyze_tables({"t": t}, exact=False).collect()}
    assert {c: tuple(r)[:4] for c, r in near.items()} == {c: tuple(r)[:4] for c, r in got.items()}
    assert near["s"].distinct_values == 3


def test_statistics_of_other_types(spark):
    t = spark.sql("""
        SELECT * FROM VALUES
            (0.0D, TIMESTAMP '2024-10-27 00:30:00Z', X'00', DATE '2024-01-01', 1.10BD),
            (-0.0D, TIMESTAMP '2024-10-27 01:30:00Z', X'01', DATE '2024-01-01', 1.20BD),
            (CAST('NaN' AS DOUBLE), NULL, X'0001', NULL, NULL) AS t(d, ts, b, day, n)""")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = {r.column_name: r.distinct_values for r in analyze_tables({"t": t}).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {"d": 2, "ts": 2, "b": 3, "day": 1, "n": 2}


def test_estimated_statistics_need_no_row_shuffle(spark):
    plan = plan_of(analyze_tables({"orders": layout.table(spark, SF, "orders")}, exact=False))
    assert "hashpartitioning" not in plan


# -- shared folder


def test_shared_folder_is_the_session_setting(spark, tmp_path):
    setting = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == setting
    kept = materialise(spark.range(5).toDF("n"))
    assert kept.count() == 5 and all(setting in f for f in kept.inputFiles())
    kept = materialise(spark.range(5).toDF("n"), str(tmp_path))
    assert all(str(tmp_path) in f for f in kept.inputFiles())

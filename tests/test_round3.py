"""The hash directory, the stored layout, levelling of whole shards and a rebalance by name."""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_right
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import layout
from evenkeel import Cluster, materialise
from evenkeel.operators import placement, ranges
from evenkeel.operators.placement import Distribution
from evenkeel.plans import layout as stored
from evenkeel.plans import levelling, rebalance

SF = "/root/testdata/sf0.001"


def hash_of(key):
    return int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16)


def plain_split(directory, alone):
    """One key after the other, by hand."""
    for h, s in sorted(alone.items()):
        i = next(i for i, (_, a, b) in enumerate(directory) if a <= h <= b)
        owner, a, b = directory[i]
        directory[i : i + 1] = [r for r in [(owner, a, h - 1), (s, h, h), (owner, h + 1, b)] if r[1] <= r[2]]
    return directory


def frame(spark, schema, rows):
    return materialise(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("n", [1, 3, 32, 1000])
def test_ranges_agree_with_the_buckets(spark, n):
    dist = Distribution("t", "k", 1, 500, n, "bigint")
    directory = ranges.hash_ranges(spark, dist)
    rows = sorted((r.low, r.high) for r in directory.collect())
    assert rows[0][0] == 0 and rows[-1][1] == 2**32 - 1 and all(a[1] + 1 == b[0] for a, b in zip(rows, rows[1:]))
    keys = spark.range(3000).withColumnRenamed("id", "k")
    met = ranges.in_ranges(keys, ranges.hash_of("k", "bigint"), directory)
    assert met.count() == 3000
    assert met.where(F.col("shardid") != dist.shard("k")).isEmpty()


def test_split_as_by_hand(spark):
    dist = Distribution("t", "k", 1, 10, 4, "bigint")
    alone = {k: 100 + k for k in range(0, 400, 3)}
    first = ranges.hash_ranges(spark, dist)
    isolated = frame(spark, "dist_value long, shardid long", [*alone.items(), (None, 9)])
    got = ranges.split_ranges(first, isolated, dist)
    want = plain_split(sorted([tuple(r) for r in first.collect()], key=lambda r: r[1]), {hash_of(k): s for k, s in alone.items()})
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    # Again, on the split directory, and in the middle of what is left.
    more = {k: 1000 + k for k in range(1, 400, 3)}
    again = ranges.split_ranges(got, frame(spark, "dist_value long, shardid long", list(more.items())), dist)
    assert sorted(tuple(r) for r in again.collect()) == sorted(plain_split(want, {hash_of(k): s for k, s in more.items()}))


def test_edges_of_the_hash_space(spark, monkeypatch):
    """Isolated hashes 0 and 2 ** 32 - 1, neighbours, and two keys with one hash: the lower number has both."""
    monkeypatch.setattr(ranges, "hash_of", lambda key, kind=None: F.col(key) if isinstance(key, str) else key)
    dist = Distribution("t", "k", 1, 10, 2, "bigint")
    top = 2**32 - 1
    alone = [(0, 70), (top, 71), (5, 72), (6, 73), (6, 69)]
    got = ranges.split_ranges(ranges.hash_ranges(spark, dist), frame(spark, "dist_value long, shardid long", alone), dist)
    rows = sorted((r.low, r.high, r.shardid) for r in got.collect())
    assert rows == [(0, 0, 70), (1, 4, 10), (5, 5, 72), (6, 6, 69), (7, 2**31 - 1, 10), (2**31, top - 1, 11), (top, top, 71)]


def test_lookups_by_range_are_those_by_key(spark):
    orders = layout.table(spark, SF, "orders")
    meta = layout.placements(spark), layout.nodes(spark)
    dist = layout.dist_of("orders")
    before = materialise(placement.place_keys(orders, dist, *meta))
    done = rebalance.apply_moves(before, materialise(rebalance.rebalance_plan(before)), *meta)
    directory = ranges.split_ranges(ranges.hash_ranges(spark, dist), done.isolated, placement.typed(dist, orders))
    by_key = placement.keys_per_shard(orders, dist, done.placements, meta[1], done.isolated)
    by_range = placement.keys_per_shard(orders, dist, done.placements, meta[1], ranges=directory)
    assert by_key.collect() == by_range.collect()
    some = done.isolated.first().dist_value
    for key in (some, some + 1, 10**9):
        one = [placement.locate_key(layout.distribution(spark), done.placements, meta[1], "orders", "o_custkey", key, "bigint", **how).collect()
               for how in ({"isolated": done.isolated}, {"ranges": directory})]
        assert one[0] == one[1] and len(one[0]) == 1
    with pytest.raises(ValueError, match="not both"):
        placement.sharded_keys(orders, dist, done.isolated, directory)
    nulls = spark.sql("SELECT CAST(NULL AS BIGINT) AS k")
    assert placement.locate_keys(nulls, "k", layout.distribution(spark), done.placements, meta[1], "orders", ranges=directory).first().shard_id is None


def test_lookup_of_many_ranges_joins_by_equality(spark, capsys):
    """Two hundred thousand isolated hashes: no row of the table is shuffled beyond its distinct keys, nothing is nested."""
    dist = Distribution("t", "k", 1, 0, 32, "bigint")
    isolated = materialise(spark.range(200_000).select(F.col("id").alias("dist_value"), (F.col("id") + 1000).alias("shardid")))
    directory = ranges.split_ranges(ranges.hash_ranges(spark, dist), isolated, dist)
    t = spark.range(2_000_000).select((F.col("id") % 5).alias("k"))  # a hot key or five
    counts = placement.keys_per_shard_global(t, dist, ranges=directory)
    counts.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sum(r.dist_value_count for r in counts.collect()) == 5
    assert directory.count() <= 32 + 2 * 200_000
    assert directory.agg(F.sum(F.col("high") - F.col("low") + 1)).first()[0] == 2**32


def sizes_below(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_moves_write_only_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "documents")
    documents = layout.table(spark, "/root/testdata/sf0.01", "documents")
    before = materialise(placement.place_keys(documents, layout.dist_of("documents"), layout.placements(spark), layout.nodes(spark)))
    first = stored.write_layout(documents, "doc_id", before, path)
    assert sorted(first.drop("nodename", "nodeport", "shardid").collect()) == sorted(documents.collect())
    old = sizes_below(path)
    plan = materialise(rebalance.rebalance_plan(before, 50))
    last = layout.placements(spark).agg(F.max("shardid")).first()[0]
    after = stored.move_rows(spark, path, documents.schema, "doc_id", stored.moved_keys(plan, last))
    new = sizes_below(path)
    assert {f: new.get(f) for f in old} == old  # nothing was changed in place
    touched = {f"s{r.shardid}" for r in plan.select("shardid").distinct().collect()}
    written = {f for f in new if f not in old}
    folders = {f.split("unit=")[1].split("/")[0] for f in written}
    assert {f.split("+")[0] for f in folders if not f.startswith("m2")} <= touched
    was = sum(n for f, n in old.items() if f.split("unit=")[1].split("/")[0] in touched)
    assert sum(new[f] for f in written) < 1.5 * was < 0.8 * sum(old.values())
    want = rebalance.apply_plan(before, plan, layout.placements(spark)).collect()
    got = {r.doc_id: (r.nodename, r.nodeport, r.shardid) for r in after.collect()}
    assert got == {r.dist_value: (r.nodename, r.nodeport, r.shardid) for r in want}
    assert sorted(after.drop("nodename", "nodeport", "shardid").collect()) == sorted(documents.collect())
    # One node alone, and a second step on top.
    one = stored.read_layout(spark, path, documents.schema, "worker-4")
    assert {r.doc_id for r in one.collect()} == {k for k, v in got.items() if v[0] == "worker-4"}
    placed = materialise(rebalance.apply_plan(before, plan, layout.placements(spark)))
    plan = materialise(rebalance.rebalance_plan(placed, 30))
    twice = stored.move_rows(spark, path, documents.schema, "doc_id", stored.moved_keys(plan, last + 1000))
    moved = {r.dist_value: r.target_node for r in plan.collect()}
    assert {r.doc_id: r.nodename for r in twice.collect()} == {k: moved.get(k, v[0]) for k, v in got.items()}
    rows = sorted(twice.collect())
    assert stored.drop_old_units(spark, path) > 0
    assert sorted(stored.read_layout(spark, path, documents.schema).collect()) == rows


def test_a_failed_step_leaves_the_old_layout(spark, tmp_path):
    path = str(tmp_path / "t")
    t = materialise(spark.sql("SELECT id AS k, id * 2 AS v FROM range(40) UNION ALL SELECT NULL, 7"))
    placed = frame(spark, "nodename string, nodeport int, shardid long, dist_value long", [("a", 1, k % 4, k) for k in range(40)])
    stored.write_layout(t, "k", placed, path)
    rows = sorted(stored.read_layout(spark, path, t.schema).collect(), key=repr)
    assert len(rows) == 41 and sum(r.nodename is None for r in rows) == 1
    moved = frame(spark, "dist_value long, shardid long, needs_isolation boolean, target_node string, target_port int, new_shard long", [(1, 1, True, "b", 1, 99)])
    os.makedirs(f"{path}/manifests/2")  # a step that ended before its manifest did
    assert sorted(stored.read_layout(spark, path, t.schema).collect(), key=repr) == rows
    after = stored.move_rows(spark, path, t.schema, "k", moved)
    assert [(r.k, r.shardid) for r in after.where("nodename = 'b'").collect()] == [(1, 99)]
    assert after.count() == 41
    whole = [(k, 2, False, "c", 1, None) for k in range(2, 40, 4)]
    files = sizes_below(path)
    moved = frame(spark, "dist_value long, shardid long, needs_isolation boolean, target_node string, target_port int, new_shard long", whole)
    after = stored.move_rows(spark, path, t.schema, "k", moved)
    assert sizes_below(path) == files  # a shard that moves as a whole costs no row
    assert {r.k for r in after.where("nodename = 'c'").collect()} == set(range(2, 40, 4))
    with pytest.raises(ValueError, match="already"):
        stored.write_layout(t, "k", placed, path)
    with pytest.raises(ValueError, match="no layout"):
        stored.read_layout(spark, str(tmp_path / "none"), t.schema)


def plain_level(weights, nodes, threshold):
    loads = {n: sum(w for m, _, w in weights if m == n) for n in nodes}
    total, n = sum(loads.values()), len(nodes)
    limit = total * (1000 + round(1000 * threshold)) // (1000 * n)
    given = []
    for node in sorted(nodes):
        left, mine = loads[node], sorted((w, p) for m, p, w in weights if m == node)
        for w, p in mine[:-1]:
            if left <= limit:
                break
            given.append((node, p, w))
            left -= w
    room = sorted(((limit - x, m) for m, x in loads.items() if x * n < total and x < limit), key=lambda r: (-r[0], r[1]))
    ends, all_given, all_room = [], sum(w for *_, w in given), sum(r for r, _ in room)
    for r, _ in room:
        ends.append((ends[-1] if ends else 0) + r)
    out, at = [], 0
    for node, p, w in given:
        spot = int(Fraction(2 * at + w, 2) * all_room / all_given) if room else None
        at += w
        if room:
            out.append((p, w, node, room[bisect_right(ends, spot)][1]))
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 1000)), min_size=1, max_size=30), st.sampled_from([0.0, 0.1, 0.5]))
def test_levelling_as_by_hand(spark, shards, threshold):
    rows = [(f"n{g}", 1, 100 + i, "t", 1, w) for i, (g, w) in enumerate(shards)]
    stats = spark.createDataFrame(rows, "nodename string, nodeport int, shardid long, table_name string, colocation_id int, shard_size long")
    dist = spark.createDataFrame([("t", "k", 1, 100, 64)], "table_name string, dist_column string, colocation_id int, shard_base long, shard_count int")
    nodes = spark.createDataFrame([(g, f"n{g}", 1, "primary") for g in range(1, 6)], "groupid int, nodename string, nodeport int, noderole string")
    got = levelling.shard_moves(stats, dist, nodes, 1, threshold).collect()
    weights = [(n, s - 100, w) for n, _, s, _, _, w in rows]
    want = plain_level(weights, [f"n{g}" for g in range(1, 6)], threshold)
    assert sorted((r.place, r.weight, r.source_node, r.target_node) for r in got) == want
    loads = {f"n{g}": sum(w for n, _, w in weights if n == f"n{g}") for g in range(1, 6)}
    before = max(loads.values())
    for r in got:
        loads[r.source_node] -= r.weight
        loads[r.target_node] += r.weight
    assert max(loads.values()) <= max(before, sum(loads.values()) * (1 + threshold) / 5 + max(w for *_, w in weights))


def test_rebalance_by_name_closes(spark):
    """Counts, lookups, sizes and the next rebalance of the cluster agree with the placement that the plan made."""
    names = ["orders", "customer"]
    tables = {n: layout.table(spark, SF, n) for n in names}
    widths = {n: layout.width_of(n) for n in names}
    cluster = Cluster(tables, layout.distribution(spark), layout.placements(spark), layout.nodes(spark), layout.shard_stats(spark, SF))
    done = cluster.rebalance_evenly("orders", analyze_at_end=False, widths=widths)
    after = cluster.after(done)
    counts = [r.dist_value_count for r in after.keys_per_node("orders", "o_custkey").collect()]
    assert max(counts) - min(counts) <= 1
    homes = {r.dist_value: (r.nodename, r.shardid) for r in done.after.collect()}
    for key in [done.plan.first().dist_value, *list(homes)[:2]]:
        one = after.locate_key("orders", "o_custkey", str(key)).collect()
        assert [(r.nodename, r.shard_id) for r in one] == [homes[key]]
    assert after.locate_key("customer", "c_custkey", done.plan.first().dist_value).count() == 1
    assert after.rebalance_evenly("orders", analyze_at_end=False).plan.isEmpty()
    size = {(r.nodename, r.table_name): r.shard_size for r in after.shard_size("orders", 1, False).collect()}
    rows = tables["orders"].groupBy("o_custkey").count().collect()
    want = {}
    for r in rows:
        node = homes[r.o_custkey][0]
        want[(node, "orders")] = want.get((node, "orders"), 0) + 56 * r["count"]
    assert size == want
    assert after.shard_size("documents", 13, False).count() == 4  # other groups as before
    # Keys of colocated tables stay together.
    both = [placement.place_keys(tables[n], layout.dist_of(n), after.placements, after.nodes, after.isolated[1]) for n in names]
    apart = both[0].join(both[1].withColumnRenamed("nodename", "other"), "dist_value").where(F.col("nodename") != F.col("other"))
    assert apart.isEmpty()


def test_rebalance_at_end_levels_whole_shards(spark):
    names = ["orders", "customer"]
    tables = {n: layout.table(spark, SF, n) for n in names}
    cluster = Cluster(tables, layout.distribution(spark), layout.placements(spark), layout.nodes(spark))
    done = cluster.rebalance_evenly("orders", max_moves=0, analyze_at_end=False, rebalance_at_end=True)
    after = cluster.after(done)
    assert done.plan.isEmpty() and done.shard_moves.count() > 0
    rows = {}
    for n in names:
        placed = placement.place_keys(tables[n], layout.dist_of(n), after.placements, after.nodes, after.isolated[1])
        key = layout.TABLES[n][0]
        for r in tables[n].join(placed, tables[n][key] == placed["dist_value"]).groupBy("nodename").count().collect():
            rows[r.nodename] = rows.get(r.nodename, 0) + r["count"]
    first = {}
    for n in names:
        placed = placement.place_keys(tables[n], layout.dist_of(n), cluster.placements, cluster.nodes)
        for r in tables[n].join(placed, tables[n][layout.TABLES[n][0]] == placed["dist_value"]).groupBy("nodename").count().collect():
            first[r.nodename] = first.get(r.nodename, 0) + r["count"]
    assert sum(rows.values()) == sum(first.values())
    assert max(rows.values()) - min(rows.values()) < max(first.values()) - min(first.values())

"""Throughput of every run in its own window, and table functions over names that need quotes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from evenkeel.functions.scalar import shard_of
from evenkeel.functions.sql import register_functions, register_key_functions
from evenkeel.operators.runs import throughput, throughput_per_run

T0 = datetime(2024, 1, 1)
EVENTS, RUNS = "ts timestamp, event_type string, run string, bin long", "run string, start timestamp"


@pytest.mark.parametrize("seed", range(2))
def test_overlapping_runs(spark, seed):
    """Against a loop: a hot minute, ties at both ends, runs without events or start, repeated rows."""
    r = random.Random(seed)
    at = [T0 + timedelta(minutes=r.randrange(600)) for _ in range(300)] + [T0 + timedelta(minutes=100, seconds=r.randrange(60)) for _ in range(600)]
    events = [(t, r.choice(("order", "other", None)), "x", 1) for t in at] + [(None, "order", "x", 1)] * 3
    starts = [(f"r{k}", T0 + timedelta(minutes=r.randrange(600))) for k in range(12)]
    starts += [starts[0], ("late", T0 + timedelta(days=9)), ("none", None), (None, T0), ("r3", T0 + timedelta(minutes=90)), ("none2", None), ("none2", T0)]
    found = throughput_per_run(spark.createDataFrame(events, EVENTS), spark.createDataFrame(starts, RUNS), 5, 45, "order")
    want = {}
    for name, start in set(starts):
        low, high = (start + timedelta(minutes=m) for m in (5, 50)) if start else (None, None)
        inside = [e for e in events if start and e[0] and low <= e[0] < high]
        total, orders = want.get(name) or (None, None)
        if start:
            total, orders = (total or 0) + len(inside), (orders or 0) + sum(e[1] == "order" for e in inside)
        want[name] = (total, orders)
    rows = {x.run: x for x in found.collect()}
    assert {k: (x.total_events, x.order_events) for k, x in rows.items()} == want
    assert all(x.tpm is None if x.total_events is None else x.tpm == x.total_events / 45 for x in rows.values())
    assert max(x.total_events or 0 for x in rows.values()) > 500


def test_one_run_is_the_whole(spark):
    events = spark.createDataFrame([(T0 + timedelta(seconds=7 * k), "order" if k % 3 else "other", "x", 1) for k in range(200)], EVENTS)
    one = throughput_per_run(events, spark.createDataFrame([("a", T0)], RUNS), 1, 4, "order").drop("run")
    assert one.collect() == throughput(events, 1, 4, "order").collect()
    none = spark.createDataFrame([], EVENTS)
    assert throughput_per_run(none, spark.createDataFrame([("a", T0)], RUNS), 1, 4, "order").head().total_events == 0
    assert throughput_per_run(events, spark.createDataFrame([], RUNS), 1, 4, "order").count() == 0
    with pytest.raises(ValueError):
        throughput_per_run(events, spark.createDataFrame([("a", T0)], RUNS), 1, 0, "order")


def test_runs_are_joined_by_bins(spark):
    """No nested loop: the windows meet events by equal bins."""
    events = spark.createDataFrame([(T0, "order", "x", 1)], EVENTS)
    plan = throughput_per_run(events, spark.createDataFrame([("a", T0)], RUNS), 1, 4, "order")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_in_quotes(spark):
    spark.createDataFrame([(k,) for k in range(40)], "`my-key it's` long").createOrReplaceTempView("`odd table`")
    spark.createDataFrame([(102008 + k, k % 2 + 1) for k in range(4)], "shardid long, groupid int").createOrReplaceTempView("`odd placements`")
    spark.createDataFrame([(1, "w1", 5432, "primary"), (2, "w2", 5432, "primary")], "groupid int, nodename string, nodeport int, noderole string").createOrReplaceTempView("`odd-nodes`")
    register_functions(spark)
    register_key_functions(spark, "o'dd", "odd table", "my-key it's", "odd placements", "odd-nodes", 4, 102008)
    per = {x.shardid: x.dist_value_count for x in spark.sql("SELECT * FROM `o'dd_keys_per_shard`()").collect()}
    want = {}
    for x in spark.range(40).select(shard_of("id", 4).alias("s")).collect():
        want[102008 + x.s] = want.get(102008 + x.s, 0) + 1
    assert per == want and sum(per.values()) == 40
    assert spark.sql("SELECT sum(dist_value_count) FROM `o'dd_keys_per_node`()").head()[0] == 40
    one = spark.sql("SELECT * FROM `o'dd_locate_key`('7')").head()
    assert one.table_name == "o'dd" and one.shard_table_name == f"o'dd_{one.shard_id}"

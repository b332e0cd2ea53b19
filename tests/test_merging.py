"""Key bitmaps, sketches per file and pattern tables."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import shard_of
from evenkeel.operators import keysets, patterns, sketches
from evenkeel.operators.placement import Distribution, keys_per_shard_global

DIST = Distribution("t", "k", 1, 100, 8)


def test_keys_count_once_over_loads(spark, tmp_path):
    """Extremes, zero, negative keys, repeats within and between loads, a load stored twice, no rows."""
    keys = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 2**63 - 1, -(2**63), 7, 7, 7, None, None]
    r = random.Random(1)
    loads = [keys, [r.randrange(-70000, 70000) for _ in range(3000)], [], keys, [7] * 500 + [11]]
    path = str(tmp_path / "keys")
    for k, load in enumerate(loads):
        t = spark.createDataFrame([(x, "shard", 1) for x in load], "k long, shardid string, bucket int").repartition(3)
        keysets.store_keys(t, DIST, path)
        table = spark.createDataFrame([(x,) for one in loads[: k + 1] for x in one], "k long")
        want = {tuple(x) for x in keys_per_shard_global(table, DIST).collect()}
        assert {tuple(x) for x in keysets.counted_keys(keysets.stored_keys(spark, path)).collect()} == want
    distinct = {x for one in loads for x in one if x is not None}
    assert sum(n for _, n in want) == len(distinct)
    keysets.compact_keys(spark, path, str(tmp_path / "compact"))
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert {tuple(x) for x in keysets.counted_keys(compact).collect()} == want
    assert compact.count() == compact.select("shardid", "bucket").distinct().count()


def test_keys_of_other_types(spark):
    t = spark.range(10).select(F.col("id").cast("int").alias("k"))
    assert {tuple(x) for x in keysets.counted_keys(keysets.key_bitmaps(t, DIST)).collect()} == {tuple(x) for x in keys_per_shard_global(t, DIST).collect()}
    assert t.select(shard_of("k", 8)).distinct().count() > 1
    with pytest.raises(ValueError, match="integer keys"):
        keysets.key_bitmaps(t.select(F.col("k").cast("string").alias("k")), DIST)


def test_counts_read_no_table(spark, tmp_path, capsys):
    path = str(tmp_path / "keys")
    keysets.store_keys(spark.range(1000).select(F.col("id").alias("k")), DIST, path)
    keysets.counted_keys(keysets.stored_keys(spark, path)).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") == plan.count("Scan ") > 0 and "Range" not in plan


def test_only_new_files_are_sketched(spark, tmp_path):
    """Rows, nulls and few distinct values are exact; a file that is gone drops out; a file added is the only one read."""
    data, store = str(tmp_path / "data"), str(tmp_path / "store")
    schema = "a long, b double, c string, d array<int>, e map<int,int>, `f g` int"
    rows = [(k % 50, float(-(k % 7)), "" if k % 3 else None, [k % 4], {1: k}, None) for k in range(1000)]
    t = spark.createDataFrame(rows, schema)
    t.repartition(2).write.parquet(data)
    first = spark.read.schema(t.schema).parquet(data)
    assert sketches.update_sketches(first, store) == 2
    assert sketches.update_sketches(first, store) == 0
    spark.createDataFrame([(1000, 5.5, "x", None, None, None)], schema).coalesce(1).write.mode("append").parquet(data)
    both = spark.read.schema(t.schema).parquet(data)
    assert sketches.update_sketches(both, store) == 1
    found = {x.column_name: x for x in sketches.merged_sketches(both, store).collect()}
    assert {c: (x.rows, x.nulls, x.distinct_values) for c, x in found.items()} == {
        "a": (1001, 0, 51), "b": (1001, 0, 8), "c": (1001, 334, 2), "d": (1001, 1, 4), "e": (1001, 1, None), "f g": (1001, 1001, 0),
    }
    assert (found["a"].quantiles[0], found["a"].quantiles[-1]) == (0.0, 1000.0) and abs(found["a"].quantiles[2] - 25) <= 2
    assert (found["b"].quantiles[0], found["b"].quantiles[-1]) == (-6.0, 5.5)
    assert found["c"].quantiles is found["f g"].quantiles is None
    before = {x.column_name: x for x in sketches.merged_sketches(first, store).collect()}
    assert (before["a"].rows, before["a"].distinct_values, before["a"].quantiles[-1]) == (1000, 50, 49.0)


def _like(pattern):
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.compile(out, re.DOTALL | re.IGNORECASE)


def test_patterns_against_a_loop(spark, capsys):
    """Wildcards alone, literals shorter and longer than a key, escapes, the empty pattern, NULLs, repeats, clashing columns."""
    r = random.Random(4)
    names = ["", "a", "ab", "A_b", "a%b", "tpcc_", "x" * 80, "new\norder", None, None] + ["".join(r.choice("abAB_%") for _ in range(r.randrange(9))) for _ in range(150)]
    asked = ["", "%", "_", "__%", "%%", "%a", "a%", "%ab%", "a_b", r"a\_b", r"a\%b", r"\_%", r"%\%%", "_b%a_", "x%", "%xxx", "tpcc%", "TPCC_", "%order", "_" * 80, "_" * 70 + "%", "ab%ab", None, "a%", "zz%"]
    asked += ["".join(r.choice("abA_%") for _ in range(r.randrange(7))) for _ in range(60)]
    table = spark.createDataFrame([(n, k, "k") for k, n in enumerate(names + names[:20])], "name string, _n int, _key string")
    found = patterns.match_patterns(table, spark.createDataFrame([(p,) for p in asked], "pattern string"))
    want = [(n, k, "k", p) for k, n in enumerate(names + names[:20]) for p in {x for x in asked if x is not None} if n is not None and _like(p).fullmatch(n)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    found.explain()
    assert "NestedLoop" not in (plan := capsys.readouterr().out) and "Cartesian" not in plan
    with pytest.raises(ValueError, match="pattern"):
        patterns.match_patterns(found, spark.createDataFrame([("a",)], "pattern string"))


def test_patterns_of_every_shape(spark):
    """Each way to place letters and wildcards, with literals on both sides of the places that keys reach to."""
    shapes = ["".join(p) for n in range(6) for p in itertools.product("a_%", repeat=n)]
    long = "abcdefghijklmnopqrstuvwxyz"
    shapes += [f"{long[:k]}%" for k in (2, 3, 4, 15, 16, 17, 26)] + [f"%{long[-k:]}" for k in (2, 3, 4, 15, 16, 17, 26)]
    shapes += ["_" * k + x + "%" for k in (14, 15, 16, 17) for x in ("p", "pq", "q", "qrs")] + ["%" + x + "_" * k for k in (14, 15, 16, 17) for x in ("j", "ij", "i", "hij")]
    names = ["".join(p) for n in range(5) for p in itertools.product("ab", repeat=n)] + [long, long.upper(), long[1:], "k\u00e4" * 20, "\u00c4" * 17]
    shapes += ["%\u00c4", "k_K%", "%\u00e4_\u00e4" + "_" * 15, "_" * 16 + "\u00e4"]
    found = patterns.match_patterns(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in shapes], "pattern string"))
    assert sorted(map(tuple, found.collect())) == sorted((n, p) for p in set(shapes) for n in names if _like(p).fullmatch(n))


def test_patterns_meet_few_names(spark, monkeypatch):
    """Names compared with patterns that differ only in a place near an end, or in a literal shorter than another one.

    At 60 times sf0.1 the pairs that a pattern's longest literal alone brings together took most of the time.
    """
    names = spark.createDataFrame([(f"{'tpcc_' if k % 2 else 'x_pay_'}{k:03d}",) for k in range(1000)], "name string")
    asked = [*(f"TPCC_{k}%" for k in range(10)), *(f"%pay__{k}_" for k in range(10)), *(f"%{k:02d}%c_%" for k in range(40))]
    monkeypatch.setattr(patterns.F, "ilike", lambda *_: F.lit(True))
    pairs = patterns.match_patterns(names, spark.createDataFrame([(p,) for p in asked], "pattern string"))
    counts = {r.kind: r.n for r in pairs.groupBy(F.substring("pattern", 1, 2).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["TP"] <= 1000 and counts["%p"] <= 1000 and sum(counts.values()) <= 3000


def test_names_of_one_file_are_dealt_out(spark, tmp_path, capsys):
    spark.createDataFrame([(f"tpcc_{k}",) for k in range(100)], "name string").coalesce(1).write.parquet(str(tmp_path / "names"))
    found = patterns.match_patterns(spark.read.schema("name string").parquet(str(tmp_path / "names")), spark.createDataFrame([("%5%",)], "pattern string"))
    found.explain()
    plan = capsys.readouterr().out
    assert "RoundRobin" in plan and "hashpartitioning(_key" not in plan

"""Every registered query against its SQL, value by value."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry_points
from checks import layout
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name, capsys):
    got = QUERIES[name](spark, SF)
    got.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[t] for c, t in got.dtypes} == types
    mine, theirs = got.collect(), want.fetchall()
    assert rows_of(got.columns, mine) == rows_of(want.columns, theirs)
    assert mine


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_declared_schemas_are_those_of_the_files(spark, sf):
    for name in layout.SCHEMAS:
        path = f"/root/testdata/{sf}"
        inferred = spark.read.parquet(f"{path}/{name}.parquet").dtypes
        assert layout.table(spark, path, name).dtypes == inferred


def test_entry(spark):
    counts = entry_points.entry(spark).collect()
    assert [r.nodename for r in counts] == ["worker-1", "worker-2", "worker-3", "worker-4"]

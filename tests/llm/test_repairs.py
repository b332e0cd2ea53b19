"""Clashing doc_ids, items without words, ledgers of two runs, shard folders, and SQL for decontamination."""

from __future__ import annotations

import random
import uuid

import duckdb
import pytest

from evenkeel.llm import jaccard, secrets, sharding, templates
from evenkeel.llm.queries import ORACLE

TEXTS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def test_texts_under_one_doc_id(spark):
    """A row shares its doc_id with another text and still links by its own."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, f"{a} x"), (5, a), (5, b), (7, c), (9, f"{b} tail"), (9, f"{b} tail"), (None, b), (None, b)]
    table = spark.createDataFrame(rows, TEXTS)
    found = jaccard.near_duplicates(table).select("doc_id", "n_shingles", "class_id", "component_id").collect()
    want = [(3, 37, 3, 3), (5, 36, 5, 3), (5, 36, 5, 5), (7, 36, 7, 7), (9, 37, 9, 5), (9, 37, 9, 5), (None, 36, None, None), (None, 36, None, None)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    kept = [tuple(r) for r in jaccard.one_per_group(table).collect()]
    assert sorted(kept, key=repr) == sorted([(3, f"{a} x"), (5, b), (7, c), (None, b), (None, b)], key=repr)


def test_one_of_several_texts_under_the_least_doc_id(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base, "p"), (1, base, "q"), (1, f"{base} more", "r"), (2, base, "s"), (4, None, "t"), (4, " ", "u")]
    table = spark.createDataFrame(rows, f"{TEXTS}, source string")
    first = [tuple(r) for r in jaccard.one_per_group(table).collect()]
    assert sorted(r[0] for r in first) == [1, 4, 4]
    assert sorted(map(repr, first)) == sorted(repr(tuple(r)) for r in jaccard.one_per_group(table.repartition(5)).collect())


def test_items_without_words(spark):
    """A row of numbers is found as it stands, not with other numbers."""
    numbers = " ".join(str(17 + 8 * k) for k in range(12))
    items = [(1, numbers), (2, "3 5 7"), (3, "Anna Bernd Carla Dora Emil Frida Gustav Hanna Ida Jonas"), (4, "some words of an item that stand in no document at all here")]
    texts = [f"The row {numbers} goes on.", "The row " + " ".join(str(18 + 8 * k) for k in range(12)), "They took 3 5 7 of them.", "with Anna Bernd Carla Dora Emil Frida Gustav Hanna Ida Jonas there", "anna bernd carla dora emil frida gustav hanna ida jonas", ""]
    found = templates.contaminated(spark.createDataFrame(list(enumerate(texts)), TEXTS), spark.createDataFrame(items, ITEMS))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, 1), (2, 2), (3, 3), (4, 3)}


def _cases(seed):
    """Items of words, names and numbers, and documents with whole, changed, cut, edited and re-cased copies."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmn"]

    def token():
        return r.choices([r.choice(words), r.choice(words).title(), str(r.randrange(40)), r.choice(["km", "hours"])], [6, 2, 2, 1])[0]

    items = [" ".join(token() + ("." if r.random() < 0.08 else "") for _ in range(r.choice((3, 9, 20, 60)))) for _ in range(24)]
    items += [" ".join(str(r.randrange(99)) for _ in range(n)) for n in (3, 11)]
    texts = []
    for _ in range(120):
        t = r.choice(items).split()
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice(([], [token()], [t[k], token()]))
            t = t or ["x"]
        t = t[r.choice((0, 0, len(t) // 2)) :]
        t = " ".join(r.choice((str, str, str.upper, str.lower))(x) for x in [" ".join(t)])
        texts.append(" ".join([*(token() for _ in range(8)), t, *(token() for _ in range(8))]))
    return items, [*texts, None, ""]


def test_decontamination_against_sql(spark):
    items, texts = _cases(1)
    docs, bench = spark.createDataFrame(list(enumerate(texts)), TEXTS), spark.createDataFrame(list(enumerate(items)), ITEMS)
    found = templates.contaminated(docs, bench).select("doc_id", "item_id", "n_windows", "n_slots", "n_changed").collect()
    with duckdb.connect() as db:
        db.register("documents", docs.toPandas())
        db.register("benchmark", bench.toPandas())
        want = db.sql(f"SELECT doc_id, item_id, n_windows, n_slots, n_changed FROM ({ORACLE['op5_decontamination']})").fetchall()
    assert sorted(map(tuple, found)) == sorted(want)
    assert len(want) > 40


def test_two_runs_on_one_blob(spark, tmp_path):
    """What two scans at the same time leave is found once; a second scan of more rows reads only the new ones."""
    texts = [f"password = abcDEF123456789{k}" for k in range(6)] + [None, ""]
    table = spark.createDataFrame(list(enumerate(texts)) * 2, TEXTS)
    once, twice = (str(tmp_path / uuid.uuid4().hex) for _ in range(2))
    want = sorted(secrets.digest(table, once).collect())
    secrets.update_ledger(table.where("doc_id < 3"), f"{twice}-other")
    secrets.update_ledger(table.where("doc_id < 3"), twice)
    spark.read.parquet(f"{twice}-other").drop("run").write.parquet(f"{twice}/run=other")
    assert sorted(secrets.digest(table, twice).collect()) == want
    assert secrets.read_ledger(spark, twice).count() == 3 + 3 + 4
    assert all(r.n_assign == (r.doc_id < 6) for r in want)


def test_later_tokens(spark, tmp_path):
    """Web tokens and tokens of code hosts, with their places."""
    jwt, hub = f"eyJ{'a' * 12}.eyJ{'b' * 12}.{'c-_' * 5}", f"ghp_{'aB3' * 12}"
    rows = [(1, f"é {jwt} end"), (2, f"x {hub}"), (3, f"{jwt[:20]} gh_{'a' * 40} xghp_{'a' * 36} ghp_{'a' * 35}")]
    spans = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, TEXTS), str(tmp_path / "ledger")).collect()}
    assert f"jwt:2:{2 + len(jwt)}" in spans[1].split(",")
    assert f"hub_token:2:{2 + len(hub)}" in spans[2].split(",")
    assert "jwt" not in spans[3] and "hub_token" not in spans[3]


def test_shard_folders(spark, tmp_path):
    """Folder names read back as the bits they stand for; an input column of that name is refused."""
    rows = [(k % 50 if k % 7 else None, "x" * (k % 90)) for k in range(300)]
    table = spark.createDataFrame(rows, TEXTS)
    sharding.write_shards(table, str(tmp_path / "shards"), 2000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    sizes = {r.shard: r.bytes for r in back.groupBy("shard").agg({"text": "count"}).withColumnRenamed("count(text)", "bytes").collect()}
    want = {f"b{r.shard}": r["count"] for r in sharding.shard_documents(table, 2000).groupBy("shard").count().collect()}
    assert sizes == want and len(want) > 3
    assert sorted(map(repr, (tuple(r) for r in back.select("doc_id", "text").collect()))) == sorted(map(repr, rows))
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(table.selectExpr("*", "1 AS Shard"), str(tmp_path / "no"), 2000)

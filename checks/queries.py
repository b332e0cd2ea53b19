"""One query per operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import layout
from evenkeel import Cluster
from evenkeel.functions import shard_of, size_pretty, to_blocks
from evenkeel.functions.scalar import hash_of
from evenkeel.operators import inventory, keysets, patterns, placement, runs, sizes, sketches, stats
from evenkeel.operators import ranges as hash_directory
from evenkeel.plans import layout as stored_layout
from evenkeel.plans import levelling, rebalance
from evenkeel.sources import file_shard_stats, materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _placed(spark: SparkSession, sf: str, name: str = "orders") -> DataFrame:
    t = layout.table(spark, sf, name)
    return placement.place_keys(
        t, layout.dist_of(name), layout.placements(spark), layout.nodes(spark)
    )


def _moved(spark: SparkSession, sf: str, name: str = "orders") -> tuple[DataFrame, DataFrame]:
    before = materialise(_placed(spark, sf, name))
    plan = materialise(rebalance.rebalance_plan(before))
    return before, rebalance.apply_plan(before, plan, layout.placements(spark))


def q_shard_of(spark: SparkSession, sf: str) -> DataFrame:
    orders = layout.table(spark, sf, "orders")
    bucket = shard_of("o_custkey", layout.N_SHARDS)
    return orders.select("o_orderkey", "o_custkey", bucket.alias("bucket"))


def q_place_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf)


def q_place_keys_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey"))
    orders = layout.table(spark, sf, "orders").select(key.alias("o_custkey"))
    dist = layout.dist_of("orders")
    return placement.place_keys(orders, dist, layout.placements(spark), layout.nodes(spark))


def _per(count: Callable[..., DataFrame], name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        t = layout.table(spark, sf, name)
        return count(t, layout.dist_of(name), layout.placements(spark), layout.nodes(spark))

    return query


def q_keys_per_shard_global(spark: SparkSession, sf: str) -> DataFrame:
    orders = layout.table(spark, sf, "orders")
    return placement.keys_per_shard_global(orders, layout.dist_of("orders"))


def q_locate_key(spark: SparkSession, sf: str) -> DataFrame:
    """The home of one customer's orders, and how many rows it holds of them."""
    orders = layout.table(spark, sf, "orders")
    home = placement.locate_key(
        layout.distribution(spark), layout.placements(spark), layout.nodes(spark),
        "orders", "o_custkey", "105", placement.key_type(orders, "o_custkey"),
    )
    rows = orders.filter(F.col("o_custkey") == 105).agg(F.count(F.lit(1)).alias("n"))
    return home.withColumn("key_rows", rows.scalar())


def q_locate_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = layout.table(spark, sf, "customer").select("c_custkey")
    return placement.locate_keys(
        keys, "c_custkey", layout.distribution(spark), layout.placements(spark),
        layout.nodes(spark), "orders",
    )


def _size(table: str | None, group: int, by_shard: bool) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return sizes.shard_size(layout.shard_stats(spark, sf), table, group, by_shard)

    return query


def q_size_pretty(spark: SparkSession, sf: str) -> DataFrame:
    size = F.expr("shiftleft(o_orderkey % 1048576, CAST(o_orderkey % 40 AS INT))")
    orders = layout.table(spark, sf, "orders").select("o_orderkey", size.alias("bytes"))
    return orders.withColumn("pretty", size_pretty("bytes"))


def q_to_blocks(spark: SparkSession, sf: str) -> DataFrame:
    orders = layout.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 1024).alias("bytes")
    )
    return orders.withColumn("blocks", to_blocks("bytes"))


def q_balance_status(spark: SparkSession, sf: str) -> DataFrame:
    return rebalance.balance_status(_per(placement.keys_per_node, "orders")(spark, sf))


def _candidates(k: int) -> Query:
    return lambda spark, sf: rebalance.move_candidates(materialise(_placed(spark, sf)), k)


def _plan(max_moves: int | None, name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rebalance.rebalance_plan(materialise(_placed(spark, sf, name)), max_moves)

    return query


def q_apply_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _moved(spark, sf)[1]


def _applied(spark: SparkSession, sf: str, moves: int | None) -> rebalance.Applied:
    before = materialise(_placed(spark, sf))
    plan = materialise(rebalance.rebalance_plan(before, moves))
    return rebalance.apply_moves(before, plan, layout.placements(spark), layout.nodes(spark))


def q_apply_plan_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of 50 moves: where each key is, and whether it has a shard to itself."""
    one = _applied(spark, sf, 50)
    plan = materialise(rebalance.rebalance_plan(one.placed, 50))
    two = rebalance.apply_moves(one.placed, plan, one.placements, layout.nodes(spark), one.isolated)
    shards = two.placed.groupBy("nodename", "nodeport", "shardid").agg(F.count(F.lit(1)).alias("n"))
    return two.placed.join(shards, ["nodename", "nodeport", "shardid"]).select(
        "nodename", "nodeport", "dist_value", (F.col("n") == 1).alias("alone")
    )


def q_keys_per_shard_after_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    """The counts from the table itself, with the metadata of a rebalance."""
    done = _applied(spark, sf, None)
    return placement.keys_per_shard(
        layout.table(spark, sf, "orders"), layout.dist_of("orders"), done.placements,
        layout.nodes(spark), done.isolated,
    )


def q_locate_keys_after_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    done = _applied(spark, sf, 50)
    keys = layout.table(spark, sf, "customer").select("c_custkey")
    return placement.locate_keys(
        keys, "c_custkey", layout.distribution(spark), done.placements, layout.nodes(spark),
        "orders", isolated=done.isolated,
    )


def q_locate_keys_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Keys given as padded text and as floating-point numbers."""
    customers = layout.table(spark, sf, "customer")
    text = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    meta = layout.distribution(spark), layout.placements(spark), layout.nodes(spark), "orders"
    as_text = placement.locate_keys(customers.select("c_custkey", text.alias("key")), "key", *meta, "bigint")
    number = customers.select("c_custkey", F.col("c_custkey").cast("double").alias("key"))
    as_number = placement.locate_keys(number, "key", *meta, "bigint")
    return as_text.drop("key").unionByName(as_number.drop("key"))


def q_apply_plan_colocated(spark: SparkSession, sf: str) -> DataFrame:
    """The customers after the plan for their orders."""
    orders, customers = (materialise(_placed(spark, sf, n)) for n in ("orders", "customer"))
    plan = materialise(rebalance.rebalance_plan(orders))
    dists = layout.dist_of("orders"), layout.dist_of("customer")
    return rebalance.follow_plan(customers, plan, *dists, layout.placements(spark))


def _report(per: str) -> Query:
    return lambda spark, sf: rebalance.balance_report(*_moved(spark, sf), per)


def q_size_report(spark: SparkSession, sf: str) -> DataFrame:
    placed = _moved(spark, sf)
    orders, dist = layout.table(spark, sf, "orders"), layout.dist_of("orders")
    before, after = (
        sizes.placed_bytes(orders, dist, layout.width_of("orders"), p) for p in placed
    )
    return rebalance.size_report(before, after, "orders", dist.colocation_id)


def q_relayout(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in their evened-out layout, then counted per folder."""
    path = f"{shared_folder(spark)}/evenkeel/{uuid.uuid4().hex}"
    after = _moved(spark, sf, "documents")[1]
    documents = layout.table(spark, sf, "documents")
    stored = rebalance.relayout(documents, "doc_id", after, path)
    return stored.groupBy("nodename", "nodeport", "shardid").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars")
    )


def q_relayout_files(spark: SparkSession, sf: str) -> DataFrame:
    """The folders of a stored layout, from its files alone."""
    path = f"{shared_folder(spark)}/evenkeel/{uuid.uuid4().hex}"
    rebalance.relayout(layout.table(spark, sf, "documents"), "doc_id", _placed(spark, sf, "documents"), path)
    found = file_shard_stats(spark, path, "documents", 13)
    return found.select("nodename", "nodeport", "shardid", "table_name", (F.col("shard_size") > 0).alias("stored"))


def _ranges_after(spark: SparkSession, sf: str, moves: int | None) -> tuple[rebalance.Applied, DataFrame]:
    done = _applied(spark, sf, moves)
    dist = placement.typed(layout.dist_of("orders"), layout.table(spark, sf, "orders"))
    return done, hash_directory.split_ranges(hash_directory.hash_ranges(spark, dist), done.isolated, dist)


def q_shard_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The directory of hash ranges after 50 moves, with the keys that lie in each range."""
    _, ranges = _ranges_after(spark, sf, 50)
    keys = layout.table(spark, sf, "orders").select("o_custkey").distinct()
    held = hash_directory.in_ranges(keys, hash_of("o_custkey", "bigint"), ranges.withColumn("shardid", F.col("low")))
    held = held.groupBy(F.col("shardid").alias("low")).agg(F.count(F.lit(1)).alias("n_keys"))
    return ranges.join(held, "low", "left").select("shardid", "low", "high", F.coalesce("n_keys", F.lit(0).cast("long")).alias("n_keys"))


def q_keys_per_shard_by_range(spark: SparkSession, sf: str) -> DataFrame:
    done, ranges = _ranges_after(spark, sf, None)
    return placement.keys_per_shard(
        layout.table(spark, sf, "orders"), layout.dist_of("orders"), done.placements, layout.nodes(spark), ranges=ranges
    )


def q_locate_keys_by_range(spark: SparkSession, sf: str) -> DataFrame:
    done, ranges = _ranges_after(spark, sf, 50)
    keys = layout.table(spark, sf, "customer").select("c_custkey")
    return placement.locate_keys(
        keys, "c_custkey", layout.distribution(spark), done.placements, layout.nodes(spark), "orders", ranges=ranges
    )


def q_shard_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Whole shards of customers and orders that level the bytes of the nodes."""
    return levelling.shard_moves(layout.shard_stats(spark, sf), layout.distribution(spark), layout.nodes(spark), 1, 0.1)


def q_rebalance_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Keys per shard and node of orders and customers by name, after a rebalance of the orders by name."""
    tables = {n: layout.table(spark, sf, n) for n in ("orders", "customer")}
    cluster = Cluster(tables, layout.distribution(spark), layout.placements(spark), layout.nodes(spark))
    cluster = cluster.after(cluster.rebalance_evenly("orders", analyze_at_end=False))
    counts = [cluster.keys_per_shard(n, layout.TABLES[n][0]).withColumn("table_name", F.lit(n)) for n in tables]
    return reduce(DataFrame.unionByName, counts)


def q_relayout_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents after 50 moves, of which only the touched folders were written anew."""
    path = f"{shared_folder(spark)}/evenkeel/{uuid.uuid4().hex}"
    documents, before = layout.table(spark, sf, "documents"), materialise(_placed(spark, sf, "documents"))
    plan = materialise(rebalance.rebalance_plan(before, 50))
    stored_layout.write_layout(documents, "doc_id", before, path)
    last = layout.placements(spark).agg(F.max("shardid")).first()[0]
    stored = stored_layout.move_rows(spark, path, documents.schema, "doc_id", stored_layout.moved_keys(plan, last))
    return stored.groupBy("nodename", "nodeport", "shardid").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars")
    )


def q_keys_per_shard_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Keys per shard from the bitmaps of three loads, one of them stored twice."""
    path = f"{shared_folder(spark)}/evenkeel/{uuid.uuid4().hex}"
    orders, status = layout.table(spark, sf, "orders"), F.coalesce("o_orderstatus", F.lit("?"))
    for load in (status == "F", status == "O", ~status.isin("F", "O"), status == "O"):
        keysets.store_keys(orders.filter(load), layout.dist_of("orders"), path)
    return keysets.counted_per_shard(keysets.stored_keys(spark, path), layout.placements(spark), layout.nodes(spark))


def q_merged_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of orders in three loads, each read once; whether the estimates keep to their bounds."""
    base = f"{shared_folder(spark)}/evenkeel/{uuid.uuid4().hex}"
    orders, status = layout.table(spark, sf, "orders"), F.coalesce("o_orderstatus", F.lit("?"))
    for load in (status == "F", status == "O", ~status.isin("F", "O")):
        orders.filter(load).write.mode("append").parquet(f"{base}/orders")
        stored = spark.read.schema(orders.schema).parquet(f"{base}/orders")
        sketches.update_sketches(stored, f"{base}/sketches")
    merged = materialise(sketches.merged_sketches(stored, f"{base}/sketches"))
    ranks = merged.filter("quantiles IS NOT NULL").select("column_name", F.posexplode("quantiles").alias("k", "q"))
    numeric = [f.name for f in orders.schema if f.dataType.simpleString() in ("int", "bigint", "double")]
    values = orders.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in numeric)))).filter("v IS NOT NULL")
    at = values.join(ranks, "column_name").groupBy("column_name", "k").agg(F.avg((F.col("v") < F.col("q")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("q")).cast("int")).alias("upto"))
    close = (F.col("below") <= F.col("k") / 4 + 0.03) & (F.col("upto") >= F.col("k") / 4 - 0.03)
    kept = at.groupBy("column_name").agg(F.bool_and(close).alias("quartiles_close"))
    exact = stats.analyze_tables({"orders": orders}).select("column_name", F.col("distinct_values").alias("exact"))
    return merged.join(kept, "column_name", "left").join(exact, "column_name").select(
        "column_name", "rows", "nulls", F.element_at("quantiles", 1).alias("min_value"), F.element_at("quantiles", 5).alias("max_value"),
        (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_close"), "quartiles_close",
    )


def q_match_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Relations against patterns made from the parts: beginnings, endings, middles and open ends."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    made = F.when(k == 0, F.concat(F.lit("TPCC_"), size, F.lit("%"))).when(k == 1, F.concat(F.lit("%_"), size))
    made = made.when(k == 2, F.concat(F.lit("x%Word_"), size, F.lit("__"))).when(k == 3, F.concat(F.lit("%"), size, F.lit("%pay%")))
    made = made.otherwise(F.concat(F.lit("____"), F.repeat(F.lit("_"), (F.col("p_size") % 3).cast("int"))))
    asked = layout.table(spark, sf, "part").select(made.alias("pattern"))
    return patterns.match_patterns(layout.relations(spark, sf), asked).select("schema", "name", "kind", "pattern")


def q_colocated_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables that share the layout of lineitem, with their bytes."""
    names = placement.colocated_tables(layout.distribution(spark), "lineitem")
    stats_of = layout.shard_stats(spark, sf).join(names, "table_name", "left_semi")
    return stats_of.groupBy("table_name").agg(F.sum("shard_size").alias("bytes"))


def q_analyze_tables(spark: SparkSession, sf: str) -> DataFrame:
    names = ["orders", "customer", "documents"]
    return stats.analyze_tables({n: layout.table(spark, sf, n) for n in names})


def q_analyze_nested(spark: SparkSession, sf: str) -> DataFrame:
    return stats.analyze_tables({"embeddings": spark.read.parquet(f"{sf}/embeddings.parquet")})


def q_top_relations(spark: SparkSession, sf: str) -> DataFrame:
    return sizes.top_relations(layout.relations(spark, sf))


def q_statements(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.statements(layout.relations(spark, sf))


def _match(kind: str, patterns: list[str]) -> Query:
    return lambda spark, sf: inventory.match_relations(layout.relations(spark, sf), kind, patterns)


def q_leftover_relations(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.leftover_relations(layout.relations(spark, sf))


def q_known_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The known tables with the rows they have here, NULL when there is none."""
    given = ["region", "nation", "supplier", "part", "customer", "orders", "lineitem"]
    counts = [
        layout.table(spark, sf, n)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("name", F.lit(n))
        for n in given
    ]
    known = inventory.known_relations(spark)
    return known.join(reduce(DataFrame.unionByName, counts), "name", "left").select(
        "workload", "name", "n_rows"
    )


def q_exists_probe(spark: SparkSession, sf: str) -> DataFrame:
    late = F.col("o_orderstatus") == "O"
    return inventory.count_where(layout.table(spark, sf, "orders"), late)


def q_result_lines(spark: SparkSession, sf: str) -> DataFrame:
    return runs.result_lines(layout.run_log(spark, sf))


def q_label_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.label_runs(layout.run_log(spark, sf))


def q_parse_results(spark: SparkSession, sf: str) -> DataFrame:
    return runs.parse_results(layout.run_log(spark, sf))


def q_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_summary(layout.run_log(spark, sf))


def q_summary_listing(spark: SparkSession, sf: str) -> DataFrame:
    return runs.summary_listing(runs.run_summary(layout.run_log(spark, sf)))


def q_missing_results(spark: SparkSession, sf: str) -> DataFrame:
    """Runs without a result, where only large purchases count as results."""
    events = layout.table(spark, sf, "events")
    logs = events.select(
        F.format_string("tpcc.PG-17.2-ext.%d.log", F.col("user_id")).alias("file_name"),
        F.when(
            (F.col("event_type") == "purchase") & (F.col("value") > 300), F.lit(runs.RESULT_MARK)
        ).otherwise(F.col("event_type")).alias("value"),
    )
    return runs.missing_results(logs)


def q_missing_iterations(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that are short of seven per variant."""
    return runs.missing_results(layout.run_log(spark, sf), iterations=7)


def q_stored_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Two variants stored one after the other, one of them again, and the other added to."""
    path = f"{shared_folder(spark)}/evenkeel/{uuid.uuid4().hex}"
    summary = runs.run_summary(layout.run_log(spark, sf))
    first, second = (summary.filter(F.col("variant") == v) for v in ("PG-17.0", "PG-17.1"))
    for part, append in ((first, False), (second, False), (second, False), (first, True)):
        runs.write_summary(part, path, append)
    stored = spark.read.parquet(path)
    return stored.groupBy("benchmark", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum("nopm").alias("nopm"))


def q_throughput(spark: SparkSession, sf: str) -> DataFrame:
    day = 24 * 60
    return runs.throughput(layout.table(spark, sf, "events"), day, 7 * day, "purchase")


def q_throughput_per_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run per calendar day of the events, with windows of 36 hours, which overlap."""
    events = layout.table(spark, sf, "events")
    starts = events.groupBy(F.to_date("ts").cast("string").alias("run")).agg(F.min("ts").alias("start"))
    return runs.throughput_per_run(events, starts, 60, 36 * 60, "purchase")


QUERIES: dict[str, Query] = {
    "shard_of": q_shard_of,
    "place_keys": q_place_keys,
    "place_keys_with_nulls": q_place_keys_with_nulls,
    "keys_per_shard": _per(placement.keys_per_shard, "orders"),
    "keys_per_shard_lineitem": _per(placement.keys_per_shard, "lineitem"),
    "keys_per_shard_documents": _per(placement.keys_per_shard, "documents"),
    "keys_per_node": _per(placement.keys_per_node, "orders"),
    "keys_per_node_lineitem": _per(placement.keys_per_node, "lineitem"),
    "keys_per_node_documents": _per(placement.keys_per_node, "documents"),
    "keys_per_shard_global": q_keys_per_shard_global,
    "locate_key": q_locate_key,
    "locate_keys": q_locate_keys,
    "shard_size_by_shard": _size(None, 1, True),
    "shard_size_by_node": _size(None, 3, False),
    "shard_size_by_table_shard": _size("documents", 13, True),
    "shard_size_by_table_node": _size("lineitem", 3, False),
    "size_pretty": q_size_pretty,
    "to_blocks": q_to_blocks,
    "balance_status": q_balance_status,
    "move_candidates": _candidates(1),
    "move_candidates_top_5": _candidates(5),
    "rebalance_plan": _plan(None, "orders"),
    "rebalance_plan_limited": _plan(50, "orders"),
    "rebalance_plan_documents": _plan(None, "documents"),
    "apply_plan": q_apply_plan,
    "apply_plan_twice": q_apply_plan_twice,
    "keys_per_shard_after_rebalance": q_keys_per_shard_after_rebalance,
    "locate_keys_after_rebalance": q_locate_keys_after_rebalance,
    "locate_keys_typed": q_locate_keys_typed,
    "apply_plan_colocated": q_apply_plan_colocated,
    "balance_report_shards": _report("shard"),
    "balance_report_nodes": _report("node"),
    "size_report": q_size_report,
    "shard_ranges": q_shard_ranges,
    "keys_per_shard_by_range": q_keys_per_shard_by_range,
    "locate_keys_by_range": q_locate_keys_by_range,
    "shard_moves": q_shard_moves,
    "rebalance_by_name": q_rebalance_by_name,
    "relayout_moves": q_relayout_moves,
    "relayout": q_relayout,
    "relayout_files": q_relayout_files,
    "keys_per_shard_stored": q_keys_per_shard_stored,
    "merged_sketches": q_merged_sketches,
    "match_patterns": q_match_patterns,
    "colocated_tables": q_colocated_tables,
    "analyze_tables": q_analyze_tables,
    "analyze_nested": q_analyze_nested,
    "top_relations": q_top_relations,
    "statements": q_statements,
    "match_relations_view": _match("v", inventory.VIEW_PATTERNS),
    "match_relations_matview": _match("m", inventory.VIEW_PATTERNS),
    "match_relations_sequence": _match("S", inventory.SEQUENCE_PATTERNS),
    "match_relations_function": _match("f", inventory.FUNCTION_PATTERNS),
    "leftover_relations": q_leftover_relations,
    "known_relations": q_known_relations,
    "exists_probe": q_exists_probe,
    "result_lines": q_result_lines,
    "label_runs": q_label_runs,
    "parse_results": q_parse_results,
    "run_summary": q_run_summary,
    "summary_listing": q_summary_listing,
    "missing_results": q_missing_results,
    "missing_iterations": q_missing_iterations,
    "stored_summaries": q_stored_summaries,
    "throughput": q_throughput,
    "throughput_per_run": q_throughput_per_run,
}

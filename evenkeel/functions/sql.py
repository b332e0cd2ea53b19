"""SQL names for the operators, so that they can be called from ``spark.sql``.

Everything is a SQL-bodied function: Catalyst inlines the body into the
calling query, nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_SCALARS = {
    "shard_of(k STRING, n INT) RETURNS BIGINT":
        "shiftright(CAST(conv(substring(md5(k), 1, 8), 16, 10) AS BIGINT) * n, 32)",
    "to_blocks(s BIGINT) RETURNS BIGINT": "(s + 4096) DIV 8192",
    "size_pretty(s BIGINT) RETURNS STRING": """
        CASE WHEN s < 10240 THEN concat(s, ' bytes')
             WHEN shiftright(s, 9) < 20479 THEN concat(shiftright(shiftright(s, 9) + 1, 1), ' kB')
             WHEN shiftright(s, 19) < 20479 THEN concat(shiftright(shiftright(s, 19) + 1, 1), ' MB')
             WHEN shiftright(s, 29) < 20479 THEN concat(shiftright(shiftright(s, 29) + 1, 1), ' GB')
             WHEN shiftright(s, 39) < 20479 THEN concat(shiftright(shiftright(s, 39) + 1, 1), ' TB')
             WHEN s IS NOT NULL THEN concat(shiftright(shiftright(s, 49) + 1, 1), ' PB') END""",
    "quote_ident(name STRING) RETURNS STRING": "concat('`', replace(name, '`', '``'), '`')",
}


def _name(name: str) -> str:
    """A name as one quoted part."""
    return "`" + name.replace("`", "``") + "`"


def _table(name: str) -> str:
    """A table's name, whose dots part it."""
    return ".".join(_name(part) for part in name.split("."))


def _text(value: str) -> str:
    """A string as a literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def register_functions(spark: SparkSession) -> None:
    """Create the scalar functions as temporary functions of the session."""
    for signature, body in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_shard_size(spark: SparkSession, shard_stats: str) -> None:
    """Create the table function ``shard_size`` over a table or view of shard
    sizes, with the same three optional arguments as the Python function."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION shard_size(
            p_table STRING DEFAULT NULL,
            p_colocation_id INT DEFAULT 1,
            p_include_shard_id BOOLEAN DEFAULT true)
        RETURNS TABLE (nodename STRING, nodeport INT, shardid BIGINT, table_name STRING,
                       shard_size BIGINT, shard_nblocks BIGINT, shard_size_pretty STRING)
        RETURN SELECT nodename, nodeport, shardid, table_name, bytes,
                      to_blocks(bytes), size_pretty(bytes)
               FROM (SELECT s.nodename, s.nodeport,
                            CASE WHEN p_include_shard_id THEN s.shardid END AS shardid,
                            CASE WHEN p_table IS NOT NULL THEN s.table_name END AS table_name,
                            sum(s.shard_size) AS bytes
                     FROM {shard_stats} s
                     WHERE s.colocation_id = p_colocation_id
                       AND (p_table IS NULL OR s.table_name = p_table)
                     GROUP BY 1, 2, 3, 4)""")


def register_key_functions(
    spark: SparkSession,
    name: str,
    table: str,
    key: str,
    placements: str,
    nodes: str,
    n_shards: int,
    shard_base: int = 0,
) -> None:
    """Create ``<name>_keys_per_shard()``, ``<name>_keys_per_node()`` and
    ``<name>_locate_key(value)`` for one distributed table. All arguments that
    name tables are tables or views of the session, with dots between the parts of a name; names may
    hold any other character. The argument of ``locate_key`` is
    cast to the key's type, and a value that isn't one of it raises."""
    columns = dict(spark.table(_table(table)).dtypes)
    if key not in columns:
        raise ValueError(f"could not determine the data type of column {key}")
    kind = columns[key]

    def text(k: str) -> str:
        if kind == "timestamp":
            return f"CAST(unix_micros({k}) AS STRING)"
        return f"CAST({k} + CAST(0 AS {kind}) AS STRING)" if kind in ("double", "float") else f"CAST({k} AS STRING)"

    owners = f"""(SELECT p.shardid, n.nodename, n.nodeport
                  FROM {_table(placements)} p JOIN {_table(nodes)} n ON n.groupid = p.groupid
                  WHERE n.noderole = 'primary')"""
    # Never NULL, so that the join puts no test of the hash on the scan.
    shard = f"coalesce({shard_base} + shard_of({text("k")}, {n_shards}), -1L)"
    counts = f"""(SELECT {shard} AS shardid, count(*) AS dist_value_count
                  FROM (SELECT DISTINCT {_name(key)} AS k FROM {_table(table)} WHERE {_name(key)} IS NOT NULL)
                  GROUP BY 1)"""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {_name(name + '_keys_per_shard')}()
        RETURNS TABLE (nodename STRING, nodeport INT, shardid BIGINT, dist_value_count BIGINT)
        RETURN SELECT o.nodename, o.nodeport, c.shardid, c.dist_value_count
               FROM {counts} c JOIN {owners} o ON o.shardid = c.shardid""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {_name(name + '_keys_per_node')}()
        RETURNS TABLE (nodename STRING, nodeport INT, dist_value_count BIGINT)
        RETURN SELECT o.nodename, o.nodeport, sum(c.dist_value_count)
               FROM {counts} c JOIN {owners} o ON o.shardid = c.shardid
               GROUP BY o.nodename, o.nodeport""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {_name(name + '_locate_key')}(v STRING)
        RETURNS TABLE (nodename STRING, nodeport INT, table_name STRING,
                       shard_table_name STRING, shard_id BIGINT)
        RETURN SELECT o.nodename, o.nodeport, {_text(name)}, concat({_text(name + '_')}, o.shardid), o.shardid
               FROM {owners} o
               WHERE o.shardid = {shard_base} + shard_of({text(f"CAST(v AS {kind})")}, {n_shards})""")

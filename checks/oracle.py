"""The registered queries in DuckDB SQL, written from the semantics and not from
the Spark plans: moves are listed one by one and numbered with plain windows."""

from __future__ import annotations

from checks import layout
from evenkeel.operators import inventory

N = layout.N_SHARDS


def _bucket(key: str) -> str:
    return f"((('0x' || substr(md5(({key})::VARCHAR), 1, 8))::BIGINT * {N}) >> 32)"


def _group(bucket: str) -> str:
    starts = sorted(layout.GROUP_STARTS.items(), key=lambda g: -g[1])
    whens = " ".join(f"WHEN {bucket} >= {first} THEN {g}" for g, first in starts)
    return f"CASE {whens} END"


def _placed(name: str, key: str | None = None) -> str:
    """Distinct keys with node and shard."""
    column, _, base, _ = layout.TABLES[name]
    return f"""
        SELECT 'worker-' || {_group("b")} AS nodename, 5432::INTEGER AS nodeport,
               {base} + b AS shardid, k AS dist_value
        FROM (SELECT k, {_bucket("k")} AS b
              FROM (SELECT DISTINCT {key or column} AS k FROM {name}) WHERE k IS NOT NULL)"""


def _per_shard(name: str) -> str:
    return f"""
        SELECT nodename, nodeport, shardid, count(DISTINCT dist_value) AS dist_value_count
        FROM ({_placed(name)}) GROUP BY nodename, nodeport, shardid"""


def _per_node(name: str) -> str:
    return f"""
        SELECT nodename, nodeport, sum(dist_value_count)::BIGINT AS dist_value_count
        FROM ({_per_shard(name)}) GROUP BY nodename, nodeport"""


def _located(bucket: str, base: int, name: str) -> str:
    return f"""'worker-' || {_group(bucket)} AS nodename, 5432::INTEGER AS nodeport,
        '{name}' AS table_name, '{name}_' || ({base} + {bucket}) AS shard_table_name,
        {base} + {bucket} AS shard_id"""


def _shard_stats() -> str:
    parts = []
    for name, (column, colocation, base, width) in layout.TABLES.items():
        size = "strlen(text)" if width is None else str(width)
        parts.append(f"""
            SELECT 'worker-' || {_group("b")} AS nodename, 5432::INTEGER AS nodeport,
                   {base} + b AS shardid, '{name}' AS table_name,
                   {colocation}::INTEGER AS colocation_id, sum(size)::BIGINT AS shard_size
            FROM (SELECT {_bucket(column)} AS b, {size} AS size FROM {name})
            GROUP BY b""")
    return " UNION ALL ".join(parts)


def _pretty(s: str) -> str:
    whens = [f"WHEN {s} < 10240 THEN {s} || ' bytes'"]
    for i, unit in enumerate(["kB", "MB", "GB", "TB"]):
        half = f"({s} >> {9 + 10 * i})"
        whens.append(f"WHEN {half} < 20479 THEN (({half} + 1) >> 1) || ' {unit}'")
    return f"CASE {' '.join(whens)} ELSE ((({s} >> 49) + 1) >> 1) || ' PB' END"


def _size(stats: str, table: str | None, group: int, by_shard: bool) -> str:
    shard = "shardid" if by_shard else "NULL::BIGINT"
    name = "table_name" if table else "NULL::VARCHAR"
    only = f"AND table_name = '{table}'" if table else ""
    return f"""
        SELECT nodename, nodeport, shardid, table_name, shard_size,
               (shard_size + 4096) // 8192 AS shard_nblocks,
               {_pretty("shard_size")} AS shard_size_pretty
        FROM (SELECT nodename, nodeport, {shard} AS shardid, {name} AS table_name,
                     sum(shard_size)::BIGINT AS shard_size
              FROM ({stats}) WHERE colocation_id = {group} {only} GROUP BY ALL)"""


def _candidates(name: str, k: int) -> str:
    return f"""
        SELECT nodename, nodeport, rank, key_text, shardid, dist_value_count
        FROM (SELECT *, row_number() OVER (PARTITION BY nodename, nodeport
                     ORDER BY dist_value_count > 1, key_text) AS rank
              FROM (SELECT nodename, nodeport, shardid, dist_value::VARCHAR AS key_text,
                           count(*) OVER (PARTITION BY shardid) AS dist_value_count
                    FROM ({_placed(name)})))
        WHERE rank <= {k}"""


def _moves(name: str, max_moves: int | None = None) -> str:
    """WITH clause that ends in ``moves``: every step of every node as a row."""
    limit = f"AND move_no <= {max_moves}" if max_moves is not None else ""
    return f"""
        WITH placed AS ({_placed(name)}),
        keys AS (
            SELECT *, dist_value::VARCHAR AS t, count(*) OVER (PARTITION BY shardid) AS n,
                   row_number() OVER (PARTITION BY shardid ORDER BY dist_value::VARCHAR) AS nth,
                   lag(dist_value::VARCHAR) OVER (PARTITION BY shardid
                                                  ORDER BY dist_value::VARCHAR) AS prev
            FROM placed),
        picks AS (
            SELECT *, n > 1 AND nth < n AS needs_isolation,
                   row_number() OVER (
                       PARTITION BY nodename, nodeport
                       ORDER BY n > 1, CASE WHEN n > 1 AND nth = n THEN prev ELSE t END,
                                n > 1 AND nth = n) AS pick
            FROM keys),
        held AS (SELECT nodename, nodeport, count(*) AS c FROM placed GROUP BY ALL),
        mean AS (SELECT sum(c) / count(*) AS a FROM held),
        gives AS (
            SELECT nodename, nodeport, c - l + 1 AS pick, l AS source_count,
                   row_number() OVER (ORDER BY l DESC, nodename, nodeport) AS move_no
            FROM (SELECT held.*, unnest(range(floor(a)::BIGINT + 1, c + 1)) AS l
                  FROM held, mean)),
        takes AS (
            SELECT nodename AS target_node, nodeport AS target_port, l AS target_count,
                   row_number() OVER (ORDER BY l, nodename, nodeport) AS move_no
            FROM (SELECT held.*, unnest(range(c, ceil(a)::BIGINT)) AS l FROM held, mean)),
        moves AS (
            SELECT move_no, dist_value, shardid, needs_isolation, nodename AS source_node,
                   nodeport AS source_port, target_node, target_port, source_count, target_count
            FROM gives JOIN takes USING (move_no) JOIN picks USING (nodename, nodeport, pick)
            WHERE source_count - target_count > 1 {limit})"""


LAST_SHARD = max(t[2] for t in layout.TABLES.values()) + N - 1


def _moved(name: str, max_moves: int | None = None) -> str:
    return f"""{_moves(name, max_moves)},
        after_moves AS (
            SELECT coalesce(target_node, nodename) AS nodename,
                   coalesce(target_port, nodeport) AS nodeport,
                   CASE WHEN m.needs_isolation THEN {LAST_SHARD} + m.move_no
                        ELSE p.shardid END AS shardid,
                   dist_value
            FROM placed p LEFT JOIN moves m USING (dist_value))"""


def _report(by: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{phase}' AS phase, {by}, count(*) AS dist_value_count
            FROM {source} GROUP BY {by}"""
        for phase, source in [("before", "placed"), ("after", "after_moves")]
    )


def _size_report() -> str:
    parts = []
    for phase, source in [("before", "placed"), ("after", "after_moves")]:
        stats = f"""SELECT nodename, nodeport, shardid, 'orders' AS table_name,
                           1 AS colocation_id, count(*) * 56 AS shard_size
                    FROM orders JOIN {source} ON o_custkey = dist_value
                    GROUP BY nodename, nodeport, shardid"""
        parts.append(f"SELECT '{phase}' AS phase, * FROM ({_size(stats, 'orders', 1, True)})")
    return f"{_moved('orders')} {' UNION ALL '.join(parts)}"


def _analyze() -> str:
    fixed = {"BIGINT": 8, "INTEGER": 4, "DOUBLE": 8, "TIMESTAMP": 8}
    columns = {
        "orders": {
            "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR",
            "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR",
        },
        "customer": {
            "c_custkey": "BIGINT", "c_name": "VARCHAR", "c_nationkey": "INTEGER",
            "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR",
        },
        "documents": {
            "doc_id": "BIGINT", "text": "VARCHAR", "lang": "VARCHAR", "source": "VARCHAR",
            "n_chars": "BIGINT",
        },
    }
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows,
                   count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values,
                   min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value,
                   avg({fixed.get(kind, f"strlen({c})")})::DOUBLE AS avg_width
            FROM {t}"""
        for t, cols in columns.items()
        for c, kind in cols.items()
    )


def _sketched() -> str:
    """Exact values, where the estimates keep to their bounds."""
    numeric = ("o_orderkey", "o_custkey", "o_totalprice")
    columns = (*numeric, "o_orderstatus", "o_orderdate", "o_orderpriority")
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls,
                   {f"min({c})" if c in numeric else "NULL"}::DOUBLE AS min_value,
                   {f"max({c})" if c in numeric else "NULL"}::DOUBLE AS max_value,
                   true AS distinct_close, {"true" if c in numeric else "NULL::BOOLEAN"} AS quartiles_close
            FROM orders"""
        for c in columns
    )


def _patterns() -> str:
    return """
        SELECT DISTINCT CASE p_partkey % 5
            WHEN 0 THEN 'TPCC_' || p_size || '%' WHEN 1 THEN '%_' || p_size
            WHEN 2 THEN 'x%Word_' || p_size || '__' WHEN 3 THEN '%' || p_size || '%pay%'
            ELSE '____' || repeat('_', p_size % 3) END AS pattern
        FROM part"""


def _relations() -> str:
    def pick(words: list[str], index: str) -> str:
        whens = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words))
        return f"CASE {index} {whens} END"

    literal = ", ".join(
        f"('{s}', '{name}', '{kind}', {size}::BIGINT)"
        for s, name, kind, size in layout.literal_relations()
    )
    prefixes = layout.NAME_PREFIXES
    return f"""
        SELECT * FROM (VALUES {literal}) v(schema, name, kind, bytes)
        UNION ALL
        SELECT 'public', {pick(prefixes, "p_partkey % 8")} || p_partkey,
               {pick(layout.KIND_CYCLE, "p_partkey % 5")}, p_size * p_partkey * 1024 FROM part
        UNION ALL
        SELECT 'public', {pick(prefixes, "s_suppkey % 8")} || s_suppkey, 'f', 0 FROM supplier"""


def _like(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"name ILIKE '{p}'" for p in patterns) + ")"


def _match(kind: str, patterns: list[str]) -> str:
    return f"""SELECT schema, name, kind FROM ({_relations()})
               WHERE schema = 'public' AND kind = '{kind}' AND {_like(patterns)}"""


def _names(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _known() -> str:
    given = ["region", "nation", "supplier", "part", "customer", "orders", "lineitem"]
    counts = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in given)
    words = [("tpcc", n) for n in inventory.TPCC_TABLES] + [
        ("tpch", n) for n in inventory.TPCH_TABLES
    ]
    values = ", ".join(f"('{w}', '{n}')" for w, n in words)
    return f"""SELECT workload, name, n_rows FROM (VALUES {values}) k(workload, name)
               LEFT JOIN ({counts}) USING (name)"""


def _run_log() -> str:
    ignored = ", ".join(f"('{f}', '{layout.IGNORED_LINE}')" for f in layout.IGNORED_LOGS)
    return f"""
        SELECT 'tpcc.PG-17.' || (event_id % 3) || '.' || (1 + event_id % 5) || '.log' AS file_name,
               CASE WHEN event_type = 'purchase'
                    THEN 'Vuser 1:TEST RESULT : System achieved ' || (30000 + event_id)
                         || ' NOPM from ' || (70000 + 2 * event_id) || ' PostgreSQL TPM'
                    ELSE 'Vuser ' || user_id || ':' || event_type END AS value
        FROM events
        UNION ALL SELECT * FROM (VALUES {ignored}) i(file_name, value)"""


_RUN_NAME = r"^([^.]+)[.](PG-.+)[.]([0-9]+)[.]log$"
_RESULT = r"Vuser ([0-9]+):TEST RESULT : System achieved ([0-9]+) NOPM from ([0-9]+) (.+) TPM"


def _labelled(source: str) -> str:
    return f"""
        SELECT regexp_extract(file_name, '{_RUN_NAME}', 1) AS benchmark,
               regexp_extract(file_name, '{_RUN_NAME}', 2) AS variant,
               regexp_extract(file_name, '{_RUN_NAME}', 3)::BIGINT AS iteration, *
        FROM ({source}) WHERE regexp_matches(file_name, '{_RUN_NAME}')"""


def _parsed(source: str) -> str:
    part = "nullif(regexp_extract(value, '{}', {}), '')"
    return f"""
        SELECT *, {part.format(_RESULT, 1)}::BIGINT AS vuser,
               {part.format(_RESULT, 2)}::BIGINT AS nopm,
               {part.format(_RESULT, 3)}::BIGINT AS tpm, {part.format(_RESULT, 4)} AS system
        FROM ({source})"""


_RESULTS = "SELECT * FROM ({}) WHERE contains(value, 'TEST RESULT :')"

_MISSING = """
    SELECT 'tpcc' AS benchmark, 'PG-17.2-ext' AS variant, user_id::BIGINT AS iteration
    FROM events GROUP BY user_id
    HAVING count(*) FILTER (event_type = 'purchase' AND value > 300) = 0"""

_THROUGHPUT = """
    SELECT count(*) AS total_events,
           count(*) FILTER (event_type = 'purchase') AS order_events,
           count(*) / 10080.0::DOUBLE AS tpm,
           count(*) FILTER (event_type = 'purchase') / 10080.0::DOUBLE AS nopm
    FROM events, (SELECT min(ts) AS t0 FROM events)
    WHERE ts >= t0 + INTERVAL 1 DAY AND ts < t0 + INTERVAL 8 DAY"""

_ORDERS_BASE = layout.TABLES["orders"][2]

_moved_100 = _moved("orders", 100)

# An isolated key is at its own shard, others at the shard of their hash, which may have moved as a whole.
_LOCATED_AFTER = f"""{_moves("orders", 50)}
    SELECT c_custkey, coalesce(m.target_node, w.target_node, 'worker-' || {_group("b")}) AS nodename,
           coalesce(m.target_port, w.target_port, 5432)::INTEGER AS nodeport, 'orders' AS table_name,
           'orders_' || s AS shard_table_name, s AS shard_id
    FROM (SELECT c_custkey, {_bucket("c_custkey")} AS b FROM customer)
    LEFT JOIN moves m ON m.dist_value = c_custkey
    LEFT JOIN moves w ON NOT w.needs_isolation AND w.shardid = {_ORDERS_BASE} + b,
    LATERAL (SELECT CASE WHEN m.needs_isolation THEN {LAST_SHARD} + m.move_no
                         ELSE {_ORDERS_BASE} + b END AS s)"""

_CUSTOMERS_AFTER = f"""
    SELECT coalesce(m.target_node, w.target_node, own.nodename) AS nodename,
           coalesce(m.target_port, w.target_port, own.nodeport) AS nodeport,
           CASE WHEN m.move_no IS NOT NULL THEN {LAST_SHARD} + m.move_no ELSE own.shardid END AS shardid,
           own.dist_value
    FROM own LEFT JOIN moves m ON m.needs_isolation AND m.dist_value = own.dist_value
    LEFT JOIN moves w ON NOT w.needs_isolation
         AND w.shardid - {_ORDERS_BASE} = own.shardid - {layout.TABLES["customer"][2]}"""

_COLOCATED = f"""{_moves("orders")}, own AS ({_placed("customer")}) {_CUSTOMERS_AFTER}"""


def _hash(key: str) -> str:
    return f"('0x' || substr(md5(({key})::VARCHAR), 1, 8))::BIGINT"


# All cut positions of the hash space in a row: each begins a range that ends before the next. What begins at an isolated hash is its
# own shard's, the rest belongs to the shard of its hash.
def _ranges(max_moves: int | None) -> str:
    return f"""{_moves("orders", max_moves)},
    own AS (
      SELECT {_hash("dist_value")} AS h, min({LAST_SHARD} + move_no) AS s FROM moves WHERE needs_isolation GROUP BY ALL
    ),
    starts AS (
      SELECT DISTINCT low FROM (
        SELECT (i * 4294967296 + {N - 1}) // {N} AS low FROM (SELECT unnest(range({N}))::BIGINT AS i)
        UNION ALL SELECT h FROM own UNION ALL SELECT h + 1 FROM own WHERE h < 4294967295
      )
    ),
    ranges AS (
      SELECT coalesce(s, {_ORDERS_BASE} + ((low * {N}) >> 32)) AS shardid, low,
             lead(low, 1, 4294967296) OVER (ORDER BY low) - 1 AS high
      FROM starts LEFT JOIN own ON h = low
    )"""


def _levelled() -> str:
    bases = " ".join(f"WHEN '{t}' THEN {base}" for t, (_, _, base, _) in layout.TABLES.items())
    return f"""
    WITH weights AS (
      SELECT nodename, nodeport, shardid - CASE table_name {bases} END AS place, sum(shard_size)::BIGINT AS weight
      FROM ({_shard_stats()}) WHERE colocation_id = 1 GROUP BY ALL
    ),
    loads AS (
      SELECT *, sum(load) OVER ()::BIGINT AS total, count(*) OVER () AS n, ((sum(load) OVER () * 1100) // (count(*) OVER () * 1000))::BIGINT AS most
      FROM (SELECT 'worker-' || g AS nodename, 5432::INTEGER AS nodeport, coalesce(sum(weight), 0)::BIGINT AS load
            FROM (SELECT unnest({list(layout.GROUP_STARTS)}) AS g) LEFT JOIN weights ON nodename = 'worker-' || g GROUP BY ALL)
    ),
    given AS (
      SELECT *, sum(weight) OVER (ORDER BY nodename, nodeport, weight, place)::BIGINT AS line_to FROM (
        SELECT w.*, load, most, sum(weight) OVER (PARTITION BY nodename, nodeport ORDER BY weight, place)::BIGINT AS upto
        FROM weights w JOIN loads USING (nodename, nodeport)
      ) WHERE load - upto + weight > most AND load > upto
    ),
    room AS (
      SELECT nodename AS target_node, nodeport AS target_port, most - load AS room,
             sum(most - load) OVER (ORDER BY most - load DESC, nodename, nodeport)::BIGINT AS room_to
      FROM loads WHERE load * n < total AND most > load
    ),
    spot AS (
      SELECT *, ((2 * line_to - weight)::HUGEINT * (SELECT sum(room) FROM room) // (2 * (SELECT sum(weight) FROM given)))::BIGINT AS spot FROM given
    )
    SELECT place, weight, nodename AS source_node, nodeport AS source_port, target_node, target_port
    FROM spot JOIN room ON spot >= room_to - room AND spot < room_to"""


ORACLE: dict[str, str] = {
    "shard_of": f"SELECT o_orderkey, o_custkey, {_bucket('o_custkey')} AS bucket FROM orders",
    "place_keys": _placed("orders"),
    "place_keys_with_nulls": _placed(
        "orders", "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END"
    ),
    "keys_per_shard": _per_shard("orders"),
    "keys_per_shard_lineitem": _per_shard("lineitem"),
    "keys_per_shard_documents": _per_shard("documents"),
    "keys_per_node": _per_node("orders"),
    "keys_per_node_lineitem": _per_node("lineitem"),
    "keys_per_node_documents": _per_node("documents"),
    "keys_per_shard_global": f"""
        SELECT shardid, count(DISTINCT dist_value) AS dist_value_count
        FROM ({_placed("orders")}) GROUP BY shardid""",
    "locate_key": f"""
        SELECT {_located(_bucket("105"), _ORDERS_BASE, "orders")},
               (SELECT count(*) FROM orders WHERE o_custkey = 105) AS key_rows""",
    "locate_keys": f"""
        SELECT c_custkey, {_located(_bucket("c_custkey"), _ORDERS_BASE, "orders")}
        FROM customer""",
    "shard_size_by_shard": _size(_shard_stats(), None, 1, True),
    "shard_size_by_node": _size(_shard_stats(), None, 3, False),
    "shard_size_by_table_shard": _size(_shard_stats(), "documents", 13, True),
    "shard_size_by_table_node": _size(_shard_stats(), "lineitem", 3, False),
    "size_pretty": f"""
        SELECT *, {_pretty("bytes")} AS pretty
        FROM (SELECT o_orderkey,
                     (o_orderkey % 1048576) * (1::BIGINT << (o_orderkey % 40)) AS bytes
              FROM orders)""",
    "to_blocks": """
        SELECT o_orderkey, o_orderkey * 1024 AS bytes,
               (o_orderkey * 1024 + 4096) // 8192 AS blocks FROM orders""",
    "balance_status": f"""
        WITH c AS ({_per_node("orders")}),
        f AS (SELECT * FROM c ORDER BY dist_value_count DESC, nodename, nodeport LIMIT 1),
        e AS (SELECT * FROM c ORDER BY dist_value_count, nodename, nodeport LIMIT 1)
        SELECT f.nodename AS source_node, f.nodeport AS source_port,
               f.dist_value_count AS source_count, e.nodename AS target_node,
               e.nodeport AS target_port, e.dist_value_count AS target_count,
               f.dist_value_count - e.dist_value_count AS spread,
               f.dist_value_count - e.dist_value_count <= 1 AS balanced
        FROM f, e""",
    "move_candidates": _candidates("orders", 1),
    "move_candidates_top_5": _candidates("orders", 5),
    "rebalance_plan": f"{_moves('orders')} SELECT * FROM moves",
    "rebalance_plan_limited": f"{_moves('orders', 50)} SELECT * FROM moves",
    "rebalance_plan_documents": f"{_moves('documents')} SELECT * FROM moves",
    "apply_plan": f"{_moved('orders')} SELECT * FROM after_moves",
    "apply_plan_twice": f"""{_moved_100}
        SELECT nodename, nodeport, dist_value,
               count(*) OVER (PARTITION BY shardid) = 1 AS alone FROM after_moves""",
    "keys_per_shard_after_rebalance": f"""{_moved('orders')}
        SELECT nodename, nodeport, shardid, count(*) AS dist_value_count
        FROM after_moves GROUP BY nodename, nodeport, shardid""",
    "locate_keys_after_rebalance": _LOCATED_AFTER,
    "locate_keys_typed": f"""
        SELECT c_custkey, {_located(_bucket("c_custkey"), _ORDERS_BASE, "orders")}
        FROM customer, (SELECT unnest([1, 2]))""",
    "apply_plan_colocated": _COLOCATED,
    "balance_report_shards": f"{_moved('orders')} {_report('nodename, nodeport, shardid')}",
    "balance_report_nodes": f"{_moved('orders')} {_report('nodename, nodeport')}",
    "size_report": _size_report(),
    "shard_ranges": f"""{_ranges(50)}
        SELECT shardid, low, high, count(k) AS n_keys
        FROM ranges LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON {_hash("k")} BETWEEN low AND high GROUP BY ALL""",
    "keys_per_shard_by_range": f"""{_ranges(None)},
        whole AS (SELECT shardid, target_node, target_port FROM moves WHERE NOT needs_isolation)
        SELECT coalesce(w.target_node, m.target_node, 'worker-' || {_group("b")}) AS nodename,
               coalesce(w.target_port, m.target_port, 5432)::INTEGER AS nodeport, r.shardid, count(*) AS dist_value_count
        FROM (SELECT DISTINCT o_custkey AS k, {_bucket("o_custkey")} AS b FROM orders)
        JOIN ranges r ON {_hash("k")} BETWEEN low AND high
        LEFT JOIN whole w USING (shardid) LEFT JOIN moves m ON r.shardid = {LAST_SHARD} + m.move_no AND m.needs_isolation
        GROUP BY ALL""",
    "locate_keys_by_range": _LOCATED_AFTER,
    "shard_moves": _levelled(),
    "rebalance_by_name": f"""{_moved("orders")},
        own AS ({_placed("customer")}), customers AS ({_CUSTOMERS_AFTER})
        SELECT 'orders' AS table_name, nodename, nodeport, shardid, count(*) AS dist_value_count FROM after_moves GROUP BY ALL
        UNION ALL
        SELECT 'customer', nodename, nodeport, shardid, count(*) FROM customers GROUP BY ALL""",
    "relayout_moves": f"""{_moved("documents", 50)}
        SELECT nodename, nodeport, shardid, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars
        FROM documents JOIN after_moves ON doc_id = dist_value GROUP BY ALL""",
    "relayout": f"""{_moved("documents")}
        SELECT nodename, nodeport, shardid, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars
        FROM documents JOIN after_moves ON doc_id = dist_value GROUP BY ALL""",
    "relayout_files": f"""
        SELECT DISTINCT nodename, nodeport, NULL::BIGINT AS shardid, 'documents' AS table_name,
               true AS stored FROM ({_placed("documents")})""",
    "colocated_tables": f"""
        SELECT table_name, sum(shard_size)::BIGINT AS bytes
        FROM ({_shard_stats()}) WHERE colocation_id = 3 GROUP BY table_name""",
    "keys_per_shard_stored": _per_shard("orders"),
    "merged_sketches": _sketched(),
    "match_patterns": f"""
        SELECT schema, name, kind, pattern FROM ({_relations()}) JOIN ({_patterns()}) ON name ILIKE pattern""",
    "analyze_tables": _analyze(),
    "analyze_nested": """
        SELECT 'embeddings' AS table_name, 'vec_id' AS column_name, count(*) AS rows,
               count(*) - count(vec_id) AS nulls, count(DISTINCT vec_id) AS distinct_values,
               min(vec_id)::VARCHAR AS min_value, max(vec_id)::VARCHAR AS max_value,
               8.0::DOUBLE AS avg_width FROM embeddings
        UNION ALL
        SELECT 'embeddings', 'label', count(*), count(*) - count(label), count(DISTINCT label),
               min(label)::VARCHAR, max(label)::VARCHAR, 4.0::DOUBLE FROM embeddings
        UNION ALL
        SELECT 'embeddings', 'embedding', count(*), count(*) - count(embedding), NULL, NULL, NULL,
               NULL FROM embeddings""",
    "top_relations": f"""
        SELECT schema, name AS table_name, bytes, {_pretty("bytes")} AS total_size
        FROM ({_relations()}) WHERE schema = 'public' AND kind IN ('r', 'p')
        ORDER BY bytes DESC, name LIMIT 20""",
    "statements": f"""
        SELECT schema, name,
               'ANALYZE TABLE `' || schema || '`.`' || name || '` COMPUTE STATISTICS' AS statement
        FROM ({_relations()}) WHERE schema = 'public' AND kind IN ('r', 'p')""",
    "match_relations_view": _match("v", inventory.VIEW_PATTERNS),
    "match_relations_matview": _match("m", inventory.VIEW_PATTERNS),
    "match_relations_sequence": _match("S", inventory.SEQUENCE_PATTERNS),
    "match_relations_function": _match("f", inventory.FUNCTION_PATTERNS),
    "leftover_relations": f"""
        SELECT kind, name FROM ({_relations()})
        WHERE schema = 'public' AND kind IN ({_names(inventory.LEFTOVER_KINDS)})
          AND ({_like(inventory.PREFIX_PATTERNS)} OR name IN ({_names(inventory.KNOWN_TABLES)}))""",
    "known_relations": _known(),
    "exists_probe": """
        SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'O') AS found,
               count(*) FILTER (o_orderstatus = 'O') AS n FROM orders""",
    "result_lines": _RESULTS.format(_run_log()),
    "label_runs": _labelled(_run_log()),
    "parse_results": _parsed(_run_log()),
    "run_summary": f"""
        SELECT benchmark, variant, iteration, vuser, nopm, tpm, system, value
        FROM ({_parsed(_RESULTS.format(_labelled(_run_log())))})""",
    "summary_listing": f"""
        WITH r AS ({_labelled(_RESULTS.format(_run_log()))})
        SELECT variant, value FROM r
        UNION ALL
        SELECT DISTINCT variant, benchmark || '.summary.' || variant || '.log' FROM r""",
    "missing_results": _MISSING,
    "missing_iterations": f"""
        WITH seen AS ({_labelled(_run_log())}),
        has AS (SELECT DISTINCT benchmark, variant, iteration FROM seen
                WHERE contains(value, 'TEST RESULT :'))
        SELECT * FROM (
            SELECT DISTINCT benchmark, variant, i AS iteration
            FROM seen, (SELECT unnest(range(1, 8)) AS i)
            UNION SELECT DISTINCT benchmark, variant, iteration FROM seen)
        EXCEPT SELECT * FROM has""",
    "stored_summaries": f"""
        SELECT benchmark, variant, count(*) * if(variant = 'PG-17.0', 2, 1) AS n,
               (sum(nopm) * if(variant = 'PG-17.0', 2, 1))::BIGINT AS nopm
        FROM ({_parsed(_RESULTS.format(_labelled(_run_log())))})
        WHERE variant IN ('PG-17.0', 'PG-17.1') GROUP BY benchmark, variant""",
    "throughput": _THROUGHPUT,
    "throughput_per_run": """
WITH R AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, min(ts) AS s FROM events GROUP BY 1),
W AS (SELECT run, s + INTERVAL 60 MINUTE AS opens, s + INTERVAL 2220 MINUTE AS closes FROM R)
SELECT run, count(ts) AS total_events, count(*) FILTER (event_type = 'purchase') AS order_events,
       count(ts) / 2160.0::DOUBLE AS tpm, count(*) FILTER (event_type = 'purchase') / 2160.0::DOUBLE AS nopm
FROM W LEFT JOIN events ON ts >= opens AND ts < closes GROUP BY run""",
}

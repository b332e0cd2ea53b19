"""The sequence of moves that evens out node counts, worked out on the table of
nodes alone.

The rule: while the fullest and the emptiest node differ by more than one, one
key goes from the fullest to the emptiest (ties: by name, then port). So the
count of a giving node walks down one level at a time and that of a receiving
node walks up, and no node does both. Move k takes the k-th step of all giving
nodes, ordered by (level falling, node), and pairs it with the k-th step of
all receiving nodes, ordered by (level rising, node).

Between two neighbouring counts the same nodes take turns, so there the steps
of a node are evenly spaced. A *leg* is such a piece of one node's walk: a few
numbers instead of one row per step. There are at most nodes x (distinct
counts) legs, whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# What is needed of all nodes (their distinct counts, the mean) are scalar
# subqueries, so no task gathers the nodes. Nodes on the same level take turns;
# `done` is what they have moved before they reach it.
_LEGS = """
WITH counted AS (
    SELECT nodename, nodeport, held,
           (SELECT array_sort(collect_set(held)) FROM {nodes}) AS counts,
           (SELECT sum(held) DIV count(*) FROM {nodes}) AS low,
           (SELECT (sum(held) + count(*) - 1) DIV count(*) FROM {nodes}) AS high
    FROM {nodes}),
walks AS (
    SELECT nodename, nodeport, held, held > low AS gives,
           IF(held > low, low, high) AS stop,
           IF(held > low, reverse(filter(counts, c -> c <= held AND c > low)),
                          filter(counts, c -> c >= held AND c < high)) AS met
    FROM counted),
pieces AS (
    SELECT nodename, nodeport, held, gives,
           inline(transform(met, (c, i) ->
               named_struct('level', c, 'until', coalesce(get(met, i + 1), stop))))
    FROM walks),
turns AS (
    SELECT nodename, nodeport, held, gives, level, until,
           row_number() OVER (PARTITION BY gives, level ORDER BY nodename, nodeport) AS nth,
           count(*) OVER (PARTITION BY gives, level) AS turn,
           sum(abs(held - level)) OVER (PARTITION BY gives, level) AS done
    FROM pieces)
SELECT nodename, nodeport, held, gives, level, CAST(nth - 1 AS BIGINT) AS place, turn,
       done + 1 AS first, done + abs(level - until) * turn AS last
FROM turns
"""

# `rounds` is a short array, one entry per level at which receiving nodes stand.
# Division rounds towards zero, hence the test `end >= move` before it.
_MATCHED = """
WITH giving AS (
    SELECT nodename, nodeport, level, turn, held - level + 1 AS pick, first + place AS move,
           last - turn + place + 1 AS end,
           (SELECT collect_list(named_struct('level', level, 'turn', turn,
                                             'first', first, 'last', last))
            FROM {legs} WHERE NOT gives AND place = 0) AS rounds
    FROM {legs} WHERE gives),
met AS (
    SELECT nodename, nodeport, level, turn, pick, move, end,
           explode(filter(rounds, r -> r.first <= end AND r.last >= move)) AS round
    FROM giving),
cut AS (
    SELECT nodename, nodeport, level, turn, pick, move, round,
           greatest(move, round.first) AS start, least(end, round.last, {max_move}) AS end
    FROM met),
picks AS (
    SELECT *, pick + (start - move + turn - 1) DIV turn AS pick_from,
           pick + (end - move) DIV turn AS pick_to
    FROM cut WHERE end >= move)
SELECT nodename, nodeport, level, turn, pick, move, pick_from, pick_to,
       round.level AS take_level, round.turn AS take_turn, round.first AS take_first
FROM picks
WHERE pick_from <= pick_to
  AND level - (pick_from - pick) - round.level
      - (move + (pick_from - pick) * turn - round.first) DIV round.turn > 1
"""


def legs(nodes: DataFrame) -> DataFrame:
    """Legs of all nodes, from ``nodes(nodename, nodeport, held)``:

    (nodename, nodeport, held, gives, level, place, turn, first, last) -- from
    ``level`` on, the moves ``first`` to ``last`` go round ``turn`` nodes, of
    which this one is number ``place`` (from 0).
    """
    return nodes.sparkSession.sql(_LEGS, nodes=nodes)


def matched_legs(walks: DataFrame, max_moves: int | None) -> DataFrame:
    """Giving legs cut where the receiving level changes, so that each meets one
    round of receiving nodes:

    (nodename, nodeport, level, turn, pick, move, pick_from, pick_to,
    take_level, take_turn, take_first) -- the node's pick number ``pick`` is
    move ``move``, the next one ``turn`` moves later; it holds for the picks
    ``pick_from`` to ``pick_to``. As counts only draw nearer, a leg is out when
    its first move already joins counts that are at most one apart.
    """
    limit = 2**63 - 1 if max_moves is None else max_moves
    return walks.sparkSession.sql(_MATCHED, legs=walks, max_move=limit)

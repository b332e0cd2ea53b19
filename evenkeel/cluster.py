"""The operators by table name, for a session that works with one cluster."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

from evenkeel.operators import placement, sizes
from evenkeel.operators.placement import Distribution
from evenkeel.plans.rebalance import Rebalanced, rebalance_evenly


@dataclass(frozen=True)
class Cluster:
    """Tables by name and the cluster's metadata frames (see
    ``operators.placement``; ``shard_stats`` as in ``operators.sizes``)."""

    tables: dict[str, DataFrame]
    distribution: DataFrame
    placements: DataFrame
    nodes: DataFrame
    shard_stats: DataFrame | None = None
    isolated: dict[int, DataFrame] | None = None
    """Keys with shards of their own (dist_value, shardid), by colocation id."""

    def _isolated(self, table: str, column: str) -> DataFrame | None:
        """The isolated keys that hold for a column: only the distribution column has any."""
        dist = placement.resolve_distribution(self.distribution, table)
        return (self.isolated or {}).get(dist.colocation_id) if column == dist.dist_column else None

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"unknown table {name}")
        return self.tables[name]

    def _by(self, table: str, column: str) -> Distribution:
        """The table's shards, keyed by any of its columns."""
        t, dist = self.table(table), placement.resolve_distribution(self.distribution, table)
        placement.key_type(t, column)
        return replace(dist, dist_column=column)

    def keys_per_shard(self, table: str, column: str) -> DataFrame:
        """Distinct values of a column per shard of the table."""
        by = self._by(table, column)
        return placement.keys_per_shard(
            self.table(table), by, self.placements, self.nodes, self._isolated(table, column)
        )

    def keys_per_node(self, table: str, column: str) -> DataFrame:
        """Distinct values of a column per node, added up over the shards."""
        by = self._by(table, column)
        return placement.keys_per_node(
            self.table(table), by, self.placements, self.nodes, self._isolated(table, column)
        )

    def shard_size(
        self, table: str | None = None, colocation_id: int = 1, include_shard_id: bool = True
    ) -> DataFrame:
        """Size report of a colocation group or of one of its tables."""
        if self.shard_stats is None:
            raise ValueError("the cluster has no shard_stats")
        if table is not None:
            placement.resolve_distribution(self.distribution, table)
        return sizes.shard_size(self.shard_stats, table, colocation_id, include_shard_id)

    def locate_key(self, table: str, column: str, value: Any) -> DataFrame:
        """Node and shard that own a key; the value is cast to the key's type
        when the table is known here, and the table is not read."""
        placement.resolve_distribution(self.distribution, table, column)
        known = self.tables.get(table)
        kind = None if known is None else placement.key_type(known, column)
        return placement.locate_key(
            self.distribution, self.placements, self.nodes, table, column, value, kind, self._isolated(table, column)
        )

    def rebalance_evenly(
        self,
        table: str,
        column: str | None = None,
        max_moves: int | None = None,
        analyze_at_end: bool = True,
        folder: str | None = None,
        **options: Any,
    ) -> Rebalanced:
        """Plan and apply an even spread of the table's keys over its nodes; ``options`` as in ``plans.rebalance``. ``after`` gives
        the cluster as it is then."""
        dist = placement.resolve_distribution(self.distribution, table)
        return rebalance_evenly(
            self.tables, self.distribution, self.placements, self.nodes, table, column,
            max_moves, analyze_at_end, folder, isolated=self._isolated(table, dist.dist_column), **options,
        )

    def after(self, done: Rebalanced) -> Cluster:
        """The cluster after a rebalance: its counts, lookups, sizes and next rebalance are those of the new placement.

        The sizes of the rebalanced group are known if ``widths`` were given; without them the group has none.
        """
        group, stats = done.dist.colocation_id, self.shard_stats
        if stats is not None:
            stats = stats.filter(stats["colocation_id"] != group)
            stats = stats if done.shard_stats is None else stats.unionByName(done.shard_stats)
        return replace(self, placements=done.placements, isolated={**(self.isolated or {}), group: done.isolated}, shard_stats=stats)

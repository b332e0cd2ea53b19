"""Plans made of several operators: evening out keys over nodes."""

from evenkeel.plans.layout import move_rows, read_layout, write_layout
from evenkeel.plans.levelling import apply_shard_moves, shard_moves
from evenkeel.plans.rebalance import (
    apply_plan,
    balance_report,
    balance_status,
    move_candidates,
    rebalance_evenly,
    rebalance_plan,
    relayout,
    size_report,
)

__all__ = [
    "apply_plan",
    "apply_shard_moves",
    "balance_report",
    "balance_status",
    "move_candidates",
    "move_rows",
    "read_layout",
    "rebalance_evenly",
    "rebalance_plan",
    "relayout",
    "shard_moves",
    "size_report",
    "write_layout",
]

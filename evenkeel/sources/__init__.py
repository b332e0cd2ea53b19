"""Readers of logs and inventories, and the shared folder for tables that
cut a plan in two."""

from evenkeel.sources.catalog import catalog_relations
from evenkeel.sources.files import file_relations, file_shard_stats
from evenkeel.sources.logs import read_logs
from evenkeel.sources.shared import materialise, scratch, shared_folder

__all__ = [
    "catalog_relations",
    "file_relations",
    "file_shard_stats",
    "materialise",
    "read_logs",
    "scratch",
    "shared_folder",
]

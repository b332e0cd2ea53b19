"""Column functions and their SQL names."""

from evenkeel.functions.scalar import key_text, quote_ident, shard_of, size_pretty, to_blocks
from evenkeel.functions.sql import register_functions

__all__ = ["key_text", "quote_ident", "register_functions", "shard_of", "size_pretty", "to_blocks"]

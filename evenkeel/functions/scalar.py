"""Column expressions used by the operators. All of them are built-in Spark
expressions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block size in bytes, and the units of a printed size.
BLOCK_BYTES = 8192
SIZE_UNITS = ["kB", "MB", "GB", "TB", "PB"]

MAX_SHARDS = 2**31 - 1
HASHES = 2**32


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_text(key: Column | str, key_type: str | None = None) -> Column:
    """The text by which a key is hashed and ordered. With its type given, instants count
    in microseconds whatever the session's time zone, and -0.0 is 0.0."""
    c = _col(key)
    if key_type == "timestamp":
        return F.unix_micros(c).cast("string")
    if key_type in ("double", "float"):
        c = c + F.lit(0.0).cast(key_type)
    return c.cast("string")


def hash_of(key: Column | str, key_type: str | None = None) -> Column:
    """Hash 0 .. 2 ** 32 - 1 of a key: the first 32 bits of the md5 of its text; NULL for a NULL key."""
    digest = F.md5(key_text(key, key_type))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def shard_of(key: Column | str, n_shards: int, key_type: str | None = None) -> Column:
    """Bucket 0 .. n_shards-1 of a key; NULL for a NULL key.

    The first 32 bits of the md5 of the key's text are cut into ``n_shards``
    equal ranges, so the same key gives the same bucket in any engine. ``key_type``
    (see ``key_text``) is needed for instants and floating-point keys.
    """
    if not 1 <= n_shards <= MAX_SHARDS:
        raise ValueError(f"n_shards must lie in 1..{MAX_SHARDS}, got {n_shards}")
    return F.shiftright(hash_of(key, key_type) * F.lit(n_shards).cast("long"), 32)


def to_blocks(size: Column | str) -> Column:
    """Bytes (>= 0) to blocks, rounded half up, in integer arithmetic."""
    half = F.lit(BLOCK_BYTES // 2).cast("long")
    return F.shiftright(_col(size).cast("long") + half, BLOCK_BYTES.bit_length() - 1)


def size_pretty(size: Column | str) -> Column:
    """Bytes (>= 0) as text: whole bytes below 10 kB, then the largest unit
    that keeps the number under 10240, rounded half up."""
    s = _col(size).cast("long")
    out = F.when(s < 10240, F.concat(s.cast("string"), F.lit(" bytes")))
    for i, unit in enumerate(SIZE_UNITS):
        halves = F.shiftright(s, 9 + 10 * i)  # in half units, so +1 >> 1 rounds
        text = F.concat(F.shiftright(halves + 1, 1).cast("string"), F.lit(f" {unit}"))
        last = i == len(SIZE_UNITS) - 1
        out = out.when(s.isNotNull() if last else halves < 20479, text)
    return out


def quote_ident(name: Column | str) -> Column:
    """Identifier in backticks, with inner backticks doubled."""
    return F.concat(F.lit("`"), F.replace(_col(name), F.lit("`"), F.lit("``")), F.lit("`"))

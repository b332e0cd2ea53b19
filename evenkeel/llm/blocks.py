"""Blocks of documents, and exchanges of packed hashes between blocks and buckets.

A block is a hash-dealt set of whole documents of some megabytes, which one
task holds in memory at a time. A block asks about hashes by sending each
bucket one row with all its hashes for it, packed, so that a hash that occurs
in a third of all documents is still one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, on average; a task needs about fifteen times as much.
BLOCK_BYTES = 6 << 20


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks for the texts of ``docs``, from one pass over their lengths."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return max(1, -(-(size or 0) // block_bytes))


def in_blocks(docs: DataFrame, n: int) -> DataFrame:
    """(block, doc_id, text): a row's block depends on its doc_id and text only."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """doc_id, whether it is set, and the bytes of each text, ordered by doc_id."""
    ids = table["doc_id"].to_numpy(zero_copy_only=False)
    known = ~np.asarray(table["doc_id"].is_null())
    ids = np.where(known, np.nan_to_num(ids) if ids.dtype.kind == "f" else ids, 0).astype(np.int64)
    if not known.all():  # a column with nulls would pass through floats
        ids = np.array([x or 0 for x in table["doc_id"].to_pylist()], np.int64)
    texts = [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]
    order = np.argsort(ids, kind="stable")
    return ids[order], known[order], [texts[i] for i in order]


def dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its keys in ascending order of key), for keys of 64 bits."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=n))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def dealt_in_order(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of each of ``n`` equal ranges of 64-bit values that sorted ``keys`` have members in."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=n))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(bucket[a]), a, b


def unpacked(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all packed rows together, and the row of each."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    rows = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    return np.concatenate(parts) if parts else np.zeros(0, kind), rows


def found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Position of each key in the sorted array ``among``, or -1."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)

"""Token ids in Simple-8b words: a file of pages that decode in whole arrays.

A 64-bit word holds a selector in its upper four bits and as many ids as fit in the
other sixty at the selector's width. An id beyond sixty bits follows an escape
word as it is. Ids are cut into blocks of ``BLOCK_IDS``; a page holds the blocks of
some whole documents with the word offset of each block, so blocks can be found and
decoded by themselves. A file is a Parquet folder with a row per page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import chunks, encoder

BLOCK_IDS = 256
#: Widths for which no wider one packs as many ids: selector i + 1 has WIDTHS[i].
WIDTHS = np.array([w for w in range(1, 61) if 60 // w > 60 // (w + 1)], np.int64)
COUNTS = 60 // WIDTHS
_ESCAPE = 15
_PAGE_BYTES = 2 << 20
PAGES = "part int, page int, first long, n_ids long, words binary, offsets binary, doc_ids array<long>, lengths array<long>"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids (unsigned 64-bit), and the first word of each block."""
    blocks = -(-len(ids) // BLOCK_IDS)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    room = int(COUNTS.max())
    grid = np.zeros((blocks, BLOCK_IDS + room), np.uint64)
    tail = len(ids) - (blocks - 1) * BLOCK_IDS
    grid[:-1, :BLOCK_IDS] = ids[: (blocks - 1) * BLOCK_IDS].reshape(-1, BLOCK_IDS)
    grid[-1, :tail] = ids[(blocks - 1) * BLOCK_IDS :]
    # A float of 53 bits holds 32 bits exactly, and its exponent is their number.
    bits = np.frexp((grid & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    if len(ids) and ids.max() >> np.uint64(32):
        high = np.frexp((grid >> np.uint64(32)).astype(np.float64))[1]
        bits = np.where(high > 0, high + 32, bits).astype(np.uint8)
    # The best selector at each id: widest count whose ids all fit.
    selector = np.where(bits[:, :BLOCK_IDS] <= 60, len(WIDTHS), _ESCAPE).astype(np.uint8)
    most, size = bits, 1
    for s in range(len(WIDTHS) - 2, -1, -1):
        count = int(COUNTS[s])
        while size < count:
            step = min(size, count - size)
            most = np.maximum(most[:, :-step], most[:, step:])
            size += step
        selector[most[:, :BLOCK_IDS] <= WIDTHS[s]] = s + 1
    taken = np.ones(16, np.int64)
    taken[1 : len(COUNTS) + 1] = COUNTS
    # All blocks step from word to word together.
    length = np.full(blocks, BLOCK_IDS)
    length[-1] = tail
    at, live, found = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        s = selector[live, at]
        found.append((live, at, s))
        at = at + taken[s]
        going = at < length[live]
        live, at = live[going], at[going]
    block, at, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, block))
    block, at, s = block[order], at[order], s[order].astype(np.int64)
    place = np.cumsum(np.where(s == _ESCAPE, 2, 1)) - np.where(s == _ESCAPE, 2, 1)
    words = np.zeros(int(place[-1]) + (2 if s[-1] == _ESCAPE else 1), np.uint64)
    words[place] = s.astype(np.uint64) << np.uint64(60)
    flat = block * (BLOCK_IDS + room) + at
    values = grid.ravel()
    for i, (width, count) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        which = np.flatnonzero(s == i + 1)
        for k in range(int(count) if len(which) else 0):
            words[place[which]] |= values[flat[which] + k] << np.uint64(width * k)
    raw = np.flatnonzero(s == _ESCAPE)
    words[place[raw] + 1] = values[flat[raw]]
    return words, place[np.flatnonzero(np.r_[True, np.diff(block) > 0])].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of :func:`encode`; of some blocks alone if their words and offsets are given."""
    s = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(s == _ESCAPE)
    if len(escapes):  # a raw word after an escape may look like one
        last = -2
        for e in escapes.tolist():
            if e != last + 1:
                raw[e + 1] = True
                last = e
        s[raw] = 0
    taken = np.zeros(16, np.int64)
    taken[1 : len(COUNTS) + 1] = COUNTS
    taken[_ESCAPE] = 1
    n = taken[s]
    # The last word of a block may have room for more ids than the block has.
    ends = np.cumsum(n)
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    before = np.concatenate([[0], ends])[offsets.astype(np.int64)]
    at = ends - n - before[block] + block * BLOCK_IDS
    out = np.zeros(len(offsets) * BLOCK_IDS + int(COUNTS.max()), np.uint64)
    order = np.argsort(s, kind="stable")
    cut = np.searchsorted(s[order], np.arange(17))
    for i in range(len(WIDTHS) - 1, -1, -1):
        which = order[cut[i + 1] : cut[i + 2]]
        mask = np.uint64((1 << int(WIDTHS[i])) - 1)
        for k in range(int(COUNTS[i]) if len(which) else 0):
            to = at[which] + k
            inside = to < (block[which] + 1) * BLOCK_IDS
            out[to[inside]] = (words[which[inside]] >> np.uint64(WIDTHS[i] * k)) & mask
    out[at[order[cut[_ESCAPE] : cut[_ESCAPE + 1]]]] = words[np.flatnonzero(raw)]
    return out[:n_ids]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 1, word_ends: bool = True) -> None:
    """Tokenise every text of ``docs`` and write its ids as a file at ``path``, in ascending doc_id order.

    A null or empty text is ``end`` alone. A null doc_id comes first; equal doc_ids are
    in the order of their texts' hashes. Other columns are not read. Partitions are
    ranges of doc_id, so any number of tasks write at once; only a document is
    never cut. A lost task writes its pages again.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, page, first = TaskContext.get().partitionId(), 0, 0
        encode_texts = encoder(tokenizer, word_ends).encode
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in chunks([len(t) for t in texts], _PAGE_BYTES):
                coded = encode_texts(texts[a:b], end)
                words, offsets = encode(np.frombuffer(b"".join(coded), "<u4").astype(np.uint64))
                n = [len(c) // 4 for c in coded]
                row = [part, page, first, sum(n), words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), ids[a:b], n]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PAGES.split(", ")])
                page, first = page + 1, first + sum(n)

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    held = held.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    held.mapInArrow(pages, PAGES).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a file: ``ids`` as little-endian unsigned 32-bit integers,
    ``start`` the number of ids of all documents before."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, offsets = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4")
                ids = decode(words, offsets, row["n_ids"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(ends), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first"], pa.int64()),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["part", "doc_id", "first", "ids"],
                )

    pages = spark.read.schema(PAGES).parquet(path)
    # One row per partition of the file, so the window is small.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = pages.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = pages.mapInArrow(documents, "part int, doc_id long, first long, ids binary")
    return rows.join(parts, "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "ids")


def digest(ids: DataFrame) -> DataFrame:
    """The contract's columns of :func:`read_ids`."""
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


"""Packing of documents into sequences of equal attention cost."""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, in_blocks, texts_of
from .tokens import chunks, encoder

#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention stays within a document).
LINEAR, QUADRATIC = 1024, 1
_CHUNK = 2 << 20
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of at most ``capacity`` tokens.

    Whole capacities of long documents are sequences of their own. The rest goes, longest
    first, to the sequence of lowest cost that has room, else to the one with the most room; a
    piece that fits nowhere is cut at the room of the lowest-cost sequence. There are as few sequences
    as the tokens allow.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest = []
    for doc, n in enumerate(lengths):
        whole = n // capacity * capacity
        out += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((n - whole, doc, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    count, base = -(-sum(x[0] for x in rest) // capacity), len(out)
    out += [[] for _ in range(count)]
    room, cost = [capacity] * count, [0] * count
    cheap = [(0, s) for s in range(count)]  # both heaps keep old entries until they come up
    roomy = [(-capacity, s) for s in range(count)]
    for n, doc, start in rest:
        while n:
            while cheap[0][0] != cost[cheap[0][1]] or not room[cheap[0][1]]:
                heapq.heappop(cheap)
            s = cheap[0][1]
            if room[s] < n:
                while -roomy[0][0] != room[roomy[0][1]]:
                    heapq.heappop(roomy)
                if room[roomy[0][1]] >= n:
                    s = roomy[0][1]
            take = min(n, room[s])
            out[base + s].append((doc, start, take))
            room[s] -= take
            cost[s] += LINEAR * take + QUADRATIC * take * take
            n, start = n - take, start + take
            heapq.heappush(cheap, (cost[s], s))
            heapq.heappush(roomy, (-room[s], s))
    return out


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, word_ends: bool = False, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: doc_id, start (its document's ids before it), length, ids_crc32,
    doc_tokens (with the end id), sequence_id, offset in the sequence and, unless ``with_ids`` is off, ids.

    Each task packs a block of documents of some megabytes, so at most one sequence's worth of room per block
    stays empty. A null or empty text is the end id alone. Rows without doc_id and rows with equal
    doc_ids are packed like others. Other columns are not read.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, known, texts = texts_of(table)
        encode, coded = encoder(tokenizer, word_ends).encode, []
        for a, b in chunks([len(t) for t in texts], _CHUNK):
            coded += encode(texts[a:b], end)
        lengths = [len(c) // 4 for c in coded]
        first = table["block"][0].as_py() << 32
        rows = []
        for s, pieces in enumerate(pack(lengths, capacity)):
            at = 0
            for doc, start, n in pieces:
                piece = coded[doc][4 * start : 4 * (start + n)]
                rows.append((int(ids[doc]) if known[doc] else None, start, n, zlib.crc32(piece), lengths[doc], first + s, at, piece if with_ids else None))
                at += n
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    pieces = in_blocks(docs, block_count(docs)).groupBy("block").applyInArrow(run, f"{_PIECES}, ids binary")
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequence_id, length, padded, ids): a sequence's length and the length it is padded to, which is
    ``capacity`` unless the length is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
    )
    power = F.pow(F.lit(2), F.round(F.log2("length"))).cast("long") == F.col("length")
    ids = F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return whole.select("sequence_id", "length", F.when(power, F.col("length")).otherwise(capacity).alias("padded"), ids.alias("ids"))

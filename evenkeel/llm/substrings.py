"""Substring dedup by Relative Lempel-Ziv parsing against earlier documents.

Every word window of the minimum factor length that may recur is indexed under
its hash; an index block (a bucket of hashes) knows the earliest document that
holds each window, and where. Every document is parsed greedily against all
index blocks: a match is extended word by word while its source goes on by one
word as well, also over windows that still earlier documents hold, as long as
the windows on both sides leave no word between them unchecked. Of the matches
that go on from a factor's end, the one that reaches furthest is the next
factor. The windows over each boundary are looked up as well, so a passage that
changes its source within a window is not lost.

Two rounds keep the index small. Each window has an anchor, the least hash of
the short word runs in it, so equal windows have equal anchors. A first round
finds anchors that occur in two documents; only windows with such an anchor are
indexed in the second.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, dealt, found, in_blocks, texts_of, unpacked
from .words import Words, lowest, windows

_RUN = 6
#: A place is 15 bits of a text's checksum, then the word's position: places that go on by one lie in one text.
_POSITION = 48
_SENT = "bucket long, block long, keys binary, more binary, first binary"
_BACK = "block long, kind int, bucket long, keys binary"
_SPANS = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long,ref:long,ref_start:long>>, kept string"


class _Parsed:
    """The windows of a block's documents."""

    def __init__(self, table: pa.Table, length: int) -> None:
        ids, known, texts = texts_of(table)
        sums = np.array([zlib.crc32(x) & 0x7FFF for x in texts], np.int64)
        order = np.lexsort((sums, ids))
        self.ids, self.known, self.texts, self.sums = ids[order], known[order], [texts[i] for i in order], sums[order]
        self.words = Words(self.texts)
        n = np.diff(self.words.first)
        self.doc = np.repeat(np.arange(len(n)), n)
        run = min(_RUN, length)
        anchor = lowest(windows(self.words.h1, run, 5), length - run + 1) if len(self.doc) >= length else np.zeros(0, np.uint64)
        inside = self.doc[: len(anchor)] == self.doc[len(self.doc) - len(anchor) :]
        self.at = np.flatnonzero(inside & self.known[self.doc[: len(anchor)]])
        self.anchor = anchor[self.at] >> np.uint64(1)
        self.of = self.doc[self.at]

    def place(self, at: np.ndarray) -> np.ndarray:
        """The places of windows by their first words."""
        doc = self.doc[at]
        return (self.sums[doc] << _POSITION) + at - self.words.first[doc]

    def wanted(self, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a shared anchor: index into ``at``, and two hashes."""
        pick = np.flatnonzero(found(self.anchor, shared) >= 0)
        at = self.at[pick]
        h1, h2 = (windows(h, length, by)[at] if len(at) else np.zeros(0, np.uint64) for h, by in ((self.words.h1, 3), (self.words.h2, 11)))
        return pick, h1, h2


def _distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash (stable), first of each distinct hash in it, and the number of the distinct hash at each place."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _planes(low: np.ndarray, place: np.ndarray) -> bytes:
    """Documents and places, byte by byte: high bytes are mostly equal and cost little in a compressed shuffle."""
    return np.stack([low, place], axis=1).astype("<i8").view(np.uint8).T.tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    """(document, place) rows of :func:`_planes`."""
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(16, -1).T).view("<i8")


def rlz_spans(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """Spans of every document that repeat earlier documents, and the text without them.

    Words are maximal runs without 0x20 and 0x09 to 0x0D. A window is
    ``min_words`` consecutive words of a document; all windows that also stand in a
    document with a smaller doc_id are found, and only those (up to collisions
    of 96-bit hashes).

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, spans (factors
    as word positions, end exclusive, with the earlier document and the position
    there; neighbours may overlap), kept (the other words joined by one space).
    The words of a factor stand in its source as they stand in the span, and
    the factors cover all words that go. A null or empty text has no words; a
    row without doc_id is neither a source nor parsed; rows with the same doc_id
    don't count as earlier than each other, and as a source each text stands by
    itself. Other columns are not read.
    """
    blocks = block_count(docs)
    held = in_blocks(docs, blocks)

    def anchors(table: pa.Table) -> pa.Table:
        p = _Parsed(table, min_words)
        new = np.ones(len(p.of), bool)
        new[1:] = (p.anchor[1:] != p.anchor[:-1]) | (p.of[1:] != p.of[:-1])
        key, of = p.anchor[new], p.ids[p.of[new]]
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        last = np.r_[first[1:], len(key)][: len(first)] - 1
        twice = (of[first] != of[last]).astype(np.uint64)
        packed = key[first] << np.uint64(1) | twice
        block = table["block"][0].as_py()
        rows = [(b, block, packed[i].tobytes(), None, None) for b, i in dealt(key[first], blocks)]
        return _table(rows, _SENT_ARROW)

    def shared(table: pa.Table) -> pa.Table:
        packed, row = unpacked(table["keys"], "<u8")
        key = packed >> np.uint64(1)
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = np.zeros(len(k), bool)
        same = k[1:] == k[:-1]
        again[1:] |= same
        again[:-1] |= same
        hit = np.zeros(len(k), bool)
        hit[order] = again
        hit |= (packed & np.uint64(1)).astype(bool)
        source = table["block"].to_pylist()
        cut = np.searchsorted(row, np.arange(len(source) + 1))
        rows = [(g, 0, None, key[a:b][hit[a:b]].tobytes()) for g, a, b in zip(source, cut[:-1], cut[1:], strict=True)]
        return _table([r for r in rows if r[3]], _BACK_ARROW)

    def index(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([], _SENT_ARROW)
        p = _Parsed(left, min_words)
        pick, h1, h2 = p.wanted(_anchors_of(right), min_words)
        order, first, _ = _distinct(h1, h2)
        h1, h2 = h1[order][first], h2[order][first]
        at = p.at[pick[order[first]]]  # documents are in order of doc_id, so the first is the least
        low, place = p.ids[p.doc[at]], p.place(at)
        block = left["block"][0].as_py()
        rows = [(b, block, h1[i].tobytes(), (h2[i] >> np.uint64(32)).astype("<u4").tobytes(), _planes(low[i], place[i])) for b, i in dealt(h1, blocks)]
        return _table(rows, _SENT_ARROW)

    def earliest(table: pa.Table) -> pa.Table:
        h1, row = unpacked(table["keys"], "<u8")
        h2 = unpacked(table["more"], "<u4")[0]
        held_at = np.concatenate([_from_planes(x) for x in table["first"].to_pylist()])
        order = np.lexsort((held_at[:, 1], held_at[:, 0], h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = np.empty_like(held_at)
        least[order] = held_at[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        source, bucket = table["block"].to_pylist(), table["bucket"].to_pylist()
        cut = np.searchsorted(row, np.arange(len(source) + 1))
        return _table([(g, 1, k, _planes(least[i:j, 0], least[i:j, 1])) for g, k, i, j in zip(source, bucket, cut[:-1], cut[1:], strict=True)], _BACK_ARROW)

    def parse(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([], _SPANS_ARROW)
        p = _Parsed(left, min_words)
        kind = right["kind"].to_numpy()
        pick, h1, h2 = p.wanted(_anchors_of(right.filter(pa.array(kind == 0))), min_words)
        order, first, number = _distinct(h1, h2)
        back = right.filter(pa.array(kind == 1))
        answer = dict(zip(back["bucket"].to_pylist(), back["keys"].to_pylist(), strict=True))
        least = np.empty((len(first), 2), np.int64)
        for b, i in dealt(h1[order][first], blocks):
            least[i] = _from_planes(answer[b])
        source = np.empty((len(pick), 2), np.int64)
        source[order] = least[number]
        earlier = source[:, 0] < p.ids[p.of[pick]]
        return _factors(p, p.at[pick][earlier], source[earlier], min_words)

    sent = held.groupBy("block").applyInArrow(anchors, _SENT)
    known = sent.groupBy("bucket").applyInArrow(shared, _BACK)
    asked = held.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(index, _SENT)
    least = asked.groupBy("bucket").applyInArrow(earliest, _BACK)
    return held.groupBy("block").cogroup(known.unionByName(least).groupBy("block")).applyInArrow(parse, _SPANS)


def _anchors_of(table: pa.Table) -> np.ndarray:
    return np.sort(unpacked(table["keys"], "<u8")[0])


def _matches(p: _Parsed, at: np.ndarray, source: np.ndarray, length: int) -> np.ndarray:
    """(start, end, source document, place there) of the longest stretches of words that stand in one source as they stand here,
    by start; none lies within another. Windows of one source in step are one stretch where they overlap or touch."""
    doc, ref, ahead = p.doc[at], source[:, 0], source[:, 1] - at
    order = np.lexsort((at, ahead, ref, doc))
    x, y, z, w = at[order], ref[order], ahead[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] > x[:-1] + length) | (y[1:] != y[:-1]) | (z[1:] != z[:-1]) | (w[1:] != w[:-1])
    begin = np.flatnonzero(new)
    end = x[np.r_[begin[1:], len(x)][: len(begin)] - 1] + length
    found = np.stack([x[begin], end, y[begin], z[begin] + x[begin]], axis=1)
    found = found[np.lexsort((found[:, 2], -found[:, 1], found[:, 0]))]
    reach = np.maximum.accumulate(found[:, 1]) if len(found) else found[:, 1]
    further = np.ones(len(found), bool)
    further[1:] = found[1:, 1] > reach[:-1]
    return found[further]


def _greedy(matches: list[list[int]]) -> list[list[int]]:
    """The factors: from the end of each, the match that goes on from there and reaches furthest."""
    factors = []
    for k, m in enumerate(matches):
        after = matches[k + 1] if k + 1 < len(matches) else None
        if factors and after and after[0] <= factors[-1][1]:
            continue
        factors.append(m)
    return factors


def _factors(p: _Parsed, at: np.ndarray, source: np.ndarray, length: int) -> pa.Table:
    """Spans of each document, and its other words."""
    first, matches = p.words.first, _matches(p, at, source, length)
    change = np.zeros(len(p.doc) + 1, np.int32)
    np.add.at(change, matches[:, 0], 1)
    np.add.at(change, matches[:, 1], -1)
    covered = np.cumsum(change[:-1]) > 0
    of = np.searchsorted(p.doc[matches[:, 0]], np.arange(len(p.ids) + 1))
    rows = []
    for i, text in enumerate(p.texts):
        a, b = int(first[i]), int(first[i + 1])
        spans = [{"start": x - a, "end": y - a, "ref": z, "ref_start": w & ((1 << _POSITION) - 1)} for x, y, z, w in _greedy(matches[of[i] : of[i + 1]].tolist())]
        words = text.split()
        gone = int(covered[a:b].sum())
        kept = b" ".join(compress(words, (~covered[a:b]).tolist()) if gone else words)
        rows.append((int(p.ids[i]) if p.known[i] else None, b - a, gone, spans, kept.decode()))
    return _table(rows, _SPANS_ARROW)


_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("first", pa.binary())])
_BACK_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary())])
_SPAN = pa.struct([(n, pa.int64()) for n in ("start", "end", "ref", "ref_start")])
_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of :func:`rlz_spans`."""
    return spans.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

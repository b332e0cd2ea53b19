"""Pages of numbered words: a few megabytes of whole texts with a dictionary of their own.

Texts are cut into words once. The pages are a table bucketed by page, so a later pass
joins them with answers for each page without moving the pages again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import scratch

from .blocks import block_count
from .tokens import chunks
from .words import Words

#: Bytes of text in a page, unless a single text is longer.
PAGE_BYTES = 4 << 20
#: Bytes of text that are cut into words at once.
_PIECE_BYTES = 1 << 20
_SCHEMA = "page long, part string, doc_ids binary, known binary, words binary, ids binary, n_words long"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = b" \t\n\v\f\r"


def _cut(texts: list[bytes], space: bytes, ends: bytes) -> tuple[pa.DictionaryArray | None, np.ndarray]:
    """The words of some texts in order, and how many of them stand before each 0."""
    buffer = b"\n".join(texts).translate(_LOWER) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    inside = np.ones(256, bool)
    inside[np.frombuffer(space + ends, np.uint8)] = False
    edge = np.flatnonzero(np.diff(inside[data].view(np.int8), prepend=0, append=0))
    stops = np.searchsorted(edge[::2], np.cumsum([len(t) + 1 for t in texts]))
    if ends:
        marked = np.isin(np.arange(256), np.frombuffer(ends, np.uint8))
        stops = np.unique(np.concatenate([stops, np.searchsorted(edge[::2], np.flatnonzero(marked[data]))]))
    if not len(edge):
        return None, stops
    # Words and what stands between them take turns, so that no byte is copied.
    runs = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(buffer)])
    coded = runs.dictionary_encode()
    return pa.DictionaryArray.from_arrays(pa.array(coded.indices.to_numpy()[::2]), coded.dictionary), stops


def numbered(texts: list[bytes], space: bytes = _SPACE, ends: bytes = b"") -> tuple[bytes, np.ndarray]:
    """The distinct words of some texts, A-Z lower-cased, joined by \\n, and the texts as word numbers from 1.

    ``space`` and ``ends`` separate words and hold \\n. A 0 stands after each text, and once between words with one
    of ``ends`` between them.
    """
    parts, stops, n = [], [], 0
    for a, b in chunks([len(t) for t in texts], _PIECE_BYTES):
        words, here = _cut(texts[a:b], space, ends)
        stops.append(here + n)
        if words is not None:
            parts.append(words)
            n += len(words)
    stops = np.concatenate(stops) if stops else np.zeros(0, np.int64)
    if not parts:
        return b"", np.zeros(len(stops), np.uint32)
    coded = pa.chunked_array(parts).unify_dictionaries()
    del parts
    number = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    dictionary = coded.chunk(coded.num_chunks - 1).dictionary
    del coded
    used = np.flatnonzero(np.bincount(number, minlength=len(dictionary)))
    place = np.zeros(len(dictionary), np.uint32)
    place[used] = np.arange(1, len(used) + 1)
    words = b"\n".join(dictionary.take(pa.array(used)).to_pylist())
    return words, np.insert(place[number], stops, np.uint32(0))


def hashes(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each word of a page's dictionary."""
    w = Words([words])
    return w.h1, w.h2


@contextmanager
def paged(docs: DataFrame, part: Column | None = None, space: bytes = _SPACE, ends: bytes = b"", page_bytes: int = PAGE_BYTES, folder: str | None = None) -> Iterator[tuple[DataFrame, str]]:
    """(pages, folder): ``docs`` as pages of texts with equal ``part``, and a folder for what is made of them.

    A page has page (its number), part, doc_ids (int64) and known (whether doc_id is set) of its texts, and
    words, ids as ``numbered`` gives them. A null text is empty. Both are gone at the end, so results have to be
    stored elsewhere before.
    """
    spark = docs.sparkSession
    part = F.lit(None) if part is None else part

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 32
        for batch in batches:
            parts = batch["part"].dictionary_encode(null_encoding="encode")
            of, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
            ids, texts = batch["doc_id"], batch["text"].cast(pa.binary())
            known, sizes = np.asarray(ids.is_valid()), pc.binary_length(texts).fill_null(0).to_numpy()
            ids = ids.fill_null(0).to_numpy()
            for p in range(len(names)):
                rows = np.flatnonzero(of == p)
                for a, b in chunks(sizes[rows].tolist(), page_bytes):
                    words, numbers = numbered([x or b"" for x in texts.take(pa.array(rows[a:b])).to_pylist()], space, ends)
                    row = [page, names[p], ids[rows[a:b]].tobytes(), known[rows[a:b]].tobytes(), words, numbers.tobytes(), int(np.count_nonzero(numbers))]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=_NAMES)
                    page += 1

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part.cast("string").alias("part"))
    name = f"pages_{uuid.uuid4().hex}"
    with scratch(spark, folder) as own:
        buckets = block_count(docs, 4 * page_bytes)
        written = named.mapInArrow(cut, _SCHEMA).write.format("parquet").bucketBy(buckets, "page").sortBy("page")
        try:
            written.option("path", f"{own}/pages").saveAsTable(name)
            yield spark.table(name), own
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]

"""Compression of vectors to one code per part, with distances looked up by value."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import materialise, scratch

#: Rows whose distances to all entries are held at once.
_ROWS = 4096
#: Components beyond this would pass 64 bits in the sums of a row.
_LARGEST = 1 << 26
_PAGE = "vec_ids binary, known binary, values binary, starts binary, codes binary, labels binary"


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    wide = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(vector.isNotNull() & fine, wide)


def cuts(width: int, parts: int) -> np.ndarray:
    """Where the parts of a vector begin, and its end: equal parts if ``width`` allows, else as near as can be."""
    return np.arange(parts + 1) * width // parts


class Dictionary:
    """The integers of some vectors, dimension by dimension: the distinct ones, and which of them each vector has."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> None:
        self.values, self.starts, self.codes = values, starts, codes

    @classmethod
    def of(cls, vectors: np.ndarray) -> Dictionary:
        """Build it from rows of integers."""
        columns = [np.unique(vectors[:, d], return_inverse=True) for d in range(vectors.shape[1])]
        most = max((len(v) for v, _ in columns), default=0)
        kind = np.uint8 if most <= 1 << 8 else np.uint16 if most <= 1 << 16 else np.uint32
        starts = np.cumsum([0, *(len(v) for v, _ in columns)])
        codes = np.array([c for _, c in columns], kind).reshape(vectors.shape[1], len(vectors))
        return cls(np.concatenate([v for v, _ in columns]) if columns else np.zeros(0, np.int64), starts, codes)

    def squares(self, book: np.ndarray) -> list[np.ndarray]:
        """Per dimension, the squared difference of every distinct value to every entry of ``book`` (entries x dimensions)."""
        spans = zip(self.starts[:-1], self.starts[1:], strict=True)
        return [(self.values[a:b, None] - book[None, :, d]) ** 2 for d, (a, b) in enumerate(spans)]

    def nearest(self, book: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, distance) of each row and part: the nearest entry, the lower index among equals.

        The distance of a part to an entry is added up from the tables of its dimensions.
        """
        tables, n = self.squares(book), self.codes.shape[1]
        code, error = np.zeros((n, len(bounds) - 1), np.int64), np.zeros((n, len(bounds) - 1), np.int64)
        for at in range(0, n, _ROWS):
            rows = slice(at, min(at + _ROWS, n))
            for part in range(len(bounds) - 1):
                total = np.zeros((rows.stop - at, len(book)), np.int64)
                for d in range(bounds[part], bounds[part + 1]):
                    total += tables[d][self.codes[d, rows]]
                code[rows, part] = total.argmin(axis=1)
                error[rows, part] = total.min(axis=1)
        return code, error

    def sums(self, code: np.ndarray, bounds: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """(count by part and entry, sum by entry and dimension) of the vectors with each code."""
        parts = len(bounds) - 1
        counts = np.array([np.bincount(code[:, p], minlength=entries) for p in range(parts)])
        total = np.zeros((entries, len(self.starts) - 1), np.int64)
        for p in range(parts):
            for d in range(bounds[p], bounds[p + 1]):
                values = self.values[self.starts[d] : self.starts[d + 1]]
                met = np.bincount(code[:, p] * len(values) + self.codes[d], minlength=entries * len(values))
                total[:, d] = met.reshape(entries, len(values)) @ values
        return counts, total


def _held(row: dict) -> Dictionary:
    starts = np.frombuffer(row["starts"], "<i8")
    width = len(starts) - 1
    raw = np.frombuffer(row["codes"], np.uint8)
    n = len(row["known"])
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // (width * n)] if width * n else np.uint8
    return Dictionary(np.frombuffer(row["values"], "<i8"), starts, raw.view(kind).reshape(width, n))


def pages(vectors: DataFrame, width: int) -> DataFrame:
    """Pages of some thousand vectors (vec_id, ints, label), each with the dictionaries of its dimensions.

    Every distinct label of a page is written once, in ``labels``, as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch["ints"].flatten().to_numpy(zero_copy_only=False)
            if len(flat) and np.abs(flat).max() > _LARGEST:
                raise ValueError(f"a component is beyond {_LARGEST} after scaling: squared distances would pass 64 bits")
            held = Dictionary.of(flat.reshape(batch.num_rows, width))
            ids = batch["vec_id"]
            row = [
                ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_valid()).tobytes(), held.values.astype("<i8").tobytes(),
                held.starts.astype("<i8").tobytes(), held.codes.tobytes(), _sealed(batch["label"]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=[c.split()[0] for c in _PAGE.split(", ")])

    return vectors.mapInArrow(run, _PAGE)


def _sealed(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], names=["label"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(raw: bytes) -> pa.Array:
    with pa.ipc.open_stream(raw) as held:
        return held.read_next_batch()["label"]


def _trained(held: DataFrame, book: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``book`` after a round: each entry the floored mean of the parts nearest to it. One row per task, part and entry is shuffled."""
    entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((len(bounds) - 1, entries), np.int64), np.zeros((entries, width), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                page = _held(row)
                c, t = page.sums(page.nearest(book, bounds)[0], bounds, entries)
                counts, total = counts + c, total + t
        for p in range(len(bounds) - 1):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p, used]),
                    pa.array(total[used, bounds[p] : bounds[p + 1]].tolist(), pa.list_(pa.int64())),
                ], names=["part", "entry", "n", "total"],
            )

    sums = held.mapInArrow(run, "part int, entry int, n long, total array<long>")
    each = sums.select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
    rows = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # entries x dimensions at most
    new = book.copy()
    for r in rows:
        new[r["entry"], bounds[r["part"]] + r["place"]] = r["x"] // r["n"]
    return new


def books_text(book: np.ndarray, bounds: np.ndarray) -> str:
    """All entries' integers by part, entry and position within the part, joined by commas."""
    return ",".join(str(x) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for x in book[:, a:b].ravel().tolist())


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, folder: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(codes, book): vec_id, label, code and error of each kept vector of (vec_id, embedding, label), and the codebooks.

    A component x becomes floor(``scale`` * x). A vector is cut into ``parts`` equal consecutive parts; the first ``entries`` vectors by
    vec_id (then by their integers, ids before none) are the first entries of each part. In each of ``rounds`` rounds every part goes
    to its nearest entry by squared distance, the lower index among equals, and an entry with parts becomes their floored mean.
    ``code`` has the index of each part in two hexadecimal digits (more above 256 entries), ``error`` the sum of squared distances.

    Vectors are kept as pages of value dictionaries; all distances are gathers from tables of (distinct value,
    entry) and additions. The driver holds the codebooks, ``entries`` vectors, and nothing that grows with the rows.

    Dropped: null vectors, those with null or non-finite components, and those whose length isn't that of the first kept
    vector. Rows with a null or repeated vec_id are coded like others; null labels and empty vectors (of which all parts are equal) as
    well. Lengths that ``parts`` doesn't divide are cut as evenly as can be. Fewer vectors than ``entries`` make smaller codebooks; an empty table
    gives no row. Components beyond 2 ** 26 after scaling raise an error. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("ints"), "label")
    kept = rows.where(F.col("ints").isNotNull())
    order = [F.asc_nulls_last("vec_id"), F.asc("ints")]
    seeds = [r["ints"] for r in kept.orderBy(*order).select("ints").limit(1).collect()]
    width = len(seeds[0]) if seeds else 0
    alike = kept.where(F.size("ints") == width)
    seeds = [r["ints"] for r in alike.orderBy(*order).select("ints").limit(entries).collect()]
    book, bounds = np.array(seeds, np.int64).reshape(len(seeds), width), cuts(width, parts)
    held = materialise(pages(alike, width), folder)
    for _ in range(rounds if len(book) else 0):
        book = _trained(held, book, bounds)
    digits = max(2, len(f"{max(len(book) - 1, 0):x}"))
    kind = vectors.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:0{digits}x}" for i in range(len(book))])
        for batch in batches:
            for row in batch.to_pylist():
                code, error = _held(row).nearest(book, bounds)
                ids, known = np.frombuffer(row["vec_ids"], "<i8"), np.frombuffer(row["known"], bool)
                text = ["".join(x) for x in names[code].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=~known), _opened(row["labels"]), pa.array(text, pa.string()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"]
                )

    coded = held.mapInArrow(run, f"vec_id long, label {kind.simpleString()}, code string, error long")
    return coded, book


def digest(vectors: DataFrame, parts: int = 16, folder: str | None = None) -> DataFrame:
    """``compressed`` with the error of each label's vectors, nulls together, and a checksum of the codebooks."""
    with scratch(vectors.sparkSession, folder) as own:
        coded, book = compressed(vectors, parts, folder=own)
        coded = materialise(coded, folder)
    by_label = materialise(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), folder)
    sha = hashlib.sha256(books_text(book, cuts(book.shape[1], parts)).encode()).hexdigest()
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))

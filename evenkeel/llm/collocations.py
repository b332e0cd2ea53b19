"""Phrases that stand together more often than their parts: candidates by mergeable summaries, counts exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.sources import materialise

from .blocks import found
from .pages import hashes, paged
from .words import mix, windows

#: What cuts a text into pieces, and what separates words within a piece.
_ENDS, _SPACE = b".,;:!?\n\v\f\r", b" \t"
#: Occurrences per hash partition, on average; a summary holds at most this many, divided by the threshold.
PARTITION_MASS = 2 << 20
_RANKED_PARTS = 64


class Summary:
    """A Misra-Gries summary of hashes: counters for at most ``capacity`` of them.

    A counter is at most ``lost`` below the true count, and a hash without a counter occurs at most ``lost`` times.
    Adding up m occurrences, in any order and through any merges, ``lost`` is at most m / (capacity + 1).
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Take in the counters of another summary, or exact counts."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        self.lost += lost
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:  # take the largest count that has no room from all
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            left = counts > cut
            keys, counts = keys[left], counts[left] - cut
            self.lost += cut
        self.keys, self.counts = keys, counts

    def possible(self, least: int) -> np.ndarray:
        """All hashes that can have occurred ``least`` times, if the capacity exceeds the mass divided by ``least``."""
        return self.keys[self.counts + self.lost >= least]


def _summarised(least: int):
    """Per hash partition: the n-grams that can be frequent among the counts of all pages, told to each page that holds them.

    The summary keeps the candidates; a second look at the same counts adds up theirs exactly. A page is told in bits, one for
    each n-gram that it asked about.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u4").astype(np.uint64) for x in table["keys"].to_pylist()]
        counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in table["counts"].to_pylist()]
        summary = Summary(sum(int(c.sum()) for c in counts) // least + 1)
        at = 0
        while at < len(keys):
            end, size = at, 0
            while end < len(keys) and (end == at or size + len(keys[end]) <= summary.capacity):
                size, end = size + len(keys[end]), end + 1
            summary.merge(np.concatenate(keys[at:end]), np.concatenate(counts[at:end]))
            at = end
        possible = summary.possible(least)
        exact = np.zeros(len(possible), np.int64)
        for k, c in zip(keys, counts, strict=True):
            place = found(k, possible)
            exact[place[place >= 0]] += c[place >= 0]  # no key twice in a row
        possible = possible[exact >= least]
        left = [found(k, possible) >= 0 for k in keys]
        told = [i for i, hit in enumerate(left) if hit.any()]
        return pa.table({
            "page": pa.array([table["page"][i].as_py() for i in told], pa.int64()),
            "bucket": pa.array([table["bucket"][i].as_py() for i in told], pa.int32()),
            "size": pa.array([table["size"][i].as_py() for i in told], pa.int32()),
            "hits": pa.array([np.packbits(left[i]).tobytes() for i in told], pa.binary()),
        })

    return run


class _Page:
    """The words of one page, and the hashes of its n-grams: 32 bits for the partition and 32 within it.

    A partition holds about as many occurrences at any size of the input, so few n-grams share a hash.
    """

    def __init__(self, row: dict, partitions: int) -> None:
        self.partitions = np.uint64(partitions)
        self.page, self.lang = row["page"], row["part"]
        self.ids = np.frombuffer(row["ids"], "<u4")
        self.words = row["words"]
        seed = np.frombuffer(self.lang.encode().ljust(8 * (len(self.lang.encode()) // 8 + 1), b"\0"), "<u8")
        salt = np.uint64(0)
        for x in seed:
            salt = mix(np.array([salt ^ x]))[0]
        h1, _ = hashes(self.words)
        self.h = np.concatenate([np.zeros(1, np.uint64), mix(h1 ^ salt)])
        self._line = self.h[self.ids]

    def keys(self, size: int) -> np.ndarray:
        """The hash of the n-gram that begins at each place."""
        h = windows(self._line, size, size)
        low = np.uint64(32)
        return (h >> low) * self.partitions + ((h & np.uint64(0xFFFFFFFF)) * self.partitions >> low)

    def inside(self, size: int) -> np.ndarray:
        """Whether the n-gram that begins at each place lies within a piece."""
        word = self.ids > 0
        n = max(len(word) - size + 1, 0)
        out = np.ones(n, bool)
        for i in range(size):
            out &= word[i : i + n]
        return out

    def candidates(self, size: int, held: dict[int, np.ndarray]) -> np.ndarray:
        """Whether the n-gram that begins at each place is one of ``held[size]``."""
        out = self.inside(size)
        at = np.flatnonzero(out)
        out[at] = found(self.keys(size)[at], held[size]) >= 0
        return out

    def asks(self, size: int, held: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the n-grams of ``size`` words, all of whose parts are candidates, in order, and their counts."""
        ok = self.inside(size)
        if size > 1:
            parts = self.candidates(size - 1, held)
            ok &= parts[:-1] & parts[1:]
        return np.unique(self.keys(size)[ok], return_counts=True)

    def hears(self, answers: list[dict]) -> dict[int, np.ndarray]:
        """By size, the hashes of the page's candidates that the partitions have answered about so far."""
        held: dict[int, np.ndarray] = {}
        for size in range(1, max((r["size"] for r in answers), default=0) + 1):
            keys, _ = self.asks(size, held)
            hit = np.zeros(len(keys), bool)
            bounds = dict(_by_partition(keys))
            for r in answers:
                if r["size"] == size:
                    span = bounds[r["bucket"]]
                    hit[span] = np.unpackbits(np.frombuffer(r["hits"], np.uint8), count=span.stop - span.start).astype(bool)
            held[size] = keys[hit]
        return held


def _by_partition(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(hash partition, its place) of ordered hashes."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(bucket[a]), slice(a, b)


_REQUEST = "bucket int, page long, size int, keys binary, counts binary"
_REQUEST_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _asked(pages: DataFrame, answers: DataFrame | None, size: int, partitions: int) -> DataFrame:
    """The counts of each page's n-grams that can be frequent as far as is known, one row per hash partition."""

    def ask(row: dict, answers: list[dict]) -> pa.Table:
        page = _Page(row, partitions)
        held = page.hears(answers)
        held.setdefault(size - 1, np.zeros(0, np.uint64))
        keys, counts = page.asks(size, held)
        short = keys.astype("<u4")
        rows = [(b, page.page, size, short[at].tobytes(), counts[at].astype("<u4").tobytes()) for b, at in _by_partition(keys)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_REQUEST_TYPES)
        return pa.table([pa.array(c, t) for c, t in zip(columns, _REQUEST_TYPES, strict=True)], names=[c.split()[0] for c in _REQUEST.split(", ")])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask(batch.slice(i, 1).to_pylist()[0], []).to_batches()

    def met(pages: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.concat_tables([ask(row, answers.to_pylist()) for row in pages.to_pylist()])

    if answers is None:
        return pages.mapInArrow(alone, _REQUEST)
    return pages.groupBy("page").cogroup(answers.groupBy("page")).applyInArrow(met, _REQUEST)


def _phrases(page: _Page, held: dict[int, np.ndarray], sizes: int) -> Iterator[pa.Table]:
    """(lang, size, phrase, n): the candidates of a page with their counts, told apart by their words."""
    words = pa.array([b"", *page.words.split(b"\n")] if page.words else [b""], pa.binary())
    number = page.ids.astype(np.int64)  # for n-grams of the size at hand: equal numbers, equal words
    for size in range(1, sizes + 1):
        n = max(len(page.ids) - size + 1, 0)
        if size > 1:
            pair = number[:n] * np.int64(len(words)) + page.ids[size - 1 : size - 1 + n]
        else:
            pair = number
        at = np.flatnonzero(page.candidates(size, held)) if size in held else np.zeros(0, np.int64)
        if size > 1:
            number = np.zeros(n, np.int64)
        _, first, same, counts = np.unique(pair[at], return_index=True, return_inverse=True, return_counts=True)
        if size > 1:
            number[at] = same + 1  # dense, so that the next pair stays within 64 bits
        first = at[first]
        texts = [words.take(pa.array(page.ids[first + i])) for i in range(size)]
        phrase = texts[0] if size == 1 else pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary()))
        yield pa.table({
            "lang": pa.array([page.lang] * len(first), pa.string()),
            "size": pa.array(np.full(len(first), size, np.int32)),
            "phrase": phrase.cast(pa.string()),
            "n": pa.array(counts.astype(np.int64)),
        })


def phrase_counts(docs: DataFrame, max_words: int = 3, least: int = 10, folder: str | None = None) -> DataFrame:
    """(lang, size, phrase, n), written: all phrases of 1 to ``max_words`` words that occur ``least`` times or more in
    their language, with their exact counts, and a row of size 0 with the number of all words of a language.

    Pages count their n-grams and send the counts to hash partitions. There a Misra-Gries
    summary, with more room than its mass divided by ``least``, keeps every n-gram that can be frequent, and
    tells each page which of its own those are. Longer n-grams are counted only where both parts are candidates.
    At the end the candidates are counted by their words, so a hash can let through a rare one but never add up two.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    with paged(docs, lang, _SPACE, _ENDS, folder=folder) as (pages, own):
        totals = pages.groupBy("part").agg(F.sum("n_words").alias("n"))
        mass = pages.agg(F.sum("n_words")).first()[0] or 0
        pages, answers = pages.select("page", "part", "words", "ids"), None
        partitions = max(1, -(-mass // PARTITION_MASS))
        for size in range(1, max_words + 1):
            asked = _asked(pages, answers, size, partitions)
            told = materialise(asked.groupBy("bucket").applyInArrow(_summarised(least), "page long, bucket int, size int, hits binary"), own)
            answers = told if answers is None else answers.unionByName(told)

        def counted(pages: pa.Table, answers: pa.Table) -> pa.Table:
            told, read = answers.to_pylist(), [_Page(row, partitions) for row in pages.to_pylist()]
            return pa.concat_tables([t for page in read for t in _phrases(page, page.hears(told), max_words)])

        rows = pages.groupBy("page").cogroup(answers.groupBy("page")).applyInArrow(counted, "lang string, size int, phrase string, n long")
        summed = rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        alls = totals.where("n > 0").select(F.col("part").alias("lang"), F.lit(0).alias("size"), F.lit("").alias("phrase"), "n")
        return materialise(summed.unionByName(alls), folder)


def _exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits, which hold it for counts up to 10 ** 16."""
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    return F.call_function("div", (wide[0] * wide[0]) * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, covered: int = 50, top: int = 2000, folder: str | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``max_words`` words of each language.

    Texts, A-Z lower-cased, are cut into pieces at ``.,;:!?`` and line breaks, and pieces into words at blanks and tabs. a
    is the phrase's count, n that of all words of the language. A cut after k words has the counts l and r of both sides and the
    score floor(1000000 * a * a / (l * r)); a phrase has that of its lowest cut, the first among equals. A phrase is dropped if a
    longer candidate that holds it has at least ``covered`` percent of its count. Ordered by score and a, falling, then phrase.

    A null text is empty, a null language is ``und``. Rows without doc_id and repeated rows count like others.
    Other columns are not read. An empty table gives no row.
    """
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    held = phrase_counts(docs, max_words, least, folder)
    phrases = held.where(F.col("size") > 0).select("lang", "size", "phrase", "n")
    longer = phrases.where(F.col("size") > 1).withColumn("w", F.split("phrase", " "))

    def cut(k: Column) -> Column:
        return F.struct(
            k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("w", k + 1, F.col("size") - k), " ").alias("tail")
        )

    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), F.inline(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    scored = cuts.select("lang", "phrase", "a", F.struct(_exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("cut").alias("cut"))

    def within(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.col("size") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))

    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), within)))
    holders = longer.where(F.col("size") > 2).select("lang", F.explode(parts).alias("phrase"), "n")
    holders = holders.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    kept = scored.join(holders, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.lit(100) * F.col("longest") < F.lit(covered) * F.col("a")))
    # First the best of each of some parts of a language, so that the last task of a language has few rows.
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(_RANKED_PARTS)))
    for by in (["lang", "_part"], ["lang"]):
        order = W.partitionBy(*by).orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
        kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = kept
    totals = held.where(F.col("size") == 0).select("lang", F.col("n").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )

"""N-gram Jaccard join by vertical partitioning.

All n-grams are put in one global order, from rare to frequent. A document's
set follows that order, so two documents that link share an n-gram in the first
part (prefix) of both sets. The order is cut into fragments; the overlap of a
pair is counted in each fragment by itself and summed per pair.

Equal sets are one class, which takes part with the text of its smallest doc_id, under a number of
its own: doc_ids may clash, since rows with one doc_id and other texts are other documents. A
class whose n-grams mostly occur nowhere else can't link; such classes are found
from a part of their n-grams first. Inside a group of near copies not all pairs are
needed to know the components: in rounds each class is tested against a hub with
which it shares prefix n-grams, and what remains between different components is
tested pair by pair at the end, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import materialise

from .blocks import block_count, dealt, found, in_blocks, unpacked
from .components import components
from .words import Words, mix, windows

#: Rounds of hubs before the rest is tested pair by pair; any number gives the same result.
_ROUNDS = 2
_CHUNK = 4 << 20
_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("id", pa.int64()), ("found", pa.binary())])
_SETS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary())])
_PART = pa.struct([("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])
_INDEX = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("skipped", pa.int64()), ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(_PART))])
_SUMS = "block long, doc_id long, text_sum long, n_shingles long, sum1 long, sum2 long"


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(_PART): "array<struct<fragment:int,grams:array<long>>>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, ordered by text and hash: the text's number, the hash.
    A text with fewer words is one n-gram."""
    w = Words(texts, lower=True)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(texts)), n)
    grams = windows(w.h1, size, 7)
    inside = np.flatnonzero(doc[: len(grams)] == doc[len(doc) - len(grams) :])
    short = np.flatnonzero((n > 0) & (n < size))
    whole = [int(windows(w.h1[w.first[i] : w.first[i + 1]], int(n[i]), 7 + 2 * int(n[i]))[0]) for i in short]
    of = np.concatenate([doc[inside], short])
    h = np.concatenate([grams[inside], np.array(whole, np.uint64)])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def _unshared(n: np.ndarray, percent: int) -> np.ndarray:
    """At most so many n-grams of a set of n can be missing in a set that it links with."""
    return n - -(-percent * n // 100)


def _sampled(n: np.ndarray, percent: int) -> np.ndarray:
    """So many n-grams of a set are looked at first."""
    return np.minimum(n, _unshared(n, percent) + 1 + n // 32)


def _by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(counts[order], first) if len(k) else counts[:0]


def _ask(block: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket with the block's distinct keys for it and how many documents have each."""
    k, c = _by_key(keys, np.ones(len(keys), np.uint32))
    return _table([(b, block, k[i].tobytes(), c[i].astype("<u4").tobytes()) for b, i in dealt(k, buckets)], _SENT)


def _answered(keys: np.ndarray, back: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the number of documents that have them, from the buckets' answers."""
    k = np.unique(keys)
    by = dict(zip(back["bucket"].to_pylist(), back["found"].to_pylist(), strict=True))
    out = np.zeros(len(k), np.uint32)
    for b, i in dealt(k, buckets):
        out[i] = np.frombuffer(by[b], "<u4")
    return k, out


def _count(table: pa.Table) -> pa.Table:
    """For every block of a bucket, in its order of keys: how many documents of all blocks have the key."""
    keys, row = unpacked(table["keys"], "<u8")
    counts, _ = unpacked(table["counts"], "<u4")
    k, total = _by_key(keys, counts)
    total = total[found(keys, k)].astype("<u4")
    block, bucket = table["block"].to_pylist(), table["bucket"].to_pylist()
    cut = np.searchsorted(row, np.arange(len(block) + 1))
    return _table([(g, b, None, total[i:j].tobytes()) for g, b, i, j in zip(block, bucket, cut[:-1], cut[1:], strict=True)], _BACK)


class _Block:
    """The sets of a block's classes."""

    def __init__(self, left: pa.Table, right: pa.Table, size: int, percent: int) -> None:
        keys = zip(right["doc_id"].to_pylist(), right["text_sum"].to_pylist(), strict=True)
        named = dict(zip(keys, right["id"].to_pylist(), strict=True))
        held = zip(left["doc_id"].to_pylist(), left["text_sum"].to_pylist(), strict=True)
        rows = {named[key]: i for i, key in enumerate(held) if key in named}  # repeated rows are one
        self.ids = np.array(sorted(rows), np.int64)
        mine = left["text"].take(pa.array([rows[i] for i in self.ids.tolist()], pa.int64())).cast(pa.binary()).to_pylist()
        self.of, self.grams = _sets([x or b"" for x in mine], size)
        self.n = np.bincount(self.of, minlength=len(mine))
        rank = np.arange(len(self.of)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.early = rank < _sampled(self.n, percent)[self.of]


def _class_sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            lengths = np.cumsum([0, *(x or 0 for x in batch.column("bytes").to_pylist())])
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(lengths, lengths[at] + _CHUNK, "right")) - 1)
                part = batch.slice(at, end - at)
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                of, h = _sets(texts, size)
                n = np.bincount(of, minlength=len(texts))
                sums = []
                for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D))):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                    ends = np.cumsum(n)
                    sums.append((total[ends] - total[ends - n]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("block", "doc_id", "text_sum")), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                    names=["block", "doc_id", "text_sum", "n_shingles", "sum1", "sum2"],
                )
                at = end

    return run


def _index(held: DataFrame, reps: DataFrame, blocks: int, size: int, percent: int) -> DataFrame:
    """For every class that can link: its size, the place of its first n-gram that others have,
    the n-grams of its prefix and its fragments."""

    def sample(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([], _SENT)
        b = _Block(left, right, size, percent)
        return _ask(left["block"][0].as_py(), b.grams[b.early], blocks)

    def surviving(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([], _SETS)
        b = _Block(left, right.filter(right["id"].is_valid()), size, percent)
        k, total = _answered(b.grams[b.early], right.filter(right["bucket"].is_valid()), blocks)
        shared = np.bincount(b.of[b.early], total[found(b.grams[b.early], k)] > 1, len(b.ids))
        stays = shared >= np.minimum(_sampled(b.n, percent), b.n) - _unshared(b.n, percent)
        return _table([(left["block"][0].as_py(), b.ids[stays].tobytes(), b.n[stays].astype("<i8").tobytes(), b.grams[stays[b.of]].tobytes())], _SETS)

    def all_grams(table: pa.Table) -> pa.Table:
        return _ask(table["block"][0].as_py(), unpacked(table["grams"], "<u8")[0], blocks)

    def ordered(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([], _INDEX)
        ids, n, grams = (unpacked(left[c], t)[0] for c, t in (("ids", "<i8"), ("sizes", "<i8"), ("grams", "<u8")))
        k, total = _answered(grams, right, blocks)
        of, df = np.repeat(np.arange(len(ids)), n), total[found(grams, k)]
        often = df > 1
        of, df, grams = of[often], df[often], grams[often]
        order = np.lexsort((grams, df, of))
        of, df, grams = of[order], df[order], grams[order].view(np.int64)
        fragment = np.log2(df).astype(np.int32)  # the order is cut at the powers of two of the frequency
        cut = np.searchsorted(of, np.arange(len(ids) + 1))
        rows = []
        for i, (a, b, u) in enumerate(zip(cut[:-1], cut[1:], _unshared(n, percent), strict=True)):
            alone = int(n[i] - (b - a))
            if alone > u:
                continue
            f = fragment[a:b]
            ends = np.r_[np.flatnonzero(np.diff(f)) + 1, b - a]
            parts = [{"fragment": int(f[y - 1]), "grams": grams[a + x : a + y]} for x, y in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            rows.append((int(ids[i]), int(n[i]), alone, grams[a : a + int(u) + 1 - alone], parts))
        return _table(rows, _INDEX)

    named = reps.select("block", "id", "doc_id", "text_sum")
    text, by_block = held.groupBy("block"), named.groupBy("block")
    asked = text.cogroup(by_block).applyInArrow(sample, _ddl(_SENT))
    seen = asked.groupBy("bucket").applyInArrow(_count, _ddl(_BACK))
    sets = text.cogroup(named.unionByName(seen.withColumnRenamed("id", "unused"), allowMissingColumns=True).groupBy("block")).applyInArrow(surviving, _ddl(_SETS)).groupBy("block")
    counted = sets.applyInArrow(all_grams, _ddl(_SENT)).groupBy("bucket").applyInArrow(_count, _ddl(_BACK))
    return sets.cogroup(counted.groupBy("block")).applyInArrow(ordered, _ddl(_INDEX))


def _may_link(percent: int, n: Column, at: Column, m: Column, m_at: Column) -> Column:
    """Whether sets of n and m with a common n-gram at these places, and none before, can overlap enough."""
    return (100 + percent) * F.least(n - at, m - m_at) >= percent * (n + m)


def _overlaps(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps by fragment, summed per pair."""
    b = parts.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    a = parts.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    common = pairs.join(b, "b").join(a, ["a", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    total = common.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return total.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def _links(index: DataFrame, percent: int) -> DataFrame:
    """Links between classes that connect what any links would connect."""
    places = index.select("id", "n", "skipped", F.posexplode("prefix").alias("at", "gram")).select("gram", "id", "n", (F.col("at") + F.col("skipped")).alias("at"))
    parts = index.select("id", F.explode("parts").alias("part")).select("id", "part.fragment", "part.grams")
    links = None
    for round_ in range(_ROUNDS + 1):
        live = places.withColumn("label", F.col("id"))
        if links is not None:
            labels = components(links).withColumnRenamed("label", "known")
            live = places.join(labels, "id", "left").select("gram", "id", "n", "at", F.coalesce("known", "id").alias("label"))
        mixed = live.groupBy("gram").agg(
            F.min("label").alias("low"), F.max("label").alias("high"),
            F.min_by(F.struct("id", "n", "at", "label"), F.xxhash64("label", F.lit(round_)) if round_ else F.col("id")).alias("hub"),
        ).where("low <> high")
        if round_ < _ROUNDS:
            shared = live.join(mixed.select("gram", "hub"), "gram").where(F.col("label") != F.col("hub.label"))
            shared = shared.where(_may_link(percent, F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at")))
            votes = shared.groupBy("id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")).count()
            best = votes.groupBy("id", "n").agg(F.max_by(F.struct("hub", "hub_n"), F.struct("count", -F.col("hub"))).alias("best"))
            pairs = best.select(F.col("best.hub").alias("a"), F.col("id").alias("b"), F.col("best.hub_n").alias("n_a"), F.col("n").alias("n_b"))
        else:
            rest = live.join(mixed.select("gram"), "gram", "left_semi")
            x, y = (rest.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "at", "label"))) for s in ("a", "b"))
            both = x.join(y, "gram").where((F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b")))
            both = both.where(_may_link(percent, F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")))
            pairs = both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b").distinct()
        new = _overlaps(pairs, parts, percent)
        links = materialise(new if links is None else links.unionByName(new))
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Component of every document under links of Jaccard similarity ``percent`` / 100 or more.

    Words are maximal runs without 0x20 and 0x09 to 0x0D, with A to Z in lower
    case. A document's set holds its distinct ``words``-word shingles; a shorter
    text is one shingle; a null text or one without words has an empty set and links
    with nothing. Shingles are compared by 64-bit hashes.

    Returns one row per row of ``docs``: doc_id, n_shingles, class_id (smallest doc_id with
    the same set), component_id (smallest doc_id reached by links). A row without doc_id
    links with nothing and has null for both; rows with the same doc_id and text are alike, rows
    with the same doc_id and other texts are documents of their own.
    Other columns are not read.
    """
    return _grouped(docs, words, percent).select("doc_id", "n_shingles", "class_id", "component_id")


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of :func:`near_duplicates` with text_sum and with component_sum, the least text_sum under the component's doc_id."""
    blocks = block_count(docs)
    held = in_blocks(docs, blocks).withColumn("text_sum", F.xxhash64("text"))
    sums = materialise(held.select("*", F.octet_length("text").alias("bytes")).mapInArrow(_class_sums(words), _SUMS))
    key = ["n_shingles", "sum1", "sum2"]
    in_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = sums.where(in_class).groupBy(*key).agg(F.min(F.struct("doc_id", "text_sum", "block")).alias("least"))
    # Numbers in order of doc_id, so the first hubs are the earliest documents; fixed by writing them.
    classes = classes.select(*key, "least.*").repartitionByRange("doc_id", "text_sum").sortWithinPartitions("doc_id", "text_sum")
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()))
    index = materialise(_index(held.where("doc_id IS NOT NULL"), classes, blocks, words, percent))
    labels = components(_links(index, percent))
    # The component's first document, of its classes' first ones; classes without a link are alone.
    linked = classes.join(labels, "id").select("id", "label", F.struct("doc_id", "text_sum").alias("least"))
    first = materialise(linked.groupBy("label").agg(F.min("least").alias("first")))
    first = labels.join(first, "label").select("id", "first")
    named = classes.join(first, "id", "left").select(*key, F.col("doc_id").alias("class_id"), F.coalesce("first", F.struct("doc_id", "text_sum")).alias("first"))
    # Rows without a set meet no class; the others meet one, however many copies it has.
    met = sums.where(in_class).select("doc_id", "text_sum", *key).join(named, key)
    met = met.select("doc_id", "text_sum", "n_shingles", "class_id", F.col("first.doc_id").alias("component_id"), F.col("first.text_sum").alias("component_sum"))
    own = [F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.col("text_sum").alias("component_sum")]
    return met.unionByName(sums.where(~in_class).select("doc_id", "text_sum", "n_shingles", *own))


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, of each component the one with the smallest doc_id.

    Of several texts under that doc_id the one with the least hash stays, and of rows that repeat it the one with
    the least hash of all columns (but maps). Rows without doc_id stay; a document
    without words is a group of its own.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    held = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("sum"), F.xxhash64(*hashed).alias("all"))
    groups = _grouped(docs, words, percent)
    gone = groups.where("doc_id <> component_id OR text_sum <> component_sum").select(F.col("doc_id").alias("gone"), F.col("text_sum").alias("gone_sum")).distinct()
    left = held.join(gone, (F.col("id") == F.col("gone")) & (F.col("sum") == F.col("gone_sum")), "left_anti")
    many = materialise(left.where("id IS NOT NULL").groupBy("id", "sum").count().where("count > 1").select(F.col("id").alias("many"), F.col("sum").alias("many_sum")))
    same = (F.col("id") == F.col("many")) & (F.col("sum") == F.col("many_sum"))
    folded = left.join(many, same, "left_semi").groupBy("id", "sum").agg(F.min_by("doc", "all").alias("doc"))
    return left.join(many, same, "left_anti").select("doc.*").unionByName(folded.select("doc.*"))

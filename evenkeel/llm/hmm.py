"""A hidden Markov language model, trained by Baum-Welch over pages of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import materialise

from .blocks import dealt_in_order
from .pages import hashes, paged
from .words import mix

#: Tokens per hash partition of the words, on average.
PARTITION_TOKENS = 2 << 20
_PAGE_BYTES = 8 << 20
#: The end of a text among the words: no hash of a word.
_END = (np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1))
#: At first, how much likelier a word is in one state than in another at most, and the chance to stay in a state.
_SPREAD, _STAY = 8.0, 0.97
#: What an unseen transition, a first state and a state's rare words count in advance, and a share of no occurrence, in 255ths.
_ONCE, _RARE, _LEAST_SHARE = 1.0, 10.0, 0.25


@dataclass(frozen=True)
class Model:
    """What every task is told: a few numbers per state. What is known of words stays in hash partitions.

    A word with ``least`` training occurrences or more has a share of its occurrences in each state, kept in 255ths. A state
    emits it with (1 - rare) * c * share / mass; all other words, unseen ones together as one, with rare * (c + 1) / rest.
    """

    start: np.ndarray
    step: np.ndarray
    rare: np.ndarray
    mass: np.ndarray
    tokens: float
    words: float
    rest: float

    def emissions(self, c: np.ndarray, frequent: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """The chance of each word (by its count) in each state; ``shares`` has the rows of frequent words."""
        out = np.outer((c + 1) / self.rest, self.rare)
        even = shares + _LEAST_SHARE
        even /= even.sum(axis=1, keepdims=True)
        out[frequent] = c[frequent, None] * even * ((1 - self.rare) / np.maximum(self.mass, 1e-300))
        return out


def first_emissions(h: np.ndarray, states: int) -> np.ndarray:
    """Where training begins: per word and state, a factor between 1 and ``_SPREAD`` that follows from the word's hash."""
    draws = np.stack([(mix(h + np.uint64(1000 * s)) >> np.uint64(40)).astype(float) / (1 << 24) for s in range(states)], axis=1)
    return _SPREAD**draws


class Steps:
    """The texts of a page in step with each other, longest first: place t of all texts longer than t stands together."""

    def __init__(self, ids: np.ndarray) -> None:
        ends = np.flatnonzero(ids == 0)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.lengths = ends - starts + 1
        self.order = np.argsort(-self.lengths, kind="stable")
        falling = self.lengths[self.order]
        steps = np.arange(falling[0] if len(falling) else 0)
        self.width = np.searchsorted(-falling, -steps, side="left")
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        place = starts[self.order][np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.width)]
        place += np.repeat(steps, self.width)
        self.tokens = ids[place]
        self.width, self.at = self.width.tolist(), self.at.tolist()

    def likelihoods(self, start: np.ndarray, step: np.ndarray, emissions: np.ndarray) -> np.ndarray:
        """log10 of each text's probability, by the forward recursion, scaled to 1 at each step."""
        out, x = np.zeros(len(self.lengths)), None
        for t, n in enumerate(self.width):
            met = emissions[self.tokens[self.at[t] : self.at[t + 1]]]
            x = met * start if x is None else (x[:n] @ step) * met
            scale = x.sum(axis=1)
            out[:n] += np.log10(scale)
            x /= scale[:, None]
        back = np.empty(len(out))
        back[self.order] = out
        return back

    def expected(self, start: np.ndarray, step: np.ndarray, emissions: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(of words, of steps, of first states): how often they are met in each state, expected over all paths."""
        emissions, start, step = emissions.astype(np.float32), start.astype(np.float32), step.astype(np.float32)
        states = len(start)
        seen, at, width = emissions[self.tokens], self.at, self.width
        moves = np.zeros((states, states))
        if not width:
            return np.zeros((words, states)), moves, np.zeros(states)
        scale = np.empty(len(seen), np.float32)
        x = None
        for t, n in enumerate(width):  # forward, in place
            here = seen[at[t] : at[t + 1]]
            here *= start if x is None else x[:n] @ step
            total = here.sum(axis=1)
            scale[at[t] : at[t + 1]] = total
            here /= total[:, None]
            x = here
        back, turned = np.ones((width[-1], states), np.float32), np.ascontiguousarray(step.T)
        for t in range(len(width) - 1, 0, -1):  # backward: what is left is the share of each state
            n = width[t]
            here = seen[at[t] : at[t + 1]]
            ahead = emissions[self.tokens[at[t] : at[t + 1]]] * back
            ahead /= scale[at[t] : at[t + 1], None]
            moves += seen[at[t - 1] : at[t - 1] + n].T @ ahead
            here *= back
            back = np.ones((width[t - 1], states), np.float32)
            back[:n] = ahead @ turned
        seen[: width[0]] *= back
        counts = np.stack([np.bincount(self.tokens, weights=seen[:, s], minlength=words) for s in range(states)], axis=1)
        return counts, moves * step, seen[: width[0]].sum(axis=0, dtype=float)


class _Page:
    """A page and its dictionary (number 0 is the end of a text), in the order of the words' hashes."""

    def __init__(self, row: dict) -> None:
        self.row, self.page, self.trains = row, row["page"], row["part"] == "true"
        self.ids = np.frombuffer(row["ids"], "<u4")
        h1, h2 = hashes(row["words"])
        self.h1, self.h2 = np.concatenate([[_END[0]], h1]), np.concatenate([[_END[1]], h2])
        self.order = np.argsort(self.h1)

    def dealt(self, partitions: int) -> Iterator[tuple[int, np.ndarray]]:
        """(hash partition, its words)."""
        for bucket, a, b in dealt_in_order(self.h1[self.order], partitions):
            yield bucket, self.order[a:b]


def _rows(pages: pa.Table) -> Iterator[dict]:
    for i in range(pages.num_rows):
        yield from pages.slice(i, 1).to_pylist()


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


_PAGE = ("page", "part", "doc_ids", "known", "words", "ids")
_ASKED = {"bucket": pa.int32(), "page": pa.int64(), "h1": pa.binary(), "h2": pa.binary(), "c": pa.binary()}
_TOLD = {"page": pa.int64(), "bucket": pa.int32(), "c": pa.binary(), "place": pa.binary(), "shares": pa.binary(), "sums": pa.list_(pa.float64())}
_SENT = {"bucket": pa.int32(), "page": pa.int64(), "c": pa.binary(), "place": pa.binary(), "counts": pa.binary(), "sums": pa.list_(pa.float64())}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.float64()): "array<double>"}


def _schema(types: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in types.items())


def _asks(partitions: int):
    """A page's words and how often each occurs in training texts, one row per hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(pa.Table.from_batches([batch])):
                page = _Page(row)
                c = np.bincount(page.ids, minlength=len(page.h1)) * page.trains
                rows = [(b, page.page, page.h1[w].tobytes(), page.h2[w].astype("<u4").tobytes(), c[w].astype("<u4").tobytes()) for b, w in page.dealt(partitions)]
                yield from _table(rows, _ASKED).to_batches()

    return run


def _counted(least: int):
    """In a hash partition: each word's count and, if it is frequent, its place, told to the pages that hold it.

    A row without page holds the counts of the frequent words, and the sums (tokens, words, those of them frequent).
    """

    def run(table: pa.Table) -> pa.Table:
        h1, h2, c = ([np.frombuffer(x, kind) for x in table[name].to_pylist()] for name, kind in (("h1", "<u8"), ("h2", "<u4"), ("c", "<u4")))
        sizes = [len(x) for x in h1]
        keys, more, counts = np.concatenate(h1), np.concatenate(h2), np.concatenate(c).astype(np.int64)
        order = np.lexsort((more, keys))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        word = np.empty(len(keys), np.int64)
        word[order] = np.cumsum(new) - 1
        total = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(keys) else counts
        frequent = total >= least
        place = np.where(frequent, np.cumsum(frequent) - 1, -1).astype("<i4")
        stops = np.cumsum([0, *sizes])
        bucket = table["bucket"][0].as_py()
        rows = []
        for i, page in enumerate(table["page"].to_pylist()):
            mine = word[stops[i] : stops[i + 1]]
            rows.append((page, bucket, total[mine].astype("<i8").tobytes(), place[mine].tobytes(), None, None))
        sums = [float(x) for x in (total.sum(), (total > 0).sum(), total[frequent].sum(), frequent.sum())]
        rows.append((None, bucket, total[frequent].astype("<i8").tobytes(), None, None, sums))
        return _table(rows, _TOLD)

    return run


class _Told:
    """What the hash partitions know of a page's words: count, place among frequent ones, shares of the states."""

    def __init__(self, page: _Page, answers: pa.Table, partitions: int, states: int) -> None:
        n = len(page.h1)
        self.c, self.place, self.shares = np.zeros(n, np.int64), np.full(n, -1, np.int32), np.zeros((n, states))
        words, shares = {}, {}
        for row in answers.to_pylist():
            if row["shares"] is None:
                words[row["bucket"]] = row
            else:
                shares[row["bucket"]] = row["shares"]
        self.parts = []
        for bucket, w in page.dealt(partitions):
            self.c[w] = np.frombuffer(words[bucket]["c"], "<i8")
            self.place[w] = np.frombuffer(words[bucket]["place"], "<i4")
            frequent = w[self.place[w] >= 0]
            self.parts.append((bucket, frequent))
            if shares:
                self.shares[frequent] = np.frombuffer(shares[bucket], np.uint8).reshape(-1, states)

    def emissions(self, model: Model) -> np.ndarray:
        frequent = self.place >= 0
        return model.emissions(self.c, frequent, self.shares[frequent])


def _short(x: np.ndarray) -> bytes:
    """Counts as 32-bit floats cut to their upper 16 bits, rounded."""
    return ((x.astype("<f4").view("<u4") + np.uint32(0x8000)) >> np.uint32(16)).astype("<u2").tobytes()


def _long(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, "<u2").astype("<u4") << np.uint32(16)).view("<f4").astype(float)


def _expects(model: Model | None, partitions: int, states: int):
    """A page's expected counts, one row per hash partition; pages that don't train only name their frequent words."""

    def run(pages: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in _rows(pages):
            page = _Page(row)
            told = _Told(page, answers, partitions, states)
            counts = None
            if page.trains:
                if model is None:
                    start, step, met = *_first(states), first_emissions(page.h1, states)
                else:
                    start, step, met = model.start, model.step, told.emissions(model)
                counts, moves, begun = Steps(page.ids).expected(start, step, met, len(page.h1))
                sums = [*moves.ravel().tolist(), *begun.tolist(), *counts[told.place < 0].sum(axis=0).tolist()]
                rows.append((page.page % partitions, page.page, None, b"", b"", sums))
            for bucket, w in told.parts:
                rows.append((bucket, page.page, None, told.place[w].tobytes(), b"" if counts is None else _short(counts[w]), None))
        return _table(rows, _SENT)

    return run


def _first(states: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full((states, states), (1 - _STAY) / max(states - 1, 1))
    np.fill_diagonal(step, _STAY if states > 1 else 1)
    return np.full(states, 1 / states), step


def _shared(states: int):
    """In a hash partition: the shares of its frequent words, told to the pages that hold them.

    A row without page has sums: those of the pages, and of all frequent words by state.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["c"], "<i8") for r in rows if r["c"] is not None)])
        total, sums = np.zeros((len(c), states)), np.zeros(states * states + 2 * states)
        for r in rows:
            if r["counts"]:
                place = np.frombuffer(r["place"], "<i4")  # no place twice in a row
                total[place] += _long(r["counts"]).reshape(-1, states)
            if r["sums"] is not None:
                sums += r["sums"]
        whole = total.sum(axis=1, keepdims=True)
        shares = np.rint(255 * total / np.where(whole > 0, whole, 1)).astype(np.uint8)
        even = shares + _LEAST_SHARE
        mass = (c[:, None] * (even / even.sum(axis=1, keepdims=True))).sum(axis=0)
        out = [(r["page"], bucket, None, None, shares[np.frombuffer(r["place"], "<i4")].tobytes(), None) for r in rows if r["page"] is not None and r["sums"] is None]
        out.append((None, bucket, None, None, None, [*sums.tolist(), *mass.tolist()]))
        return _table(out, _TOLD)

    return run


def _sums(told: DataFrame) -> list[float]:
    """The sums of all hash partitions: a row per number comes to the driver."""
    each = told.where(F.col("page").isNull() & F.col("sums").isNotNull()).select(F.posexplode("sums").alias("i", "x"))
    return [r["x"] for r in sorted(each.groupBy("i").agg(F.sum("x").alias("x")).collect(), key=lambda r: r["i"])]


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(model: Model, partitions: int, states: int):
    def run(pages: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in _rows(pages):
            page = _Page(row)
            told = _Told(page, answers, partitions, states)
            steps = Steps(page.ids)
            score = steps.likelihoods(model.start, model.step, told.emissions(model))
            firsts = np.cumsum(steps.lengths) - steps.lengths
            c = told.c[page.ids]
            base = np.add.reduceat(np.log10((c + 1) / (model.tokens + model.words + 1)), firsts)
            ids, known = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["known"], bool)
            n = len(ids)
            columns = [
                pa.array(ids, mask=~known), pa.array([not page.trains] * n, pa.bool_()), pa.array(steps.lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), firsts)),
                pa.array(np.full(n, int(model.tokens))), pa.array(base), pa.array(score),
            ]
            out.append(pa.table(columns, names=[x.split()[0] for x in _SCORED.split(", ")]))
        return pa.concat_tables(out)

    return run


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 2 when divided by 7; not so for a null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def scored(docs: DataFrame, held_out: Column | None = None, states: int = 8, rounds: int = 2, least: int = 10, folder: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, written.

    Tokens are the words between white space, A-Z lower-cased, and one end per text. The model learns from the texts that aren't
    ``held_out`` (by default ``is_held_out``): ``rounds`` rounds of Baum-Welch train ``states`` latent states. In each, every page of texts
    runs the scaled forward and backward recursions and sends its expected counts to the hash partitions of its words;
    the partitions add them up and tell the pages what they know of their words. ``score`` is log10 of the text's exact probability by the forward
    recursion over the trained model, ``base_score`` by a word's count + 1 alone, and n_known counts the tokens met in training.

    Words with fewer than ``least`` training occurrences share a distribution over states; their own counts stay apart. Counts that pages
    send are rounded to 8 binary digits and shares to 255ths; the model is made of the rounded ones and sums to 1.

    A null or empty text is the end alone. Rows without doc_id are learned from; repeated rows count and are scored each.
    Other columns are not read. An empty table gives no row; without training texts every score is 0. The steps of a page are as many as the
    tokens of its longest text.
    """
    trains = ~(is_held_out() if held_out is None else F.coalesce(held_out, F.lit(False)))
    with paged(docs, trains, page_bytes=_PAGE_BYTES, folder=folder) as (held, own):
        tokens = held.agg(F.sum("n_words")).first()[0] or 0
        partitions = max(1, -(-tokens // PARTITION_TOKENS))
        pages = held.select(*_PAGE)
        asked = pages.mapInArrow(_asks(partitions), _schema(_ASKED))
        words = materialise(asked.groupBy("bucket").applyInArrow(_counted(least), _schema(_TOLD)), own)
        n, v, n_frequent, v_frequent = _sums(words) or [0.0] * 4
        known = words.where(F.col("page").isNotNull())
        master = words.where(F.col("page").isNull()).select("bucket", "page", "c", F.lit(None).cast("binary").alias("place"), F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("array<double>").alias("sums"))
        model, told = None, known
        for _ in range(rounds):
            sent = pages.groupBy("page").cogroup(told.groupBy("page")).applyInArrow(_expects(model, partitions, states), _schema(_SENT))
            shares = materialise(sent.unionByName(master).groupBy("bucket").applyInArrow(_shared(states), _schema(_TOLD)), own)
            sums = np.array(_sums(shares) or [0.0] * (states * states + 3 * states))
            moves, (begun, rare, mass) = sums[: states * states].reshape(states, states) + _ONCE, sums[states * states :].reshape(3, states)
            model = Model(
                start=(begun + _ONCE) / (begun + _ONCE).sum(),
                step=moves / moves.sum(axis=1, keepdims=True),
                rare=(rare + _RARE * (n - n_frequent + 1) / (n + 1)) / (rare + mass + _RARE),
                mass=mass, tokens=n, words=v, rest=n - n_frequent + v - v_frequent + 1,
            )
            told = known.unionByName(shares.where(F.col("page").isNotNull()))
        return materialise(pages.groupBy("page").cogroup(told.groupBy("page")).applyInArrow(_scores(model, partitions, states), _SCORED), folder)

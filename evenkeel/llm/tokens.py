"""Token ids of whole texts, with every distinct piece of a batch encoded once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .words import Words, mix

#: Pieces remembered per worker and tokenizer; beyond that all are encoded anew, which changes no result.
_REMEMBERED = 1_500_000
#: Pieces encoded as one text.
_TOGETHER = 100
#: Marks that end a word.
_MARKS = ".,;:!?#$%&*"
_OTHER_SPACE = re.compile(r"[^\S \t\n\r\f\v]")
_SPACED = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def encoder(path: str, word_ends: bool, special: bool = True) -> Encoder:
    """The worker's encoder for a file of the tokenizers library."""
    return Encoder(path, word_ends, special)


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids, as the tokenizer itself does.

    Texts are cut where the tokenizer's own pre-tokenizer cuts in any case, at the white space of
    ASCII. Words are told apart by hashes in whole arrays; what is known of them is a table of hashes, in order, with
    places in one array of ids, and only unknown words are encoded. ``word_ends``: the tokenizer drops white
    space; otherwise a blank belongs to the word after it, and what else stands
    between words is a piece of its own. There, texts with other kinds of space are encoded whole, and so are all texts with the
    string of an added token, in any case. With ``special`` off such strings are ordinary text.
    """

    def __init__(self, path: str, word_ends: bool, special: bool = True) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        added = [t.content.lower() for t in self._tokenizer.get_added_tokens_decoder().values()] if special else []
        self._added = re.compile("|".join(map(re.escape, added)).encode(), re.IGNORECASE) if added else None
        # What has no case in each of them: a text without any of these has none of the strings.
        self._signs = sorted({max(re.split(r"[^\W_]", t), key=len).encode() for t in added})
        self._word_ends = word_ends
        # What stands between pieces that are encoded as one text: cut off on both sides in any case, and one id.
        self._mark = "\x01" if word_ends else "\n"
        self._between = f" {self._mark} " if word_ends else self._mark
        (self._mark_id,) = self._ids([self._mark])[0]
        self._forget()

    def _forget(self) -> None:
        self._keys, self._other = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._place, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._flat = np.zeros(0, "<u4")
        self._few: dict[bytes | int, tuple[int, int]] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self._ids(texts)]

    def _coded(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, many of which are encoded as one text."""
        out: list[bytes] = [b""] * len(pieces)
        mark, between = self._mark.encode(), self._between.encode()
        odd = {i for i, p in enumerate(pieces) if mark in p or p.isspace()}
        for i, ids in zip(odd, self._raw([pieces[i].decode() for i in odd]), strict=True):
            out[i] = ids
        plain = [i for i in range(len(pieces)) if i not in odd]
        for at in range(0, len(plain), _TOGETHER):
            part = plain[at : at + _TOGETHER]
            ids = np.array(self._ids([between.join([pieces[i] for i in part]).decode()])[0], "<u4")
            marks = np.flatnonzero(ids == self._mark_id)
            raw = ids.tobytes()
            starts, ends = [0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), len(raw)]
            for i, a, b in zip(part, starts, ends, strict=True):
                out[i] = raw[a:b]
        return out

    def _kept(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place, size) of new ids, put behind those that are there."""
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        place = len(self._flat) + np.cumsum(size) - size
        self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(coded), "<u4")])
        return place, size

    def _words(self, w: Words, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word among the distinct ones, their places, their sizes)."""
        key = np.where(spaced, mix(w.h1 ^ _SPACED), w.h1)
        order = np.argsort(key)
        sorted_, other = key[order], w.h2[order]
        new = np.ones(len(key), bool)
        new[1:] = (sorted_[1:] != sorted_[:-1]) | (other[1:] != other[:-1])
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        first, keys, other = order[new], sorted_[new], other[new]
        at = np.searchsorted(self._keys, keys)
        place, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known = np.zeros(len(keys), bool)
        if len(self._keys):
            near = np.minimum(at, len(self._keys) - 1)
            known = (self._keys[near] == keys) & (self._other[near] == other)
            place[known], size[known] = self._place[near[known]], self._size[near[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            buffer, begin = w.buffer, (w.start[first[fresh]] - spaced[first[fresh]]).tolist()
            coded = self._coded([buffer[a:b] for a, b in zip(begin, w.end[first[fresh]].tolist(), strict=True)])
            place[fresh], size[fresh] = self._kept(coded)
            for name, values in (("_keys", keys), ("_other", other), ("_place", place), ("_size", size)):
                setattr(self, name, np.insert(getattr(self, name), at[fresh], values[fresh]))
        return number, place, size

    def _piece(self, piece: bytes | int) -> tuple[int, int]:
        """(place, size) of a piece of space, or of an id of its own."""
        if piece not in self._few:
            (place,), (size,) = self._kept([np.array([piece], "<u4").tobytes()] if isinstance(piece, int) else self._coded([piece]))
            self._few[piece] = int(place), int(size)
        return self._few[piece]

    def _gaps(self, w: Words) -> tuple[np.ndarray, list[tuple[int, bytes, int]]]:
        """Whether each word has a blank of its own before it, and the other pieces of space as (place, piece, text)."""
        starts = w.texts
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(w.first))
        before = np.empty(len(w.start), np.int64)
        before[1:] = w.end[:-1]
        opens = w.first[:-1][np.diff(w.first) > 0]
        before[opens] = starts[doc[opens]]
        data = np.frombuffer(w.buffer, np.uint8)
        gap = w.start - before
        spaced = (gap > 0) & (data[np.maximum(w.start - 1, 0)] == 0x20)
        pieces = []
        for i in np.flatnonzero(gap > spaced).tolist():
            space = w.buffer[before[i] : w.start[i]]
            parts = (space[:-1],) if spaced[i] else (space[:-1], space[-1:])
            pieces += [(4 * i, p, 0) for p in parts if p]
        last = np.where(np.diff(w.first) > 0, np.append(w.end, 0)[np.maximum(w.first[1:] - 1, 0)], starts[:-1])
        for d in np.flatnonzero(starts[1:] - 1 > last).tolist():
            pieces.append((4 * int(w.first[d + 1]) - 1, w.buffer[last[d] : starts[d + 1] - 1], d))
        return spaced, pieces

    def _whole(self, text: bytes) -> bool:
        """Whether a text isn't cut at its white space."""
        if any(sign in text for sign in self._signs) and self._added.search(text):
            return True
        return not self._word_ends and not text.isascii() and _OTHER_SPACE.search(text.decode()) is not None

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """The ids of each text (in UTF-8), then ``end``."""
        if len(self._keys) > _REMEMBERED or len(self._few) > _REMEMBERED:
            self._forget()
        whole = [d for d, t in enumerate(texts) if self._whole(t)]
        skipped = set(whole)
        here = [b"" if d in skipped else t for d, t in enumerate(texts)] if whole else texts
        w = Words(here, lower=self._word_ends, marks=_MARKS)
        spaced, gaps = (np.zeros(len(w.h1), bool), []) if self._word_ends else self._gaps(w)
        number, place, size = self._words(w, spaced)
        # All pieces in their order: words, what else stands between them, and the end of each text.
        extra = sorted({p for _, p, _ in gaps})
        at = {p: len(place) + i for i, p in enumerate(extra)}
        more = [self._piece(p) for p in [*extra, end]]
        place = np.append(place, [p for p, _ in more])
        size = np.append(size, [n for _, n in more])
        final = len(place) - 1
        places = np.array([*(k for k, _, _ in gaps), *(4 * w.first[1:] - 1).tolist()], np.int64)
        inserted = np.array([*(at[p] for _, p, _ in gaps), *[final] * len(texts)], np.int64)
        of = np.array([*(d for _, _, d in gaps), *range(len(texts))], np.int64)
        ranked = np.lexsort((np.arange(len(of)), of, places))  # a text's last space, then its end, text by text
        unit = np.insert(number, np.searchsorted(4 * np.arange(len(number)) + 2, places[ranked]), inserted[ranked])
        count = size[unit]
        ends = np.cumsum(count)
        raw = self._flat[np.repeat(place[unit] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = (4 * ends[unit == final]).tolist()
        out = [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)] if stops else []
        if whole:
            last = np.array([end], "<u4").tobytes()
            for d, ids in zip(whole, self._raw([texts[d].decode() for d in whole]), strict=True):
                out[d] = ids + last
        return out


def chunks(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together, or one row."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(lengths))] if lengths else []


__all__ = ["Encoder", "chunks", "encoder"]

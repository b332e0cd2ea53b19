"""Words of whole texts as numpy arrays of 128-bit hashes, for use inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes that separate words: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words beyond this many bytes are hashed one by one, so that a single huge word costs no long loop.
_LANES = 8
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_C, _D = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * _D
    return x ^ (x >> np.uint64(31))


class Words:
    """All words of some texts in order.

    ``first[i]`` to ``first[i + 1]`` are the words of text i, which begins at ``texts[i]``; ``start`` and
    ``end`` are byte positions in ``buffer``; ``h1`` and ``h2`` are two
    independent hashes of each word's bytes. ``marks`` at the end of words can be made words of their own.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, marks: str = "") -> None:
        buffer = b"\n".join(texts) + b"\n"
        if lower:
            buffer = buffer.translate(_LOWER)
        self.buffer = buffer
        data = np.frombuffer(buffer, np.uint8)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
        self.texts = starts
        if marks:
            self._cut(np.isin(np.arange(256), list(marks.encode())), data)
        self.first = np.searchsorted(self.start, starts)
        self.h1, self.h2 = self._hashes()

    def _cut(self, mark: np.ndarray, data: np.ndarray) -> None:
        """Make the marks at the end of a word, after a letter or digit of ASCII, a word of their own."""
        cut, going = self.end.copy(), np.arange(len(self.end))
        while len(going):
            going = going[mark[data[cut[going] - 1]] & (cut[going] - 1 > self.start[going])]
            cut[going] -= 1
        cut = np.where(_ALNUM[data[cut - 1]], cut, self.end) if len(cut) else cut
        has = cut < self.end
        self.start = np.sort(np.concatenate([self.start, cut[has]]))
        self.end = np.sort(np.concatenate([cut, self.end[has]]))

    def _hashes(self) -> tuple[np.ndarray, np.ndarray]:
        padded = self.buffer + bytes(8)
        lane = np.ndarray((len(self.buffer) + 1,), "<u8", padded, 0, (1,))
        length = self.end - self.start
        h1 = mix(length.astype(np.uint64) * _A + _C)
        h2 = mix(length.astype(np.uint64) * _B + _D)
        which, at = slice(None), 0
        while at < _LANES:
            begin, left = self.start[which] + 8 * at, length[which] - 8 * at
            if not len(begin):
                break
            value = lane[begin] & _KEEP[np.minimum(left, 8)]
            h1[which] = mix(h1[which] ^ (value * _A))
            h2[which] = mix(h2[which] ^ (value * _B + _D))
            at += 1
            which = np.flatnonzero(length > 8 * at)
        for i in np.flatnonzero(length > 8 * _LANES):
            digest = hashlib.blake2b(self.buffer[self.start[i] : self.end[i]], digest_size=16).digest()
            h1[i], h2[i] = np.frombuffer(digest, "<u8")
        return h1, h2


def windows(h: np.ndarray, size: int, by: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive hashes; empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, by, np.uint64)
    factor = np.uint64((by * 2 + 1) | 1)
    for i in range(size):
        out = out * factor + h[i : i + n]
    return mix(out)


def lowest(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of ``size`` consecutive values."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x

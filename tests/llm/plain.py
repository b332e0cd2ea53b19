"""The operators of the subpackage again, as plain loops over a few documents."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def removed(docs, size=13):
    """(doc_id, n_words, n_removed, sha256 of the kept words) of (doc_id, text) rows."""
    held = [(i, words(t)) for i, t in docs]
    least = {}
    for i, w in held:
        if i is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in held:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + j for k in range(len(w) - 2) for j in range(3) if tri[tuple(w[k : k + 3])] > 1}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def near(docs, size=5, percent=80):
    """(doc_id, n_shingles, component_id)."""
    sets = []
    for i, t in docs:
        w = words(lowered(t))
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return [(i, len(s), None if i is None else top(i)) for i, s in sets]


def line_dedup(docs, sites=8, keep_whole=False):
    """(doc_id, n_lines, n_removed, kept text) of (doc_id, text, source) rows."""
    on = defaultdict(set)
    for _, t, s in docs:
        for x in (t or "").split("\n"):
            if words(x) and s is not None:
                on[x].add(s)
    out = []
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        n, left = sum(bool(words(x)) for x in lines), [x for x in lines if len(on.get(x, ())) < sites]
        gone = len(lines) - len(left)
        out.append((i, n, 0, t) if not gone or (keep_whole and gone == n) else (i, n, gone, "\n".join(left)))
    return out


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    at = [(k, label) for phrase, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def secrets_base(text):
    """n_assign, n_access, n_hex, base_sha256."""
    text, spans = text or "", []
    key = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = Counter(s[2] for s in spans)
    whole = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(whole.encode()).hexdigest()


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))

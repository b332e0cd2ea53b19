"""Phrases, codebooks and the hidden Markov model against plain loops."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import codebooks, collocations, hmm, lines, pages

LONG = " ".join(random.Random(5).choice(["ab", "cd", "ef", "gh"]) for _ in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, page int, part string, n int, score double"


def documents(spark, n=60):
    r = random.Random(1)
    words = ["the", "The", "cat", "sat", "on", "mat.", "a", "b;c", "x\ty", "é", "no\nend", "!", ""]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(n)]
    rows = [(i, t, r.choice(["en", "de", None]), "s", 1, "p", 2, 0.5) for i, t in enumerate(texts)]
    rows += [(7, texts[0], "en", None, None, None, None, None)] * 12 + [(None, "the cat sat on the mat", None, "s", 1, "p", 1, 1.0)] * 3
    rows += [(900, None, "en", "s", 1, "p", 1, 1.0), (901, "", None, "s", 1, "p", 1, 1.0), (902, LONG, "und", "s", 1, "p", 1, 1.0)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def plain_phrases(rows, longest, least, covered, top):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "covered", "top"), [(3, 10, 50, 2000), (2, 3, 50, 4), (4, 2, 80, 50), (3, 1, 100, 10**6)])
def test_phrases(spark, longest, least, covered, top):
    rows, docs = documents(spark)
    if longest == 4:  # the long text has too many pairs for the plain version
        rows, docs = [x for x in rows if x[0] != 902], docs.where("doc_id is null or doc_id != 902")
    got = collocations.collocations(docs, longest, least, covered, top)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, longest, least, covered, top)


def test_phrases_over_many_partitions_and_pages(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PARTITION_MASS", 50)
    rows, docs = documents(spark)
    got = collocations.collocations(docs, 3, 5)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 3, 5, 50, 2000)
    assert spark.sql("SHOW TABLES").isEmpty()  # pages are gone


def test_phrase_scores_are_exact(spark):
    big = 3 * 10**12 + 7
    one = spark.range(1).select(collocations._exact_score(F.lit(big), F.lit(big + 1), F.lit(big + 2)).alias("s"))
    assert one.first().s == 10**6 * big * big // ((big + 1) * (big + 2))


def test_summary_keeps_what_is_frequent():
    """However the counts are split and merged, nothing frequent is lost, and no counter is off by more than allowed."""
    r = random.Random(2)
    for least in (2, 5, 20):
        stream = [r.choice(range(12)) if r.random() < 0.5 else r.randrange(10**6) for _ in range(4000)]
        capacity, true = len(stream) // least + 1, Counter(stream)
        parts = []
        for a in range(0, 4000, 500):
            part = collocations.Summary(capacity)
            for b in range(a, a + 500, 50):
                keys, counts = np.unique(np.array(stream[b : b + 50], np.uint64), return_counts=True)
                part.merge(keys, counts)
            parts.append(part)
        whole = collocations.Summary(capacity)
        for part in r.sample(parts, len(parts)):
            whole.merge(part.keys, part.counts, part.lost)
        assert len(whole.keys) <= capacity and whole.lost <= len(stream) / (capacity + 1)
        assert {k for k, n in true.items() if n >= least} <= set(whole.possible(least).tolist())
        assert all(0 <= true[k] - n <= whole.lost for k, n in zip(whole.keys.tolist(), whole.counts.tolist(), strict=True))


def test_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.collocations(none).isEmpty() and hmm.scored(none).isEmpty()
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codebooks.digest(vectors).isEmpty()
    nothing = spark.createDataFrame([(1, [None, 1.0], 3), (2, None, 3), (3, [float("nan")], 3), (4, [float("inf")], 3)], "vec_id long, embedding array<float>, label int")
    assert codebooks.digest(nothing).isEmpty()


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    at = [i * width // parts for i in range(parts + 1)]
    books = [[v[at[p] : at[p + 1]] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(v[at[p] : at[p + 1]], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        met = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                met[p, nearest(v, p)[1]].append(v[at[p] : at[p + 1]])
        for (p, k), vs in met.items():
            books[p][k] = tuple(sum(x) // len(vs) for x in zip(*vs, strict=True))
    done = [(i, label, [nearest(v, p) for p in range(parts)]) for i, v, label in kept]
    by = Counter()
    for _, label, found in done:
        by[label] += sum(d for d, _ in found)
    sha = __import__("hashlib").sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), by[label], sha) for i, label, found in done]


@pytest.mark.parametrize(("width", "parts", "n"), [(32, 16, 300), (16, 16, 40), (20, 16, 90), (0, 16, 5)])
def test_codes(spark, width, parts, n):
    r = random.Random(width)
    rows = [(i, [r.choice([-0.5, 0.25, r.uniform(-2, 2)]) for _ in range(width)], r.choice([1, 2, None])) for i in range(n, 0, -1)]
    rows += [rows[3]] * 5 + [(None, rows[2][1], 1), (500, None, 1), (501, [float("nan")] * width or None, 1), (502, [None] * width or None, 2), (503, [1.0] * (width + 1), 2)]
    vectors = spark.createDataFrame([(*x, "clash", 9) for x in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(4)
    got = codebooks.digest(vectors, parts)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(plain_codes(rows, parts, 64, 2), key=repr)


def test_too_large_components_raise(spark):
    vectors = spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        codebooks.digest(vectors).collect()


def plain_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def test_likelihood_and_counts_against_all_paths():
    """The forward recursion and the expected counts of short texts, by adding up all paths of states."""
    rng = np.random.default_rng(1)
    start, step, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.random((5, 3))
    texts = [[1, 2, 0], [0], [3, 3, 4, 1, 0], [2, 0]]
    steps = hmm.Steps(np.array(list(itertools.chain(*texts)), np.uint32))
    counts, moves, first = steps.expected(start, step, emit, 5)
    want, words, met, begun = [], np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    for t in texts:
        paths = {}
        for path in itertools.product(range(3), repeat=len(t)):
            p = start[path[0]] * emit[t[0], path[0]]
            for i in range(1, len(t)):
                p *= step[path[i - 1], path[i]] * emit[t[i], path[i]]
            paths[path] = p
        whole = sum(paths.values())
        want.append(math.log10(whole))
        for path, p in paths.items():
            begun[path[0]] += p / whole
            for i, s in enumerate(path):
                words[t[i], s] += p / whole
                if i:
                    met[path[i - 1], s] += p / whole
    assert np.allclose(steps.likelihoods(start, step, emit), want)
    assert np.allclose(counts, words, atol=1e-5) and np.allclose(moves, met, atol=1e-5) and np.allclose(first, begun, atol=1e-5)


def test_scores(spark, monkeypatch):
    """Counts and base scores by hand; the same model whatever the pages; held-out texts gain over words alone."""
    rows, docs = documents(spark, 400)
    # Two sorts of texts without a common word, so that there is something to learn.
    more = [(1000 + i, " ".join(random.Random(i).choice(("aa", "bb", "cc") if i % 2 else ("dd", "ee", "ff")) for _ in range(30)), "en", "s", 1, "p", 1, 1.0) for i in range(300)]
    rows, docs = rows + more, docs.unionByName(spark.createDataFrame(more, DOCS))
    got = hmm.scored(docs, states=4).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    c = Counter(t for (_, text, *_), h in zip(rows, held, strict=True) if not h for t in plain_tokens(text))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(t := plain_tokens(text)), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for (i, text, *_), h in zip(rows, held, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    apart = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart) + len(apart)
    monkeypatch.setattr(hmm, "PARTITION_TOKENS", 1000)
    monkeypatch.setattr(hmm, "_PAGE_BYTES", 4000)
    again = hmm.scored(docs, states=4).collect()
    close = [sorted(((r.doc_id or -1, r.n_tokens, r.score) for r in x)) for x in (got, again)]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 0.01 * abs(a[2]) for a, b in zip(*close, strict=True))


def test_model_sums_to_one():
    """All words and the unseen ones together, in each state."""
    c = np.array([50, 30, 12, 3, 1, 0, 0])  # the last is any unseen word
    frequent, shares = c >= 10, np.array([[255.0, 0], [100, 155], [0, 255]])
    even = (shares + 0.25) / (shares + 0.25).sum(axis=1, keepdims=True)
    mass = (c[:3, None] * even).sum(axis=0)
    model = hmm.Model(np.full(2, 0.5), np.full((2, 2), 0.5), np.array([0.1, 0.3]), mass, 96, 5, 4 + 2 + 1)
    assert np.allclose(model.emissions(c, frequent, shares)[:6].sum(axis=0), 1)


def test_no_training_texts_and_no_states_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in hmm.scored(docs, F.lit(True)).collect()] == [(0, 0, 0, 0)] * 2
    one = hmm.scored(docs, F.lit(False), states=1, least=1).collect()
    assert all(r.n_known == r.n_tokens for r in one)


def test_words_of_pages():
    texts = [b"A b, c.  d", b"", b"x\ty\n\nz b", "É é".encode()]
    words, ids = pages.numbered(texts)
    names = [b"", *words.split(b"\n")]
    assert [names[i] for i in ids] == [b"a", b"b,", b"c.", b"d", b"", b"", b"x", b"y", b"z", b"b", b"", "É".encode(), "é".encode(), b""]


def test_pages_without_own_lines(spark):
    """Ten sites with the same menu: it goes from all, also where it is most or all of the page."""
    menu = "Home\nAbout"
    rows = [(i, f"{menu}\n{' '.join(f'own{i}_{k}' for k in range(200))}", f"s{i}") for i in range(10)] + [(99, menu, "s99")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in lines.without_boilerplate(docs).select("doc.doc_id", "n_removed", "kept").collect()}
    assert all(got[i] == (2, rows[i][1].split("\n")[2]) for i in range(10)) and got[99] == (2, "")
    whole = {r.doc_id: r.text for r in lines.line_dedup(docs, keep_whole=True).collect()}
    assert whole[99] == menu and whole[3] == rows[3][1].split("\n")[2]

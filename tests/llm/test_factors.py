"""Factors of op1 against the words of their sources."""

from __future__ import annotations

import random
from collections import defaultdict

from evenkeel.llm import blocks, substrings

TEXTS = "doc_id long, text string"


def _check(rows, found, words=13):
    """Every factor stands in its source, none lies in another, all repeated windows are covered and nothing else."""
    texts, held = defaultdict(list), defaultdict(lambda: float("inf"))
    for d, t in rows:
        if d is not None:
            texts[d].append((t or "").split())
    for d, ts in texts.items():
        for t in ts:
            for k in range(len(t) - words + 1):
                held[tuple(t[k : k + words])] = min(d, held[tuple(t[k : k + words])])
    for r in found:
        spans = [tuple(s) for s in r.spans]
        if r.doc_id is None:
            assert not spans
            continue
        want = None
        for t in texts[r.doc_id]:
            ok = all(any(u[c : c + b - a] == t[a:b] for u in texts[ref]) for a, b, ref, c in spans if ref < r.doc_id)
            gone = {k + i for k in range(len(t) - words + 1) if held[tuple(t[k : k + words])] < r.doc_id for i in range(words)}
            covered = {k for a, b, _, _ in spans for k in range(a, b)}
            kept = " ".join(w for k, w in enumerate(t) if k not in gone)
            if ok and gone == covered and kept == r.kept:
                want = t
        assert want is not None, r
        assert all(b - a >= words and ref < r.doc_id for a, b, ref, _ in spans)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(spans, spans[1:]))
        assert all(x[1] < z[0] for x, z in zip(spans, spans[2:]))


def test_windows_apart_in_the_source_are_two_factors(spark):
    w = [f"w{k}" for k in range(1, 15)]
    rows = [(1, " ".join(w[:13] + ["x", "y"] + w[1:])), (2, " ".join(w))]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.rlz_spans(spark.createDataFrame(rows, TEXTS)).collect()}
    assert found == {1: [], 2: [(0, 13, 1, 0), (1, 14, 1, 15)]}


def test_a_factor_goes_on_over_windows_of_earlier_documents(spark):
    """Document 0 holds the middle of the passage; the factor is still the whole passage in document 1."""
    w = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(["a"] + w[20:36] + ["b"])), (1, " ".join(["c"] + w)), (2, " ".join(w + ["d"]))]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.rlz_spans(spark.createDataFrame(rows, TEXTS)).collect()}
    assert found == {0: [], 1: [(21, 37, 0, 1)], 2: [(0, 60, 1, 1)]}


def test_texts_under_one_doc_id_are_sources_of_their_own(spark):
    w = [f"w{k}" for k in range(15)]
    rows = [(1, " ".join(w[:14] + ["x"])), (1, " ".join(["y"] + w[1:])), (2, " ".join(w)), (2, " ".join(w)), (None, " ".join(w)), (3, None), (4, "")]
    _check(rows, substrings.rlz_spans(spark.createDataFrame(rows, TEXTS)).collect())


def test_factors_of_mixed_texts(spark, monkeypatch):
    """Passages cut, joined and repeated, in many blocks; repeated rows and clashing doc_ids."""
    monkeypatch.setattr(substrings, "block_count", lambda d: blocks.block_count(d, 4_000))
    for seed in (3, 8):
        r = random.Random(seed)
        pool = [[f"{c}{k}" for k in range(r.randrange(20, 70))] for c in "abcdefgh"]
        rows = []
        for d in range(70):
            t = []
            for _ in range(r.randrange(0, 5)):
                p = r.choice(pool)
                a = r.randrange(len(p))
                t += p[a : a + r.randrange(5, 60)] + [f"own{d}"] * r.randrange(0, 2)
            rows.append((r.choice([d, d, d, d, d // 2, None]), " ".join(t)))
        rows += rows[:9]
        found = substrings.rlz_spans(spark.createDataFrame(rows, TEXTS).repartition(4)).collect()
        assert len(found) == len(rows) and any(len(x.spans) > 1 for x in found)
        _check(rows, found)

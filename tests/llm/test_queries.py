"""The registered queries over sf0.01: against their SQL, or against plain loops."""

from __future__ import annotations

import math

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evenkeel.llm.queries import ORACLE, QUERIES
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def plain_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain_rows(got.columns, got.collect()) == plain_rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_decontamination", "op6_license_scan", "op8_line_dedup"])
def test_runs_no_python(spark, name, capsys):
    QUERIES[name](spark, SF).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


def test_op2(spark, documents):
    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    want = []
    for i, text in sorted(documents):
        ids = plain.ids_of(t, text)
        want.append((i, at, len(ids), plain.crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_simple8b"](spark, SF).collect()) == want


def test_op6(spark, documents):
    got = QUERIES["op6_license_scan"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted((i, *plain.license_base(t)) for i, t in documents)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got if r.base_labels)
    assert all(0 <= r.score <= 1 for r in got)


def test_op7(spark, documents):
    got = QUERIES["op7_secret_scan"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted((i, *plain.secrets_base(t)) for i, t in documents)


def test_op9(spark, documents):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: plain.ids_of(t, text) for i, text in documents}
    got = QUERIES["op9_packing"](spark, SF).collect()
    at, lengths = dict.fromkeys(ids, 0), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == plain.crc(ids[r.doc_id][r.start : r.start + r.length])
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert max(lengths.values()) <= 2048
    assert sum(2048 - n for n in lengths.values() if n & (n - 1)) < 0.01 * sum(lengths.values())


def test_pipeline(spark, duck):
    """The pipeline's pieces belong to the documents that plain versions of the stages keep."""
    rows = duck.sql("SELECT doc_id, text, source FROM documents").fetchall()
    judged = {r.doc_id: r.kept for r in QUERIES["op3_quality_rules"](spark, SF).collect()}  # held against SQL above
    rows = [r for r in rows if judged[r[0]]]
    source = {r[0]: r[2] for r in rows}
    text = {i: kept for i, _, _, kept in plain.line_dedup(rows, keep_whole=True)}
    text = {i: text[i] for i, _, c in plain.near(list(text.items())) if i == c}
    items = {i: plain.words(t) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()}
    whole = {i: " ".join(w) for i, w in items.items()}
    leaky = {i for i, t in text.items() for w in whole.values() if w in " ".join(plain.words(t))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(text) - leaky
    assert source.keys() >= {r.doc_id for r in got}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        ids = plain.ids_of(t, text[r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == plain.crc(ids[r.start : r.start + r.length])

"""Findings of round 3 on the corpus operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpdesk_lake.llm import minhash_forest, word_bpe
from helpdesk_lake.llm.common import tokenizer_path
from test_corpus_operators import edited, frame, made


@pytest.mark.parametrize("copies", [30, 60])
def test_a_set_in_many_dense_regions_is_looked_up_once(spark, monkeypatch, copies):
    """Dense regions are looked up by one row a set, however many trees and depths they span; no candidate is lost by it."""
    seen, held = {}, minhash_forest.stored

    def stored(df, name):
        out = held(df, name)
        seen.setdefault(name, out.count())
        return out

    monkeypatch.setattr(minhash_forest, "stored", stored)
    base = made(200, 41)
    texts = [" ".join(base[:150] + edited(base[150:], 0.02, k) + [f"tail{k}"]) for k in range(copies)] + [" ".join(made(80, 50 + k)) for k in range(5)]
    docs = frame(spark, texts + texts[:3] + [None, ""])
    out = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs, region=8, percent=80).collect()}
    assert out == {k: 0 for k in range(copies)} | {copies + k: copies + k for k in range(5)} | {copies + 5 + k: 0 for k in range(3)} | {
        k: k for k in (copies + 8, copies + 9)}
    assert seen["members"] == copies and seen["regions"] > 5 * copies


def test_dense_regions_are_made_by_one_row_a_set_and_region(spark, monkeypatch):
    """Not by a row per depth, twice: the regions at all depths travel together, and a set's leaders are listed once for all of them."""
    seen, held = {}, minhash_forest.stored

    def stored(df, name):
        out = held(df, name)
        seen.setdefault(name, out.count())
        return out

    monkeypatch.setattr(minhash_forest, "stored", stored)
    base = made(200, 43)
    docs = frame(spark, [" ".join(base[:150] + edited(base[150:], 0.02, k) + [f"tail{k}"]) for k in range(30)])
    sets = minhash_forest.signatures(docs, limits=minhash_forest.Limits(80)).select("fp", F.col("id").alias("rep"), "n", "sig")
    pairs, dense = minhash_forest.candidates(sets, 8, minhash_forest.Limits(80))
    assert seen["below"] == dense.count() > 30 and not [name for name in seen if name.startswith("regions") and name != "regions"]
    found = pairs.collect()
    assert len(found) == len(set(found)) >= 29 and all(r.u < r.v for r in found)


def test_bpe_asks_for_longer_tokens_only_and_remembers_a_bounded_number():
    spec = word_bpe.read_spec(tokenizer_path("word_bpe_49k.json"))
    small, large = word_bpe.WordBpe(spec, 16), word_bpe.WordBpe(spec)
    text = " ".join(made(300, 7)) + " Zürich éèê 1984 ßchen \x00 don't, x" + " unterbrechungsfreiheiten" * 3
    assert small.encode(text) == large.encode(text) == small.encode(text)
    assert small.encoded(text) == large.encoded(text) and small.encoded("") == small.encoded(None) == []
    assert [i for got in small.encoded(text) for i in got[0]] == small.encode(text)
    for held in (small.chunk, small.chunk_ids, small.word_ids, small.compatible):
        assert len(held) <= 8 and len(held.older) <= 8
    assert large.compatible and all(pair % large.count in large.parts for pair in large.compatible)

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import packing

BUDGET = "budget_id int, tokenizer_name string, capacity_tokens int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(1, 6))
def test_windows_hold_everything_within_capacity(sizes, most):
    w, seen, emitted = packing.Windows(50, most), [], []
    for i, s in enumerate(sizes):
        if out := w.place(s, i):
            emitted.append(out[1])
        assert len(w.free) <= most
    for items in [*emitted, *w.held.values()]:
        assert sum(sizes[i] for i in items) <= 50
        seen += items
    assert sorted(seen) == list(range(len(sizes)))


def test_pieces():
    assert packing.pieces(0, 5) == [(0, 0)] and packing.pieces(5, 5) == [(0, 5)] and packing.pieces(12, 5) == [(0, 5), (5, 5), (10, 2)]


@pytest.mark.parametrize("parts,merge_items", [(1, 100_000), (5, 40)])
def test_every_document_comes_out_once(spark, monkeypatch, parts, merge_items):
    monkeypatch.setattr(packing, "MERGE_ITEMS", merge_items)
    texts = [(i, None if i % 11 == 0 else "" if i % 7 == 0 else "word " * (i % 90 + 1), 1) for i in range(300)] + [(500, "long text " * 2000, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, capacity int").repartition(parts)
    budgets = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "piece_bpe_32k", 100), (3, None, 5), (4, "byte_bpe_50k", 0), (5, "byte_bpe_50k", None)], BUDGET)
    rows = packing.pack(spark, docs, budgets, windows=4).collect()
    for b, cap, name in [(1, 64, "byte_bpe_50k"), (2, 100, "piece_bpe_32k")]:
        own = [r for r in rows if r.budget_id == b]
        size, spans, slots = defaultdict(int), defaultdict(list), defaultdict(list)
        for r in own:
            size[r.container] += r.n_tokens
            spans[r.doc_id].append((r.piece_no, r.token_start, r.n_tokens))
            slots[r.container].append(r.position)
        assert max(size.values()) <= cap and all(sorted(s) == list(range(len(s))) for s in slots.values())
        count = packing.counter(name)
        for d, t, _ in texts:
            n = count([t or ""])[0]
            got = sorted(spans[d])
            assert sum(x[2] for x in got) == n and (n > cap or len(got) == 1)
            assert all(x[1] + x[2] == y[1] for x, y in zip(got, got[1:]))
        assert sum(size.values()) / (len(size) * cap) > 0.8
    assert {r.budget_id for r in rows} == {1, 2}


def test_empty_tables_and_unknown_tokenizer(spark):
    docs, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], BUDGET)
    one = spark.createDataFrame([(1, "byte_bpe_50k", 64)], BUDGET)
    assert packing.pack(spark, docs, one).collect() == []
    assert packing.pack(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark, docs, spark.createDataFrame([(1, "nothing", 64)], BUDGET))

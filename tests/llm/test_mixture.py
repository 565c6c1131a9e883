"""Problem 9: exact fits, caps and reports."""

import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import mixture
from tests.conftest import TESTDATA

pytestmark = pytest.mark.skipif(not os.path.exists(mixture.TOKENIZER), reason="no tokenizer file")


def best_below(counts, budget):
    sums = {0}
    for n, c in counts.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= budget}
    return max(sums)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=5), st.integers(0, 300))
def test_fit_is_best(counts, budget):
    take = mixture.fit(counts, budget)
    assert all(0 < k <= counts[n] for n, k in take.items())
    assert sum(n * k for n, k in take.items()) == best_below(counts, budget)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=6), st.floats(0, 1), st.sampled_from([0, 1, 30, 500]), st.sampled_from([1, 7, 1000]))
def test_fit_is_best_wherever_it_begins(counts, share, most, unit):
    """The size that the dynamic programming begins with changes no total."""
    counts = {n * unit: c for n, c in counts.items()}
    budget = int(sum(n * c for n, c in counts.items()) * share)
    take = mixture.fit(counts, budget, most)
    assert all(0 < k <= counts[n] for n, k in take.items())
    assert sum(n * k for n, k in take.items()) == best_below({n // unit: c for n, c in counts.items()}, budget // unit) * unit


@pytest.mark.parametrize("counts, budget, best", [({50_000: 1, 26_000: 2}, 52_000, 52_000), ({50_000: 1, 26_000: 2}, 51_999, 50_000), ({70_001: 10**6, 70_003: 10**6}, 70_001 * 999 + 70_003 * 7, 70_001 * 999 + 70_003 * 7), ({10**6: 3, 999_983: 2}, 2_999_999, 2_999_983)])
def test_long_documents(counts, budget, best):
    assert sum(n * k for n, k in mixture.fit(counts, budget).items()) == best


def test_shares_can_be_kept(spark):
    docs = spark.createDataFrame([(i, "same text here", s) for s, n in [("a", 400), ("b", 30), ("c", 5)] for i in range(n)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("gone", 0.25, 3)], "source string, target_share double, max_repeats int")
    got = {r.source: (r.tokens, r.most_copies) for r in mixture.shares(docs, targets, keep_shares=True).collect()}
    assert got == {"a": (360, 1), "b": (180, 2), "gone": (0, 0)}
    got = {r.source: r.tokens for r in mixture.shares(docs, targets, total=90, keep_shares=True).collect()}
    assert got == {"a": 60, "b": 30, "gone": 0}
    assert mixture.shares(docs.limit(0), targets, keep_shares=True).count() == 3


def test_table(spark):
    docs, targets = spark.read.parquet(f"{TESTDATA}/documents.parquet"), spark.read.parquet(f"{TESTDATA}/mix_targets.parquet")
    chosen = mixture.mix(docs, targets, seed=1).collect()
    report = {r.source: r for r in mixture.shares(docs, targets, seed=1).collect()}
    goal = {r.source: r for r in targets.collect()}
    assert set(report) == set(goal) and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    for s, r in report.items():
        mine = [c for c in chosen if c.source == s]
        assert sum(c.n_tokens * c.copies for c in mine) == r.tokens and all(1 <= c.copies <= goal[s].max_repeats for c in mine)
        counts = Counter(x.n_tokens for x in mixture.token_lengths(docs).filter(f"source = '{s}'").collect() if x.n_tokens)
        have = sum(n * c for n, c in counts.items())
        budget = min(round(goal[s].target_share * r.total), have * goal[s].max_repeats)
        passes = budget // have if have else 0
        assert r.tokens == passes * have + best_below(counts, budget - passes * have)
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, mixture.mix(docs, targets, seed=1).collect()))


def test_hot_length_and_edges(spark):
    rows = [(i, "same text here", " A ") for i in range(500)] + [(900, None, "a"), (901, "", "a"), (902, "x", None), (903, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("gone", 0.5, 3), (None, 0.1, 1), ("b", None, 1)], "source string, target_share double, max_repeats int")
    out = mixture.mix(docs, targets, total=600).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in mixture.mix(docs, targets, total=600).collect()} != {r.doc_id for r in mixture.mix(docs, targets, seed=2, total=600).collect()}
    assert len(out) == 100 and {r.copies for r in out} == {1} and {r.n_tokens for r in out} == {3}
    assert {(r.source, r.tokens) for r in mixture.shares(docs, targets, total=600).collect()} == {("a", 300), ("gone", 0)}
    assert mixture.mix(docs.limit(0), targets).count() == 0 and mixture.mix(docs, targets.limit(0)).count() == 0


def test_other_tokenizers(spark):
    docs = spark.createDataFrame([(1, "Hello wörld", "a"), (2, "<|endoftext|>", "a")], "doc_id long, text string, source string")
    for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"):
        n = [r.n_tokens for r in mixture.token_lengths(docs, f"/opt/tokenizers/{f}").collect()]
        assert all(x > 2 for x in n)

"""Problems 8 and 10 against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import leakage, spans
from tests.conftest import TESTDATA


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


def docs(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")


def pairs(rows, n=250):
    seen = {}
    for i, t in rows:
        for j in range(len(t or "") - n + 1):
            seen.setdefault(t[j : j + n], set()).add(i)
    return {(a, b) for v in seen.values() for a in v for b in v if a < b}


def classes(rows, n=250):
    """The unbranched paths of windows that several documents have, walked window by window."""
    at = {}
    for i, t in rows:
        for j in range(len(t or "") - n + 1):
            at.setdefault(t[j : j + n], []).append((i, j, t))
    shared = {w: v for w, v in at.items() if len({i for i, _, _ in v}) > 1}
    side = lambda v, f: len({f(i, j, t) for i, j, t in v}) > 1
    left = {w for w, v in shared.items() if side(v, lambda i, j, t: t[j - 1] if j else i)}
    right = {w for w, v in shared.items() if side(v, lambda i, j, t: t[j + n] if j + n < len(t) else i)}
    out = set()
    for i, t in rows:
        t, low = t or "", None
        for j in range(len(t) - n + 1):
            w, after = t[j : j + n], t[j + 1 : j + n + 1]
            if w in shared:
                low = j if low is None else low
                if w in right or after in left or after not in shared or len(after) < n:
                    out.add((i, low + 1, j + n - low, hashlib.md5(t[low : j + n].encode()).hexdigest()))
                    low = None
    links = {}
    for i, *_, c in out:
        links.setdefault(c, set()).add(i)
    return {(*x, len(links[x[3]])) for x in out}


def listed(df):
    return {(r.doc_id, r.start_at, r.n_chars, r.class_id, r.documents) for r in df.collect()}


def test_spans_of_the_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {tuple(r) for r in spans.shared_pairs(documents).collect()} == pairs(rows)
    got = spans.shared_spans(documents)
    assert listed(got) == classes(rows) and got.count() == len(classes(rows)) > 10


@pytest.mark.parametrize("length", [250, 183, 60, 7, 1])
def test_spans_of_any_length(spark, length):
    """Passages cut, joined and repeated in many ways, so that paths fork inside of spans."""
    rnd = random.Random(length)
    word = lambda n: "".join(rnd.choice("abcdefgh \n.あ𠮷") for _ in range(n))
    base, rows = [word(int(length * x) + 1) for x in (0.6, 1, 1.4, 3)], []
    for i in range(25):
        t = ""
        for _ in range(rnd.randrange(1, 4)):
            p = rnd.choice(base)
            a, b = sorted((rnd.randrange(len(p) + 1), rnd.choice([rnd.randrange(len(p) + 1), len(p)])))
            t += rnd.choice(["", word(rnd.randrange(1, length + 2))]) + rnd.choice([p, p[a:b]])
        rows.append((i, t))
    got = spans.shared_spans(docs(spark, rows), length)
    assert listed(got) == classes(rows, length)
    assert {tuple(r) for r in spans.shared_pairs(docs(spark, rows), length, got).collect()} == pairs(rows, length)


def test_spans_by_hand(spark):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefgh \n.あいう𠮷") for _ in range(n))
    p, q, short = word(250), word(700), word(249)
    rows = [
        (1, word(90) + p + word(300)), (2, p), (3, word(1) + p), (4, word(40) + short + word(40)), (5, word(3) + short + word(200)), (6, q), (7, q), (8, word(500) + q[200:600] + "x" + p), (9, None), (10, ""), (11, "z"),
        (12, " " * 400), (13, "x" + " " * 300), (14, "a" * 1000), (15, p + word(5) + p), (15, p), (15, p), (16, q + q), (17, word(251)), (17, word(251)),
    ]
    got = [tuple(r) for r in spans.shared_pairs(docs(spark, rows)).collect()]
    assert set(got) == pairs(rows) and len(got) == len(set(got))
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(docs(spark, rows)).collect()}
    assert share[2] == 250 and share[6] == 700 and share[9] == share[10] == share[4] == share[17] == 0 and share[15] == 750 and share[16] == 1400 and len(share) == 17


def test_a_passage_of_many_costs_rows_like_documents(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK_MEMBERS", 7)
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh \n.") for _ in range(n))
    p = word(5000)
    rows = [(i, word(100) + chr(0x4E00 + i) + p + chr(0x4E00 + i) + word(100)) for i in range(60)]
    texts = spans._texts(docs(spark, rows))
    n = sum(x["b"] - x["a"] + 1 for r in spans.places(spans.graph(texts)).collect() for x in r.ranges)
    assert n < 60 * 600 and len(classes(rows)) == spans.shared_spans(docs(spark, rows)).count() == 60
    assert spans.shared_pairs(docs(spark, rows)).count() == 60 * 59 // 2


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 1000)
    rnd, (k, s) = random.Random(1), spans.sizes(250)
    t = "".join(rnd.choice("abcde ") for _ in range(20_000))
    codes = spans.code_points(t)
    whole = spans.syncmers(codes, k, s)[0].tolist()
    parts = sorted({int(x) + off for c, where in spans._pieces([t], k - 1) for _, start, size, off in where for x in spans.syncmers(c[start : start + size], k, s)[0]})
    assert parts == whole


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abc ", min_size=260, max_size=600), st.integers(0, 50), st.sampled_from([250, 100, 9]))
def test_every_run_has_a_node(t, cut, length):
    """What the method rests on: k-mers are chosen by themselves alone, and no run of k - s of them is without one."""
    k, s = spans.sizes(length)
    at, h = spans.syncmers(spans.code_points(t), k, s)
    inner, hi = spans.syncmers(spans.code_points(t[cut:]), k, s)
    keep = at >= cut
    assert (at[keep] - cut).tolist() == inner.tolist() and h[keep].tolist() == hi.tolist()
    places = np.concatenate([[-1], at, [len(t) - k + 1]])
    assert (np.diff(places) <= max(1, k - s)).all() and 2 * k - s <= length


def test_texts_that_repeat_themselves(spark):
    rows = [(1, "a" * 60_000), (2, "b" + "a" * 60_000), (3, "ab" * 20_000), (4, "xab" + "ab" * 20_000), (5, " " * 300), (6, "a" * 249)]
    assert {tuple(r) for r in spans.shared_pairs(docs(spark, rows)).collect()} == {(1, 2), (3, 4)}


def test_spans_empty_and_clashing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, at long, node long, span long")
    assert spans.shared_pairs(none).count() == 0 and spans.shared_share(none).count() == 0
    with pytest.raises(ValueError):
        spans.shared_pairs(none, 0)


def leaks(rows, items, run=12):
    out = set()
    for i, t in rows:
        w = leakage.words(t or "")
        grams = {tuple(w[j : j + run]) for j in range(len(w) - run + 1)}
        for k, s in items:
            v = leakage.words(s or "")
            if any(tuple(v[j : j + run]) in grams for j in range(len(v) - run + 1)):
                out.add((i, k))
    return out


def test_leaks_of_the_table(spark, documents):
    items = spark.read.parquet(f"{TESTDATA}/eval_items.parquet")
    got = [tuple(r) for r in leakage.leaks(documents, items).collect()]
    assert set(got) == leaks([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()]) and len(got) == len(set(got)) > 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=4), st.lists(st.sampled_from("abcd"), max_size=60), st.integers(1, 6))
def test_search_by_words(items, text, run):
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    assert {(0, k) for k in leakage.WuManber(items, run).search(" ".join(text))} == leaks([(0, " ".join(text))], items, run)


def test_leaks_by_hand(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PASS_WORDS", 15)  # several passes
    s = "One two, three-four FIVE six 7 eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, "x", s), (2, "x", "too short"), (3, "x", None), (4, "y", s.upper()), (5, "y", "")], "item_id long, suite string, text string")
    rows = [(1, "zz " + s.replace(" ", "\u3000…\n")), (2, s[: s.rindex("twelve")]), (3, None), (4, ""), (5, "é" + s), (6, "q" + s), (7, "a " * 200_000 + s)]
    got = {tuple(r) for r in leakage.leaks(docs(spark, rows), items).collect()}
    assert got == {(d, i) for d in (1, 5, 6, 7) for i in (1, 4)} == leaks(rows, [(r.item_id, r.text) for r in items.collect()])
    assert {(r.item_id, r.documents) for r in leakage.leaked_items(docs(spark, rows), items).collect()} == {(1, 4), (2, 0), (3, 0), (4, 4), (5, 0)}
    assert leakage.leaks(docs(spark, []), items).count() == 0 and leakage.leaks(docs(spark, rows), items.limit(0)).count() == 0

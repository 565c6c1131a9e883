"""Problem 7, against a dictionary."""

import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.operators import deliveries as D

from .conftest import TESTDATA

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def brute(rows):
    best = {}
    for r in rows:
        u = (r.get("uuid") or "").strip().lower()
        key = (r.get("session_id"), u) if u else (r.get("session_id"), r.get("record_type"), r.get("written_at"), (r.get("item_text") or "").strip(), (r.get("item_content") or "").strip())
        best.setdefault(key, []).append((r["received_at"], r["record_id"]))
    return sorted(i for v in best.values() for _, i in sorted(v)[1:])


def test_random_against_brute(spark, session_rows, zones):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        u = rnd.choice([None, "hot", f"U{rnd.randrange(300)}", f" u{rnd.randrange(300)} "])
        rows.append({"record_id": i, "session_id": rnd.choice(["a", "b"]), "uuid": u, "record_type": rnd.choice(["user", "assistant"]), "batch_no": rnd.randrange(40), "received_at": T0 + dt.timedelta(seconds=rnd.randrange(500)),
                     "written_at": rnd.choice(["2026-01-01T00:00:00Z", "2026-01-01T00:00:01Z", "n/a"]), "item_text": rnd.choice([None, "", "x", " x\n"])})
    got = sorted(r[0] for r in D.surplus_copies(session_rows(rows), zones([])).collect())
    assert got == brute(rows)


def test_same_instant_in_other_writing(session_rows, zones):
    rows = [{"record_id": 1, "session_id": "s", "source_id": "p", "record_type": "user", "written_at": "2026-01-01T10:00:00Z", "received_at": T0}, {"record_id": 2, "session_id": "s", "source_id": "q", "record_type": "user", "written_at": "2026-01-01 11:00:00", "received_at": T0}]
    assert [r[0] for r in D.surplus_copies(session_rows(rows), zones([("q", "Europe/Berlin")])).collect()] == [2]


def test_table_and_incremental(spark):
    """Ingesting in two parts ends with the same keepers as in one, and again gives nothing."""
    cs, so = spark.read.parquet(f"{TESTDATA}/claude_session.parquet"), spark.read.parquet(f"{TESTDATA}/sources.parquet")
    whole = {r[0] for r in D.surplus_copies(cs, so).collect()}
    keyed = D.copy_keys(cs, so)
    index = D.IdentifierIndex(spark, rows_expected=200_000)
    a, b = keyed.filter("record_id % 3 = 0"), keyed.filter("record_id % 3 <> 0")
    parts = {r[0] for r in index.ingest(a).collect()} | {r[0] for r in index.ingest(b).collect()}
    assert parts == whole and len(whole) > 10
    assert index.ingest(a).join(D.first_copies(keyed, ["record_id"]), "record_id").count() == 0
    kept = {r[0] for r in D.first_copies(keyed, ["record_id"]).collect()}
    assert kept.isdisjoint(whole) and len(kept) + len(whole) == cs.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5)), max_size=12), max_size=12))
def test_runs_keep_the_first(batches):
    runs, rows, lost, n = D.Runs(), [], [], 0
    for batch in batches:
        keys = D._wide(np.array([k for k, _ in batch], "i8"), np.zeros(len(batch), "i8"))
        held = np.array([(at, n + i) for i, (_, at) in enumerate(batch)], D._HELD)
        rows += [(k, at, n + i) for i, (k, at) in enumerate(batch)]
        n += len(batch)
        lost += [int(x) for a in runs.ingest(keys, held) for x in a]
    keep = {min((at, i) for k2, at, i in rows if k2 == k)[1] for k, _, _ in rows}
    assert sorted(lost) == sorted(i for _, _, i in rows if i not in keep)


def test_empty_nulls_and_clashing_columns(session_rows, zones):
    assert D.surplus_copies(session_rows([]), zones([])).count() == 0
    rows = [{"record_id": None}, {"record_id": 1}, {"record_id": 2}, {"record_id": 3, "uuid": "  "}]
    out = D.surplus_copies(session_rows(rows, "k1 long, prefix string, lost boolean, instant_us long"), zones([]))
    assert sorted(r[0] for r in out.collect()) == [2, 3]


KEYED = "record_id long, k1 long, k2 long, received_at timestamp, batch_no int"


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_index_opened_again(spark, tmp_path):
    """A second object on the folder knows what the first one took in, prefixes included."""
    keyed = spark.createDataFrame([(i, 7 * k << 20, k, None, 1) for i, k in enumerate([1, 2, 3, 4] * 3)], KEYED)
    path = f"file://{tmp_path}/index"
    first = D.IdentifierIndex(spark, path, rows_expected=5 * D.BUCKET_ROWS)
    assert first.ingest(keyed.filter("record_id < 4")).count() == 0
    (tmp_path / "index" / "data-broken").mkdir()  # an ingestion that broke off
    again = D.IdentifierIndex(spark, path)
    assert again.prefixes == 5
    assert ids(again.ingest(keyed.filter("record_id between 4 and 7"))) == [4, 5, 6, 7]
    assert ids(D.IdentifierIndex(spark, path, rows_expected=1).ingest(keyed.filter("record_id > 7"))) == [8, 9, 10, 11]
    again.versions.sweep()
    assert not (tmp_path / "index" / "data-broken").exists() and ids(again.ingest(keyed.filter("record_id < 8"))) == [4, 5, 6, 7]


def test_runs_are_merged_and_prefixes_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_ROWS", 10)
    rnd, rows = random.Random(2), []
    for i in range(240):
        k = rnd.randrange(100)
        rows.append((i, (k * 0x9E3779B97F4A7C15 & (2**64 - 1)) - 2**63, k, T0 + dt.timedelta(seconds=rnd.randrange(99)), i // 30))
    keyed, path, lost = spark.createDataFrame(rows, KEYED).cache(), f"file://{tmp_path}/index", []
    for b in range(8):
        index = D.IdentifierIndex(spark, path)
        lost += ids(index.ingest(keyed.filter(f"batch_no = {b}")))
        assert len(index.versions.newest()[1]["data"]) <= D.MERGE_RUNS
    best = {}
    for i, _, k, at, _ in rows:
        best.setdefault(k, []).append((at, i))
    assert sorted(lost) == sorted(i for v in best.values() for _, i in sorted(v)[1:])
    assert index.prefixes >= 8
    keyed.unpersist()


def test_a_small_batch_writes_little(spark, tmp_path):
    keyed = spark.range(200_000).selectExpr("id as record_id", "xxhash64(id) as k1", "id as k2", "cast(null as timestamp) as received_at", "1 as batch_no")
    path = f"file://{tmp_path}/index"
    size = lambda d: sum(f.stat().st_size for f in (tmp_path / "index" / d).iterdir())
    index = D.IdentifierIndex(spark, path)
    index.ingest(keyed)
    index.ingest(keyed.filter("record_id < 2000").selectExpr("record_id + 1000000 as record_id", "xxhash64(record_id, 1) as k1", "k2", "received_at", "batch_no"))
    whole, small = index.versions.newest()[1]["data"]
    assert size(small) < size(whole) / 30


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The one that is overtaken looks its rows up again in what the other has brought."""
    keyed = spark.createDataFrame([(i, k << 20, k, None, 1) for i, k in enumerate([1, 2, 1, 2])], KEYED)
    path = f"file://{tmp_path}/index"
    a, b = D.IdentifierIndex(spark, path), D.IdentifierIndex(spark, path)
    add, overtaken = a.versions.add, []

    def late(number, state):
        if not overtaken:
            overtaken.append(ids(b.ingest(keyed.filter("record_id >= 2"))))
        return add(number, state)

    monkeypatch.setattr(a.versions, "add", late)
    assert ids(a.ingest(keyed.filter("record_id < 2"))) == [2, 3] and overtaken == [[]]


def test_ingestions_make_no_difference(spark):
    cs, so = spark.read.parquet(f"{TESTDATA}/claude_session.parquet"), spark.read.parquet(f"{TESTDATA}/sources.parquet")
    assert ids(D.surplus_copies(cs, so, 1)) == ids(D.surplus_copies(cs, so, 7))

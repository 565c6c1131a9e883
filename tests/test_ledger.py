"""Problem 6, and the durable ledger."""

import datetime as dt
import random

from loomlog.operators import ledger as L

CHANGES = "change_id long, run_no int, attempt_no int, source_id string, disposition string, previous_byte_end long, committed_byte_end long, observed_size long, records_added long, run_state string, reported_at timestamp"
RECORDS = "src_record_id long, source_id string, line_no long, byte_start long, byte_len long, changed_run int, ends_line boolean, body_hash string, observed_at timestamp"


def test_random_against_brute(spark):
    rnd = random.Random(5)
    changes = [(i, rnd.randrange(1, 9), rnd.randrange(1, 3), rnd.choice(["hot", "b"]), rnd.choice(["source_appended", "source_rewritten", "source_rebuilt", "tail_incomplete"]), rnd.randrange(0, 500), rnd.randrange(0, 900), 0, 1, rnd.choice(["committed", "failed", None]), None) for i in range(60)]
    records = [(i, rnd.choice(["hot", "b", "c"]), i, i * 10, rnd.randrange(1, 30), rnd.randrange(1, 9), rnd.random() < 0.9, "h", None) for i in range(90)]
    ok = lambda r: any(c[3] == r[1] and c[9] == "committed" and c[1] >= r[5] and (0 if c[4] in L.WHOLE else c[5]) <= r[3] and r[3] + r[4] <= c[6] for c in changes)
    exp = sorted((r[1], r[3]) for r in records if r[6] and not ok(r))
    twice = spark.createDataFrame(changes + changes[:20], CHANGES), spark.createDataFrame(records + records[:30], RECORDS)
    assert sorted(map(tuple, L.pending_records(*twice).collect())) == exp


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], CHANGES)
    nulls = spark.createDataFrame([tuple([None] * 11)], CHANGES)
    rec = spark.createDataFrame([(1, "s", 1, 0, 5, None, True, None, None), tuple([None] * 9), (2, None, 1, 0, 5, 1, True, None, None)], RECORDS)
    for changes in (none, nulls):
        assert sorted(map(str, map(tuple, L.pending_records(changes, rec).collect()))) == ["('s', 0)", "(None, 0)"]
    assert L.pending_records(none, spark.createDataFrame([], RECORDS)).count() == 0


def test_leases_fencing_and_retries(spark):
    led = L.WorkLedger(spark)
    items = spark.createDataFrame([("s", 0, 10), ("s", 10, 20)], "source_id string, from_byte long, to_byte long")
    led.offer(items)
    led.offer(items)
    assert led.table().count() == 2
    first = led.lease(now=0, seconds=10).collect()
    assert len(first) == 2 and led.lease(now=5, seconds=10).count() == 0
    second = led.lease(now=11, seconds=10).collect()  # the first lease expired
    assert {r["token"] for r in second} == {2} and {r["output"] for r in first} == {r["output"] for r in second}
    stale = spark.createDataFrame([(r["source_id"], r["from_byte"], r["to_byte"], r["token"]) for r in first], "source_id string, from_byte long, to_byte long, token long")
    assert led.commit(stale, now=12).count() == 2
    fresh = spark.createDataFrame([(r["source_id"], r["from_byte"], r["to_byte"], r["token"]) for r in second[:1]], stale.schema)
    assert led.commit(fresh, now=12).count() == 0
    assert led.table().filter("state = 'done'").count() == 1
    assert led.lease(now=30, seconds=10).count() == 1


KEYS = "source_id string, from_byte long, to_byte long"


def test_ledger_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    led = L.WorkLedger(spark, path)
    led.offer(spark.createDataFrame([("s", 0, 10), ("s", 10, 20)], KEYS))
    held = led.lease(now=0, seconds=10).orderBy("from_byte").collect()
    done = spark.createDataFrame([(*held[0][:3], 1)], KEYS + ", token long")
    assert led.commit(done, now=1).count() == 0
    (tmp_path / "ledger" / "data-broken").mkdir()  # a change that broke off
    again = L.WorkLedger(spark, path)
    assert again.version == led.version and sorted(r["state"] for r in again.table().collect()) == ["done", "leased"]
    assert again.commit(done, now=2).count() == 1
    assert [r["token"] for r in again.lease(now=11, seconds=10).collect()] == [2]
    assert again.commit(spark.createDataFrame([(*held[1][:3], 1)], KEYS + ", token long"), now=12).count() == 1
    again.versions.sweep()
    assert not (tmp_path / "ledger" / "data-broken").exists() and again.table().count() == 2


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """Both lease at one time: every item goes to one of them, under one token."""
    path = f"file://{tmp_path}/ledger"
    a, b = L.WorkLedger(spark, path), L.WorkLedger(spark, path)
    a.offer(spark.createDataFrame([("s", i, i + 1) for i in range(4)], KEYS))
    add, other = a.versions.add, []

    def late(number, state):
        if not other:
            other.extend(b.lease(now=0, seconds=10, most=3).collect())
        return add(number, state)

    monkeypatch.setattr(a.versions, "add", late)
    mine = a.lease(now=0, seconds=10).collect()
    assert len(other) == 3 and len(mine) == 1 and {r["from_byte"] for r in other}.isdisjoint({r["from_byte"] for r in mine})
    # a commit under a lease that expires while another takes the item over
    monkeypatch.setattr(a.versions, "add", add)
    assert b.lease(now=20, seconds=10).count() == 4
    stale = spark.createDataFrame([(*r[:3], r["token"]) for r in other], KEYS + ", token long")
    assert a.commit(stale, now=21).count() == 3 and a.table().filter("state = 'done'").count() == 0


def test_changed_items_and_merged_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MERGE_CHANGES", 3)
    led, token = L.WorkLedger(spark, f"file://{tmp_path}/l"), KEYS + ", token long"
    for revision in range(3):
        led.offer(spark.createDataFrame([("s", 0, 10, revision)], KEYS + ", revision int"))
        got = led.lease(now=revision, seconds=10).collect()
        assert [(r["token"], r["revision"]) for r in got] == [(revision + 1, revision)]
        assert led.commit(spark.createDataFrame([("s", 0, 10, revision + 1)], token), now=revision).count() == 0
        led.offer(spark.createDataFrame([("s", 0, 10, revision)], KEYS + ", revision int"))
        assert led.lease(now=revision, seconds=10).count() == 0
    assert len(led.versions.newest()[1]["data"]) <= 4 and led.table().count() == 1


def test_open_attempts_hold_their_lease(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h, tzinfo=dt.timezone.utc)
    row = lambda i, start, state, hour, attempt=1: (i, 1, attempt, "s", "source_appended", start, start + 5, 0, 1, state, at(hour))
    changes = spark.createDataFrame([row(1, 0, None, 1), row(2, 5, None, 9), row(3, 10, None, 9), row(4, 10, "failed", 9, 2), row(5, 15, "committed", 1), row(6, 15, None, 9, 2)], CHANGES)
    got = {r["from_byte"]: r["state"] for r in L.ledger(changes).collect()}
    assert got == {0: "pending", 5: "leased", 10: "pending", 15: "done"}
    led = L.WorkLedger(spark)
    led.enter(changes)
    led.enter(changes)
    assert {r["from_byte"]: r["state"] for r in led.table().collect()} == got
    assert led.lease(now=at(10).timestamp(), seconds=10).count() == 2

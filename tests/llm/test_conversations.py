"""Problem 4 against a plain version."""

import datetime as dt

import pytest

from loomlog.llm import conversations as C
from loomlog.operators import deliveries
from tests.conftest import TESTDATA

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def row(i, session, speaker, at, text="x", **k):
    return {"record_id": i, "source_id": "l", "line_no": i, "session_id": session, "record_type": speaker, "msg_role": speaker, "item_type": "text", "item_text": text, "uuid": f"u{i}", "written_at": f"2026-01-01T00:{at // 60:02d}:{at % 60:02d}Z", "received_at": T0} | k


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["session_id"], []).append(r)
    out = []
    for s, rs in by.items():
        own = {x["uuid"].strip().lower() for x in rs if x.get("uuid")}
        m = [x for x in rs if x["record_type"] in ("user", "assistant") and not x.get("is_sidechain") and not x.get("is_meta") and not x.get("is_compact_summary") and x["item_type"] in (None, "text") and (x["item_text"] or "").strip() or x["record_type"] == "attachment" and (x.get("attachment_prompt") or "").strip()]
        m.sort(key=lambda x: (x["written_at"], x["source_id"], x["line_no"]))
        if not m or any(x.get("parent_uuid") and x["parent_uuid"].strip().lower() not in own for x in rs) or any(x["record_type"] != "attachment" and x["msg_role"] != x["record_type"] for x in m):
            continue
        if m[0]["record_type"] == "assistant" or m[-1]["record_type"] != "assistant":
            continue
        out += [(s, i + 1, x["record_id"]) for i, x in enumerate(m)]
    return sorted(out)


def test_by_hand(session_rows, zones):
    rows = [
        row(1, "good", "user", 5), row(2, "good", "assistant", 9, parent_uuid=" U1 "), row(3, "good", "assistant", 9), row(4, "good", "user", 2000, item_type=None), row(5, "good", "assistant", 3000),
        row(6, "good", "user", 4000, is_meta=True), row(7, "good", "assistant", 4000, item_type="tool_use", item_text=None), row(8, "good", "assistant", 1, text=" \n\u3000"),
        row(10, "lost", "user", 1, parent_uuid="gone"), row(11, "lost", "assistant", 2),
        row(20, "lost2", "user", 1), row(21, "lost2", "assistant", 2), row(22, "lost2", "system", 3, parent_uuid="gone", msg_role=None, item_text=None),
        row(30, "role", "user", 1, msg_role="assistant"), row(31, "role", "assistant", 2), row(40, "role2", "user", 1), row(41, "role2", "assistant", 2, msg_role=None),
        row(50, "opens", "assistant", 1), row(51, "opens", "user", 2), row(52, "opens", "assistant", 3), row(60, "ends", "assistant", 2), row(61, "ends", "user", 1), row(62, "ends", "user", 9),
        row(70, "blank", "user", 1, text=""), row(71, "blank", "assistant", 1, text=None), row(80, "queue", "attachment", 1, item_text=None, item_type=None, attachment_prompt="p", msg_role=None), row(81, "queue", "assistant", 2),
        row(90, "far", "user", 1), row(91, "far", "assistant", 2, written_at="2026-09-01T00:00:00Z"),
    ]
    again = dict(rows[1], record_id=99, received_at=T0 + dt.timedelta(1), source_id="m", line_no=1)
    got = C.conversations(session_rows([*rows, again]), zones([])).select("session_id", "turn_no", "record_id").collect()
    assert sorted(map(tuple, got)) == plain(rows) and {r[0] for r in plain(rows)} == {"good", "queue", "far"}


def test_table(spark):
    cs, so = spark.read.parquet(f"{TESTDATA}/claude_session.parquet"), spark.read.parquet(f"{TESTDATA}/sources.parquet")
    kept = deliveries.first_copies(deliveries.copy_keys(cs, so), [*cs.columns, "instant_us"]).collect()
    rows = [r.asDict() | {"written_at": -1 if r.instant_us is None else r.instant_us} for r in kept]
    got = sorted(tuple(r) for r in C.conversations(cs, so).select("session_id", "turn_no", "record_id").collect())
    assert got == plain(rows) and len(got) > 50


@pytest.mark.parametrize("stretch", ["10 seconds", "1 day"])
def test_stretches_make_no_difference(spark, session_rows, zones, stretch):
    rows = [row(i, "hot", "user" if i % 2 else "assistant", i * 3) for i in range(1, 401)]
    got = C.conversations(session_rows(rows), zones([]), stretch).select("session_id", "turn_no", "record_id").collect()
    assert sorted(map(tuple, got)) == [("hot", i, i) for i in range(1, 401)]


def test_empty_nulls_and_clashing(session_rows, zones):
    assert C.conversations(session_rows([]), zones([])).count() == 0
    assert C.conversations(session_rows([{}, {"record_id": 1}], "speaker string, own long, k1 long, event_time timestamp"), zones([])).count() == 0
    rows = [row(1, None, "user", 1), row(2, None, "assistant", 2, written_at="n/a"), row(3, None, "assistant", 3)]
    assert C.conversations(session_rows(rows), zones([])).count() == 0  # the unreadable time comes first, so the assistant opens


def test_undated_messages_come_first_in_the_order_of_their_place(session_rows, zones, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [row(1, "s", "assistant", 50), row(2, "s", "user", 40)]
    rows += [row(i, "s", "user", 0, written_at=None, line_no=n, source_id=log, received_at=at(h)) for i, log, n, h in [(3, "b", 2, 1), (4, "b", 1, 30), (5, "a", 9, 90), (6, "a", 3, 2), (7, "a", 2, 400), (8, "a", 2, 1)]]
    rows += [row(9, "t", "user", 1, parent_uuid="u10"), row(10, "t", "assistant", 3000), row(11, "u", "user", 1, parent_uuid="u10"), row(12, "u", "assistant", 3000)]
    got = [tuple(r) for r in C.conversations(session_rows(rows), zones([])).orderBy("session_id", "turn_no").select("session_id", "turn_no", "record_id").collect()]
    assert got == [("s", i + 1, r) for i, r in enumerate([7, 8, 6, 5, 4, 3, 2, 1])] + [("t", 1, 9), ("t", 2, 10)]


def test_live_stream(spark, session_rows, zones, tmp_path):
    """Batches out of order: conversations come out before the end, late messages are buffered, too late ones counted, and a restart goes on."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    n = 0
    (tmp_path / "in").mkdir()

    def arrive(*rows):
        nonlocal n
        n += 1
        session_rows(list(rows)).coalesce(1).write.parquet(f"{tmp_path}/part{n}")
        next((tmp_path / f"part{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")

    stream = spark.readStream.schema(session_rows([]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start = lambda: C.Live(stream, zones([]), f"file://{tmp_path}/out", delay="30 minutes", idle="1 hour")
    out = lambda x: sorted(tuple(r) for r in x.conversations().select("session_id", "turn_no", "record_id").collect())
    m = lambda i, s, who, minute, **k: row(i, s, who, 0, written_at=f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", **k)
    arrive(m(2, "a", "assistant", 10, parent_uuid="u1"), m(5, "b", "user", 1))
    live = start()
    live.process()
    assert out(live) == []
    arrive(m(1, "a", "user", 5), m(2, "a", "assistant", 10, source_id="moved", line_no=9), m(9, "hot", "user", 12))  # late, and again
    live.process()
    assert out(live) == []
    arrive(m(20, "clock", "user", 200), m(21, "clock", "assistant", 250))  # time goes on: a and b are closed, b without an answer
    live.process()
    assert out(live) == [("a", 1, 1), ("a", 2, 2)]
    assert {(r.session_id, r.reason) for r in live.verdicts().filter("not kept").collect()} == {("b", "unanswered"), ("hot", "unanswered")}
    arrive(m(6, "b", "assistant", 3))  # too late
    again = start()
    again.process()
    assert again.late == 1
    arrive(m(30, "a", "user", 400), m(31, "a", "assistant", 401), m(40, "end", "user", 900))
    arrive(m(41, "end", "assistant", 1200))
    again.process()
    assert out(again) == [("a", 1, 1), ("a", 1, 30), ("a", 2, 2), ("a", 2, 31), ("clock", 1, 20), ("clock", 2, 21)]

"""Every query with SQL against DuckDB; rules about pages and several queries; null and empty tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomlog.plans import ask, corpus, events, joins, said, search, sessions, timeline

from .conftest import TESTDATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TESTDATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple("NULL" if r[i] is None else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, TESTDATA)
    cur = duck.execute(SQL[name])
    names, rows = [c[0] for c in cur.description], cur.fetchall()
    if name.startswith("p2_"):  # entity tables have a column for each scalar that any row has; these tables are small
        keep = [i for i, n in enumerate(names) if n in df.columns or any(r[i] is not None for r in rows)]
        names, rows = [names[i] for i in keep], [tuple(r[i] for i in keep) for r in rows]
    assert sorted(df.columns) == sorted(names) and table(df.collect(), df.columns) == table(rows, names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, TESTDATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def ev(spark):
    df = events.session_events(spark.read.parquet(f"{TESTDATA}/claude_session.parquet"), spark.read.parquet(f"{TESTDATA}/sources.parquet")).cache()
    yield df
    df.unpersist()  # else later plans would read it


def test_several_queries_are_each_alone(ev):
    terms = ["flaky", "the", "FLAKY", "flaky"]
    both = search.matches(ev, terms, ignore_case=True)
    for t in set(terms):
        alone = search.matches(ev, [t], ignore_case=True)
        ids = lambda df: sorted(r[0] for r in df.select("event_index").collect())
        assert ids(both.filter(both.query == t)) == ids(alone)


@pytest.mark.parametrize("newest", [False, True])
def test_pages_join_up(ev, newest):
    hits = search.matches(ev, ["the"])
    whole = [r.event_index for r in search.page(hits, 200, 0, newest).collect()]
    parts = [r.event_index for i in range(0, 200, 37) for r in search.page(hits, 37, i, newest).collect()][: len(whole)]
    assert parts == whole


def test_bad_requests(ev):
    for call in (lambda: search.matches(ev, [""]), lambda: search.matches(ev, []), lambda: search.page(ev, 0), lambda: search.page(ev, 1, -1)):
        with pytest.raises(ValueError):
            call()


def test_null_and_empty_events(spark, session_rows, zones):
    nulls = events.session_events(session_rows([{}, {"record_id": 1, "record_type": "user"}, {"record_id": 2, "record_type": "user", "item_text": "", "session_id": "s"}]), zones([]))
    none = events.session_events(session_rows([]), zones([]))
    assert [(r.kind, r.sender, r.event_date) for r in nulls.collect()] == [("unknown", "system", "undated"), ("user", "system", "undated"), ("user", "system", "undated")]
    for df in (nulls, none):
        for f in (said.with_reply_before, said.replies_after, said.turns):
            assert f(df).count() >= 0
        assert search.facets(search.matches(df, ["x"]), ["session", "kind"]).count() == 0


def test_budgets():
    rows = [{"human_text": "a" * 10}, {"human_text": "b" * 10, "context": "c" * 5}, {"human_text": "d"}]
    assert [len(r["human_text"]) for r in said.budget_page(rows, 4)] == [4] and len(said.budget_page(rows, 25)) == 2
    kept = ask.within_budget([{"text": "x" * 100}, {"text": "y" * 100}, {"text": "z"}], budget=230)
    assert [r["text"][0] for r in kept] == ["x", "z"]
    assert ask.month_quota({"a": 10, "b": 2, "c": 100}, 30) == {"a": 8, "b": 2, "c": 20}


def test_screen_failures(spark):
    class Broken(ask.LexicalScorer):
        def screen(self, question, texts):
            raise RuntimeError

    pieces = spark.createDataFrame([(i, 0, 0, "t") for i in range(6)], "event_index long, piece_no int, start int, piece_text string").coalesce(1)
    assert sorted(str(r.score) for r in ask.screened(pieces, "q", Broken()).collect()) == ["2", "2", "None", "None", "None", "None"]


def test_corpus_events_feed_the_plans(spark, tmp_path):
    log = tmp_path / ".claude/projects/p/a.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text('{"type":"user","sessionId":"S","message":{"role":"user","content":"find the needle"}}\n')
    c = corpus.Corpus(spark, str(tmp_path / "c"))
    c.sync([str(tmp_path / ".claude")])
    log.write_text(log.read_text() + '{"type":"assistant","sessionId":"S","timestamp":"2026-01-01T23:30:00Z","cwd":"/w/x/y","message":{"role":"assistant","content":[{"type":"text","text":"a need"},{"type":"text","text":"le"}]}}\n')
    c.sync([])
    ev = corpus.Corpus(spark, str(tmp_path / "c"), "Asia/Tokyo").events()
    assert [(r["event_date"], r["project"]) for r in ev.orderBy("line").collect()] == [("undated", None), ("2026-01-02", "x/y")]
    assert [(r["line"], r["field"]) for r in search.field_matches(ev, ["needle", "NEED"], ignore_case=True).orderBy("line", "query").collect()] == [(1, "/message/content"), (1, "/message/content"), (2, "/message/content/0/text")]
    assert search.matches(ev, ["needle"]).count() == 1 and said.replies_after(ev).first()["replies"] == 1 and sessions.summary(ev).count() == 1 and timeline.date_map(ev).count() == 2


def test_bounds(spark):
    rows = spark.createDataFrame([(i, us, "undated" if us is None else day) for i, us, day in [(1, 1_767_225_600_000_000, "2026-01-01"), (2, 1_767_229_199_999_999, "2026-01-01"), (3, 1_767_229_200_000_000, "2026-01-01"), (4, None, None), (5, 1_767_312_000_000_000, "2026-01-02")]], "event_index int, instant_us long, event_date string")
    found = lambda **k: [r[0] for r in search.where(rows, **k).orderBy("event_index").collect()]
    assert found(since="2026-01-01") == [1, 2, 3, 5] and found(until="2026-01-01") == [1, 2, 3] and found() == [1, 2, 3, 4, 5]
    assert found(since="2026-01-01T01:00:00Z") == [3, 5] and found(since="2026-01-01T02:00:00", zone="Europe/Berlin") == [3, 5] and found(until="2026-01-01T00:59:59.999999+00:00") == [1, 2]
    for bad in ("2026-02-30", "yesterday", "", "2026-01-01T25:00:00Z"):
        with pytest.raises(ValueError):
            search.where(rows, since=bad)


def test_page_facts(spark):
    rows = spark.createDataFrame([(i, i, None, "s") for i in range(7)] + [(9, None, w, "s") for w in ("b", "", None, "a")], "event_index int, instant_us long, written string, source_id string")
    at = lambda **k: [(r.event_index, r.position, r.truncated, r.next_offset) for r in search.page_with_facts(rows, **k).orderBy("position").collect()]
    assert at(limit=2, offset=3) == [(3, 4, True, 5), (4, 5, True, 5)] and at(limit=5, offset=8)[0][2:] == (False, None) and at(limit=3, offset=50) == []
    assert [r.written for r in search.page(rows, 20).collect()][7:9] == ["a", "b"] and [r.event_index for r in search.page(rows, 3, newest_first=True).collect()] == [6, 5, 4]


def test_answers_to_two_questions_are_two_messages(spark):
    ddl = "source_id string, event_index int, instant_us long, written string, via string, call_id string, human_text string"
    rows = [("s", 1, 5, "t", "question_reply", "a", "yes"), ("s", 2, 5, "t", "question_reply", "b", "yes "), ("s", 3, 5, "t", "question_reply", "a", " yes"), ("s", 4, 5, "t", "typed", "a", "no"), ("s", 5, 5, "u", "typed", "b", "no"), ("s", 6, None, "u", "typed", None, "no"), ("s", 7, None, "v", "typed", None, "no"), ("s", 8, None, "v", "typed", None, "no")]
    got = {r.event_index: r.copies for r in said.first_copies(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: 2, 2: 1, 4: 2, 6: 1, 7: 2}


def test_joins_with_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "gone", "z")], "event_index int, source_id string, app string")
    sources = spark.createDataFrame([("a", "claude", "/p"), ("a", "claude", "/q"), (None, "codex", "/r")], "source_id string, app string, log_path string")
    assert [(r.event_index, r.app, r.log_app, r.log_path) for r in joins.with_source(rows, sources).orderBy("event_index").collect()] == [(1, "x", "claude", "/p"), (2, "y", None, None), (3, "z", None, None)]
    assert joins.answered(spark.createDataFrame([], "session string, call_id string, kind string, event_index int")).count() == 0
    got = joins.as_of(spark.createDataFrame([(1, "u", 1), (2, "u", 2), (3, "v", 1)], "id int, u string, ts int"), F.lit(True), "id", "u", ["ts"], "before").collect()
    assert {r.id: r.before for r in got} == {1: None, 2: 1, 3: None}

"""The question pipeline on the test table."""

import json
from datetime import datetime

import pytest

from loomlog.plans import answer as A
from loomlog.plans import ask, events

from .conftest import TESTDATA


@pytest.fixture(scope="module")
def ev(spark):
    df = events.session_events(spark.read.parquet(f"{TESTDATA}/claude_session.parquet"), spark.read.parquet(f"{TESTDATA}/sources.parquet")).cache()
    yield df
    df.unpersist()  # else later plans would read it


class Writer:
    def __init__(self, *replies):
        self.replies = list(replies)

    def write(self, question, blocks):
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply(blocks) if callable(reply) else reply


def test_evidence_only(ev):
    r = A.answer(ev, "Which flaky migration needs another reviewer")
    assert r.disposition == "evidence_only" and r.evidence and all("flaky" in e["text"].lower() or "migration" in e["text"].lower() or e["score"] for e in r.evidence)
    assert len({e["event_index"] for e in r.evidence}) == len(r.evidence) <= 40 and json.loads(r.to_json())["terms"] == r.terms
    assert A.as_text(r).startswith("evidence_only")


def test_answer_with_quotes(ev):
    def good(blocks):
        return {"answer": "yes", "findings": [{"evidence": 1, "quote": "flaky"}, {"evidence": 1, "quote": "never said by anyone"}]}

    r = A.answer(ev, "flaky", writer=Writer(RuntimeError(), good))
    assert r.answer == "yes" and [f["quote_verified"] for f in r.findings] == [True, False]
    assert A.answer(ev, "flaky", writer=Writer({"answer": 1}, {"findings": []})).disposition == "evidence_only"


def test_nothing_to_find(ev, session_rows, zones):
    assert A.answer(ev, "zzzzzzzz").disposition == "no_evidence" and A.answer(ev, "").disposition == "no_terms"
    assert A.answer(events.session_events(session_rows([]), zones([])), "flaky").disposition == "no_evidence"


def test_near_copies():
    assert A.without_near_copies([(False, "a b c"), (True, "A  B C"), (False, "d"), (False, "e"), (False, "f"), (False, "a b c")]) == ["A  B C", "d", "e", "f", "a b c"]


def test_spread_is_the_plan(spark):
    rows = [{"score": s, "session": x, "pos": i} for i, (s, x) in enumerate([(2, "a"), (2, "a"), (3, "b"), (2, "c"), (3, "b"), (2, "a")])]
    df = spark.createDataFrame([(r["score"], r["session"], r["pos"]) for r in rows], "score int, session string, pos int")
    assert [r["pos"] for r in A._spread(rows)] == [r["pos"] for r in ask.spread_order(df).collect()]


class Paraphrase:
    """Knows what the question means by other words than its terms."""

    def plan(self, question):
        return ["retry"]

    def screen(self, question, texts):
        return [3 if "give up after" in t or (question.startswith("retry") and "forget that rule" in t) else 1 if "retry" in t else 0 for t in texts]


def test_stages_of_the_answer(spark, session_rows, zones):
    base = {"source_id": "a", "session_id": "s", "record_type": "user", "msg_role": "user", "item_type": "text"}
    reply = base | {"record_type": "assistant", "msg_role": "assistant"}
    rows = [base | {"item_text": "x" * 900 + " give up after three attempts " + "y" * 500, "written_at": "2024-01-01T00:00:00Z"}]
    rows += [base | {"item_text": f"retry {i}", "written_at": f"2024-03-01T00:{i:02}:00Z"} for i in range(5)]
    rows += [reply | {"item_text": f"retry reply {i}", "written_at": f"2024-{'01' if i == 0 else '03'}-02T00:{i:02}:00Z"} for i in range(5)]
    rows += [base | {"item_text": "forget that rule", "written_at": "2024-04-01T00:00:00Z"}]
    ev = events.session_events(session_rows([r | {"record_id": i, "line_no": i, "uuid": str(i), "received_at": datetime.fromisoformat(r["written_at"])} for i, r in enumerate(rows)]), zones([])).cache()
    # The month's quota keeps an old reply that the newest two leave out.
    found = A.candidates(ev, ["retry"], A.Options(agent_per_term=2)).collect()
    assert {r["event_date"][:7] for r in found if r["sender"] != "human"} == {"2024-01", "2024-03"}
    # The sweep finds a message without any term, by a piece in its middle.
    r = A.answer(ev, "what is the limit", Paraphrase(), Writer({"answer": "3", "findings": [{"evidence": 1, "quote": "give up after three"}]}))
    assert r.evidence[0]["text"].startswith("xxx") and r.search["swept"] == 7 and r.search["swept_relevant"] == 1
    assert r.later == []
    w = Writer({"answer": "r", "findings": [{"evidence": 1, "quote": "retry 4"}]})
    r = A.answer(ev.filter("text not like 'x%'"), "limit", Paraphrase(), w, options=A.Options(closest=1))
    assert [x["text"] for x in r.later] == ["forget that rule"] and r.later[0]["after"] == "retry 4"
    ev.unpersist()

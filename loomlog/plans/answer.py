"""One question answered from records, step by step, with whatever judges and writes behind ``Scorer``.

Retrieval, selection and counting run as DataFrames; only a bounded page of candidates reaches the driver,
where it is read, screened and composed. Without a model the answer is the evidence.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import discard, settle
from . import ask, said, search, sessions


@dataclass
class Options:
    """Bounds of one question; each is what a reader of the answer can take in, none depends on the data's size."""

    terms: int = 16
    person_per_term: int = 60
    agent_per_term: int = 40
    candidates: int = 600
    read: int = 40
    closest: int = 8
    recent_sessions: int = 4
    recent_messages: int = 8
    before: int = 2
    after: int = 3
    digest_chars: int = 36_000
    unread: int = 12
    more_terms: int = 8
    rounds: int = 2
    claims: int = 6
    later: int = 12


class Writer(Protocol):
    def write(self, question: str, blocks: list[str]) -> dict: ...


@dataclass
class Report:
    question: str
    terms: list[str]
    disposition: str = "ready"
    answer: str | None = None
    findings: list[dict] = field(default_factory=list)
    evidence: list[dict] = field(default_factory=list)
    recent: list[dict] = field(default_factory=list)
    digest: list[dict] = field(default_factory=list)
    unread: list[dict] = field(default_factory=list)
    later: list[dict] = field(default_factory=list)
    search: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, ensure_ascii=False)


def _columns(events: DataFrame) -> DataFrame:
    return events.select("event_index", "source_id", "line", "session", "instant_us", "event_date", "sender", "via", "project", "text", "human_text", "reply_text")


def candidates(events: DataFrame, terms: list[str], options: Options) -> DataFrame:
    """The person's newest hits of each term and, as many as the agent's newest would be, the agent's rarest of each month; one row per record, ranked.

    What of the person's is older than that, or holds no term, is found by ``swept``.
    """
    variants = [v for t in terms for v in (t, *T.spacing_variants(t))]
    hits = search.matches(_columns(events), variants, ignore_case=True)
    person = ask.per_term(hits.filter("human_text is not null"), options.person_per_term).drop("rank")
    replies = hits.filter("reply_text is not null")
    quota = ask.per_term(replies, options.agent_per_term).select("event_index").distinct().count()
    dated = ask.idf_scores(replies).withColumn("idf", F.round("idf", 9)).join(replies.select("event_index", "event_date", "instant_us").dropDuplicates(["event_index"]), "event_index")
    agent = replies.join(ask.select_by_month(dated, quota).select("event_index"), "event_index", "left_semi")
    both = person.unionByName(agent)
    found = ask.union_of_terms(both).join(both.dropDuplicates(["event_index"]).drop("query"), "event_index")
    return ask.ranked(found).limit(options.candidates)


def judged(messages: DataFrame, question: str, scorer: ask.Scorer) -> DataFrame:
    """(event_index, score) of every message, by its best piece; those without a score as 1, as if near."""
    return ask.best_piece(ask.screened(ask.sweep(messages), question, scorer)).select("event_index", F.coalesce("score", F.lit(1)).alias("score"))


def swept(events: DataFrame, question: str, scorer: ask.Scorer, options: Options) -> tuple[list[dict], int, int]:
    """Every message of the person's screened, whatever words it has: the best, how many were screened and how many of them are relevant (2 or 3)."""
    person = said.person(_columns(events)).filter(F.length(T.strip(F.col("human_text"))) > 0)
    scores = judged(person, question, scorer)
    scores = settle(scores, "swept")
    counts = scores.agg(F.count("*").alias("n"), F.count(F.when(F.col("score") >= 2, 1)).alias("relevant")).first()
    best = person.join(scores.filter("score >= 1"), "event_index").orderBy(F.desc("score"), F.desc_nulls_last("instant_us"), "event_index").limit(options.candidates)
    out = [r.asDict() for r in best.collect()]
    discard(scores)
    return out, counts["n"], counts["relevant"]


def later_messages(events: DataFrame, findings: list[dict], evidence: list[dict], scorer: ask.Scorer, options: Options) -> list[dict]:
    """What the person wrote after the records of verified findings and that a screen for the finding's quote finds relevant: it may undo them.

    Every later message is screened, not only those that hold a term; of what is relevant the findings take in turn.
    """
    by = {e["id"]: e for e in evidence}
    claims: list[tuple[int, int, int, str]] = []
    for f in findings:
        own = by.get(f["evidence"])
        if f["quote_verified"] and own and own["instant_us"] is not None and own["event_index"] not in {c[2] for c in claims} and len(claims) < options.claims:
            claims.append((len(claims) + 1, own["instant_us"], own["event_index"], f["quote"]))
    if not claims:
        return []
    person = said.person(_columns(events))
    after = ask.written_after(events.sparkSession.createDataFrame([c[:3] for c in claims], "claim int, instant_us long, event_index long"), person, options.claims)
    found = None
    for claim, *_, quote in claims:
        of = judged(person.join(after.filter(F.col("claim") == claim).select("event_index"), "event_index", "left_semi"), quote, scorer).filter("score >= 2").withColumn("claim", F.lit(claim))
        found = of if found is None else found.unionByName(of)
    placed = found.join(person.select("event_index", "instant_us"), "event_index").withColumn("pos", F.struct(-F.col("score"), "instant_us", "event_index"))
    taken = ask.take_in_turn(placed, options.later)
    rows = taken.join(person.select("event_index", "session", "event_date", "text"), "event_index").orderBy("turn", "claim", "event_index").collect()
    quotes = {c[0]: c[3] for c in claims}
    return [{k: r[k] for k in ("event_index", "session", "event_date", "text")} | {"after": quotes[r["claim"]]} for r in rows]


def recent_tail(events: DataFrame, options: Options) -> DataFrame:
    """The last messages of the latest sessions."""
    spoken = _columns(events).filter("human_text is not null or reply_text is not null")
    latest = spoken.groupBy("session").agg(F.max("instant_us").alias("ended")).orderBy(F.desc_nulls_last("ended"), "session").limit(options.recent_sessions)
    return ask.half_cap(spoken.join(F.broadcast(latest.select("session")), "session"), 2 * options.recent_messages, ["instant_us", "line", "event_index"], ["session"])


def without_near_copies(lines: list[tuple[bool, str]], last: int = 3) -> list[str]:
    """Shown lines without those that say what one of the ``last`` shown says; a hit replaces its copy."""
    shown: list[tuple[bool, str]] = []
    for hit, line in lines:
        key = T.normalized(line)
        again = next((i for i in range(max(0, len(shown) - last), len(shown)) if key and (key in T.normalized(shown[i][1]) or T.normalized(shown[i][1]) in key)), None)
        if again is None:
            shown.append((hit, line))
        elif hit and not shown[again][0]:
            shown[again] = (hit, line)
    return [line for _, line in shown]


def blocks(events: DataFrame, read: list[dict], options: Options) -> list[dict]:
    """Each record read with its neighbours in the log, near copies left out, long ones clipped around the terms."""
    if not read:
        return []
    wanted = events.sparkSession.createDataFrame([(r["event_index"],) for r in read], "event_index long")
    near = sessions.neighbours(events, F.broadcast(wanted), options.before, options.after)
    rows = near.join(events.select("event_index", "sender", "text"), "event_index").collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["hit"], r["distance"])):
        by.setdefault(r["hit"], []).append((r["distance"] == 0, f"{r['sender']}: {T.window(r['text'] or '', [], 600)}"))
    return [r | {"context": "\n".join(without_near_copies(by.get(r["event_index"], [])))} for r in read]


def valid_reply(reply: object) -> bool:
    """Whether a written answer has the shape asked for: an answer and findings with evidence and quote."""
    if not isinstance(reply, dict) or not isinstance(reply.get("answer"), str) or not isinstance(reply.get("findings"), list):
        return False
    return all(isinstance(f, dict) and isinstance(f.get("evidence"), int) and isinstance(f.get("quote"), str) for f in reply["findings"])


def written(writer: Writer, question: str, parts: list[str], tries: int = 2) -> dict | None:
    """The writer's reply, asked for again where it fails or has another shape; None in the end."""
    for _ in range(tries):
        try:
            reply = writer.write(question, parts)
        except Exception:  # a remote writer may fail in any way
            continue
        if valid_reply(reply):
            return reply
    return None


def answer(events: DataFrame, question: str, scorer: ask.Scorer | None = None, writer: Writer | None = None, terms: list[str] | None = None, options: Options | None = None) -> Report:
    scorer, options = scorer or ask.LexicalScorer(), options or Options()
    terms = T.distinct_terms(terms or scorer.plan(question), options.terms)
    report = Report(question, terms)
    if not terms:
        report.disposition = "no_terms"
        return report
    seen: dict[int, dict] = {}
    for round_no in range(options.rounds):
        ask_for = terms if round_no == 0 else _more_terms(list(seen.values()), terms, options)
        if not ask_for:
            break
        found = [r.asDict() for r in candidates(events, ask_for, options).collect()]
        new = [r for r in found if r["event_index"] not in seen]
        for i in range(0, len(new), 40):
            part = new[i : i + 40]
            for r, score in zip(part, scorer.screen(question, [r["text"] or "" for r in part]), strict=True):
                seen[r["event_index"]] = r | {"score": score}
        report.terms = T.distinct_terms([*report.terms, *ask_for], options.terms + options.more_terms)
        if any(r["score"] >= 2 for r in seen.values()):
            break
    best, screened, relevant_swept = swept(events, question, scorer, options)
    for r in best:
        # A message's score is that of its best piece, where one is better than the whole was.
        had = seen.get(r["event_index"])
        if had is None or r["score"] > had["score"]:
            seen[r["event_index"]] = (had or {}) | r
    pool = [r for r in seen.values() if r["score"] >= 1]
    relevant = _spread([r for r in pool if r["score"] >= 2]) or sorted(pool, key=lambda r: -r["score"])[: options.closest]
    read, rest = relevant[: options.read], relevant[options.read :]
    report.evidence = [{k: r[k] for k in ("event_index", "session", "sender", "event_date", "instant_us", "text", "score")} | {"id": i + 1, "context": r["context"]} for i, r in enumerate(blocks(events, read, options))]
    report.digest = ask.within_budget([{"event_index": r["event_index"], "text": r["text"] or ""} for r in rest], options.digest_chars)
    report.recent = [{"session": r["session"], "sender": r["sender"], "text": r["text"]} for r in recent_tail(events, options).collect()]
    sessions_read = events.sparkSession.createDataFrame([(r["session"],) for r in read], "session string")
    unread = ask.unread_sessions(said.person(events), F.broadcast(sessions_read)).orderBy(F.desc_nulls_last("ended"), "session").limit(options.unread)
    report.unread = [r.asDict() for r in unread.collect()]
    report.search = {"candidates": len(seen), "relevant": len(pool), "read": len(read), "left_out": len(rest) - len(report.digest), "swept": screened, "swept_relevant": relevant_swept}
    if not report.evidence:
        report.disposition = "no_evidence"
    elif writer and (reply := written(writer, question, [e["context"] for e in report.evidence])):
        report.answer = reply["answer"]
        report.findings = [_checked(f, report.evidence) for f in reply["findings"]]
        report.later = later_messages(events, report.findings, report.evidence, scorer, options)
    else:
        report.disposition = "evidence_only"
    return report


def _more_terms(rows: list[dict], had: list[str], options: Options) -> list[str]:
    """Words of the best records that were not searched yet, the longest first."""
    words = {w.strip(".,:;()[]\"'`") for r in sorted(rows, key=lambda r: -r["score"])[:10] for w in (r["text"] or "").split()}
    known = {t.lower() for t in had}
    return sorted((w for w in words if len(w) > 5 and w.lower() not in known), key=lambda w: (-len(w), w))[: options.more_terms]


def _spread(rows: list[dict]) -> list[dict]:
    """By score, then one session at a time, in the order found."""
    turns: dict[tuple, int] = {}
    first: dict[tuple, int] = {}
    keyed = []
    for pos, r in enumerate(rows):
        group = (r["score"], r["session"])
        turns[group] = turns.get(group, 0) + 1
        keyed.append(((-r["score"], turns[group], first.setdefault(group, pos)), r))
    return [r for _, r in sorted(keyed, key=lambda x: x[0])]


def _checked(finding: dict, evidence: list[dict]) -> dict:
    """A finding with whether its quote is in the record it names; else the first record that has it, the person's first."""
    by = {e["id"]: e for e in evidence}
    own = by.get(finding["evidence"])
    if own and T.quote_found(finding["quote"], own["text"] or ""):
        return finding | {"quote_verified": True}
    other = next((e for e in sorted(evidence, key=lambda e: e["sender"] != "human") if T.quote_found(finding["quote"], e["text"] or "")), None)
    return finding | {"evidence": other["id"] if other else finding["evidence"], "quote_verified": other is not None}


def as_text(report: Report) -> str:
    """The report for a reader."""
    lines = [report.answer or f"{report.disposition}: {len(report.evidence)} records on {', '.join(report.terms)}"]
    lines += [f"- {f['quote']} [{f['evidence']}]{'' if f['quote_verified'] else ' (not found)'}" for f in report.findings]
    lines += [f"[{e['id']}] {e['event_date']} {e['sender']}: {T.window(e['text'] or '', report.terms, 240)}" for e in report.evidence]
    return "\n".join(lines)

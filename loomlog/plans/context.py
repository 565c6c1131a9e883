"""Original records around an event, and text forms of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.flatten import flatten
from ..operators.classify import classify, describe, project, readable
from .corpus import Corpus
from .sessions import neighbours


def around(corpus: Corpus, source_id: str, byte_start: int, before: int = 0, after: int = 0) -> dict:
    """The record at ``byte_start`` and those around it, as they lie in the log, with how fresh the corpus is."""
    events = corpus.events().filter(F.col("source_id") == source_id)
    hit = events.filter(F.col("byte_start") == byte_start).select("event_index")
    near = neighbours(events, hit, before, after).select("event_index", "distance")
    rows = events.join(near, "event_index").select("line", "byte_start", "byte_len", "distance").orderBy("line").collect()
    fresh = corpus.freshness().filter(F.col("source_id") == source_id).first()
    records = [r.asDict() | {"raw": corpus.original(source_id, r["byte_start"], r["byte_len"]).decode("utf-8", "replace")} for r in rows]
    return {"source_id": source_id, "freshness": fresh["freshness"] if fresh else "unreachable", "records": records, "closes_on_record": bool(records) and records[-1]["raw"].endswith("\n")}


def as_text(records: list[dict], origin: str) -> str:
    """Records for a reader: one block each, unknown kinds left out."""
    out = []
    for r in records:
        record = project(classify(origin, describe(flatten(r["raw"]))), 0, r["raw"].encode())
        if record.kind != "unknown":
            label, text = readable(record)
            out.append(f"{label} {record.timestamp or 'undated'} line {r['line']}\n{text}")
    return "\n\n".join(out)


def to_json(df: DataFrame, names: list[str], empty_is_null: tuple[str, ...] = ()) -> DataFrame:
    """(json): rows as JSON objects with the keys in the order given; nulls are written, empty names are null."""
    columns = [F.nullif(F.col(n), F.lit("")).alias(n) if n in empty_is_null else F.col(n) for n in names]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def text_page(rows: list[dict], query: str | None = None) -> str:
    """Matches as lines: time, sender, session, and the text on one line around the query."""
    return "\n".join(f"{r.get('timestamp') or 'undated'} {r['sender']} {r['session']}: {' / '.join(T.window(r['text'] or '', [query] if query else [], 240).splitlines())}" for r in rows)


def export(df: DataFrame, names: list[str], path: str) -> None:
    """Write rows as JSON lines."""
    to_json(df, names).write.mode("overwrite").text(path)


def page_disposition(total: int, offset: int, returned: int) -> str:
    """How a page stands to the whole: empty, beyond the end, more to come, or complete."""
    return "no_match" if total == 0 else "result_page_empty" if returned == 0 else "result_page_truncated" if offset + returned < total else "ready"


def git_commits(repository: str) -> list[tuple[str, str, str]]:
    """(commit, author date, subject) of all commits a repository can reach, reflogs too."""
    import subprocess

    run = lambda *a, given="": subprocess.run(["git", "-C", repository, *a], input=given, capture_output=True, text=True, check=True).stdout
    ids = run("rev-list", "--all", "--reflog")
    return [tuple(x.split("\t", 2)) for x in run("log", "--no-walk", "--stdin", "--format=%H\t%aI\t%s", given=ids).splitlines()] if ids else []


def dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)

"""Logs on disk: discovery, the source, incremental sync, following."""

import json
import os
import socket

import pyarrow as pa
import pytest

from loomlog.plans import context
from loomlog.plans import corpus as corpus_module
from loomlog.plans.corpus import Corpus
from loomlog.sources import lines as lines_module
from loomlog.sources.discovery import app_of, collect, describe, fnv64, origin_of
from loomlog.sources.jsonl import register
from loomlog.sources.lines import read_range, records
from loomlog.streaming.follow import follow, messages, new_records


def line(i, role="user", text="hi", **k):
    return json.dumps({"type": role, "sessionId": "S", "uuid": f"u{i}", "timestamp": f"2026-01-01T00:00:{i:02d}Z", "cwd": "/w", "message": {"role": role, "content": text}, **k}) + "\n"


def log(tmp_path, name="p/a.jsonl", text=""):
    p = tmp_path / ".claude/projects" / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return p


def zst(path, data):
    with pa.output_stream(str(path), compression="zstd") as f:
        f.write(data)


def content(c):
    return [tuple(r) for r in c.events().orderBy("source_id", "line").select("line", "event_index", "byte_start", "byte_len", "session", "turn", "kind", "sender", "human_text", "reply_text").collect()]


def test_lines(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_bytes(b'{"a":1}\n\n{"b":"\xe3\x81\x82"}\nunfinished')
    assert [(n, at, size) for n, at, size, _, _ in records(str(p))] == [(1, 0, 8), (2, 8, 1), (3, 9, 12)]
    zst(tmp_path / "x.jsonl.zst", p.read_bytes())
    assert list(records(str(tmp_path / "x.jsonl.zst"))) == list(records(str(p)))
    assert list(records(str(tmp_path / "x.jsonl.zst"), 9, first_line=3)) == list(records(str(p), 9, first_line=3)) == list(records(str(p)))[2:]
    assert read_range(str(p), 9, 12) == read_range(str(tmp_path / "x.jsonl.zst"), 9, 12) == b'{"b":"\xe3\x81\x82"}\n'
    with pytest.raises(ValueError):
        read_range(str(p), 30, 500)


def test_discovery(tmp_path):
    a = log(tmp_path, "p/a.jsonl", line(1))
    zst(str(a) + ".zst", b"{}\n")
    zst(a.parent / "b.jsonl.zst", line(1).encode())
    (a.parent / "notes.txt").write_text("x")
    paths, found = collect([str(tmp_path), str(tmp_path / "none"), str(a.parent / "notes.txt"), f"file://{tmp_path}/./"])
    assert [os.path.basename(p) for p in paths] == ["a.jsonl", "b.jsonl.zst"]
    assert {f.availability for f in found} == {"present", "missing", "not_jsonl"}
    s = describe(paths)
    assert all(x.app == "claude" and x.source_id.startswith("claude-") for x in s) and len({x.source_id for x in s}) == 2
    assert fnv64("") == "cbf29ce484222325" and fnv64("a") == "af63dc4c8601ec8c"
    sub = log(tmp_path, "p/S/subagents/agent-1.jsonl", line(1))
    assert origin_of("claude", str(sub)) == "claude_subagent"
    c = tmp_path / "c.jsonl"
    c.write_text(json.dumps({"type": "session_meta", "payload": {"id": "x", "source": "exec"}}) + "\n")
    assert app_of(str(c)) == "codex" and origin_of("codex", str(c)) == "codex_exec"
    c.write_text(json.dumps({"type": "session_meta", "payload": {"id": "x", "source": {"subagent": {"a": 1}}}}) + "\n")
    assert origin_of("codex", str(c)) == "codex_child"


def test_source_and_damage(spark, tmp_path):
    register(spark)
    log(tmp_path, "p/a.jsonl", line(1) + line(2))
    broken = tmp_path / ".claude/projects/p/z.jsonl.zst"
    zst(broken, "".join(line(i % 60, text=os.urandom(2000).hex()) for i in range(2000)).encode())
    broken.write_bytes(broken.read_bytes()[:-1000])
    df = spark.read.format("loomlog_jsonl").load(str(tmp_path))
    n = {r["path"].rsplit("/", 1)[1]: r["count"] for r in df.groupBy("path").count().collect()}
    assert n["a.jsonl"] == 2 and 0 < n["z.jsonl.zst"] < 2000


def test_incremental_equals_rebuild(spark, tmp_path):
    whole = line(1) + line(2, "assistant", "ok") + line(3, text="more") + line(4, "assistant", "fine") + line(5)
    p = log(tmp_path, text=whole[:400])
    c = Corpus(spark, str(tmp_path / "corpus"))
    assert c.sync([str(tmp_path / ".claude")])["dispositions"] == {"tail_incomplete": 1}
    for cut in (500, 640, len(whole)):
        p.write_text(whole[:cut])
        c.sync([])
    grown = content(c)
    again = Corpus(spark, str(tmp_path / "other"))
    again.sync([str(tmp_path / ".claude")])
    assert grown == content(again) and len(grown) == 5
    assert c.sync([])["read"] == 0 and c.sync([], rebuild=True)["dispositions"] == {"source_rebuilt": 1} and content(c) == grown


def test_moved_rewritten_gone(spark, tmp_path):
    p = log(tmp_path, text=line(1) + line(2, "assistant", "ok"))
    c = Corpus(spark, str(tmp_path / "corpus"))
    c.sync([str(tmp_path / ".claude")])
    before = content(c)
    q = log(tmp_path, "q/a.jsonl", p.read_text())
    p.unlink()
    report = c.sync([])
    assert report["moved"] == 1 and content(c) == before and c.events().select("path").first()[0] == str(q)
    q.write_text(line(1, text="other words") + line(2, "assistant", "ok") + line(3))
    assert c.sync([])["dispositions"] == {"source_rewritten": 1}
    assert [r[8] for r in content(c)] == ["other words", None, "hi"]
    q.unlink()
    assert c.sync([])["gone"] == 1 and len(content(c)) == 3 and c.status()["freshness"] == {"unreachable": 1}


def test_failed_sync_leaves_nothing(spark, tmp_path, monkeypatch):
    p = log(tmp_path, text=line(1))
    c = Corpus(spark, str(tmp_path / "corpus"))
    c.sync([str(tmp_path / ".claude")])
    p.write_text(line(1) + line(2))
    monkeypatch.setattr(Corpus, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        c.sync([])
    assert len(content(c)) == 1
    monkeypatch.undo()
    c.sync([])
    assert len(content(c)) == 2


def test_lock_and_import(spark, tmp_path):
    log(tmp_path, text=line(1))
    c = Corpus(spark, str(tmp_path / "corpus"))
    (tmp_path / "corpus/LOCK").touch()
    with pytest.raises(RuntimeError):
        c.sync([])
    (tmp_path / "corpus/LOCK").unlink()
    assert len(c.import_logs(str(tmp_path / ".claude"), "old")["files"]) == 1
    with pytest.raises(ValueError):
        c.import_logs(str(tmp_path / ".claude"), "old")
    c.sync([])
    assert c.status()["imports"] == 1 and len(content(c)) == 1


def test_context(spark, tmp_path):
    log(tmp_path, text=line(1) + line(2, "assistant", "ok") + line(3, text="more"))
    c = Corpus(spark, str(tmp_path / "corpus"))
    c.sync([str(tmp_path / ".claude")])
    e = c.events().filter("line = 2").first()
    r = context.around(c, e["source_id"], e["byte_start"], 1, 0)
    assert [x["raw"] for x in r["records"]] == [line(1), line(2, "assistant", "ok")] and r["freshness"] == "current" and r["closes_on_record"]
    assert context.as_text(r["records"], "claude_main").splitlines()[1] == "hi"
    assert context.page_disposition(0, 0, 0) == "no_match" and context.page_disposition(5, 0, 5) == "ready" and context.page_disposition(5, 0, 2) == "result_page_truncated" and context.page_disposition(5, 9, 0) == "result_page_empty"
    out = context.to_json(c.events().filter("line = 1"), ["session", "via", "call_id"], ("session",)).first()[0]
    assert json.loads(out) == {"session": "S", "via": "typed", "call_id": None}


def test_stream(spark, tmp_path):
    p = log(tmp_path, text=line(1) + line(2, "assistant", "ok"))
    q = messages(new_records(spark, str(tmp_path)), "any").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert spark.table("followed").count() == 2
        with p.open("a") as f:
            f.write(line(3, "assistant", "later")[:-1])
        q.processAllAvailable()
        assert spark.table("followed").count() == 2
        with p.open("a") as f:
            f.write("\n" + line(4))
        q.processAllAvailable()
        assert [r[0] for r in spark.table("followed").orderBy("line").select("line").collect()] == [1, 2, 3, 4]
    finally:
        q.stop()


def test_follow(tmp_path):
    p = log(tmp_path, text=line(1) + line(2, "assistant", "ok") + line(3, "assistant", "more"))
    first = follow(str(p), after_byte=0, seconds=0, limit=1)
    assert [m["text"] for m in first["messages"]] == ["ok"]
    second = follow(str(p), after_byte=first["after_byte"], seconds=0)
    assert [m["text"] for m in second["messages"]] == ["more"] and not follow(str(p), after_byte=second["after_byte"], seconds=0)["received"]
    p.write_text(p.read_text() + line(3, "assistant", "more") + line(5, "assistant", "new"))
    assert [m["text"] for m in follow(str(p), after_byte=second["after_byte"], seconds=0)["messages"]] == ["new"]
    assert follow(str(p), after_byte=0, seconds=0, sender="any", prefix="hi")["messages"][0]["sender"] == "human"


def test_oversized_records_keep_their_beginning(spark, tmp_path, monkeypatch):
    from loomlog.sources import lines

    p = log(tmp_path, text=line(1) + line(2, text="long " + "x" * 500) + line(3))
    monkeypatch.setattr(lines, "MOST_BYTES", 300)
    monkeypatch.setattr(corpus_module, "records", lambda *a, **k: lines.records(*a, **k))
    entry = corpus_module.Entry("s", "claude", "claude_main", str(p), "f", p.stat().st_size, 0, 0)
    rows = [dict(zip(corpus_module._ARROW.names, r, strict=True)) for r in corpus_module._read(entry)]
    assert [r["kind"] for r in rows] == ["user", "invalid", "user"] and rows[1]["body_cut"]
    assert rows[1]["fields"] == [("/raw", line(2, text="long " + "x" * 500)[:300] + "…[truncated]")]
    assert [m["text"] for m in follow(str(p), after_byte=0, seconds=0, sender="human")["messages"]] == ["hi", "hi"]


def test_lease_of_a_dead_writer_is_taken_over(spark, tmp_path, monkeypatch):
    log(tmp_path, text=line(1))
    c = Corpus(spark, str(tmp_path / "corpus"))
    lock = tmp_path / "corpus/LOCK"
    lock.write_text(json.dumps({"host": socket.gethostname(), "pid": 2**22 - 3}))
    assert c.sync([str(tmp_path / ".claude")])["read"] == 1 and not lock.exists()
    lock.write_text(json.dumps({"host": "elsewhere", "pid": 1}))
    with pytest.raises(RuntimeError):
        c.sync([])
    os.utime(lock, (1, 1))
    c.sync([])
    assert not lock.exists() and not list((tmp_path / "corpus").glob("LOCK*"))


def test_rebuild_of_one_log_and_moves_within_an_app(spark, tmp_path):
    a, b = log(tmp_path, "p/a.jsonl", line(1)), log(tmp_path, "p/b.jsonl", line(2))
    c = Corpus(spark, str(tmp_path / "corpus"))
    c.sync([str(tmp_path)])
    ident = next(e.source_id for e in c.catalog().values() if e.path == str(a))
    report = c.sync([], rebuild=[ident])
    assert report["read"] == 1 and report["dispositions"] == {"source_rebuilt": 1, "complete": 1} and len(content(c)) == 2
    other = tmp_path / ".codex/sessions/b.jsonl"
    other.parent.mkdir(parents=True)
    b.rename(other)
    assert c.sync([])["moved"] == 0


def test_originals_in_bulk(spark, tmp_path):
    a = log(tmp_path, "p/a.jsonl", "".join(line(i) for i in range(200)))
    z = a.with_name("z.jsonl.zst")
    zst(z, "".join(line(i, text=f"é{i}") for i in range(50)).encode())
    gone = log(tmp_path, "p/c.jsonl", line(1) + line(2))
    c = Corpus(spark, str(tmp_path / "corpus"))
    c.sync([str(tmp_path / ".claude")])
    gone.write_text(line(1))
    got = {(r["path"], r["line"]): bytes(r["raw"]).decode() if r["raw"] is not None else None for r in c.originals(c.events()).join(c.events().select("source_id", "event_index", "path", "line"), ["source_id", "event_index"]).collect()}
    assert got[str(a), 117] == line(116) and got[str(z), 50] == line(49, text="é49") and got[str(gone), 1] == line(1) and got[str(gone), 2] is None and len(got) == 252


def test_follow_reads_only_the_end(tmp_path, monkeypatch):
    from loomlog.streaming import follow as f

    p = log(tmp_path, text="".join(line(i) for i in range(5000)) + line(9, "assistant", "last"))
    read = []
    monkeypatch.setattr(f, "LOOK_BACK_BYTES", 2000)
    monkeypatch.setattr(f, "records", lambda path, start=0: read.append(start) or lines_module.records(path, start))
    assert not f.follow(str(p), seconds=0)["received"] and min(read) > p.stat().st_size - 4000
    at = p.stat().st_size - len(line(9, "assistant", "last")) + 3
    assert [m["text"] for m in f.follow(str(p), after_byte=at, seconds=0)["messages"]] == ["last"]

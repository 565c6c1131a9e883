"""Kinds, senders, projections and the fold over a log, record by record."""

import json

import pytest

from loomlog.functions.flatten import flatten
from loomlog.operators import classify as C
from loomlog.operators.fold import LogFold, LogState
from loomlog.operators.records import folded, headers, inherited


def rec(origin="claude_main", **body):
    return C.project(C.classify(origin, C.describe(flatten(json.dumps(body)))))


def msg(role, content, **k):
    return dict(type=role, message={"role": role, "content": content}, sessionId="S", uuid="u", timestamp="2026-01-01T00:00:00Z", **k)


CLAUDE = [
    (msg("user", "hello"), "user", "human", "typed"),
    (msg("user", [{"type": "text", "text": "hi"}, {"type": "image"}]), "user", "human", "typed"),
    (msg("user", [{"type": "image"}]), "user", "human", "typed"),
    (msg("user", "  "), "user", "system", "injected"),
    (msg("user", [{"type": "tool_result", "tool_use_id": "t", "content": "x"}]), "output", "system", "tool_result"),
    (msg("user", "summary of it", isCompactSummary=True), "summary", "summary", "compact_summary"),
    (msg("user", "This session is being continued from a previous conversation that"), "summary", "summary", "compact_summary"),
    (msg("user", "note", isMeta=True), "user", "system", "meta"),
    (msg("user", "do it", isSidechain=True), "user", "agent", "subagent_prompt"),
    (msg("user", "[Request interrupted by user for tool use]"), "user", "system", "interrupted"),
    (msg("user", "[Request interrupted by user]\nbut go on"), "user", "human", "typed"),
    (msg("user", "<task-notification>x"), "user", "system", "notification"),
    (msg("user", "<task-notifications>x"), "user", "human", "typed"),
    (msg("user", "<teammate-message id=1>x"), "user", "agent", "agent_message"),
    (msg("user", "<bash-stdout>x"), "user", "system", "command_output"),
    (msg("user", "<user-prompt-submit-hook>x"), "user", "system", "hook"),
    (msg("user", "<command-name>/x"), "user", "human", "slash_command"),
    (msg("user", "<bash-input>ls"), "user", "human", "shell_command"),
    (msg("user", "<system-reminder>r</system-reminder>"), "user", "system", "injected"),
    (msg("user", "brief", turnOrigin="sdk", entrypoint="claude-desktop"), "user", "agent", "session_brief"),
    (msg("user", "<side-sessions-event>x", turnOrigin="sdk", entrypoint="claude-desktop"), "user", "system", "notification"),
    (dict(type="attachment", attachment={"type": "queued_command", "prompt": "later"}, sessionId="S"), "user", "human", "queued"),
    (dict(type="attachment", attachment={"type": "todo", "content": "x"}, sessionId="S"), "unknown", "system", "attachment"),
    (dict(type="system", subtype="compact_boundary", sessionId="S"), "unknown", "system", "compact_boundary"),
    (dict(type="system", subtype="api_error", sessionId="S"), "unknown", "system", ""),
    (msg("assistant", [{"type": "text", "text": "ok"}]), "assistant", "assistant", ""),
    (dict(type="file-history-snapshot", sessionId="S"), "unknown", "system", ""),
]


@pytest.mark.parametrize("body,kind,sender,via", CLAUDE)
def test_claude(body, kind, sender, via):
    r = rec(**body)
    assert (r.kind, r.sender, r.via) == (kind, sender, via)


def item(kind, **p):
    return dict(type="response_item", payload=dict(type=kind, **p))


def said(role, text, kind="input_text"):
    return item("message", role=role, content=[{"type": kind, "text": text}])


CODEX = [
    ("codex_thread", said("user", "hi"), "user", "human", "typed"),
    ("codex_child", said("user", "hi"), "user", "agent", "codex_child"),
    ("codex_exec", said("user", "hi"), "user", "agent", "codex_exec"),
    ("codex_thread", said("user", "<environment_context>x"), "user", "system", "injected"),
    ("codex_thread", said("user", "# AGENTS.md instructions"), "user", "system", "instructions"),
    ("codex_thread", said("user", "<heartbeat>"), "user", "system", "automation"),
    ("codex_thread", said("user", "# Files mentioned by the user:\n\n## a.txt\n\n## My request for Codex:\nfix it"), "user", "human", "typed"),
    ("codex_thread", said("developer", "rules"), "unknown", "system", "instructions"),
    ("codex_thread", said("assistant", "done", "output_text"), "assistant", "assistant", ""),
    ("codex_thread", dict(type="event_msg", payload=dict(type="user_message", message="hi")), "user", "human", "typed"),
    ("codex_thread", dict(type="event_msg", payload=dict(type="agent_message", message="ok")), "assistant", "assistant", ""),
    ("codex_thread", item("function_call", name="shell", call_id="c", arguments="{}"), "command", "assistant", ""),
    ("codex_thread", item("function_call_output", call_id="c", output="x"), "output", "system", "tool_result"),
    ("codex_thread", dict(type="compacted", payload=dict(message="sum")), "summary", "summary", "compact_summary"),
    ("codex_thread", dict(type="compacted", payload=dict(message=" ")), "unknown", "system", "compact_boundary"),
    ("generic", dict(type="agent_message", text="x"), "assistant", "assistant", ""),
    ("generic", dict(type="apply_patch", patch="x"), "patch", "unknown", ""),
]


@pytest.mark.parametrize("origin,body,kind,sender,via", CODEX)
def test_codex_and_generic(origin, body, kind, sender, via):
    r = rec(origin, **body)
    assert (r.kind, r.sender, r.via) == (kind, sender, via)


def test_fields_keep_what_was_written():
    assert flatten('{"a":1e3,"b":1.50,"a":null,"c/d~":[true,{}],"e":"\\u3042"}') == [("/a", "1e3", "number"), ("/b", "1.50", "number"), ("/a", "null", "null"), ("/c~1d~0/0", "true", "boolean"), ("/e", "あ", "string")]
    for bad in ['{"a":NaN}', '{"a":"\\ud800"}', '{"a":"\t"}', '{"a":1} x', "[" * 300 + "]" * 300, "", b"\xff{}", "nul"]:
        assert flatten(bad) is None


def test_metadata_places():
    r = rec("generic", message={"timestamp": "t1", "content": {"cwd": "/hidden"}}, deep={"x": {"timestamp": "t2"}}, session_id="s", payload={"cwd": "/p"})
    assert (r.timestamp, r.cwd, r.session) == ("t1", "/p", "s")
    assert rec("generic", kind="session_meta", id="abc").session == "abc" and rec("generic", kind="turn_x", id="abc").turn == "abc"


def test_persons_words():
    assert C.person_text("/message/content", "<system-reminder>a</system-reminder>\n\nhi <system-reminder>b</system-reminder>  ") == "hi"
    assert C.person_text("/message/content", "a <system-reminder> never ends") == "a <system-reminder> never ends"
    assert C.person_text("/payload/message", '# Files pasted by the user:\n## "start of it": f.txt\n## My request:\ndo\nthis') == "start of it\ndo\nthis"
    assert C.person_text("/payload/content/0/text", "<image name=[Image #1] path=x>") is None


def test_projection():
    r = rec(**msg("assistant", [{"type": "thinking", "thinking": "secret", "signature": "x"}, {"type": "text", "text": "seen"}]))
    assert ("/message/content/1/text", "seen") in r.body and not any("secret" in v for _, v in r.body)
    long = C.project(C.classify("claude_main", C.describe(flatten(json.dumps(msg("user", [{"type": "tool_result", "content": "y" * 500}]))))))
    assert long.cut and any(v.endswith(C.TRUNCATED) and len(v) == 300 + len(C.TRUNCATED) for _, v in long.body)
    bad = C.project(C.describe(None), raw=b"\xffoops")
    assert bad.kind == "invalid" and bad.body == [("/raw", "�oops")]
    assert C.reply_text(r) == "seen" and C.is_compaction(rec(type="system", subtype="compact_boundary")) and C.is_completion(C.Record([], event_type="task_complete"))


def test_calls_and_history():
    r = rec(**msg("assistant", [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}]))
    assert C.tool_calls(r) == [("Bash", "command: ls")] and C.is_tool_call(r)
    h = rec("codex_thread", type="compacted", payload={"message": "m", "replacement_history": [{"role": "user", "turn_id": "1", "content": [{"text": "a"}]}, {"role": "assistant", "content": [{"text": "b"}]}]})
    assert C.embedded_messages(h) == [("user", "1", "a"), ("assistant", "", "b")]


def lines(*bodies):
    return [(json.dumps(b) + "\n").encode() for b in bodies]


def fold(origin, raws, state=None):
    f, at, out = LogFold(origin, "file", state), 0, []
    for raw in raws:
        out.append(f.take(raw, at))
        at += len(raw)
    return out, f.state


def test_turns_and_inheritance():
    raws = lines(dict(type="event_msg", payload={"type": "x"}), msg("user", "1", cwd="/w"), msg("assistant", "a"), msg("user", "2"), dict(type="user", message={"role": "user", "content": "3"}))
    out, _ = fold("claude_main", raws)
    assert [r.session for r in out] == ["file", "S", "S", "S", "S"] and [r.cwd for r in out] == [None, "/w", "/w", "/w", "/w"]
    ats = [sum(map(len, raws[:i])) for i in range(5)]
    assert [r.turn for r in out] == ["turn@0", f"turn@{ats[1]}", f"turn@{ats[1]}", f"turn@{ats[3]}", f"turn@{ats[4]}"]


def test_explicit_and_imported_turns():
    out, _ = fold("codex_thread", lines(dict(type="event_msg", payload={"type": "task_started", "turn_id": "external-import-turn-1"}), said("user", "copied"), said("user", "again"), dict(type="event_msg", payload={"type": "task_started", "turn_id": "T"}), said("user", "own")))
    assert [r.turn for r in out] == ["external-import-turn-1"] * 3 + ["T", "T"] and [r.via for r in out] == ["", "imported", "imported", "", "typed"]


def test_checkpoint_is_enough():
    raws = lines(*[b for b, *_ in CLAUDE], *[msg("user", str(i)) for i in range(5)])
    whole, _ = fold("claude_main", raws)
    head, state = fold("claude_main", raws[:11])
    f, at, tail = LogFold("claude_main", "file", LogState.load(state.dump())), sum(map(len, raws[:11])), []
    for raw in raws[11:]:
        tail.append(f.take(raw, at))
        at += len(raw)
    assert [(r.turn, r.session, r.cwd, r.via) for r in head + tail] == [(r.turn, r.session, r.cwd, r.via) for r in whole]


def test_answers_to_questions():
    ask = msg("assistant", [{"type": "tool_use", "id": "q", "name": "AskUserQuestion", "input": {"questions": [{"question": "Which?"}, {"question": "a/b"}]}}])
    reply = msg("user", [{"type": "tool_result", "tool_use_id": "q", "content": "ok"}]) | {"toolUseResult": {"answers": {"Which?": "blue", "a/b": " ", "other": "x"}}}
    out, state = fold("claude_main", lines(ask, reply, reply))
    assert (out[1].sender, out[1].via, out[1].kind, out[1].call_id, [v for _, v in out[1].body]) == ("human", "question_reply", "user", "q", ["blue"])
    assert out[2].sender == "system" and not state.questions
    error = msg("user", [{"type": "tool_result", "tool_use_id": "q", "is_error": True, "content": "x"}])
    assert [r.sender for r in fold("claude_main", lines(ask, error, reply))[0]][1:] == ["system", "system"]
    call = item("function_call", name="request_user_input", call_id="c", arguments='{"questions":[{"id":"k"}]}')
    ack = item("function_call_output", call_id="c", output='{"accepted":true}')
    answer = item("function_call_output", call_id="c", output='{"answers":{"k":{"answers":["yes"]}}}')
    out, _ = fold("codex_thread", lines(call, ack, answer))
    assert [r.via for r in out] == ["", "tool_result", "question_reply"]


def test_windows_say_the_same_as_the_fold(spark):
    from .conftest import TESTDATA

    raw = spark.read.parquet(f"{TESTDATA}/raw_records.parquet").dropDuplicates(["source_id", "line_no"])
    f = {(r["source_id"], r["line"]): (r["session"], r["turn"], r["cwd"], r["byte_start"]) for r in folded(raw).collect()}
    w = inherited(headers(raw)).collect()
    start = {k: v[3] for k, v in f.items()}
    differ = [r for r in w if (r["session"], f"turn@{start[r['source_id'], r['turn_line']]}", r["cwd"]) != f[r["source_id"], r["line"]][:3]]
    answered = {(r["source_id"]) for r in folded(raw).filter("via = 'question_reply'").collect()}
    assert [r for r in differ if r["source_id"] not in answered] == [] and len(f) == len(w)

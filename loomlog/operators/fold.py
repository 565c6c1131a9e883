"""What a record takes from those before it in its log: session, directory, turn, and answered questions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa

from ..functions.flatten import flatten
from .classify import IMPORTED_TURN, Record, classify, describe, project, reply_text, shape_of


@dataclass
class Turn:
    name: str
    has_user: bool = False


@dataclass
class LogState:
    """The checkpoint of a log; it is all that a later read needs. Plain data, so it can be stored as JSON."""

    session: str | None = None
    cwd: str | None = None
    index: int = 0
    turns: dict[str, list] = field(default_factory=dict)
    questions: dict[str, list[str]] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def load(cls, s: str | None) -> LogState:
        return cls(**json.loads(s)) if s else cls()


class LogFold:
    """Takes the records of one log in order."""

    def __init__(self, origin: str, fallback_session: str, state: LogState | None = None, output_chars: int = 300) -> None:
        self.origin, self.fallback, self.output_chars = origin, fallback_session, output_chars
        self.state = state or LogState()

    def take(self, raw: bytes, byte_start: int, oversized: bool = False) -> Record:
        """The record of one line; of an ``oversized`` one ``raw`` is the beginning, which is kept as it is, with a mark."""
        record = describe(None if oversized else flatten(raw))
        record.cut = oversized
        record = classify(self.origin, record)
        record = self._answered(record) or project(record, self.output_chars, raw)
        state = self.state
        record.session = state.session = record.session or state.session or self.fallback
        record.cwd = state.cwd = record.cwd or state.cwd
        record.turn = self._turn(record, byte_start)
        if record.sender == "human" and record.turn.startswith(IMPORTED_TURN):
            record.via = "imported"
        state.index += 1
        return record

    def _turn(self, record: Record, byte_start: int) -> str:
        """An explicit id holds; an imported turn lasts; else a start or a second user message opens a new one."""
        known = Turn(*self.state.turns[record.session]) if record.session in self.state.turns else None
        t = (record.event_type or "").lower()
        begins = known is None or "turn_start" in t or "turnstarted" in t or (record.opens_user_turn and known.has_user)
        if record.turn:
            name = record.turn
        elif known and (known.name.startswith(IMPORTED_TURN) or not begins):
            name = known.name
        else:
            name = f"turn@{byte_start}"
        has_user = record.opens_user_turn or bool(known and known.name == name and known.has_user)
        self.state.turns[record.session] = [name, has_user]
        return name

    def _answered(self, record: Record) -> Record | None:
        """A result that answers a question put to the person becomes the person's message."""
        answers = self._claude_answers(record) if self.origin.startswith("claude") else self._codex_answers(record) if self.origin.startswith("codex") else []
        if not answers:
            return None
        calls = [call for call, _ in answers]
        record.sender, record.via, record.kind, record.role = "human", "question_reply", "user", "user"
        record.call_id = calls[0] if len(calls) == 1 else json.dumps(calls)
        record.body = [(f"/answers/{i}", text) for i, text in enumerate(x for _, texts in answers for x in texts)]
        return record

    def _claude_answers(self, r: Record) -> list[tuple[str, list[str]]]:
        asks = r.value("/type") == "assistant"
        if not self.state.questions and not (asks and any(f[1] == "AskUserQuestion" for f in r.fields or ())):
            return []
        blocks = shape_of(r.fields).blocks if r.fields else []
        item = lambda i, leaf: r.text(f"/message/content/{i}/{leaf}")
        if asks:
            for i in blocks:
                if item(i, "type") == "tool_use" and (call := item(i, "id")):
                    self.state.questions.pop(call, None)
                    if item(i, "name") == "AskUserQuestion":
                        self._ask(call, _numbered(r, f"/message/content/{i}/input/questions", "question"))
            return []
        if r.value("/type") != "user":
            return []
        results = [i for i in blocks if item(i, "type") == "tool_result"]
        out = []
        for i in results:
            keys = self.state.questions.pop(item(i, "tool_use_id") or "", None)
            if keys is None or r.flag(f"/message/content/{i}/is_error") or r.flag("/isMeta"):
                continue
            texts = _answers(r, "/toolUseResult/answers", keys, "") if len(results) == 1 else []
            for encoded in ([r.text("/toolUseResult")] if len(results) == 1 else []) + [item(i, "content")]:
                if not texts and encoded and (inner := flatten(encoded)) is not None:
                    texts = _answers(Record(inner), "/answers", keys, "")
            if texts:
                out.append((item(i, "tool_use_id"), texts))
        return out

    def _codex_answers(self, r: Record) -> list[tuple[str, list[str]]]:
        call = r.text("/payload/call_id")
        if r.value("/type") != "response_item" or not call:
            return []
        what = r.value("/payload/type")
        if what in ("function_call", "custom_tool_call"):
            self.state.questions.pop(call, None)
            arguments = r.text("/payload/arguments") or r.text("/payload/input")
            if r.value("/payload/name") in ("request_user_input", "functions.request_user_input") and arguments and (inner := flatten(arguments)) is not None:
                self._ask(call, _numbered(Record(inner), "/questions", "id"))
        elif what in ("function_call_output", "custom_tool_call_output") and call in self.state.questions:
            inner = flatten(r.text("/payload/output") or "")
            reply = Record(inner) if inner is not None else None
            error = r.flag("/payload/is_error")
            if not error and reply and reply.flag("/accepted") and not any(p.startswith("/answers/") for p in reply.at):
                return []  # an acknowledgement leaves the question open
            keys = self.state.questions.pop(call)
            texts = _answers(reply, "/answers", keys, "/answers") if reply and not error else []
            return [(call, texts)] if texts else []
        return []

    def _ask(self, call: str, keys: list[str]) -> None:
        if call and keys:
            self.state.questions[call] = keys


def _numbered(r: Record, array: str, leaf: str) -> list[str]:
    out, i = [], 0
    while any(p.startswith(f"{array}/{i}/") for p in r.at):
        if value := r.text(f"{array}/{i}/{leaf}"):
            out.append(value)
        i += 1
    return list(dict.fromkeys(out))


def _answers(r: Record, root: str, keys: list[str], below: str) -> list[str]:
    """The answers to the questions ``keys``, each a text or a list of texts; blank ones are none."""
    out = []
    for key in keys:
        at = f"{root}/{key.replace('~', '~0').replace('/', '~1')}{below}"
        values = [r.text(at)] if not below and r.text(at) is not None else [v for p, v, k in r.fields or () if k == "string" and p.startswith(at + "/") and p[len(at) + 1 :].isdigit()]
        out += [v for v in values if v and v.strip()]
    return out


HEADER = "source_id string, line long, byte_start long, byte_len long, event_index long, session string, turn string, role string, kind string, event_type string, timestamp string, cwd string, repository string, call_id string, sender string, via string, body_cut boolean, fields array<struct<path:string,value:string>>, human_text string, images int, reply_text string"


def row(record: Record, source_id: str, line: int, byte_start: int, byte_len: int, index: int) -> tuple:
    person = "\n".join(v for _, v in record.body) if record.sender == "human" else None
    return (source_id, line, byte_start, byte_len, index, record.session, record.turn, record.role, record.kind, record.event_type, record.timestamp, record.cwd, record.repository, record.call_id,
            record.sender, record.via, record.cut, record.body, person, record.images, reply_text(record))


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as Arrow; the (path, value) lists are laid out by offsets, without an object per field."""
    columns = []
    for column, f in zip(zip(*rows, strict=True), schema, strict=True):
        if pa.types.is_list(f.type):
            sizes = [len(x or ()) for x in column]
            pairs = [p for x in column if x for p in x]
            inner = pa.StructArray.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())], names=["path", "value"])
            columns.append(pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), inner))
        else:
            columns.append(pa.array(column, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)

"""What a record of a log is, who put it there, and what of it is kept: pure functions of its fields.

The rules are tables. ``META`` names the keys of each header column, ``KINDS`` the tests of each kind in
order, ``CLAUDE_TEXT`` and ``CODEX_TEXT`` how the opening of a text tells its sender; the functions below only
look things up in them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.flatten import Field

# --- fixed values -----------------------------------------------------------------------------------------
RULES_VERSION = 1
KINDS_OF_EVENT = ["user", "assistant", "command", "output", "patch", "summary", "unknown", "invalid"]
SENDERS = ["human", "agent", "system", "summary", "assistant", "unknown"]
ORIGINS = ["generic", "claude_main", "claude_subagent", "codex_thread", "codex_child", "codex_exec"]
TYPE_PATHS = ["/payload/type", "/response_item/type", "/event_msg/type", "/type", "/event_type", "/eventtype", "/kind"]
META = {
    "session": ["sessionid", "session"],
    "turn": ["turnid", "turn"],
    "timestamp": ["timestamp", "createdat", "time", "ts", "date"],
    "cwd": ["cwd", "currentworkingdirectory"],
    "repository": ["repository", "repo", "repositorypath"],
    "call_id": ["callid", "toolcallid", "functioncallid", "itemid"],
    "role": ["role"],
}
PAYLOADS = set("arguments content input output command parameters toolinput tooloutput usermessage assistantmessage functioncall functionoutput toolcall toolresult".split())
ENVELOPES = set("eventmsg responseitem payload metadata envelope record event message".split())
IDENTITY = set("type eventtype kind role sessionid session turnid turn timestamp createdat time ts date cwd currentworkingdirectory repository repo repositorypath callid toolcallid functioncallid itemid name".split())
NOISE_PATHS = ["encrypted_content", "/reasoning", "/analysis", "token_count", "/rate_limits", "/base_instructions", "/host_skills", "/agents_md", "/dynamic_tools", "/workspace_roots", "/comp_hash"]
NOISE_TYPES = set("token_count token_count_event agent_reasoning reasoning world_state turn_context session_meta thread_settings_applied inter_agent_communication_metadata compacted context_compacted compaction".split())
COMPACTIONS = {"compacted", "context_compacted", "compaction"}
SPOKEN_KEYS = {"message", "text", "content", "lastagentmessage", "input"}
COMPLETIONS = ["turn_complete", "turncomplete", "task_complete", "taskcomplete", "response_complete", "responsecomplete"]
IMPORTED_TURN = "external-import-turn-"
TRUNCATED = "…[truncated]"
OUTPUT_CHARS = 300
INJECTED = [("<system-reminder>", "</system-reminder>"), ("<in-app-browser-context", "</in-app-browser-context>")]
REQUEST_HEADINGS = {"## My request:", "## My request for Codex:"}
COMPACTION_SENTENCE = "This session is being continued from a previous conversation"
CONTEXT_TAGS = "environment_context codex_internal_context recommended_plugins user_instructions permissions collaboration_mode app-context turn_aborted external_codex_apps_open_page"


def _tags(names: str) -> str:
    return rf"<(?:{'|'.join(map(re.escape, names.split()))})[>/ \t\r\n]"


# (opening of the trimmed text, sender, via); via None is the way the text came
CLAUDE_TEXT = [
    (COMPACTION_SENTENCE, "summary", "compact_summary"),
    (r"\[Request interrupted by user[^\n]*\]\s*\Z", "system", "interrupted"),
    (_tags("task-notification"), "system", "notification"),
    (_tags("agent-message cross-session-message teammate-message"), "agent", "agent_message"),
    (_tags("local-command-stdout local-command-stderr local-command-caveat bash-stdout bash-stderr") + "|Caveat: The messages below", "system", "command_output"),
    (_tags("user-prompt-submit-hook"), "system", "hook"),
    (_tags("command-name command-message command-args"), "human", "slash_command"),
    (_tags("bash-input"), "human", "shell_command"),
    ("", "human", None),
]
CODEX_TEXT = [
    (COMPACTION_SENTENCE, "summary", "compact_summary"),
    (r"# AGENTS\.md", "system", "instructions"),
    (_tags(CONTEXT_TAGS), "system", "injected"),
    (_tags("heartbeat"), "system", "automation"),
    (_tags("task-notification"), "system", "notification"),
    (_tags("codex_delegation subagent_notification agent-message"), "agent", "agent_message"),
    (_tags("send_user_message_question_reply"), "human", "question_reply"),
    ("", "human", None),
]
CLAUDE_TEXT = [(re.compile(p), s, v) for p, s, v in CLAUDE_TEXT]
CODEX_TEXT = [(re.compile(p), s, v) for p, s, v in CODEX_TEXT]
_ANY_TAG = re.compile(r"<[A-Za-z0-9_-]+[>/ \t\r\n]")
_TEXT_PATH = re.compile(r"/message/content|/attachment/prompt|/payload/message|/(?:message/content|attachment/prompt|payload/content)/[0-9]+/text")
_IMAGE_TAG = re.compile(r"</image>|<image(?: [^>\n]*)?>")
_PASTED = re.compile(r'^## "(.*)": ', re.DOTALL)


# --- paths and keys ---------------------------------------------------------------------------------------
@lru_cache(100_000)
def key_of(segment: str) -> str:
    return re.sub("[^a-z0-9]", "", segment.lower()) if segment.isascii() else re.sub("[^a-z0-9]", "", "".join(c.lower() for c in segment if c.isascii()))


@lru_cache(200_000)
def place_of(path: str) -> tuple[str, str, int | None, bool]:
    """(leaf, key of the leaf, rank as metadata, inside a payload): rank 0 at the top, 1 in an envelope, 2 elsewhere, None hidden."""
    parts = [p for p in path.split("/") if p]
    if not parts:
        return "", "", None, False
    above = [key_of(p) for p in parts[:-1]]
    inside = any(a in PAYLOADS for a in above)
    hidden = inside or "replacement_history" in parts[:-1]
    rank = None if hidden else 0 if not above else 1 if any(a in ENVELOPES for a in above) else 2
    return parts[-1], key_of(parts[-1]), rank, inside


@lru_cache(200_000)
def is_noise(path: str) -> bool:
    low = path.lower()
    return any(n in low or n.replace("_", "") in low for n in NOISE_PATHS)


@dataclass
class Record:
    """A record and what is found out about it."""

    fields: list[Field] | None
    kind: str = "unknown"
    event_type: str | None = None
    role: str | None = None
    session: str | None = None
    turn: str | None = None
    timestamp: str | None = None
    cwd: str | None = None
    repository: str | None = None
    call_id: str | None = None
    sender: str = "unknown"
    via: str = ""
    body: list[tuple[str, str]] = field(default_factory=list)
    cut: bool = False
    images: int = 0

    def __post_init__(self) -> None:
        self.at: dict[str, tuple[str, str]] = {}
        for path, value, kind in self.fields or ():
            self.at.setdefault(path, (value, kind))

    def value(self, path: str) -> str:
        return self.at.get(path, ("", ""))[0]

    def text(self, path: str) -> str | None:
        value, kind = self.at.get(path, ("", ""))
        return value if kind == "string" else None

    def flag(self, path: str) -> bool:
        return self.value(path) == "true"

    @property
    def opens_user_turn(self) -> bool:
        return self.kind == "user" and self.sender in ("human", "unknown")


_META_KEYS = frozenset(k for keys in META.values() for k in keys) | {"id"}


#: Shapes of records that are remembered.
SHAPES = 20_000
_TYPE_LENGTH = max(map(len, TYPE_PATHS))


class Shape:
    """What the paths of a record say by themselves; logs have few shapes of records."""

    __slots__ = ("blocks", "kind", "meta", "types")

    def __init__(self, paths: tuple[str, ...]) -> None:
        low: dict[str, int] = {}
        meta: dict[str, list[tuple[int, str, int]]] = {}
        for i, path in enumerate(paths):
            if len(path) <= _TYPE_LENGTH:
                low.setdefault(path.lower(), i)
            _, key, rank, _ = place_of(path)
            if key in _META_KEYS and rank is not None:
                meta.setdefault(key, []).append((rank, path, i))
        #: places of the type, the first that says something holds
        self.types = [low[p] for p in TYPE_PATHS if p in low]
        #: per metadata key its places, the highest first, of equal ones that with the smaller path
        self.meta = {key: [(place[:2], place[2]) for place in sorted(places)] for key, places in meta.items()}
        #: numbers of the items of ``message.content``
        self.blocks = sorted({int(b) for p in paths if p.startswith("/message/content/") and (b := p.split("/", 4)[3]).isdigit()})
        leaves = {place_of(p)[1] for p in paths}
        #: places of types, whether there is output, a patch, a command
        self.kind = [i for i, p in enumerate(paths) if p.endswith("/type")], bool(leaves & {"stdout", "stderr", "output"}), any("patch" in p.lower() for p in paths), bool(leaves & {"command", "arguments"})


_shapes: dict[tuple[str, ...], Shape] = {}


def shape_of(fields: list[Field]) -> Shape:
    paths = tuple([f[0] for f in fields])
    shape = _shapes.get(paths)
    if shape is None:
        shape = Shape(paths)
        if len(_shapes) < SHAPES:
            _shapes[paths] = shape
    return shape


def _places(fields: list[Field], shape: Shape) -> dict[str, str]:
    """Per metadata key the value at its highest place that has one; of a repeated path the smaller value."""
    out = {}
    for key, places in shape.meta.items():
        best = None
        for place, i in places:
            value = fields[i][1]
            if value and (best is None or (place == best[0] and value < best[1])):
                best = place, value
        if best:
            out[key] = best[1]
    return out


def event_type(record: Record) -> str | None:
    fields = record.fields or []
    return next((v for i in shape_of(fields).types if (v := fields[i][1]).lower() not in ("event_msg", "response_item")), None)


@lru_cache(4096)
def _kind_by_name(t: str, r: str) -> tuple[str | None, str | None]:
    """What type and role say before, and after, results inside of the record are looked for."""
    has = lambda *words: any(w in t for w in words)
    if t in COMPACTIONS:
        return "unknown", None
    if has("output", "result", "toolreturn", "call_end"):
        return "output", None
    if "patch" in t:
        return "patch", None
    if has("command", "function_call", "functioncall", "tool_call", "toolcall"):
        return "command", None
    if r == "user" or t == "user" or has("user_message", "usermessage"):
        return None, "user"
    if r == "assistant" or t == "assistant" or has("assistant_message", "assistantmessage", "agent_message", "agentmessage"):
        return None, "assistant"
    return None, None


def kind(fields: list[Field], type_name: str | None, role: str | None) -> str:
    """The first rule that holds decides."""
    first, second = _kind_by_name((type_name or "").lower(), (role or "").lower())
    if first:
        return first
    types, output, patch, command = shape_of(fields).kind
    if any(fields[i][1] == "tool_result" for i in types):
        return "output"
    return second or ("output" if output else "patch" if patch else "command" if command else "unknown")


def describe(fields: list[Field] | None) -> Record:
    """The header of a record, before its sender is known; unreadable records are ``invalid``."""
    record = Record(fields)
    if fields is None:
        record.kind = "invalid"
        return record
    record.event_type = event_type(record)
    places = _places(fields, shape_of(fields))
    for name, keys in META.items():
        setattr(record, name, next((places[k] for k in keys if k in places), None))
    t = (record.event_type or "").lower()
    if record.session is None and "session" in t:
        record.session = places.get("id")
    if record.turn is None and "turn" in t:
        record.turn = places.get("id")
    record.kind = kind(fields, record.event_type, record.role)
    return record


# --- the person's words -------------------------------------------------------------------------------------
def without_injected(value: str) -> str:
    """The value without injected blocks, from the left, up to the first that doesn't end."""
    out, rest = [], value
    while True:
        opened = [(i, close) for start, close in INJECTED if (i := rest.find(start)) >= 0]
        if not opened:
            break
        at, close = min(opened)
        end = rest.find(close, at)
        if end < 0:
            break
        out.append(rest[:at])
        rest = rest[end + len(close) :]
    return "".join([*out, rest])


def _words(value: str) -> str | None:
    kept = without_injected(value)
    if not kept.strip():
        return None
    if any(start in value for start, _ in INJECTED):
        if value.lstrip().startswith(tuple(start for start, _ in INJECTED)):
            kept = kept.lstrip("\r\n")
        if value.rstrip().endswith(tuple(close for _, close in INJECTED)):
            kept = kept.rstrip()
    return kept


def _wrapped(value: str) -> str | None:
    """The request in a value that lists files, pages and pasted texts before it; None if it isn't so wrapped."""
    text = without_injected(value).lstrip()
    lines = text.splitlines(keepends=True)
    heading = lambda line: line.rstrip() in REQUEST_HEADINGS
    if not lines or not (heading(lines[0]) or (lines[0].startswith("# ") and lines[0].rstrip().endswith(":"))):
        return None
    at = next((i for i, line in enumerate(lines) if heading(line)), None)
    if at is None:
        return None
    pasted, section = [], ""
    for line in lines[:at]:
        bare = line.rstrip("\r\n")
        if bare.startswith("# "):
            section = bare[2:].rstrip()
        elif section == "Files pasted by the user:" and (m := _PASTED.match(bare)):
            pasted.append(m[1])
    request = "".join(lines[at + 1 :])
    return "\n".join([*pasted, *([request] if request.strip() else [])])


def person_text(path: str, value: str) -> str | None:
    """What of the value at a text path the person wrote, or None."""
    if path == "/payload/message" or path.startswith("/payload/content/"):
        if _IMAGE_TAG.fullmatch(value.strip()):
            return None
        request = _wrapped(value)
        if request is not None:
            return _words(request)
    return _words(value)


def _texts(record: Record) -> list[tuple[str, str]]:
    return [(p, t) for p, v, _ in record.fields or () if _TEXT_PATH.fullmatch(p) and (t := person_text(p, v)) is not None]


def human_text(record: Record) -> str:
    return "\n".join(t.strip() for _, t in _texts(record))


def _has_item(record: Record, *types: str) -> bool:
    return any(p.endswith("/type") and "/content/" in p and v in types for p, v, _ in record.fields or ())


def _is_wrapped(record: Record) -> bool:
    return any(_TEXT_PATH.fullmatch(p) and p.startswith("/payload/") and _wrapped(v) is not None for p, v, _ in record.fields or ())


# --- senders ------------------------------------------------------------------------------------------------
def _by_text(text: str, attached: bool, table: list, came: str) -> tuple[str, str]:
    text = text.lstrip()
    if not text:
        return ("human", came) if attached else ("system", "injected")
    return next((s, came if v is None else v) for pattern, s, v in table if pattern.match(text))


def _claude(origin: str, r: Record) -> tuple[str, str, dict]:
    """(sender, via, corrections of the header)."""
    sub = origin == "claude_subagent"
    summary = lambda s: {"kind": "summary"} if s == "summary" else {}
    record_type = r.value("/type")
    if record_type == "user":
        if r.flag("/isCompactSummary"):
            return "summary", "compact_summary", {"kind": "summary"}
        if r.kind == "output" or _has_item(r, "tool_result"):
            return "system", "tool_result", {}
        if r.flag("/isMeta"):
            return "system", "meta", {}
        if sub or r.flag("/isSidechain"):
            return "agent", "subagent_prompt", {}
        text = human_text(r)
        sender, via = _by_text(text, _has_item(r, "image"), CLAUDE_TEXT, "typed")
        if sender == "human" and (r.value("/turnOrigin"), r.value("/entrypoint")) == ("sdk", "claude-desktop"):
            return ("system", "notification", {}) if _ANY_TAG.match(text.lstrip()) else ("agent", "session_brief", {})
        return sender, via, summary(sender)
    if record_type == "attachment":
        if r.value("/attachment/type") != "queued_command":
            return "system", "attachment", {"kind": "unknown"}
        if sub:
            return "agent", "subagent_prompt", {"kind": "unknown"}
        sender, via = _by_text(human_text(r), False, CLAUDE_TEXT, "queued")
        return sender, via, {"kind": "user", "role": "user"} | summary(sender)
    if record_type == "system":
        if r.value("/subtype") == "compact_boundary":
            return "system", "compact_boundary", {"kind": "unknown", "event_type": "compact_boundary"}
        return "system", "", {"kind": "unknown"}
    if record_type == "assistant":
        return "assistant", "", {}
    return "system", "", {"kind": "unknown"}


def _codex(origin: str, r: Record) -> tuple[str, str, dict]:
    delivered = {"codex_child": "codex_child", "codex_exec": "codex_exec"}.get(origin)
    what = (r.value("/type"), r.value("/payload/type"))
    role = r.value("/payload/role")
    if what == ("event_msg", "user_message") or (what == ("response_item", "message") and role == "user"):
        if delivered:
            sender, via = "agent", delivered
        else:
            attached = _is_wrapped(r) or (what[0] == "response_item" and _has_item(r, "input_image"))
            sender, via = _by_text(human_text(r), attached, CODEX_TEXT, "typed")
    elif what == ("response_item", "message"):
        sender, via = ("assistant", "") if role == "assistant" else ("system", "instructions")
    elif what == ("response_item", "agent_message"):
        sender, via = "agent", "agent_message"
    elif what == ("event_msg", "agent_message"):
        sender, via = "assistant", ""
    elif what[0] == "response_item":
        sender, via = ("system", "tool_result") if r.kind == "output" else ("assistant", "")
    elif what[0] == "compacted":
        sender, via = ("summary", "compact_summary") if r.value("/payload/message").strip() else ("system", "compact_boundary")
    else:
        sender, via = "system", ""
    return sender, via, {"kind": "summary"} if sender == "summary" else {}


def classify(origin: str, record: Record) -> Record:
    """The record with its sender, and with the kind, role and type that the sender corrects."""
    if record.fields is None:
        return record
    if origin.startswith("claude"):
        sender, via, fixes = _claude(origin, record)
    elif origin.startswith("codex"):
        sender, via, fixes = _codex(origin, record)
    else:
        sender, via, fixes = ("assistant" if record.kind == "assistant" else "unknown"), "", {}
    for name, value in {"sender": sender, "via": via, **fixes}.items():
        setattr(record, name, value)
    return record


# --- projection -----------------------------------------------------------------------------------------------
@lru_cache(200_000)
def kept(path: str, kind: str, t: str) -> bool:
    """Whether a field of a record that is no person's message, of this kind and type (lower case), belongs to its body."""
    low, (_, key, _, inside) = path.lower(), place_of(path)
    if kind != "unknown" and is_noise(path):
        return False
    if t in COMPACTIONS:
        return low == "/payload/message" or ("/replacement_history/" in low and key in ("role", "text", "message", "turnid"))
    if key in ("thinking", "signature") and "/content/" in low:
        return False
    if t in NOISE_TYPES:
        return key in IDENTITY
    if key in IDENTITY and not inside:
        return key == "name"
    if kind in ("user", "assistant", "summary"):
        return key in SPOKEN_KEYS or "/content/" in low
    return True


def project(record: Record, output_chars: int = OUTPUT_CHARS, raw: bytes = b"") -> Record:
    """The record with its body: the person's texts and image count, or the kept fields, tool output cut short.

    An unreadable record keeps its bytes as one field; one that is too long (``cut``) those that were read, marked.
    """
    if record.fields is None:
        record.body = [("/raw", raw.decode("utf-8", "replace") + (TRUNCATED if record.cut else ""))]
        return record
    if record.sender == "human":
        record.body = _texts(record)
        record.images = sum(place_of(p)[1] == "type" and v in ("image", "input_image") for p, v, _ in record.fields)
        return record
    short, t = record.kind == "output" and output_chars > 0, (record.event_type or "").lower()
    for path, value, _ in record.fields:
        if kept(path, record.kind, t):
            if short and len(value) > output_chars:
                value, record.cut = value[:output_chars] + TRUNCATED, True
            record.body.append((path, value))
    return record


def reply_text(record: Record) -> str | None:
    """The visible text of an agent's record: its text items, without calls and thinking."""
    if record.sender != "assistant":
        return None
    item = re.compile(r"/(?:message|payload)/content(?:/[0-9]+/text)?|/payload/message")
    parts = [v.strip() for p, v in record.body if item.fullmatch(p) and v.strip()]
    return "\n".join(parts) or None


def is_tool_call(record: Record) -> bool:
    return record.sender == "assistant" and (record.kind == "command" or _has_item(record, "tool_use"))


def is_compaction(record: Record) -> bool:
    return (record.event_type or "") in ("compact_boundary", "compacted")


def is_completion(record: Record) -> bool:
    t = (record.event_type or "").lower()
    return any(c in t for c in COMPLETIONS)


def tool_calls(record: Record) -> list[tuple[str, str]]:
    """(name, input) of the calls in an original record: items of a message, or one call as payload."""
    calls: dict[str, tuple[str, list[str]]] = {}
    for path, value, _ in record.fields or ():
        m = re.match(r"(/message/content/[0-9]+)/(name|input(?:/.*)?)$|(/payload)/(name|arguments|input)$", path)
        if not m:
            continue
        base, leaf = (m[1], m[2]) if m[1] else (m[3], m[4])
        name, inputs = calls.get(base, ("", []))
        if leaf == "name":
            name = value
        else:
            inputs = [*inputs, value if leaf in ("input", "arguments") else f"{leaf[6:]}: {value}"]
        calls[base] = (name, inputs)
    return [(name, "\n".join(inputs)) for name, inputs in calls.values() if name]


def embedded_messages(record: Record) -> list[tuple[str, str, str]]:
    """(role, turn, text) of the messages in a compaction's replacement history, in order."""
    groups: dict[str, dict[str, list[str]]] = {}
    for path, value, _ in record.fields or ():
        if m := re.match(r"/payload/replacement_history/([0-9]+)/(.*)$", path):
            key = place_of(path)[1]
            if key in ("role", "text", "message", "turnid"):
                groups.setdefault(m[1], {}).setdefault("text" if key == "message" else key, []).append(value)
    return [("".join(g.get("role", [])[:1]), "".join(g.get("turnid", [])[:1]), "\n".join(g.get("text", []))) for g in groups.values()]


def readable(record: Record) -> tuple[str, str]:
    """(label, text) of a record for a reader: who or what it is, its texts, and calls as ``[tool] key: value``."""
    labels = {"human": "person", "assistant": "agent", "summary": "summary", "agent": "user turn"}
    label = "result" if record.kind == "output" else "tool" if is_tool_call(record) else labels.get(record.sender, "system" if record.sender == "system" else "record")
    if calls := tool_calls(record):
        lines = [f"[{name}] {text}" for name, text in calls]
        spoken = reply_text(record)
        return label, "\n".join([*([spoken] if spoken else []), *lines])
    return label, "\n".join(v for _, v in record.body)

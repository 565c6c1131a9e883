"""Finding logs: which files there are, what wrote them, and what they are called."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from ..functions.flatten import flatten
from .lines import records

# Constants of the 64-bit FNV-1a hash.
_FNV_START, _FNV_STEP = 0xCBF29CE484222325, 0x100000001B3
SNIFF_LINES, SNIFF_BYTES = 16, 1 << 20


def fnv64(s: str) -> str:
    h = _FNV_START
    for b in s.encode("utf-8", "surrogateescape"):
        h = ((h ^ b) * _FNV_STEP) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@dataclass(frozen=True)
class Found:
    input_path: str
    path: str
    availability: str  # present, missing, unreadable, not_jsonl, unsupported


@dataclass(frozen=True)
class Source:
    source_id: str
    app: str
    origin: str
    path: str
    fallback_session: str
    size: int
    mtime_us: int
    inode: int


def default_sources(env: dict[str, str] | None = None) -> list[str]:
    """The folders in which the agents keep their logs."""
    env = os.environ if env is None else env
    home = env.get("HOME") or env.get("USERPROFILE") or "~"
    return [str(Path(env.get("CLAUDE_CONFIG_DIR") or Path(home, ".claude"), "projects")), str(Path(env.get("CODEX_HOME") or Path(home, ".codex"), "sessions"))]


def normalize_input(s: str) -> str:
    """One spelling for one place: absolute, without ``~``, dots and trailing slashes; ``file://`` is taken off."""
    s = s.removeprefix("file://")
    return os.path.normpath(os.path.abspath(os.path.expanduser(s)))


def collect(inputs: list[str]) -> tuple[list[str], list[Found]]:
    """(paths, availability): the logs below ``inputs``, sorted, each once; a plain log hides its compressed twin."""
    found: list[Found] = []
    for given in dict.fromkeys(map(normalize_input, inputs)):
        p = Path(given)
        if not p.exists():
            found.append(Found(given, given, "missing"))
        elif p.is_file():
            found.append(Found(given, given, "present" if is_log(given) else "not_jsonl"))
        elif not p.is_dir():
            found.append(Found(given, given, "unsupported"))
        else:
            refused: list[str] = []
            for folder, folders, files in os.walk(given, onerror=lambda e: refused.append(str(e.filename))):
                folders.sort()
                found += [Found(given, os.path.join(folder, f), "present") for f in sorted(files) if is_log(f)]
            found += [Found(given, f, "unreadable") for f in refused]
    paths = sorted({f.path for f in found if f.availability == "present"})
    plain = {p for p in paths if p.endswith(".jsonl")}
    return [p for p in paths if not (p.endswith(".zst") and p.removesuffix(".zst") in plain)], found


def is_log(name: str) -> bool:
    return name.endswith((".jsonl", ".jsonl.zst"))


def app_of(path: str) -> str:
    """By the nearest ``.claude`` or ``.codex`` folder, else by the first records; ``other`` if they don't tell."""
    for part in reversed(Path(path).parts[:-1]):
        if part in (".claude", ".codex"):
            return part[1:]
    for fields in _first_fields(path):
        at = dict((p, v) for p, v, _ in fields)
        if at.get("/type") in ("session_meta", "response_item", "event_msg", "turn_context") and any(p.startswith("/payload") for p in at):
            return "codex"
        if "/sessionId" in at and ("/uuid" in at or "/parentUuid" in at or "/message/role" in at):
            return "claude"
    return "other"


def origin_of(app: str, path: str) -> str:
    if app == "claude":
        return "claude_subagent" if "/subagents/" in path.replace("\\", "/") else "claude_main"
    if app != "codex":
        return "generic"
    first = next(_first_fields(path), [])
    at = dict((p, v) for p, v, _ in first)
    if at.get("/type") != "session_meta":
        return "codex_thread"
    if at.get("/payload/parent_thread_id") not in (None, "", "null") or any(p.startswith("/payload/source/subagent") for p in at):
        return "codex_child"
    return "codex_exec" if "exec" in (at.get("/payload/source") or "") or "exec" in (at.get("/payload/originator") or "") else "codex_thread"


def _first_fields(path: str):
    n = 0
    try:
        for _, _, _, raw, _ in records(path, 0, most_lines=SNIFF_LINES):
            n += len(raw)
            if (fields := flatten(raw)) is not None:
                yield fields
            if n > SNIFF_BYTES:
                return
    except OSError:
        return


def describe(paths: list[str], known: dict[str, str] | None = None) -> list[Source]:
    """The sources at ``paths``. ``known``: source_id by path of logs that keep theirs (moved ones too)."""
    out, taken = [], {}
    for path in paths:
        app = app_of(path)
        place = path.removesuffix(".zst")
        ident = (known or {}).get(path) or f"{app}-{fnv64(place)}"
        n = 1
        while taken.get(ident, place) != place:
            ident = f"{app}-{fnv64(f'{place}\n{n}')}"
            n += 1
        taken[ident] = place
        stat = os.stat(path)
        stem = re.sub(r"\.jsonl(\.zst)?$", "", os.path.basename(path))
        out.append(Source(ident, app, origin_of(app, path), path, stem, stat.st_size, stat.st_mtime_ns // 1000, stat.st_ino))
    return out

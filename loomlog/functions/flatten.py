"""One JSON record to its ordered scalar fields, without losing anything the text says.

A field is (path, value, kind): RFC 6901 pointer, the scalar's text (numbers exactly as written), and one of
string, number, boolean, null. Repeated keys are both kept, empty containers give no field. Records that are
no strict JSON (NaN, control characters, lone surrogates, more than 256 levels, anything after the value)
have no fields: the result is None.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from ..operators.shred import escape

DEPTH = 256
Field = tuple[str, str, str]


class _Number(str):
    __slots__ = ()


class _Pairs(list):
    __slots__ = ()


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


_decode = json.JSONDecoder(object_pairs_hook=_Pairs, parse_int=_Number, parse_float=_Number, parse_constant=_refuse).decode


def flatten(record: bytes | str) -> list[Field] | None:
    try:
        text = record.decode() if isinstance(record, bytes) else record
        out: list[Field] = []
        _walk("", _decode(text), 0, out.append)
        if not isinstance(record, bytes) or "\\u" in text:  # only escapes can bring lone surrogates into bytes
            for path, value, _ in out:
                path.encode()
                value.encode()
    except (ValueError, RecursionError):
        return None
    return out


_WORDS = {None: ("null", "null"), True: ("true", "boolean"), False: ("false", "boolean")}


def _walk(path: str, v: object, depth: int, add: Callable[[Field], None]) -> None:
    kind = type(v)
    if kind is not _Pairs and kind is not list:
        add((path, v, "string") if kind is str else (path, str(v), "number") if kind is _Number else (path, *_WORDS[v]))
        return
    if depth >= DEPTH:
        raise ValueError("too deep")
    path += "/"
    for key, x in v if kind is _Pairs else enumerate(v):
        at = path + (str(key) if kind is list else escape(key))
        inner = type(x)
        if inner is str:
            add((at, x, "string"))
        elif inner is _Pairs or inner is list:
            _walk(at, x, depth + 1, add)
        elif inner is _Number:
            add((at, str(x), "number"))
        else:
            add((at, *_WORDS[x]))

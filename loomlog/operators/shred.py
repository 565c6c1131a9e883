"""Problem 2: deeply nested records to flat, related tables, by adjacency-table shredding.

``shred`` turns each JSON body into rows of one adjacency table (node, parent, label, ordinal, kind, scalar).
``pivot`` joins object nodes with their scalar children into entity rows: one aggregation whose map side
already folds the children into their object, so one row per object is shuffled, not one per node.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle

#: Nodes a task gives on at a time, and characters of their places.
BATCH_NODES = 20_000
BATCH_CHARS = 1 << 24

NODES = "raw_id long, stream_key string, node string, parent string, label string, ordinal long, kind string, scalar string, element boolean, owner string"
_SCHEMA = pa.schema([
    ("raw_id", pa.int64()), ("stream_key", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("label", pa.string()),
    ("ordinal", pa.int64()), ("kind", pa.string()), ("scalar", pa.string()), ("element", pa.bool_()), ("owner", pa.string()),
])


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


_decode = json.JSONDecoder(parse_constant=_refuse).decode
_decode_long = json.JSONDecoder(parse_constant=_refuse, parse_int=float).decode


def load(body: str | None) -> tuple[bool, object]:
    """(whether ``body`` is valid JSON, its value). Of a repeated key the last value counts.

    NULL, blank, cut and NaN-bearing bodies are invalid. Nesting may be of any depth.
    """
    if body is None:
        return False, None
    try:
        return True, _decode(body)
    except RecursionError:
        return _load_deep(body)
    except ValueError as e:
        if "integer string conversion" not in str(e):
            return False, None
    try:
        return True, _decode_long(body)
    except RecursionError:
        return _load_deep(body)
    except ValueError:
        return False, None


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", re.ASCII)
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _load_deep(body: str) -> tuple[bool, object]:
    """As ``load``, with a stack of its own: for bodies nested deeper than the parser's calls may be."""
    try:
        return True, _deep(body)
    except (ValueError, IndexError):
        return False, None


def _deep(s: str) -> object:
    skip, string = _SPACE.match, json.decoder.scanstring
    top: list = []
    stack: list[tuple[object, str | None]] = [(top, None)]  # open containers, the key each waits to fill
    i = skip(s, 0).end()
    while True:
        held, key = stack[-1]
        c = s[i]
        value: object
        opened = c in "{["
        if opened:
            value, i = ({} if c == "{" else []), i + 1
        elif c == '"':
            value, i = string(s, i + 1, True)
        elif c in _WORDS:
            word, value = _WORDS[c]
            if not s.startswith(word, i):
                raise ValueError(i)
            i += len(word)
        else:
            m = _NUMBER.match(s, i)
            if not m:
                raise ValueError(i)
            if m[1] or m[2]:
                value = float(m[0])
            else:
                try:
                    value = int(m[0])
                except ValueError:  # more digits than an integer may be read from
                    value = float(m[0])
            i = m.end()
        if key is None:
            held.append(value)
        else:
            held[key] = value
        if opened:
            i = skip(s, i).end()
            if s[i] != ("}" if c == "{" else "]"):
                key, i = _key(s, i) if c == "{" else (None, i)
                stack.append((value, key))
                continue
            i += 1
        while True:  # after a value: close containers, or go on to the next value
            i = skip(s, i).end()
            if len(stack) == 1:
                if i != len(s):
                    raise ValueError(i)
                return top[0]
            held, key = stack[-1]
            c, i = s[i], i + 1
            if c == ",":
                i = skip(s, i).end()
                if key is not None:
                    key, i = _key(s, i)
                    stack[-1] = held, key
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(i)
            stack.pop()


def _key(s: str, i: int) -> tuple[str, int]:
    """The key that begins at ``i``, and where its value begins."""
    if s[i] != '"':
        raise ValueError(i)
    key, i = json.decoder.scanstring(s, i + 1, True)
    i = _SPACE.match(s, i).end()
    if s[i] != ":":
        raise ValueError(i)
    return key, _SPACE.match(s, i + 1).end()


def dumps(value: object, sort_keys: bool = False) -> str:
    """JSON of ``value``, as ``json.dumps`` writes it, at any depth."""
    try:
        return json.dumps(value, sort_keys=sort_keys, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list[object] = [(value,)]  # a tuple is a value to write, a string is text
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
            continue
        v = x[0]
        if type(v) is dict and v:
            parts: list[object] = []
            for k in sorted(v) if sort_keys else v:
                parts += [(", " if parts else "{") + json.dumps(k, ensure_ascii=False) + ": ", (v[k],)]
            stack += reversed([*parts, "}"])
        elif type(v) is list and v:
            parts = []
            for y in v:
                parts += [", " if parts else "[", (y,)]
            stack += reversed([*parts, "]"])
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def text(s: str) -> str:
    """``s`` in a form every sink can write: lone surrogates become question marks."""
    try:
        s.encode()
    except UnicodeEncodeError:
        return s.encode("utf-8", "replace").decode()
    return s


def escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1") if "~" in key or "/" in key else key


def nodes(value: object, labels: frozenset[str] | None, every_object: bool) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar, element, owner) of every wanted node below and with the top.

    ``owner`` is the nearest enclosing object that is an array element. ``labels`` keeps scalars under these
    keys only (None: all); without ``every_object`` only element objects and wanted scalars are given.
    """
    stack = [("", None, None, None, value, False, "")]
    while stack:
        path, parent, label, ordinal, v, element, owner = stack.pop()
        if type(v) is dict:
            if every_object or element:
                yield path, parent, label, ordinal, "object", None, element, owner
            inner = path if element else owner
            for k, x in v.items():
                kind = type(x)
                if kind is dict or kind is list:
                    if x or every_object:
                        stack.append((f"{path}/{escape(k)}", path, k, None, x, False, inner))
                elif labels is None or k in labels:
                    yield (f"{path}/{escape(k)}" if labels is None else path, path, k, None, *scalar(x), False, inner)
        elif type(v) is list:
            if every_object:
                yield path, parent, label, ordinal, "array", None, False, owner
            for i, x in enumerate(v):
                kind = type(x)
                if kind is dict:
                    stack.append((f"{path}/{i}", path, None, i, x, True, owner))
                elif kind is list:
                    stack.append((f"{path}/{i}", path, None, i, x, False, owner))
                elif labels is None:
                    yield (f"{path}/{i}", path, None, i, *scalar(x), False, owner)
        elif labels is None:
            yield (path, None, None, None, *scalar(v), False, owner)


def scalar(x: object) -> tuple[str, str | None]:
    if x is None:
        return "null", None
    if isinstance(x, str):
        return "string", text(x)
    if isinstance(x, bool):
        return "boolean", "true" if x else "false"
    return "number", json.dumps(x)


def shred(raw_records: DataFrame, labels: Iterable[str] | None = None, every_object: bool = True) -> DataFrame:
    """The adjacency table of ``body``; rows of invalid bodies are left out, empty containers are nodes.

    With ``labels`` the table is projected while it is made: scalars under other keys never leave the worker.
    """
    wanted = None if labels is None else frozenset(labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            for raw_id, stream, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ok, value = load(body)
                if not ok:
                    continue
                for node, parent, label, *rest in nodes(value, wanted, every_object):
                    rows.append((raw_id, stream, text(node), parent and text(parent), label and text(label), *rest[:-1], text(rest[-1])))
                    chars += len(node)
                    if len(rows) >= BATCH_NODES or chars >= BATCH_CHARS:
                        yield _batch(rows)
                        rows, chars = [], 0
        if rows:
            yield _batch(rows)

    return raw_records.select("raw_id", "stream_key", "body").mapInArrow(run, NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def pivot(adjacency: DataFrame, labels: Iterable[str]) -> DataFrame:
    """One row per object node, its scalar children under ``labels`` as columns (``f_`` and the label).

    (raw_id, stream_key, node, element, owner, label, ordinal, f_...). Children that are null are NULL.
    A child under an array has no object and is left out.
    """
    is_object = F.col("kind") == "object"
    child = lambda k: F.max(F.when(~is_object & (F.col("label") == k), F.col("scalar"))).alias(f"f_{k}")
    own = lambda c: F.max(F.when(is_object, F.col(c))).alias(c)
    rows = adjacency.filter(is_object | F.col("label").isNotNull()).withColumn("at", F.when(is_object, F.col("node")).otherwise(F.col("parent")))
    out = rows.groupBy("raw_id", "stream_key", "at").agg(
        F.coalesce(F.max(F.when(is_object, F.col("element"))), F.lit(False)).alias("element"), own("owner"), own("label"), own("ordinal"), *map(child, labels)
    )
    return out.withColumnRenamed("at", "node")


def linked_elements(raw_records: DataFrame) -> DataFrame:
    """(raw_id, child_path, parent_path, link_raw_id) of every object that is an array element.

    The link of an object with a ``tool_use_id`` is the smallest raw_id of its stream with an array element
    of that ``id``, else -1. Ids are compared as text. A null stream is a stream of its own.
    """
    adjacency = shred(raw_records, ["id", "tool_use_id"], every_object=False)
    elements = settle(
        pivot(adjacency, ["id", "tool_use_id"]).filter("element").select("raw_id", F.coalesce("stream_key", F.lit("")).alias("stream_key"), F.col("node").alias("child_path"), F.col("owner").alias("parent_path"), F.col("f_id").alias("id"), F.col("f_tool_use_id").alias("answers")),
        "elements",
    )
    calls = elements.filter(F.col("id").isNotNull()).groupBy("stream_key", F.col("id").alias("answers")).agg(F.min("raw_id").alias("link_raw_id"))
    answers = elements.filter(F.col("answers").isNotNull()).join(calls, ["stream_key", "answers"], "left")
    columns = ["raw_id", "child_path", "parent_path", F.coalesce("link_raw_id", F.lit(-1)).cast("long").alias("link_raw_id")]
    rest = elements.filter(F.col("answers").isNull()).withColumn("link_raw_id", F.lit(-1).cast("long"))
    return answers.select(*columns).unionByName(rest.select(*columns))


#: Entity tables: name -> (pattern of the node's pointer, scalars that always have a column)
ENTITIES = {
    "items": (r"^/message/content/\d+$", ["type", "id", "tool_use_id", "name", "text", "is_error"]),
    "blocks": (r"^/message/content/\d+/content/\d+$", ["type", "text"]),
    "questions": (r"/questions/\d+$", ["question", "header"]),
    "options": (r"/options/\d+$", ["label", "description"]),
    "edits": (r"/edits/\d+$", ["old", "new", "old_string", "new_string"]),
    "prompts": (r"^/attachment/prompt/\d+$", ["type", "text"]),
}
#: Elements that no pattern takes, and what lies in a body outside of any element.
OTHERS, RECORDS = "others", "records"

_ENTITY_DDL = "raw_id long, stream_key string, node string, owner string, ordinal long, entity string, canonical_type string, fields map<string,string>"
_ENTITY = pa.schema([
    ("raw_id", pa.int64()), ("stream_key", pa.string()), ("node", pa.string()), ("owner", pa.string()), ("ordinal", pa.int64()),
    ("entity", pa.string()), ("canonical_type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
])


def objects(value: object) -> Iterator[tuple[str, str, int | None, str, dict]]:
    """(node, owner, ordinal, path as ``a.b[]``, object) of the top and of every object that is an array element."""
    if type(value) is dict:
        yield "", "", None, "", value
    stack = [("", "", "", value)]
    while stack:
        node, owner, path, v = stack.pop()
        if type(v) is dict:
            for k, x in v.items():
                if type(x) is dict or type(x) is list:
                    stack.append((f"{node}/{escape(k)}", owner, f"{path}.{k}" if path else k, x))
        elif type(v) is list:
            for i, x in enumerate(v):
                at = f"{node}/{i}"
                if type(x) is dict:
                    yield at, owner, i, path + "[]", x
                    stack.append((at, at, path + "[]", x))
                elif type(x) is list:
                    stack.append((at, owner, path + "[]", x))


def flat(value: dict) -> dict[str, str]:
    """The scalars of an object and of the objects in it, under dotted names (``input.command``); nulls are left out.

    An array is left to its elements' own rows where all are objects; any other is its JSON, and so is an empty
    container. A dot inside a key is written ``~1``.
    """
    out: dict[str, str] = {}
    stack = [("", value)]
    while stack:
        before, v = stack.pop()
        for k, x in v.items():
            name = before + k.replace("~", "~0").replace(".", "~1")
            if type(x) is dict and x:
                stack.append((name + ".", x))
            elif type(x) is dict or type(x) is list:
                if not x or not all(type(y) is dict for y in x):
                    out[text(name)] = text(dumps(x))
            elif x is not None:
                out[text(name)] = scalar(x)[1]
    return out


def _columns(keys: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """A column name for each key; one that differs from an earlier in case only gets underscores."""
    used, out = {t.lower() for t in taken}, {}
    for k in keys:
        name = k
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out[k] = name
    return out


def entities(raw_records: DataFrame, names: Iterable[str] = (*ENTITIES, OTHERS, RECORDS)) -> dict[str, DataFrame]:
    """The entity tables: raw_id, stream_key, node, owner, ordinal, link_raw_id, canonical_type and the entity's scalars.

    A column for each scalar any row has, nested objects dotted (``flat``). All children of an object are in
    one body, so they are folded where they are read and only names of columns reach the driver.
    ``canonical_type`` is the discriminator under whatever name its file writes it (``drift.canonical_names``),
    of ``{"name": x}`` x; ``link_raw_id`` is as in ``linked_elements``.
    """
    from .drift import canonical_names, canonical_text

    names = list(names)
    patterns = [(n, re.compile(where)) for n, (where, _) in ENTITIES.items()]
    chief = canonical_names(raw_records)

    def kind(path: str, v: dict) -> str | None:
        at = lambda k: f"{path}.{k}" if path else k
        wanted = chief.get(at("type"), at("type"))
        same = [k for k in v if v[k] is not None and chief.get(at(k), at(k)) == wanted]
        return canonical_text(v[min(same, key=lambda k: (k != "type", k))]) if same else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for raw_id, stream, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ok, value = load(body)
                for node, owner, ordinal, path, v in objects(value) if ok else ():
                    found = [n for n, where in patterns if where.search(node)] if path else [RECORDS]
                    for n in found or [OTHERS]:
                        if n in names:
                            rows.append((raw_id, stream, text(node), text(owner), ordinal, n, kind(path, v), list(flat(v).items())))
                if len(rows) >= BATCH_NODES:
                    yield _entity_batch(rows)
                    rows = []
        if rows:
            yield _entity_batch(rows)

    wide = settle(raw_records.select("raw_id", "stream_key", "body").mapInArrow(run, _ENTITY_DDL), "entities")
    keys: dict[str, set[str]] = {n: set() for n in names}
    for r in wide.select("entity", F.explode(F.map_keys("fields")).alias("key")).distinct().collect():
        keys[r["entity"]].add(r["key"])
    ids = pivot(shred(raw_records, ["id"], every_object=False), ["id"]).filter("element and f_id is not null")
    calls = settle(ids.groupBy(F.coalesce("stream_key", F.lit("")).alias("in_stream"), F.col("f_id").alias("answers")).agg(F.min("raw_id").alias("link_raw_id")), "calls")
    wide = wide.withColumn("answers", F.when(F.col("entity") != RECORDS, F.col("fields")["tool_use_id"])).withColumn("in_stream", F.coalesce("stream_key", F.lit("")))
    first = ["raw_id", "stream_key", "node", "owner", "ordinal", "link_raw_id", "canonical_type"]
    out = {}
    for n in names:
        rows, always = wide.filter(F.col("entity") == n), ENTITIES[n][1] if n in ENTITIES else []
        columns = _columns([*always, *sorted(keys[n] - set(always))], first)
        none = rows.filter("answers is null").withColumn("link_raw_id", F.lit(-1).cast("long"))
        linked = rows.filter("answers is not null").join(calls, ["in_stream", "answers"], "left").withColumn("link_raw_id", F.coalesce("link_raw_id", F.lit(-1)).cast("long"))
        both = none.select(*first, "fields").unionByName(linked.select(*first, "fields"))
        out[n] = both.select(*first, *[F.col("fields")[k].alias(c) for k, c in columns.items()])
    return out


def _entity_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTITY, strict=True)], schema=_ENTITY)

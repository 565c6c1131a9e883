"""Problem 5: schemas that drift between the files of a stream, by tagged-union inference.

Each task infers the schema of its share of a file: per path a set of JSON types (the tagged union). Schemas
fuse by union, so the fused schema of a file is one aggregation over few rows. A path with several types is
split into typed branches, with one canonical conversion next to them. Changes are read off neighbouring
files; a rename is settled by values that the removed and the added path share.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, settle
from .shred import dumps, load, text

# The bit of each JSON type.
TYPES = {"string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16}
_BIT = {str: 1, int: 2, float: 2, bool: 4, list: 8, dict: 16}


def walk(value: object) -> Iterator[tuple[str, object]]:
    """(path, value) of everything below the top that isn't null; ``a.b[].c``, the values of a path in the order of the text."""
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        top = len(stack)
        if type(v) is dict:
            for k, x in v.items():
                if x is not None:
                    at = f"{path}.{k}" if path else k
                    yield at, x
                    if type(x) is dict or type(x) is list:
                        stack.append((at, x))
        elif type(v) is list:
            at = path + "[]"
            for x in v:
                if x is not None:
                    yield at, x
                    if type(x) is dict or type(x) is list:
                        stack.append((at, x))
        stack[top:] = reversed(stack[top:])


_FILE = "stream_key string, file_no int"
_PARTIAL = pa.schema([("stream_key", pa.string()), ("file_no", pa.int32()), ("path", pa.string()), ("types", pa.int32())])


def _infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple, dict[str, int]] = {}
        for stream, file_no, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            types = seen.setdefault((stream, file_no), {})
            ok, value = load(body)
            if ok:
                for path, v in walk(value):
                    types[path] = types.get(path, 0) | _BIT[type(v)]
        rows = [(s, f, p and text(p), t) for (s, f), types in seen.items() for p, t in [(None, 0), *types.items()]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTIAL, strict=True)], schema=_PARTIAL)


def file_schemas(raw_records: DataFrame) -> DataFrame:
    """(stream_key, file_no, path, types): the fused tagged union per file; a row without path per file.

    ``types`` is a set of bits of ``TYPES``. Files whose lines are all invalid have only the row without path.
    """
    part = raw_records.select("stream_key", F.col("file_no").cast("int").alias("file_no"), "body").mapInArrow(_infer, _FILE + ", path string, types int")
    return part.groupBy("stream_key", "file_no", "path").agg(F.bit_or("types").alias("types"))


def _parent(path: str) -> F.Column:
    return F.regexp_replace(path, r"(^|\.)[^.]*$", "")


def _in_files(raw_records: DataFrame) -> DataFrame:
    return raw_records.select("stream_key", "file_no", "body").filter("stream_key is not null and file_no is not null")


def changes(raw_records: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(stream_key, file_no, change_kind, field_path, new_path): each file against the one before it in its stream.

    ``removed``, ``added``, ``retyped`` and ``renamed`` as TESTDATA.md has them; a renamed pair is reported
    once, not as removed and added too. Where one path shares values with several, each pair is reported. A file without valid lines has no paths. Lines without a
    stream or file number belong to no file and are left out; an empty table has no changes. ``schemas``:
    the settled ``file_schemas`` of these lines, where they are at hand.
    """
    raw_records = _in_files(raw_records)
    schemas = schemas or settle(file_schemas(raw_records), "schemas")
    w = Window.partitionBy("stream_key").orderBy("file_no")
    files = schemas.filter(F.col("path").isNull()).select("stream_key", "file_no", F.lag("file_no").over(w).alias("before"), F.lead("file_no").over(w).alias("after"))
    files = broadcast_if_small(files)
    sides = schemas.filter(F.col("path").isNotNull()).join(files, ["stream_key", "file_no"])
    # Each file's schema is the new side of one comparison and the old side of the next.
    sides = sides.select(
        "stream_key", "path",
        F.explode(F.array(
            F.struct(F.when(F.col("before").isNotNull(), F.col("file_no")).alias("file_no"), F.col("types").alias("new"), F.lit(None).cast("int").alias("old")),
            F.struct(F.col("after").alias("file_no"), F.lit(None).cast("int").alias("new"), F.col("types").alias("old")),
        )).alias("x"),
    ).select("stream_key", "path", "x.*").filter(F.col("file_no").isNotNull())
    both = sides.groupBy("stream_key", "file_no", "path").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    kind = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("new") != F.col("old"), "retyped")
    found = settle(both.withColumn("change_kind", kind).filter(F.col("change_kind").isNotNull()), "changes")
    renamed = settle(_renames(raw_records, found, files), "renames")
    gone = renamed.select("stream_key", "file_no", F.explode(F.array("field_path", "new_path")).alias("path")).distinct()
    plain = found.join(gone, ["stream_key", "file_no", "path"], "left_anti")
    plain = plain.select("stream_key", "file_no", "change_kind", F.col("path").alias("field_path"), F.lit("").alias("new_path"))
    return plain.unionByName(renamed.select("stream_key", "file_no", F.lit("renamed").alias("change_kind"), "field_path", "new_path"))


def _renames(raw_records: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of a removed and an added path of one parent that share a string value."""
    side = lambda kind, types: found.filter((F.col("change_kind") == kind) & (F.col(types).bitwiseAND(1) == 1)).withColumn("parent", _parent("path"))
    key = ["stream_key", "file_no", "parent"]
    removed, added = side("removed", "old"), side("added", "new")
    # Only paths that have a partner are worth their values: the removed ones in the file before, the added in this one.
    old = removed.join(added.select(*key), key, "left_semi").join(files.select("stream_key", "file_no", "before"), ["stream_key", "file_no"]).select("stream_key", F.col("before").alias("in_file"), F.struct("path", "file_no", F.lit(True).alias("old")).alias("want"))
    new = added.join(removed.select(*key), key, "left_semi").select("stream_key", F.col("file_no").alias("in_file"), F.struct("path", "file_no", F.lit(False).alias("old")).alias("want"))
    wanted = old.unionByName(new).groupBy("stream_key", F.col("in_file").alias("file_no")).agg(F.collect_set("want").alias("wanted"))
    wanted = broadcast_if_small(settle(wanted, "wanted"))
    lines = raw_records.select("stream_key", F.col("file_no").cast("int").alias("file_no"), "body").join(wanted, ["stream_key", "file_no"])
    values = lines.select("stream_key", F.transform("wanted", lambda x: F.to_json(x)).alias("wanted"), "body").mapInArrow(_values, _VALUES_DDL).distinct()
    # Both sides of a value meet in one aggregation: a value is under few candidate paths of one parent.
    side = lambda old: F.collect_set(F.when(F.col("old") == old, F.col("path")))
    met = values.groupBy("stream_key", "file_no", _parent("path").alias("parent"), "value").agg(side(True).alias("olds"), side(False).alias("news"))
    pairs = met.filter("size(olds) > 0 and size(news) > 0").select("stream_key", "file_no", F.explode("olds").alias("field_path"), "news").distinct()
    return pairs.select("stream_key", "file_no", "field_path", F.explode("news").alias("new_path")).distinct()


_VALUES_DDL = "stream_key string, file_no int, path string, old boolean, value binary"
_VALUES = pa.schema([("stream_key", pa.string()), ("file_no", pa.int32()), ("path", pa.string()), ("old", pa.bool_()), ("value", pa.binary())])


def _values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit marks of the string values at the wanted paths."""
    for batch in batches:
        out: set[tuple] = set()
        for stream, wanted, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ok, value = load(body)
            if not ok:
                continue
            want: dict[str, list] = {}
            for w in map(json.loads, wanted):
                want.setdefault(w["path"], []).append((w["file_no"], w["old"]))
            for path, v in walk(value):
                if type(v) is str and path in want:
                    mark = xxhash.xxh3_128_digest(v.encode("utf-8", "surrogatepass"))
                    for file_no, old in want[path]:
                        out.add((stream, file_no, path, old, mark))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _VALUES, strict=True)], schema=_VALUES)


_BRANCH_DDL = "raw_id long, stream_key string, file_no int, path string, written_path string, ordinal int, as_string string, as_number double, as_boolean boolean, canonical string"
_BRANCH = pa.schema([("raw_id", pa.int64()), ("stream_key", pa.string()), ("file_no", pa.int32()), ("path", pa.string()), ("written_path", pa.string()), ("ordinal", pa.int32()), ("as_string", pa.string()), ("as_number", pa.float64()), ("as_boolean", pa.bool_()), ("canonical", pa.string())])
#: Rows a task gives on at a time.
BATCH_VALUES = 20_000


def _bare(path: str) -> str:
    """The path of the field itself, without the marks of its elements."""
    while path.endswith("[]"):
        path = path[:-2]
    return path


def canonical_names(raw_records: DataFrame) -> dict[str, str]:
    """Every renamed field's other names and the one they come out under, by the renames of all streams.

    Names that renames lead to, directly or in steps, are one field; it goes by the name that most files have,
    then the smallest. Names that stand side by side in some file are two fields and never meet: the renames
    that most files show are joined first, one that would bring such names together isn't. Only names come to
    the driver, as many as fields have.
    """
    schemas = settle(file_schemas(_in_files(raw_records)), "schemas")
    pairs: dict[tuple[str, str], int] = {}
    for r in changes(raw_records, schemas).filter("change_kind = 'renamed'").groupBy("field_path", "new_path").count().collect():
        a, b = sorted((_bare(r["field_path"]), _bare(r["new_path"])))
        if a != b:
            pairs[a, b] = pairs.get((a, b), 0) + r["count"]
    if not pairs:
        return {}
    names = raw_records.sparkSession.createDataFrame([(n,) for n in sorted({n for p in pairs for n in p})], "path string")
    held = schemas.withColumn("path", F.regexp_replace("path", r"(\[\])+$", "")).join(broadcast_if_small(names), "path").select("stream_key", "file_no", "path").distinct()
    held = settle(held.withColumn("parent", _parent("path")), "names")
    files = {r["path"]: r["count"] for r in held.groupBy("path").count().collect()}
    both = held.alias("a").join(held.alias("b"), ["stream_key", "file_no", "parent"]).filter("a.path < b.path").select(F.col("a.path").alias("a"), F.col("b.path").alias("b")).distinct()
    apart = {(r["a"], r["b"]) for r in both.collect()}
    group = {n: {n} for n in files}
    for a, b in sorted(pairs, key=lambda p: (-pairs[p], p)):
        if group[a] is not group[b] and not any((min(x, y), max(x, y)) in apart for x in group[a] for y in group[b]):
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    chief = {n: min(g, key=lambda x: (-files[x], x)) for n, g in group.items()}
    return {n: c for n, c in chief.items() if n != c}


def canonical_path(path: str, names: dict[str, str]) -> str:
    """``path`` with each renamed field on its way under its canonical name."""
    if not names:
        return path
    out, at = "", ""
    for part in path.split("."):
        at = f"{at}.{part}" if at else part
        bare = _bare(at)
        last = names[bare].rpartition(".")[2] + at[len(bare) :] if bare in names else part
        out = f"{out}.{last}" if out else last
    return out


def consistent(raw_records: DataFrame, paths: Iterable[str] | None = None) -> DataFrame:
    """One table over all files: every value that isn't null, of any path, conflicts split into typed branches.

    (raw_id, stream_key, file_no, path, written_path, ordinal, as_string, as_number, as_boolean, canonical).
    ``path`` is the field's canonical path (``canonical_names``), ``written_path`` the one in this line; the
    ordinal counts a line's values of one ``path`` in their order. ``canonical`` is the text of a scalar and of
    a container its JSON; an object with the one field ``name`` stands for it. ``paths`` are for a reader who
    wants only these, as they are written.
    """
    wanted = None if paths is None else frozenset(paths)
    names = canonical_names(raw_records) if wanted is None else {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        rows: list[tuple] = []
        for batch in batches:
            for raw_id, stream, file_no, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ok, value = load(body)
                counts: dict[str, int] = {}
                for written, v in walk(value) if ok else ():
                    if wanted is None or written in wanted:
                        path = known.get(written)
                        if path is None:
                            path = canonical_path(written, names)
                            if len(known) < BATCH_VALUES:
                                known[written] = path
                        counts[path] = counts.get(path, -1) + 1
                        rows.append((raw_id, stream, file_no, text(path), text(written), counts[path], *_branches(v)))
                if len(rows) >= BATCH_VALUES:
                    yield _branch_batch(rows)
                    rows = []
        if rows:
            yield _branch_batch(rows)

    return raw_records.select("raw_id", "stream_key", F.col("file_no").cast("int").alias("file_no"), "body").mapInArrow(run, _BRANCH_DDL)


def _branch_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BRANCH, strict=True)], schema=_BRANCH)


def _number(v: int | float) -> float:
    try:
        return float(v)
    except OverflowError:
        return math.inf if v > 0 else -math.inf


def _branches(v: object) -> tuple:
    kind = _BIT[type(v)]
    if kind == 1:
        return text(v), None, None, text(v)
    if kind == 4:
        return None, None, v, "true" if v else "false"
    if kind == 2:
        return None, _number(v), None, json.dumps(v)
    if kind == 16 and list(v) == ["name"] and type(v["name"]) is str:
        return None, None, None, text(v["name"])
    return None, None, None, text(dumps(v, sort_keys=True))


def canonical_text(v: object) -> str:
    """One text for a value however it is typed: of a scalar its text, of ``{"name": x}`` x, of a container its JSON."""
    return _branches(v)[3]

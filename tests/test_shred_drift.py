"""Problems 2 and 5, against recursion over the parsed bodies."""

import json
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.operators import drift, shred

from .conftest import TESTDATA

RAW = "raw_id long, stream_key string, file_no int, source_id string, line_no long, received_at timestamp, body string"


def raw(spark, rows, extra=""):
    return spark.createDataFrame([(i, s, f, None, i, None, b) for i, s, f, b in rows], RAW + extra)


def elements(rows):
    out, ids = [], {}

    def walk(v, path, owner, is_element):
        if isinstance(v, dict):
            if is_element:
                out.append((i, s, path, owner, v))
                owner = path
                if isinstance(v.get("id"), str):
                    ids[s, v["id"]] = min(i, ids.get((s, v["id"]), i))
            for k, x in v.items():
                walk(x, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", owner, False)
        elif isinstance(v, list):
            for j, x in enumerate(v):
                walk(x, f"{path}/{j}", owner, True)

    for i, s, _, b in rows:
        try:
            walk(json.loads(b), "", "", False)
        except (ValueError, TypeError):
            pass
    return {(i, p, o, ids.get((s, e.get("tool_use_id")), -1)) for i, s, p, o, e in out}


@pytest.fixture(scope="module")
def table(spark):
    df = spark.read.parquet(f"{TESTDATA}/raw_records.parquet")
    return df, [tuple(r) for r in df.select("raw_id", "stream_key", "file_no", "body").collect()]


def test_elements_of_the_table(table):
    df, rows = table
    got = [tuple(r) for r in shred.linked_elements(df).collect()]
    assert set(got) == elements(rows) and len(got) == len(set(got)) > 100


def test_elements_by_hand(spark):
    rows = [
        (1, "s", 1, '{"a":[{"id":"t"},[{"x/y~":[{"tool_use_id":"t"}]}],3,null,{}]}'), (2, "s", 1, '{"a":[{"id":"t"},{"tool_use_id":"t"},{"tool_use_id":"none"},{"tool_use_id":null}]}'), (3, "r", 1, '[{"tool_use_id":"t"}]'),
        (4, "s", 1, '{"a":[{'), (5, "s", 1, None), (6, "s", 1, ""), (7, "s", 1, '{"a":[{"v":NaN}]}'), (8, "s", 1, "[" * 50000), (9, "s", 1, '[{"n":' + "9" * 5000 + "}]"), (10, None, 1, '[{"id":"t"},{"tool_use_id":"t"}]'),
    ]
    got = {tuple(r) for r in shred.linked_elements(raw(spark, rows)).collect()}
    assert got == elements([r for r in rows if r[0] not in (7, 8, 9)]) | {(9, "/0", "", -1)}
    assert (1, "/a/1/0/x~1y~0/0", "/a/1/0", 1) in got and (3, "/0", "", -1) in got


def test_adjacency_round_trip(spark):
    body = {"a": {"b": [1, "x", {"c": None}], "d": True}, "e": [], "f": {}, "g": 1.5}
    rows = shred.shred(raw(spark, [(1, "s", 1, json.dumps(body))])).collect()
    at = {r["node"]: r for r in rows}

    def build(node):
        r = at[node]
        below = [x for x in rows if x["parent"] == node]
        if r["kind"] == "object":
            return {x["label"]: build(x["node"]) for x in below}
        if r["kind"] == "array":
            return [build(x["node"]) for x in sorted(below, key=lambda x: x["ordinal"])]
        return {"string": str, "number": json.loads, "boolean": lambda s: s == "true", "null": lambda s: None}[r["kind"]](r["scalar"])

    assert build("") == body


def test_entities(table):
    df, rows = table
    items = shred.entities(df)["items"].collect()
    exp = {(i, f"/message/content/{j}", c.get("type"), c.get("text")) for i, _, _, b in rows for j, c in _content(b)}
    assert {(r["raw_id"], r["node"], r["type"], r["text"]) for r in items} == exp


def _content(b):
    try:
        c = json.loads(b)["message"]["content"]
    except (ValueError, KeyError, TypeError):
        return []
    return [(j, x) for j, x in enumerate(c) if isinstance(x, dict)] if isinstance(c, list) else []


def changes(rows):
    kinds = {str: "s", bool: "b", int: "n", float: "n", list: "a", dict: "o"}
    files = defaultdict(lambda: defaultdict(lambda: (set(), set())))

    def walk(v, path, out):
        for p, x in [(f"{path}.{k}" if path else k, x) for k, x in v.items()] if isinstance(v, dict) else [(path + "[]", x) for x in v] if isinstance(v, list) else []:
            if x is not None:
                out[p][0].add(kinds[type(x)])
                if isinstance(x, str):
                    out[p][1].add(x)
                walk(x, p, out)

    for _, s, f, b in rows:
        out = files[s, f]
        try:
            walk(json.loads(b), "", out)
        except (ValueError, TypeError):
            pass
    found = set()
    for s, f in files:
        before = max((g for t, g in files if t == s and g < f), default=None)
        if before is None:
            continue
        old, new, used = files[s, before], files[s, f], set()
        gone, came = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
        for a in gone:
            for b in came:
                if a.rpartition(".")[0] == b.rpartition(".")[0] and old[a][1] & new[b][1] and not {a, b} & used:
                    used |= {a, b}
                    found.add((s, f, "renamed", a, b))
        found |= {(s, f, "removed", a, "") for a in gone if a not in used} | {(s, f, "added", b, "") for b in came if b not in used}
        found |= {(s, f, "retyped", p, "") for p in old.keys() & new.keys() if old[p][0] != new[p][0]}
    return found


def test_changes_of_the_table(table):
    df, rows = table
    got = [tuple(r) for r in drift.changes(df).collect()]
    assert set(got) == changes(rows) and len(got) == len(set(got))


def test_changes_by_hand(spark):
    rows = [
        (1, "s", 1, '{"a":"v","x":{"k":"q"},"n":1,"z":null,"l":[1,"t"]}'), (2, "s", 3, '{"b":"v","x":{"m":"q"},"n":"1","z":2,"l":[1]}'), (3, "s", 3, "broken"), (4, "s", 4, None),
        (5, "t", 1, '{"a":"1"}'), (6, None, 1, '{"a":1}'), (7, "t", None, '{"q":1}'),
    ]
    got = {tuple(r) for r in drift.changes(raw(spark, rows)).collect()}
    assert got == changes(rows[:5])
    assert ("s", 3, "renamed", "a", "b") in got and ("s", 3, "renamed", "x.k", "x.m") in got and ("s", 3, "retyped", "n", "") in got and ("s", 3, "added", "z", "") in got


def test_consistent_table(spark):
    rows = [(1, "s", 1, '{"v":"2.1"}'), (2, "s", 2, '{"v":2}'), (3, "s", 3, '{"v":{"name":"x"}}'), (4, "s", 3, '{"v":[true,false]}'), (5, "s", 3, '{"v":true}'), (6, "s", 3, "no")]
    got = {r["raw_id"]: (r["as_string"], r["as_number"], r["as_boolean"], r["canonical"]) for r in drift.consistent(raw(spark, rows), ["v"]).collect()}
    assert got == {1: ("2.1", None, None, "2.1"), 2: (None, 2.0, None, "2"), 3: (None, None, None, "x"), 4: (None, None, None, "[true, false]"), 5: (None, None, True, "true")}


def test_empty(spark):
    none = raw(spark, [])
    assert shred.linked_elements(none).count() == 0 and drift.changes(none).count() == 0 and drift.consistent(none, ["a"]).count() == 0
    clash = spark.createDataFrame([(1, "s", 1, None, 1, None, '[{"id":"a"}]', "k", "p", True)], RAW + ", kind string, path string, element boolean")
    assert shred.linked_elements(clash).count() == 1 and drift.changes(clash).count() == 0


def test_consistent_table_has_every_field_under_one_name(spark):
    rows = [
        (1, "s", 1, '{"type":"user","m":{"c":[{"type":"text","id":"a"},{"type":"tool","id":"b"}]},"tags":["x"],"n":1}'),
        (2, "s", 2, '{"kind":"user","m":{"c":[{"kind":"text","id":"a"},{"kind":{"name":"tool"}}]},"labels":["x",null],"n":"1","e":{}}'),
        (3, "t", 1, '{"kind":{"name":"user"},"late":' + "9" * 400 + "}"), (4, "t", 1, "{broken"), (5, None, None, '{"kind":true}'),
    ]
    got = {(r["raw_id"], r["path"], r["ordinal"]): (r["written_path"], r["canonical"]) for r in drift.consistent(raw(spark, rows)).collect()}
    # The name that most files have, then the smallest: kind (2 of 3 files), labels and m.c[].kind (1 of 2).
    assert {k: v for k, v in got.items() if k[1] == "kind"} == {(1, "kind", 0): ("type", "user"), (2, "kind", 0): ("kind", "user"), (3, "kind", 0): ("kind", "user"), (5, "kind", 0): ("kind", "true")}
    assert [got[1, "m.c[].kind", i] for i in (0, 1)] == [("m.c[].type", "text"), ("m.c[].type", "tool")]
    assert [got[2, "m.c[].kind", i] for i in (0, 1)] == [("m.c[].kind", "text"), ("m.c[].kind", "tool")]
    assert got[1, "labels[]", 0] == ("tags[]", "x") and got[1, "labels", 0] == ("tags", '["x"]') and got[2, "e", 0] == ("e", "{}") and got[3, "late", 0][1] == "9" * 400
    expected = sum(1 for _, _, _, b in rows if not b.startswith("{broken") for _ in drift.walk(json.loads(b)))
    assert len(got) == expected


def test_names_side_by_side_are_two_fields(spark):
    rows = [(1, "s", 1, '{"a":"v"}'), (2, "s", 2, '{"b":"v"}'), (3, "t", 1, '{"a":"1","b":"2"}')]
    assert drift.canonical_names(raw(spark, rows)) == {}
    assert drift.canonical_names(raw(spark, rows[:2])) == {"b": "a"}


def test_consistent_table_is_whole(table):
    df, rows = table
    expected = 0
    for *_, b in rows:
        ok, value = shred.load(b)
        expected += sum(1 for _ in drift.walk(value)) if ok else 0
    got = drift.consistent(df)
    assert got.count() == expected and not {"recordType", "record_type", "modelName"} & {r["path"] for r in got.select("path").distinct().collect()}


def test_entities_have_every_scalar(spark):
    item = {"kind": {"name": "tool_use"}, "id": "c", "input": {"edits": [{"old": "a", "new": "b", "extra": 1}], "a.b": {"c": True}, "tags": ["x", 1]}, "ID": "upper", "thinking": "t"}
    rows = [
        (1, "s", 1, json.dumps({"m": 1, "message": {"content": [{"type": "text", "text": "q"}, {"type": "tool_use"}]}})),
        (2, "s", 2, json.dumps({"message": {"content": [{"kind": "text", "text": "q"}, item]}, "x": [{"questions": [{"question": "?", "options": [{"label": "l"}]}]}]})),
        (3, "s", 2, json.dumps({"message": {"content": [{"kind": "tool_result", "tool_use_id": "c", "content": "out"}]}, "attachment": {"prompt": [{"type": "text", "text": "p"}]}})),
        (4, "s", 2, json.dumps({"message": {"content": [{"kind": "tool_result", "tool_use_id": "c", "content": [{"type": "text", "source": {"data": "d"}}]}]}})), (5, "s", 2, "{"),
    ]
    got = {n: {(r["raw_id"], r["node"]): r.asDict() for r in t.collect()} for n, t in shred.entities(raw(spark, rows)).items()}
    tool = got["items"][2, "/message/content/1"]
    assert (tool["input.a~1b.c"], tool["input.tags"], tool["thinking"], tool["canonical_type"], tool["kind.name"], tool["link_raw_id"]) == ("true", '["x", 1]', "t", "tool_use", "tool_use", -1)
    assert {tool["id"], tool["ID_"] if "ID_" in tool else tool["id_"]} == {"c", "upper"}
    assert [got["items"][i, "/message/content/0"][k] for i in (3, 4) for k in ("link_raw_id", "content", "canonical_type")] == [2, "out", "tool_result", 2, None, "tool_result"]
    assert got["blocks"][4, "/message/content/0/content/0"]["source.data"] == "d" and got["prompts"][3, "/attachment/prompt/0"]["text"] == "p" and got["records"][1, ""]["m"] == "1"
    assert got["edits"][2, "/message/content/1/input/edits/0"]["extra"] == "1" and got["edits"][2, "/message/content/1/input/edits/0"]["owner"] == "/message/content/1"
    assert list(got["questions"]) == [(2, "/x/0/questions/0")] and list(got["options"]) == [(2, "/x/0/questions/0/options/0")] and list(got["others"]) == [(2, "/x/0")]
    assert shred.entities(raw(spark, []), ["items"])["items"].count() == 0


def test_entities_are_whole(table):
    df, rows = table
    import __spark_entry__

    assert {"p2_items", "p2_blocks", "p2_questions", "p2_options", "p2_edits", "p2_prompts", "p2_others", "p2_records"} <= set(__spark_entry__.queries())
    tables = shred.entities(df)
    assert sum(tables[n].count() for n in tables if n != "records") == len(elements(rows))
    expected = sum(len(shred.flat(v)) for *_, b in rows for ok, top in [shred.load(b)] if ok for *_, v in shred.objects(top))
    assert sum(r[c] is not None for t in tables.values() for r in t.collect() for c in r.asDict() if c not in ("raw_id", "stream_key", "node", "owner", "ordinal", "link_raw_id", "canonical_type")) == expected
    links = {(r["raw_id"], r["child_path"]): r["link_raw_id"] for r in shred.linked_elements(df).collect()}
    assert all(links[r["raw_id"], r["node"]] == r["link_raw_id"] and r["canonical_type"] for r in tables["items"].collect())


def test_every_renamed_pair(spark):
    rows = [(1, "s", 1, '{"a":"v","d":"w"}'), (2, "s", 1, '{"a":"u"}'), (3, "s", 2, '{"b":"v","c":"u","e":"w","f":"q"}')]
    got = [tuple(r)[2:] for r in drift.changes(raw(spark, rows)).collect()]
    assert sorted(got) == [("added", "f", ""), ("renamed", "a", "b"), ("renamed", "a", "c"), ("renamed", "d", "e")]


LEVELS = 60_000
DEEP = "[" * LEVELS + '{"a":[{"id":"x"},{"tool_use_id":"x"}]}' + "]" * LEVELS


def test_any_depth(spark):
    """Nesting that a parser with calls of its own gives up on, before and after a line of the usual kind."""
    with pytest.raises(RecursionError):
        json.loads(DEEP)
    rows = spark.createDataFrame([(1, "s", 1, DEEP), (2, "s", 2, '{"a":[{"id":"x"}]}'), (3, "s", 2, DEEP[:-1])], "raw_id long, stream_key string, file_no int, body string")
    got = {(r.raw_id, r.child_path): (r.parent_path, r.link_raw_id) for r in shred.linked_elements(rows).collect()}
    top = "/0" * LEVELS
    assert got == {(1, top): ("", -1), (1, top + "/a/0"): (top, -1), (1, top + "/a/1"): (top, 1), (2, "/a/0"): ("", -1)}
    body = '{"a":[' * 1500 + "1" + "]}" * 1500
    changes = drift.changes(spark.createDataFrame([("s", 1, body), ("s", 2, '{"b":1}')], "stream_key string, file_no int, body string"))
    assert sorted(r["count"] for r in changes.groupBy("change_kind").count().collect()) == [1, 3000]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**25), 10**25) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3)), st.sampled_from([None, 1]), st.data())
def test_both_readers_agree(value, indent, data):
    body = json.dumps(value, indent=indent, ensure_ascii=data.draw(st.booleans()))
    if data.draw(st.booleans()):
        at = data.draw(st.integers(0, len(body)))
        body = body[:at] + data.draw(st.sampled_from(["", "x", ",", "}", "]", '"', "NaN", ":", "\\u12"])) + body[at + data.draw(st.integers(0, 1)) :]
    assert repr(shred.load(body)) == repr(shred._load_deep(body))
    assert shred.dumps(value, sort_keys=True) == json.dumps(value, sort_keys=True, ensure_ascii=False)

"""Queries (and SQL, where SQL can say it) of the record-level operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants_sql import WRITTEN_WELL, timed
from ..runtime import table
from . import deliveries, drift, ledger, records, shred, timestamps


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred.linked_elements(table(spark, folder, "raw_records"))


def _entity(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: shred.entities(table(spark, folder, "raw_records"), [name])[name]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = timestamps.normalised(table(spark, folder, "claude_session"), table(spark, folder, "hits"), table(spark, folder, "sources"))
    return rows.select("table_name", "row_key", "instant_us")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "raw_records"))


def p5_consistent(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent(table(spark, folder, "raw_records"))


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent table's scalars: all of its columns but the canonical text."""
    return drift.consistent(table(spark, folder, "raw_records")).filter("coalesce(as_string, cast(as_number as string), cast(as_boolean as string)) is not null").select("raw_id", "stream_key", "file_no", "path", "written_path", "ordinal", "as_string", "as_number", "as_boolean")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.pending_records(table(spark, folder, "source_changes"), table(spark, folder, "source_records"))


def p6_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.ledger(table(spark, folder, "source_changes"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return deliveries.surplus_copies(table(spark, folder, "claude_session"), table(spark, folder, "sources"))


def record_fields(spark: SparkSession, folder: str) -> DataFrame:
    return records.fields(table(spark, folder, "raw_records"))


def record_headers(spark: SparkSession, folder: str) -> DataFrame:
    return records.inherited(records.headers(table(spark, folder, "raw_records")))


def record_events(spark: SparkSession, folder: str) -> DataFrame:
    return records.folded(table(spark, folder, "raw_records")).drop("fields")


def json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """The ``props`` of the events table, flattened."""
    bodies = table(spark, folder, "events").select(F.col("event_id").alias("raw_id"), F.col("props").alias("body"))
    return records.fields(bodies).select(F.col("raw_id").alias("event_id"), "path", "value", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p3_found, p5_found, p5_consistent, p5_values, p6_found, p6_ledger, p7_found, record_fields, record_headers, record_events, json_flatten)
}
QUERIES |= {f"p2_{n}": _entity(n) for n in (*shred.ENTITIES, shred.OTHERS, shred.RECORDS)}

# The bodies as trees; what DuckDB calls valid JSON is the same here.
_TREE = """WITH RECURSIVE nodes AS (SELECT r.raw_id, r.stream_key, r.file_no, t.id, t.parent, t.key, t.type, t.atom FROM (SELECT * FROM raw_records WHERE json_valid(body)) r, json_tree(r.body) t),"""
_START = "CASE WHEN disposition IN ('source_rewritten', 'source_rebuilt') THEN 0 ELSE previous_byte_end END"
_W = "\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B"


def bare_sql(column: str) -> str:
    """A text column without surrounding white space, '' for NULL."""
    return f"coalesce(regexp_replace({column}, '^[{_W}]+|[{_W}]+$', '', 'g'), '')"


#: CTEs that end with ``copies``: claude_session with its instants, ids and, per message, the place of each copy.
COPIES_SQL = timed("SELECT *, written_at AS written FROM claude_session", "dated") + f""",
    named AS (SELECT *, lower({bare_sql('uuid')}) AS own_id, coalesce(session_id, '') AS sess FROM dated),
    copies AS (SELECT *, row_number() OVER (PARTITION BY sess, own_id, CASE WHEN own_id = '' THEN {{'t': coalesce(record_type, ''), 'i': coalesce(instant_us::VARCHAR, ''), 'x': {bare_sql('item_text')}, 'c': {bare_sql('item_content')}}} END
        ORDER BY received_at NULLS LAST, record_id) AS copy_no FROM named)"""
_DRIFT_SQL = (
    _TREE
    + r"""
    p AS (SELECT raw_id, stream_key, file_no, id, type, atom, '' AS path FROM nodes WHERE parent IS NULL
        UNION ALL SELECT n.raw_id, n.stream_key, n.file_no, n.id, n.type, n.atom, CASE WHEN p.type = 'ARRAY' THEN p.path || '[]' WHEN p.path = '' THEN n.key ELSE p.path || '.' || n.key END
        FROM p JOIN nodes n ON n.raw_id = p.raw_id AND n.parent = p.id),
    v AS (SELECT stream_key, file_no, path, CASE WHEN type = 'VARCHAR' THEN 's' WHEN type IN ('ARRAY', 'OBJECT', 'BOOLEAN') THEN type ELSE 'n' END AS kind, CASE WHEN type = 'VARCHAR' THEN atom END AS text FROM p WHERE path <> '' AND type <> 'NULL'),
    s AS (SELECT stream_key, file_no, path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM v GROUP BY ALL),
    f AS (SELECT stream_key, file_no, lag(file_no) OVER (PARTITION BY stream_key ORDER BY file_no) AS before FROM (SELECT DISTINCT stream_key, file_no FROM raw_records)),
    o AS (SELECT f.stream_key, f.file_no, s.path, s.kinds FROM f JOIN s ON s.stream_key = f.stream_key AND s.file_no = f.before),
    n AS (SELECT f.stream_key, f.file_no, s.path, s.kinds FROM f JOIN s ON s.stream_key = f.stream_key AND s.file_no = f.file_no WHERE before IS NOT NULL),
    c AS (SELECT stream_key, file_no, path, CASE WHEN n.kinds IS NULL THEN 'removed' WHEN o.kinds IS NULL THEN 'added' ELSE 'retyped' END AS change_kind, regexp_replace(path, '(^|\.)[^.]*$', '') AS above
        FROM o FULL JOIN n USING (stream_key, file_no, path) WHERE o.kinds IS DISTINCT FROM n.kinds),
    r AS (SELECT DISTINCT a.stream_key, a.file_no, a.path AS field_path, b.path AS new_path FROM c a JOIN c b ON a.change_kind = 'removed' AND b.change_kind = 'added' AND a.stream_key = b.stream_key AND a.file_no = b.file_no AND a.above = b.above
        JOIN f ON f.stream_key = a.stream_key AND f.file_no = a.file_no JOIN v x ON x.stream_key = a.stream_key AND x.file_no = f.before AND x.path = a.path JOIN v y ON y.stream_key = b.stream_key AND y.file_no = b.file_no AND y.path = b.path AND x.text = y.text)
"""
)
SQL = {
    "p3_found": "WITH "
    + timed("SELECT 'claude_session' AS table_name, record_id AS row_key, source_id, written_at AS written FROM claude_session UNION ALL SELECT 'hits', hit_id, source_id, hit_at FROM hits", "dated")
    + f" SELECT table_name, row_key, instant_us FROM dated WHERE instant_us IS NOT NULL AND NOT regexp_matches(written, '{WRITTEN_WELL}')",
    "p7_found": f"WITH {COPIES_SQL} SELECT record_id FROM copies WHERE copy_no > 1",
    "p2_found": _TREE
    + """
    p AS (SELECT raw_id, stream_key, id, type, '' AS ptr, '' AS owner, false AS element FROM nodes WHERE parent IS NULL
        UNION ALL SELECT n.raw_id, n.stream_key, n.id, n.type, p.ptr || '/' || replace(replace(n.key, '~', '~0'), '/', '~1'), CASE WHEN p.element THEN p.ptr ELSE p.owner END, p.type = 'ARRAY' AND n.type = 'OBJECT'
        FROM p JOIN nodes n ON n.raw_id = p.raw_id AND n.parent = p.id),
    e AS (SELECT p.*, i.atom AS own, a.atom AS answers FROM p LEFT JOIN nodes i ON i.raw_id = p.raw_id AND i.parent = p.id AND i.key = 'id' AND i.type = 'VARCHAR'
        LEFT JOIN nodes a ON a.raw_id = p.raw_id AND a.parent = p.id AND a.key = 'tool_use_id' AND a.type = 'VARCHAR' WHERE element),
    calls AS (SELECT stream_key, own AS answers, min(raw_id) AS link FROM e WHERE own IS NOT NULL GROUP BY ALL)
    SELECT raw_id, ptr AS child_path, owner AS parent_path, coalesce(link, -1) AS link_raw_id FROM e LEFT JOIN calls USING (stream_key, answers)""",
    "p5_found": _DRIFT_SQL
    + "SELECT stream_key, file_no, change_kind, path AS field_path, '' AS new_path FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.stream_key = c.stream_key AND r.file_no = c.file_no AND c.path IN (r.field_path, r.new_path)) UNION ALL SELECT stream_key, file_no, 'renamed', field_path, new_path FROM r",
    "p5_values": _DRIFT_SQL.rstrip()
    + r""",
    edges AS (SELECT a, b FROM (SELECT DISTINCT regexp_replace(field_path, '(\[\])+$', '') AS a, regexp_replace(new_path, '(\[\])+$', '') AS b FROM r) WHERE a <> b), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    same AS (SELECT a, b FROM both_ways UNION SELECT s.a, e.b FROM same s JOIN both_ways e ON e.a = s.b),
    held AS (SELECT path, count(*) AS files FROM (SELECT DISTINCT stream_key, file_no, regexp_replace(path, '(\[\])+$', '') AS path FROM s) GROUP BY path),
    chief AS (SELECT a AS name, arg_min(regexp_extract(b, '[^.]*$'), (-files, b)) AS last FROM (SELECT a, b FROM same UNION SELECT a, a FROM same) JOIN held ON held.path = b GROUP BY a),
    q AS (SELECT raw_id, id, type, '' AS written, '' AS path FROM nodes WHERE parent IS NULL
        UNION ALL SELECT n.raw_id, n.id, n.type, CASE WHEN q.type = 'ARRAY' THEN q.written || '[]' WHEN q.written = '' THEN n.key ELSE q.written || '.' || n.key END,
            CASE WHEN q.type = 'ARRAY' THEN q.path || '[]' ELSE CASE WHEN q.path = '' THEN '' ELSE q.path || '.' END || coalesce(c.last, n.key) END
        FROM q JOIN nodes n ON n.raw_id = q.raw_id AND n.parent = q.id LEFT JOIN chief c ON q.type = 'OBJECT' AND c.name = CASE WHEN q.written = '' THEN n.key ELSE q.written || '.' || n.key END),
    ord AS (SELECT *, (row_number() OVER (PARTITION BY raw_id, path ORDER BY id) - 1)::INTEGER AS ordinal FROM q WHERE written <> '' AND type <> 'NULL')
    SELECT raw_id, stream_key, file_no, ord.path, written AS written_path, ordinal, CASE WHEN ord.type = 'VARCHAR' THEN nodes.atom->>'$' END AS as_string, CASE WHEN ord.type NOT IN ('VARCHAR', 'BOOLEAN') THEN nodes.atom::DOUBLE END AS as_number, CASE WHEN ord.type = 'BOOLEAN' THEN nodes.atom = 'true' END AS as_boolean
    FROM ord JOIN nodes USING (raw_id, id) WHERE ord.type NOT IN ('ARRAY', 'OBJECT')""",
    "record_fields": _TREE
    + """
    p AS (SELECT raw_id, id, type, atom, '' AS ptr FROM nodes WHERE parent IS NULL
        UNION ALL SELECT n.raw_id, n.id, n.type, n.atom, p.ptr || '/' || replace(replace(n.key, '~', '~0'), '/', '~1') FROM p JOIN nodes n ON n.raw_id = p.raw_id AND n.parent = p.id)
    SELECT raw_id, (row_number() OVER (PARTITION BY raw_id ORDER BY id) - 1)::INTEGER AS place, ptr AS path, CASE WHEN type = 'NULL' THEN 'null' ELSE atom->>'$' END AS value, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM p WHERE type NOT IN ('ARRAY', 'OBJECT')""",
    "json_flatten": "SELECT event_id, '/k' AS path, json_extract_string(props, '$.k') AS value, 'number' AS kind FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "p6_found": f"""
        SELECT DISTINCT source_id, byte_start FROM source_records r WHERE ends_line AND NOT EXISTS (
            SELECT 1 FROM source_changes c WHERE c.source_id = r.source_id AND c.run_state = 'committed' AND c.run_no >= r.changed_run
            AND {_START} <= r.byte_start AND c.committed_byte_end >= r.byte_start + r.byte_len)""",
    "p6_ledger": f"""
        WITH a AS (SELECT source_id, {_START} AS from_byte, committed_byte_end AS to_byte, (run_no * 1000000 + attempt_no)::BIGINT AS token, max(run_no) FILTER (run_state = 'committed') AS revision,
                bool_or(coalesce(run_state = 'committed', false)) AS ok, bool_and(run_state IS NULL) AS open, epoch_us(max(reported_at)) + {ledger.LEASE_SECONDS * 1_000_000}::BIGINT AS until FROM source_changes GROUP BY ALL),
            i AS (SELECT source_id, from_byte, to_byte, bool_or(ok) AS ok, arg_max(open, token) AS open, arg_max(until, token) AS until, max(token) AS fencing_token, count(*) AS attempts, max(revision) AS revision FROM a GROUP BY ALL),
            s AS (SELECT *, CASE WHEN ok THEN 'done' WHEN open AND until > (SELECT epoch_us(max(reported_at)) FROM source_changes) THEN 'leased' ELSE 'pending' END AS state FROM i)
        SELECT source_id, from_byte, to_byte, state, fencing_token, attempts, revision, CASE WHEN state = 'leased' THEN until / 1e6 END AS expires_at FROM s""",
}


def _entity_sql(where: str, columns: list[str]) -> str:
    """An entity table whose columns are known; in the driver's tables a type is called type, blockType or kind."""
    typed = "coalesce(" + ", ".join(f"max(CASE WHEN rel = '{c}' THEN text END)" for c in ("type", "type.name", "blockType", "kind")) + ")"
    return (
        _TREE.replace("SELECT r.raw_id", "SELECT t.value, r.raw_id")
        + f"""
    p AS (SELECT raw_id, stream_key, id, type, value, atom, '' AS ptr, '' AS owner, false AS element, NULL::BIGINT AS ordinal, NULL::BIGINT AS top, '' AS rel FROM nodes WHERE parent IS NULL
        UNION ALL SELECT n.raw_id, n.stream_key, n.id, n.type, n.value, n.atom, p.ptr || '/' || replace(replace(n.key, '~', '~0'), '/', '~1'), CASE WHEN p.element THEN p.ptr ELSE p.owner END, p.type = 'ARRAY' AND n.type = 'OBJECT', CASE WHEN p.type = 'ARRAY' THEN n.key::BIGINT END,
            CASE WHEN p.element THEN p.id WHEN p.type = 'OBJECT' THEN p.top END, CASE WHEN p.element THEN n.key WHEN p.type = 'OBJECT' THEN p.rel || '.' || n.key END FROM p JOIN nodes n ON n.raw_id = p.raw_id AND n.parent = p.id),
    e AS (SELECT * EXCLUDE (rel) FROM p WHERE element), f AS (SELECT raw_id, top, rel, CASE WHEN type IN ('ARRAY', 'OBJECT') THEN value::VARCHAR ELSE atom->>'$' END AS text FROM p WHERE top IS NOT NULL AND type <> 'NULL' AND (type NOT IN ('ARRAY', 'OBJECT') OR value::VARCHAR IN ('[]', '{{}}'))),
    w AS (SELECT e.raw_id, e.stream_key, e.ptr AS node, e.owner, e.ordinal, {typed} AS canonical_type, max(CASE WHEN rel = 'tool_use_id' THEN text END) AS answers, max(CASE WHEN rel = 'id' THEN text END) AS own,
        {", ".join(f"max(CASE WHEN rel = '{c}' THEN text END) AS \"{c}\"" for c in columns)} FROM e LEFT JOIN f ON f.raw_id = e.raw_id AND f.top = e.id GROUP BY ALL),
    calls AS (SELECT stream_key, own AS answers, min(raw_id) AS link FROM w WHERE own IS NOT NULL GROUP BY ALL)
    SELECT raw_id, stream_key, node, owner, ordinal, coalesce(link, -1) AS link_raw_id, canonical_type, {", ".join(f'"{c}"' for c in columns)} FROM w LEFT JOIN calls USING (stream_key, answers) WHERE regexp_matches(node, '{where}')"""
    )


_BLOCK = ["type", "text", "blockType", "kind", "source.data", "source.encoding", "source.media_type", "type.name"]
_ENTITY_COLUMNS = {
    "items": ["type", "id", "tool_use_id", "name", "text", "is_error", "blockType", "caller.mode", "content", "input.command", "input.description", "input.file_path", "kind", "signature", "source.data", "source.encoding", "source.media_type", "thinking", "type.name"],
    "blocks": _BLOCK, "questions": ["question", "header"], "options": ["label", "description"], "edits": ["old", "new", "old_string", "new_string"], "prompts": _BLOCK,
}
SQL |= {f"p2_{n}": _entity_sql(shred.ENTITIES[n][0], c) for n, c in _ENTITY_COLUMNS.items()}

"""Queries of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.queries import COPIES_SQL, bare_sql
from ..runtime import table
from . import conversations, leakage, mixture, pii, spans


#: For these queries on invented data only; callers bring a key of their own and keep it.
TEST_KEY = "not a secret"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.entities(table(spark, folder, "claude_session"), table(spark, folder, "name_hints"), TEST_KEY).select("record_id", "field_name", "pii_kind", "start_at")


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact(table(spark, folder, "claude_session"), table(spark, folder, "name_hints"), TEST_KEY)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(table(spark, folder, "claude_session"), table(spark, folder, "sources")).select("session_id", "turn_no", "record_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares_kept(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), keep_shares=True)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_pairs(table(spark, folder, "documents"))


def p10_spans(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents")).drop("part")


def p10_share(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_share(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_redacted, p4_found, p8_found, p8_items, p9_mix, p9_shares, p9_shares_kept, p10_found, p10_spans, p10_share)}
_WORDS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))"
_LEAKS = f"""g AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM g)),
    h AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), e AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM h)),
    leaks AS (SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (k))"""
_SPANS = "w AS (SELECT DISTINCT doc_id, i, substring(text, i, 250) AS k FROM (SELECT doc_id, text, unnest(range(1, length(text) - 248)) AS i FROM documents WHERE length(text) >= 250))"
SQL: dict[str, str] = {
    "p4_found": f"""WITH {COPIES_SQL}, kept AS (SELECT *, lower({bare_sql("parent_uuid")}) AS parent_id, coalesce(source_id, '') AS src, coalesce(line_no, 0) AS line,
            record_type IN ('user', 'assistant') AND NOT coalesce(is_sidechain, false) AND NOT coalesce(is_meta, false) AND NOT coalesce(is_compact_summary, false) AND coalesce(item_type, 'text') = 'text' AND {bare_sql("item_text")} <> '' AS spoken,
            record_type = 'attachment' AND {bare_sql("attachment_prompt")} <> '' AS queued FROM copies WHERE copy_no = 1),
        m AS (SELECT *, CASE WHEN spoken THEN record_type ELSE 'user' END AS speaker, row_number() OVER (PARTITION BY sess ORDER BY instant_us NULLS FIRST, src, line, record_id) AS turn_no, count(*) OVER (PARTITION BY sess) AS n FROM kept WHERE spoken OR queued),
        bad AS (SELECT a.sess FROM kept a WHERE parent_id <> '' AND NOT EXISTS (SELECT 1 FROM kept b WHERE b.sess = a.sess AND b.own_id = a.parent_id)
            UNION ALL SELECT sess FROM m WHERE spoken AND msg_role IS DISTINCT FROM record_type OR turn_no = 1 AND speaker <> 'user' OR turn_no = n AND speaker <> 'assistant')
        SELECT sess AS session_id, turn_no, record_id FROM m WHERE sess NOT IN (SELECT sess FROM bad)""",
    "p8_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p8_items": f"WITH {_LEAKS} SELECT i.item_id, i.suite, count(l.doc_id) AS documents FROM eval_items i LEFT JOIN leaks l USING (item_id) GROUP BY ALL",
    "p10_found": f"WITH {_SPANS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.k = b.k AND a.doc_id < b.doc_id",
    "p10_spans": """WITH w AS (SELECT doc_id, text, i, substring(text, i, 250) AS k, CASE WHEN i > 1 THEN substring(text, i - 1, 1) ELSE 'doc ' || doc_id END AS before,
            CASE WHEN i + 250 <= length(text) THEN substring(text, i + 250, 1) ELSE 'doc ' || doc_id END AS after FROM (SELECT doc_id, text, unnest(range(1, length(text) - 248)) AS i FROM documents WHERE length(text) >= 250)),
        s AS (SELECT k, min(before) < max(before) AS l, min(after) < max(after) AS r FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
        x AS (SELECT doc_id, text, i, l OR lag(i) OVER o IS DISTINCT FROM i - 1 OR lag(r) OVER o AS begins FROM w JOIN s USING (k) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        n AS (SELECT doc_id, text, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS piece FROM x),
        p AS (SELECT doc_id, min(i) AS start_at, max(i) - min(i) + 250 AS n_chars, md5(substring(any_value(text), min(i), max(i) - min(i) + 250)) AS class_id FROM n GROUP BY doc_id, piece)
        SELECT doc_id, start_at, n_chars, class_id, documents FROM p JOIN (SELECT class_id, count(DISTINCT doc_id) AS documents FROM p GROUP BY class_id) USING (class_id)""",
    "p10_share": f"""WITH {_SPANS}, s AS (SELECT k FROM w GROUP BY k HAVING count(DISTINCT doc_id) > 1), a AS (SELECT doc_id, i FROM w SEMI JOIN s USING (k)),
        c AS (SELECT doc_id, sum(least(250, coalesce(lead - i, 250)))::BIGINT AS shared_chars FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead FROM a) GROUP BY doc_id)
        SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0.0 END AS share FROM documents LEFT JOIN c USING (doc_id)""",
}

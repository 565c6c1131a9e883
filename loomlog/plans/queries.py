"""Queries of the read plans over the driver's tables, and the same in SQL.

The delivered session records stand for events (``events.session_events``). Times are given as microseconds
since 1970; lists are joined by commas, so that both sides can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import table
from . import ask, commits, joins, resume, said, search, sessions, timeline
from .events import EVENTS_SQL, session_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WITH = f"WITH {EVENTS_SQL}"
_TRIM = r"regexp_replace(human_text, '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+$', '', 'g')"


def query(sql: str | None = None):
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(session_events(table(spark, folder, "claude_session"), table(spark, folder, "sources")))
        if sql:
            SQL[f.__name__] = f"{WITH} {sql}"
        return f

    return add


def own(sql: str | None = None):
    """For queries over other tables: the function gets the session and the folder."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TERMS = ["flaky", "migration", "the shared", "Umgebung", "検索"]
_IN = " UNION ALL ".join(f"SELECT *, '{t}' AS query FROM ev WHERE contains(text, '{t}')" for t in TERMS)


# --- search and history -----------------------------------------------------------------------------------
@query("SELECT event_index, source_id, session, instant_us, substring(text, greatest(1, instr(text, 'migration') - 120), instr(text, 'migration') - greatest(1, instr(text, 'migration') - 120) + 129) AS snippet FROM ev WHERE contains(text, 'migration')")
def search_literal(ev: DataFrame) -> DataFrame:
    hits = search.matches(ev, ["migration"])
    return hits.select("event_index", "source_id", "session", "instant_us", T.snippet(F.col("text"), F.col("query")).alias("snippet"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT event_index, instr({_FOLD}, 'use the') AS at FROM ev WHERE contains({_FOLD}, 'use the')")
def search_ignore_case(ev: DataFrame) -> DataFrame:
    return search.matches(ev, ["Use THE"], ignore_case=True).select("event_index", F.instr(T.fold(F.col("text")), F.lit("use the")).alias("at"))


@query(f"SELECT query, event_index FROM ({_IN})")
def search_multi(ev: DataFrame) -> DataFrame:
    return search.matches(ev, TERMS).select("query", "event_index")


@query(f"""SELECT query, facet, value, n, distinct_values FROM (
    SELECT *, row_number() OVER (PARTITION BY query, facet ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY query, facet) AS distinct_values FROM (
        {' UNION ALL '.join(f"SELECT query, '{c}' AS facet, coalesce({c}, '') AS value, count(*) AS n FROM ({_IN}) GROUP BY ALL" for c in ('source_id', 'session', 'kind', 'sender', 'event_date'))})) WHERE r <= 50""")
def search_facets(ev: DataFrame) -> DataFrame:
    return search.facets(search.matches(ev, TERMS), ["source_id", "session", "kind", "sender", "event_date"])


@query("SELECT event_index, instant_us FROM ev WHERE contains(text, 'flaky') ORDER BY instant_us DESC NULLS LAST, nullif(written, '') DESC NULLS FIRST, source_id DESC, event_index DESC LIMIT 50 OFFSET 20")
def search_page_desc(ev: DataFrame) -> DataFrame:
    return search.page(search.matches(ev, ["flaky"]), 50, 20, newest_first=True).select("event_index", "instant_us")


@query("SELECT event_index, instant_us FROM ev WHERE contains(text, 'flaky') ORDER BY instant_us NULLS LAST, nullif(written, '') NULLS LAST, source_id, event_index LIMIT 50")
def search_page_asc(ev: DataFrame) -> DataFrame:
    return search.page(search.matches(ev, ["flaky"]), 50).select("event_index", "instant_us")


@query("SELECT event_index, kind, sender FROM ev WHERE contains(translate(cwd, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'users') AND kind = 'command' AND sender = 'assistant' AND event_date <> 'undated' AND event_date BETWEEN '2026-01-01' AND '2026-06-30'")
def search_filters(ev: DataFrame) -> DataFrame:
    return search.where(ev, cwd="USERS", kind="command", sender="assistant", since="2026-01-01", until="2026-06-30", skip_imported=True).select("event_index", "kind", "sender")


@query("SELECT event_index FROM ev WHERE role = 'user' AND instant_us >= 1769932800000000 AND instant_us <= 1774828799999999")
def search_instants(ev: DataFrame) -> DataFrame:
    return search.where(ev, role="user", since="2026-02-01T08:00:00Z", until="2026-03-30T01:59:59.999999", zone="Europe/Berlin").select("event_index")


@query("""SELECT event_index, position, truncated, CASE WHEN truncated THEN 60 END AS next_offset FROM (SELECT event_index, row_number() OVER (ORDER BY instant_us NULLS LAST, nullif(written, '') NULLS LAST, source_id, event_index)::INTEGER AS position, count(*) OVER () > 60 AS truncated
    FROM ev WHERE contains(text, 'migration')) WHERE position BETWEEN 21 AND 60""")
def search_page_facts(ev: DataFrame) -> DataFrame:
    return search.page_with_facts(search.matches(ev, ["migration"]), 40, 20).select("event_index", "position", "truncated", "next_offset")


@own("SELECT raw_id, source_id, line_no, octet_length(encode(split_part(body, 'toolu_', 1))) AS at_byte FROM raw_records WHERE contains(body, 'toolu_')")
def search_raw(spark: SparkSession, folder: str) -> DataFrame:
    return search.raw_matches(table(spark, folder, "raw_records"), "toolu_")


@query(f"SELECT query, event_date, count(*) AS matched, count(DISTINCT source_id) AS sources, count(DISTINCT session) AS sessions FROM ({_IN}) GROUP BY ALL")
def history_map(ev: DataFrame) -> DataFrame:
    return search.history(search.matches(ev, TERMS))


@query(f"SELECT * FROM (SELECT query, event_date, count(*) AS matched, count(DISTINCT source_id) AS sources, count(DISTINCT session) AS sessions FROM ({_IN}) GROUP BY query, event_date) ORDER BY event_date = 'undated', event_date DESC, query LIMIT 12")
def history_page(ev: DataFrame) -> DataFrame:
    return search.date_page(search.history(search.matches(ev, TERMS)), 12)


_DATES = " UNION ALL ".join(f"SELECT query, event_date, '{c}' AS facet, coalesce({c}, '') AS value, count(*) AS n FROM ({_IN}) GROUP BY ALL" for c in ("source_id", "session", "kind"))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, event_date, facet ORDER BY n DESC, value)::INTEGER AS rank FROM ({_DATES})) WHERE rank <= 12")
def history_facets(ev: DataFrame) -> DataFrame:
    return search.history_facets(search.matches(ev, TERMS))


@query(f"SELECT * FROM (SELECT query, event_date, count(*) AS matched FROM ({_IN}) GROUP BY query, event_date) ORDER BY matched DESC, event_date = 'undated', event_date DESC, query LIMIT 12")
def history_busiest(ev: DataFrame) -> DataFrame:
    return search.busiest_dates(search.history(search.matches(ev, TERMS))).select("query", "event_date", "matched")


_BUSY = "(SELECT session FROM ev GROUP BY session ORDER BY count(*) DESC, session LIMIT 1)"


@query(f"SELECT event_index, source_id FROM ev WHERE session = {_BUSY} AND source_id IN (SELECT source_id FROM ev WHERE session = {_BUSY})")
def scope_session(ev: DataFrame) -> DataFrame:
    busy = ev.groupBy("session").count().orderBy(F.desc("count"), "session").first()
    return search.in_declared_sources(ev, busy["session"]).select("event_index", "source_id") if busy else ev.select("event_index", "source_id")


# --- timeline ---------------------------------------------------------------------------------------------
_RUNS = """, ordered AS (SELECT *, CASE WHEN event_date IS NOT DISTINCT FROM lag(event_date) OVER w THEN 0 ELSE 1 END AS change FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY line, event_index)),
    numbered AS (SELECT *, sum(change) OVER (PARTITION BY source_id ORDER BY line, event_index) AS run_no FROM ordered),
    runs AS (SELECT source_id, run_no::BIGINT AS run_no, event_date, count(*) AS events, count(DISTINCT session) AS sessions, arg_min(event_index, (line, event_index)) AS first_index, arg_max(event_index, (line, event_index)) AS last_index FROM numbered GROUP BY ALL)"""


@query(_RUNS + " SELECT * FROM runs")
def timeline_runs(ev: DataFrame) -> DataFrame:
    return timeline.runs(ev)


@query(_RUNS + " SELECT event_date, sum(events)::BIGINT AS events, sum(sessions)::BIGINT AS session_runs, count(DISTINCT source_id) AS sources, count(*) AS runs FROM runs GROUP BY ALL")
def timeline_map(ev: DataFrame) -> DataFrame:
    return timeline.date_map(ev)


@query("SELECT event_date, kind, count(*) AS n FROM ev GROUP BY ALL")
def timeline_kinds(ev: DataFrame) -> DataFrame:
    return timeline.kinds_by_date(ev)


@query("SELECT event_index, kind, substring(text, 1, 100) AS head FROM ev WHERE event_date = '2026-03-08' ORDER BY instant_us DESC, source_id DESC, event_index DESC LIMIT 50")
def timeline_day(ev: DataFrame) -> DataFrame:
    return timeline.day(ev, "2026-03-08").select("event_index", "kind", F.substring("text", 1, 100).alias("head"))


# --- kinds and senders --------------------------------------------------------------------------------------
@query("SELECT kind, sender, via, count(*) AS n FROM ev GROUP BY ALL")
def sender_counts(ev: DataFrame) -> DataFrame:
    return ev.groupBy("kind", "sender", "via").agg(F.count("*").alias("n"))


@query("SELECT event_index, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '…[truncated]' ELSE text END AS text, coalesce(length(text) > 300, false) AS cut FROM ev WHERE kind = 'output'")
def output_bounded(ev: DataFrame) -> DataFrame:
    return ev.filter("kind = 'output'").select("event_index", T.truncate(F.col("text"), 300).alias("text"), F.coalesce(F.char_length("text") > 300, F.lit(False)).alias("cut"))


# --- the person's messages ----------------------------------------------------------------------------------
_COPY = "coalesce(instant_us::VARCHAR, 'as written: ' || coalesce(written, '')), CASE WHEN via = 'question_reply' THEN call_id END"
_SAID = f", person AS (SELECT *, {_TRIM} AS said FROM ev WHERE human_text IS NOT NULL), firsts AS (SELECT *, row_number() OVER c AS r, count(*) OVER (PARTITION BY {_COPY}, said) AS copies FROM person WINDOW c AS (PARTITION BY {_COPY}, said ORDER BY source_id, event_index))"


@query("SELECT event_index, session, via, human_text FROM ev WHERE human_text IS NOT NULL")
def said_list(ev: DataFrame) -> DataFrame:
    return said.person(ev).select("event_index", "session", "via", "human_text")


@own(f"{WITH} SELECT event_index FROM ev WHERE human_text IS NOT NULL AND source_id IN (SELECT source_id FROM sources WHERE app = 'claude')")
def said_of_app(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "sources")
    return said.of_app(said.person(session_events(table(spark, folder, "claude_session"), sources)), sources, "claude").select("event_index")


@query(_SAID + " SELECT event_index, copies FROM firsts WHERE r = 1")
def said_dedup(ev: DataFrame) -> DataFrame:
    return said.first_copies(said.person(ev)).select("event_index", "copies")


@query("SELECT event_index FROM ev WHERE human_text IS NOT NULL ORDER BY instant_us DESC NULLS FIRST, source_id DESC, event_index DESC LIMIT 30")
def said_page(ev: DataFrame) -> DataFrame:
    return said.page(said.person(ev)).select("event_index")


_TALK = f""", talk0 AS (SELECT *, CASE WHEN human_text IS NOT NULL THEN {{'t': coalesce(instant_us::VARCHAR, 'as written: ' || coalesce(written, '')), 's': {_TRIM}}} END AS said FROM ev WHERE human_text IS NOT NULL OR reply_text IS NOT NULL),
    talk1 AS (SELECT *, coalesce(said = last_value(said IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line, event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS copy FROM talk0),
    talk AS (SELECT * FROM talk1 WHERE NOT copy)"""


@query(_TALK + " SELECT * FROM (SELECT event_index, human_text, last_value(reply_text IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line, event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM talk) WHERE human_text IS NOT NULL")
def said_context_before(ev: DataFrame) -> DataFrame:
    return said.with_reply_before(ev).select("event_index", "human_text", "before")


@query(_TALK + """, islands AS (SELECT *, count(human_text) OVER w AS turn_no, last_value(CASE WHEN human_text IS NOT NULL THEN event_index END IGNORE NULLS) OVER w AS opener FROM talk WINDOW w AS (PARTITION BY source_id ORDER BY line, event_index)),
    answers AS (SELECT *, coalesce(lag(reply_text) OVER (PARTITION BY source_id, turn_no ORDER BY line, event_index) = reply_text, false) AS again FROM islands WHERE reply_text IS NOT NULL AND opener IS NOT NULL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id, turn_no ORDER BY line DESC, event_index DESC) AS r FROM answers WHERE NOT again)
    SELECT source_id, opener, count(*) AS replies, string_agg(CASE WHEN r <= 3 THEN reply_text END, '|' ORDER BY line, event_index) AS last_replies FROM numbered GROUP BY ALL""")
def said_context_after(ev: DataFrame) -> DataFrame:
    out = said.replies_after(ev)
    return out.withColumn("last_replies", F.array_join(F.col("last_replies.reply_text"), "|"))


@query("SELECT event_index, count(CASE WHEN sender = 'human' THEN 1 END) OVER (PARTITION BY source_id ORDER BY line, event_index) AS turn_no FROM ev")
def turn_assign(ev: DataFrame) -> DataFrame:
    return said.turns(ev).select("event_index", "turn_no")


@query("SELECT event_index, coalesce(cwd, last_value(cwd IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line, event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS cwd FROM ev")
def cwd_inherited(ev: DataFrame) -> DataFrame:
    return joins.carried(ev, "cwd", "source_id", ["line", "event_index"]).select("event_index", "cwd")


# --- sessions -----------------------------------------------------------------------------------------------
@query(_SAID + """, whole AS (SELECT session, min(instant_us) AS started, max(instant_us) AS ended, count(*) AS records, count(*) FILTER (sender = 'assistant') AS agent_records, count(*) FILTER (via = 'compact_boundary') AS compactions, count(DISTINCT source_id) AS sources FROM ev GROUP BY session),
    mine AS (SELECT session, count(*) AS person_messages, sum(length(human_text))::BIGINT AS person_chars, count(*) FILTER (contains(human_text, 'flaky')) AS matched_messages, arg_min(event_index, (instant_us, source_id, event_index)) AS first_message, arg_max(event_index, (instant_us, source_id, event_index)) AS last_message FROM firsts WHERE r = 1 GROUP BY session)
    SELECT w.*, coalesce(person_messages, 0) AS person_messages, coalesce(person_chars, 0) AS person_chars, coalesce(matched_messages, 0) AS matched_messages, first_message, last_message FROM whole w LEFT JOIN mine USING (session)""")
def sessions_summary(ev: DataFrame) -> DataFrame:
    return sessions.summary(ev, "flaky")


@query("SELECT session, min(instant_us) AS started FROM ev GROUP BY session ORDER BY started DESC NULLS LAST, session LIMIT 30")
def sessions_page(ev: DataFrame) -> DataFrame:
    return sessions.page(ev.groupBy("session").agg(F.min("instant_us").alias("started")))


_PLACES = r""", seen AS (SELECT session, regexp_replace(replace(CASE WHEN starts_with(cwd, 'file://') THEN url_decode(substring(cwd, 8)) ELSE cwd END, '\', '/'), '(.)/+$', '\1') AS place, min(instant_us) AS first_seen FROM ev WHERE cwd IS NOT NULL AND cwd <> '' GROUP BY ALL)"""


@query(_PLACES + " SELECT * FROM seen a WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.session = a.session AND starts_with(a.place, b.place || '/'))")
def sessions_places(ev: DataFrame) -> DataFrame:
    return sessions.places(ev)


@query(r"SELECT DISTINCT session FROM ev WHERE replace(cwd, '\', '/') = '/work/amber-board' OR starts_with(replace(cwd, '\', '/'), '/work/amber-board/') OR contains(translate(cwd, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/work/amber-board')")
def sessions_worked_in(ev: DataFrame) -> DataFrame:
    return sessions.worked_in(ev, "/work/amber-board")


@query(""", n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line, event_index) AS k FROM ev)
    SELECT a.event_index AS hit, b.event_index, (b.k - a.k)::INTEGER AS distance FROM n a JOIN n b ON a.source_id = b.source_id AND b.k BETWEEN a.k - 2 AND a.k + 3 WHERE contains(a.text, 'migration')""")
def neighbours_k(ev: DataFrame) -> DataFrame:
    return sessions.neighbours(ev, search.matches(ev, ["migration"]), 2, 3)


# --- resume ---------------------------------------------------------------------------------------------------
@query("""SELECT session, category, r AS rank, event_index FROM (SELECT *, row_number() OVER (PARTITION BY session, category ORDER BY instant_us DESC NULLS LAST, line DESC, event_index DESC)::INTEGER AS r FROM (
    SELECT *, CASE WHEN human_text IS NOT NULL THEN 'human' WHEN reply_text IS NOT NULL THEN 'reply' WHEN kind IN ('command', 'output', 'patch', 'summary') THEN kind END AS category FROM ev) WHERE category IS NOT NULL) WHERE r <= 8""")
def resume_latest(ev: DataFrame) -> DataFrame:
    return resume.latest(ev, 8)


@query("SELECT session, count(*) FILTER (via = 'compact_boundary') AS compactions, max(CASE WHEN via = 'compact_boundary' THEN instant_us END) AS last_compaction, count(*) FILTER (kind = 'summary') AS summaries FROM ev GROUP BY session")
def resume_compactions(ev: DataFrame) -> DataFrame:
    return resume.compactions(ev)


@query(""", turns AS (SELECT *, coalesce(project, '') || ':' || kind AS turn FROM ev), isl AS (SELECT * FROM (SELECT *, turn IS DISTINCT FROM lag(turn) OVER (PARTITION BY session ORDER BY instant_us NULLS FIRST, line, event_index) AS new FROM turns) WHERE new),
    by_turn AS (SELECT session, turn, max((coalesce(instant_us, -9e18::BIGINT), line, event_index)) AS place, count(*) AS islands FROM isl GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY place DESC) AS r FROM by_turn)
    SELECT session, max(CASE WHEN r = 1 THEN turn END) AS "current", max(CASE WHEN r = 2 THEN turn END) AS previous, max(CASE WHEN r = 1 THEN islands END) > 1 AS reentered FROM ranked WHERE r <= 2 GROUP BY session""")
def resume_turns(ev: DataFrame) -> DataFrame:
    return resume.current_and_previous(ev.withColumn("turn", F.concat(F.coalesce("project", F.lit("")), F.lit(":"), "kind")))


@query(""", turns AS (SELECT *, coalesce(project, '') || ':' || kind AS turn FROM ev), isl AS (SELECT * FROM (SELECT *, turn IS DISTINCT FROM lag(turn) OVER (PARTITION BY session ORDER BY instant_us NULLS FIRST, line, event_index) AS new FROM turns) WHERE new),
    by_turn AS (SELECT session, turn, max((coalesce(instant_us, -9e18::BIGINT), line, event_index)) AS place, count(*) AS islands FROM isl GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY place DESC) AS r FROM by_turn),
    mine AS (SELECT t.*, CASE r WHEN 1 THEN 'current' ELSE 'previous' END AS place, r = 1 AND islands > 1 AS again, row_number() OVER (PARTITION BY t.session, r ORDER BY instant_us DESC NULLS LAST, line DESC, event_index DESC) AS back FROM turns t JOIN ranked k ON k.session IS NOT DISTINCT FROM t.session AND k.turn = t.turn WHERE r <= 2)
    SELECT session, place, turn, count(*) AS records, string_agg(CASE WHEN back <= 128 THEN event_index::VARCHAR END, ',' ORDER BY back DESC) AS last_events, coalesce(string_agg(DISTINCT cwd, chr(10) ORDER BY cwd), '') AS directories,
        coalesce(string_agg(DISTINCT project, chr(10) ORDER BY project), '') AS projects, bool_or(coalesce(via IN ('turn_completed', 'completion') OR lower(coalesce(subtype, '')) IN ('turn_duration', 'task_complete', 'turn_complete', 'turn_completed'), false)) AS completed, bool_or(again) AS reentered FROM mine WHERE session IS NOT NULL GROUP BY ALL""")
def resume_snapshots(ev: DataFrame) -> DataFrame:
    rows = resume.snapshots(ev.withColumn("turn", F.concat(F.coalesce("project", F.lit("")), F.lit(":"), "kind")))
    return rows.withColumn("last_events", F.array_join(F.transform("last_events", lambda x: x.cast("string")), ","))


# --- questions, calls and answers -------------------------------------------------------------------------------
@query(""", calls AS (SELECT session, call_id, min(event_index) AS call FROM ev WHERE kind = 'command' AND call_id IS NOT NULL GROUP BY ALL), answers AS (SELECT session, call_id, min(event_index) AS answer FROM ev WHERE kind = 'output' AND call_id IS NOT NULL GROUP BY ALL)
    SELECT session, call_id, call, answer FROM calls LEFT JOIN answers USING (session, call_id)""")
def calls_answered(ev: DataFrame) -> DataFrame:
    return joins.answered(ev)


# --- commits ------------------------------------------------------------------------------------------------------
_NAMES = "(SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Fa-f-]+')) AS name FROM documents) WHERE length(name) BETWEEN 7 AND 40 AND NOT contains(name, '-') AND regexp_matches(name, '[A-Fa-f]'))"
_COMMITS = f"(SELECT DISTINCT rpad(lower(name), 40, '0') AS \"commit\" FROM {_NAMES} UNION SELECT md5(doc_id::VARCHAR) FROM documents)"


def _named(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents")
    found = commits.names(documents, "doc_id", "text").distinct()
    known = found.select(F.rpad(F.lower("name"), 40, "0").alias("commit")).union(documents.select(F.md5(F.col("doc_id").cast("string")))).distinct()
    return found, known


@own(f"SELECT * FROM {_NAMES}")
def commit_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder)[0]


@own(f"SELECT lower(name) AS name, count(DISTINCT doc_id) AS mentions, string_agg(DISTINCT name, ',' ORDER BY name) AS forms FROM {_NAMES} GROUP BY lower(name)")
def commit_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return commits.mentions(_named(spark, folder)[0], "doc_id")


@own(f"SELECT name, min(\"commit\") AS \"commit\" FROM (SELECT DISTINCT lower(name) AS name FROM {_NAMES}) JOIN {_COMMITS} ON starts_with(\"commit\", name) GROUP BY name HAVING count(*) = 1")
def commit_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return commits.resolve(*_named(spark, folder))


@own(f"""WITH r AS (SELECT name, min("commit") AS c FROM (SELECT DISTINCT lower(name) AS name FROM {_NAMES}) JOIN {_COMMITS} ON starts_with("commit", name) GROUP BY name HAVING count(*) = 1),
    m AS (SELECT c, doc_id, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS k FROM (SELECT DISTINCT c, doc_id FROM r JOIN {_NAMES} n ON lower(n.name) = r.name))
    SELECT c AS "commit", count(*) AS mentions, string_agg(CASE WHEN k <= 16 THEN doc_id::VARCHAR END, ',' ORDER BY k) AS earliest FROM m GROUP BY c""")
def commit_mentioned(spark: SparkSession, folder: str) -> DataFrame:
    found, known = _named(spark, folder)
    return commits.mentioned_commits(found.withColumn("at", F.col("doc_id")), known, "doc_id", "at")


# --- asking ---------------------------------------------------------------------------------------------------------
_IDF = f""", hits AS ({_IN}), g AS (SELECT DISTINCT event_index, lower(replace(query, ' ', '')) AS term FROM hits), t AS (SELECT count(DISTINCT event_index) AS total FROM g), d AS (SELECT term, count(*) AS df FROM g GROUP BY term),
    idf AS (SELECT event_index, sum(ln(1 + (total - df + 0.5) / (df + 0.5))) AS idf FROM g JOIN d USING (term), t GROUP BY event_index)"""


@query(_IDF + " SELECT event_index, round(idf, 6) AS idf FROM idf")
def idf_select(ev: DataFrame) -> DataFrame:
    return ask.idf_scores(search.matches(ev, TERMS)).select("event_index", F.round("idf", 6).alias("idf"))


@query()
def month_quota(ev: DataFrame) -> DataFrame:
    scores = ask.idf_scores(search.matches(ev, TERMS)).withColumn("idf", F.round("idf", 9)).join(ev.select("event_index", "event_date", "instant_us"), "event_index")
    return ask.select_by_month(scores, 200).select("event_index", "month", "rank")


@query(f"SELECT event_index, string_agg(DISTINCT query, ',' ORDER BY query) AS terms, count(DISTINCT query)::INTEGER AS n_terms FROM ({_IN}) GROUP BY event_index")
def hits_union(ev: DataFrame) -> DataFrame:
    return ask.union_of_terms(search.matches(ev, TERMS)).withColumn("terms", F.array_join("terms", ","))


@query(f"SELECT query, event_index, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY instant_us DESC NULLS LAST, source_id DESC, event_index DESC)::INTEGER AS r FROM ({_IN})) WHERE r <= 40")
def hits_per_term(ev: DataFrame) -> DataFrame:
    return ask.per_term(search.matches(ev, TERMS), 40).select("query", "event_index", "rank")


@query(f"SELECT event_index, n_terms FROM (SELECT event_index, any_value(sender) AS sender, any_value(instant_us) AS instant_us, count(DISTINCT query)::INTEGER AS n_terms FROM ({_IN}) GROUP BY event_index) ORDER BY n_terms DESC, sender = 'human' DESC, instant_us DESC NULLS LAST, event_index LIMIT 600")
def hits_ranked(ev: DataFrame) -> DataFrame:
    hits = ask.union_of_terms(search.matches(ev, TERMS)).join(ev.select("event_index", "sender", "instant_us"), "event_index")
    return ask.ranked(hits).limit(600).select("event_index", "n_terms")


_SCORED = ", s AS (SELECT event_index, session, event_index AS pos, length(human_text) % 4 AS score FROM ev WHERE human_text IS NOT NULL)"


def _scored(ev: DataFrame) -> DataFrame:
    return said.person(ev).select("event_index", "session", "human_text", F.col("event_index").alias("pos"), (F.char_length("human_text") % 4).alias("score"))


@query(_SCORED + """, t AS (SELECT *, row_number() OVER (PARTITION BY score, session ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY score, session) AS first FROM s)
    SELECT event_index FROM t ORDER BY score DESC, turn, first LIMIT 40""")
def spread_order(ev: DataFrame) -> DataFrame:
    return ask.spread_order(_scored(ev)).limit(40).select("event_index")


@query(_SCORED + """, c AS (SELECT event_index, score AS claim, row_number() OVER (PARTITION BY score ORDER BY pos) AS turn FROM s), o AS (SELECT event_index, min((turn, claim)) AS place FROM c GROUP BY ALL)
    SELECT event_index FROM o ORDER BY place, event_index LIMIT 12""")
def take_in_turn(ev: DataFrame) -> DataFrame:
    return ask.take_in_turn(_scored(ev).withColumnRenamed("score", "claim")).select("event_index")


@query(_SCORED + """, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS i FROM s)
    SELECT session, event_index FROM n WHERE n <= 5 OR i IN (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1)""")
def even_sample(ev: DataFrame) -> DataFrame:
    return ask.even_sample(_scored(ev), 5, ["pos"], ["session"]).select("session", "event_index")


@query(_SCORED + ", n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY pos) AS i FROM s) SELECT session, event_index FROM n WHERE i <= 4 OR n - i < 3")
def half_cap(ev: DataFrame) -> DataFrame:
    return ask.half_cap(_scored(ev), 7, ["pos"], ["session"]).select("session", "event_index")


@query(""", p AS (SELECT event_index, human_text, length(human_text) AS n FROM ev WHERE human_text IS NOT NULL), starts AS (SELECT *, unnest(CASE WHEN n <= 150 THEN [0] ELSE range(0, 80 * ceil((n - 100) / 80.0)::BIGINT + 1, 80) END)::INTEGER AS start FROM p)
    SELECT event_index, (row_number() OVER (PARTITION BY event_index ORDER BY start) - 1)::INTEGER AS piece_no, start, CASE WHEN n <= 150 THEN human_text ELSE substring(human_text, start + 1, 100) END AS piece_text FROM starts""")
def sweep_pieces(ev: DataFrame) -> DataFrame:
    return ask.sweep(ev, 100, 20, 150)


_WORDS = ["which", "flaky", "migration", "needs", "another", "reviewer"]


@query(f""", p AS (SELECT event_index, human_text, length(human_text) AS n FROM ev WHERE human_text IS NOT NULL), starts AS (SELECT *, unnest(CASE WHEN n <= 150 THEN [0] ELSE range(0, 80 * ceil((n - 100) / 80.0)::BIGINT + 1, 80) END)::INTEGER AS start FROM p),
    t AS (SELECT event_index, start, translate(CASE WHEN n <= 150 THEN human_text ELSE substring(human_text, start + 1, 100) END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS piece FROM starts),
    c AS (SELECT event_index, start, least(3, {' + '.join(f"contains(piece, '{w}')::INTEGER" for w in _WORDS)}) AS score FROM t)
    SELECT event_index, max(score) AS score, arg_min(start, (-score, start)) AS focus FROM c GROUP BY event_index""")
def sweep_screened(ev: DataFrame) -> DataFrame:
    pieces = ask.sweep(ev, 100, 20, 150)
    return ask.best_piece(ask.screened(pieces, "Which flaky migration needs another reviewer", ask.LexicalScorer()))


_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


@query(_SCORED + f""" SELECT said, count(*) AS copies, max(score) AS score, min(event_index) AS first_index FROM (SELECT s.*, translate(regexp_replace(translate(e.human_text, '{T._WIDE.replace("'", "''")}', '{T._NARROW.replace("'", "''")}'), '{_BLANK}+', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS said FROM s JOIN ev e USING (event_index)) GROUP BY said""")
def digest_unique(ev: DataFrame) -> DataFrame:
    return ask.digest(_scored(ev))


@query("SELECT session, count(*) AS records, max(instant_us) AS ended FROM ev WHERE session NOT IN (SELECT session FROM ev WHERE contains(text, 'flaky')) GROUP BY session")
def unread_sessions(ev: DataFrame) -> DataFrame:
    return ask.unread_sessions(ev, search.matches(ev, ["flaky"]))


@query("SELECT event_index FROM ev WHERE human_text IS NOT NULL AND session IN (SELECT session FROM ev WHERE starts_with(cwd, '/work/'))")
def scope_semi(ev: DataFrame) -> DataFrame:
    return ask.in_sessions_of(said.person(ev), ev.filter(F.col("cwd").startswith("/work/"))).select("event_index")


@query("SELECT event_index FROM ev WHERE contains(text, 'flaky') AND NOT contains(text, 'migration')")
def take_new_anti(ev: DataFrame) -> DataFrame:
    return ask.take_new(search.matches(ev, ["flaky"]), search.matches(ev, ["migration"])).select("event_index")


@query(""", m AS (SELECT * FROM ev WHERE human_text IS NOT NULL), c AS (SELECT event_index AS own, instant_us AS from_us, row_number() OVER (ORDER BY event_index) AS claim FROM m WHERE contains(text, 'flaky') ORDER BY event_index LIMIT 6)
    SELECT own AS claim, event_index FROM c JOIN m ON m.instant_us > from_us AND event_index <> own""")
def claims_later(ev: DataFrame) -> DataFrame:
    person = said.person(ev)
    claims = person.filter(F.contains("text", F.lit("flaky"))).withColumn("claim", F.col("event_index"))
    return ask.written_after(claims, person)


@query()
def quotes_verified(ev: DataFrame) -> DataFrame:
    findings = said.person(ev).select(F.col("event_index").alias("finding"), "event_index", F.concat(F.substring("text", 1, 12), F.lit(" … "), F.right("text", F.lit(12))).alias("quote"))
    return ask.verified(findings, ev)


# --- text -----------------------------------------------------------------------------------------------------------
@own("SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 200) || ' … [' || (length(text) - 300)::VARCHAR || ' characters left out] … ' || right(text, 100) ELSE text END AS clipped FROM documents")
def clip_middle(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.clip_middle(F.col("text"), 300).alias("clipped"))


@own("SELECT doc_id, CASE WHEN length(text) > 240 THEN substring(text, 1, 240) || ' … [' || (length(text) - 240)::VARCHAR || ' more characters]' ELSE text END AS clipped FROM documents")
def clip_head(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.clip_head(F.col("text"), 240).alias("clipped"))


_DTRIM = f"regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@own(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_DTRIM}, '\\x1b(\\[[^@-~]*[@-~]?)?', '', 'g'), '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', ' / ', 'g') AS line FROM documents")
def one_line(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@own(f"SELECT doc_id, CASE WHEN length(l) > 120 THEN '…' || right(l, 120) ELSE l END AS tail, CASE WHEN length(l) > 120 THEN substring(l, 1, 80) || ' … ' || right(l, 40) ELSE l END AS middle FROM (SELECT doc_id, regexp_replace({_DTRIM}, '{_BLANK}+', ' ', 'g') AS l FROM documents)")
def tail_and_middle(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.tail(F.col("text"), 120).alias("tail"), T.middle(F.col("text"), 120).alias("middle"))


@query(r"""SELECT DISTINCT cwd, array_to_string(list_filter(string_split(replace(CASE WHEN starts_with(cwd, 'file://') THEN url_decode(substring(cwd, 8)) ELSE cwd END, '\', '/'), '/'), lambda x: x <> '')[-2:], '/') AS project FROM ev WHERE cwd IS NOT NULL""")
def project_names(ev: DataFrame) -> DataFrame:
    return ev.filter("cwd is not null").select("cwd", T.project_from_cwd(F.col("cwd")).alias("project")).distinct()


# --- other tables -----------------------------------------------------------------------------------------------------
@own("SELECT app, count(*) AS sources, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (zone_name IS NULL) AS zoneless, min(epoch_us(modified_at)) AS synced_through FROM sources GROUP BY app")
def status_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").groupBy("app").agg(F.count("*").alias("sources"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("zone_name").isNull()).alias("zoneless"), F.min(F.unix_micros("modified_at")).alias("synced_through"))


@own("""SELECT disposition, count(*) AS changes, count(DISTINCT source_id) AS sources, coalesce(sum(records_added), 0)::BIGINT AS records,
    count(*) FILTER (observed_size > committed_byte_end) AS behind, coalesce(sum(greatest(observed_size - committed_byte_end, 0)), 0)::BIGINT AS unscanned_bytes FROM source_changes GROUP BY disposition""")
def coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    left = F.col("observed_size") - F.col("committed_byte_end")
    return table(spark, folder, "source_changes").groupBy("disposition").agg(
        F.count("*").alias("changes"), F.count_distinct("source_id").alias("sources"), F.coalesce(F.sum("records_added"), F.lit(0)).alias("records"),
        F.count_if(left > 0).alias("behind"), F.coalesce(F.sum(F.greatest(left, F.lit(0))), F.lit(0)).alias("unscanned_bytes"),
    )


@own("SELECT hit_id, s.app AS log_app, s.log_path FROM hits h LEFT JOIN sources s USING (source_id)")
def hits_with_source(spark: SparkSession, folder: str) -> DataFrame:
    return joins.with_source(table(spark, folder, "hits"), table(spark, folder, "sources")).select("hit_id", "log_app", "log_path")


@own("SELECT term, count(DISTINCT hit_id) AS hits, count(DISTINCT session_id) AS sessions FROM (SELECT hit_id, session_id, unnest(terms) AS term FROM hits) GROUP BY term")
def hit_terms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hits").select("hit_id", "session_id", F.explode("terms").alias("term")).groupBy("term").agg(F.count_distinct("hit_id").alias("hits"), F.count_distinct("session_id").alias("sessions"))


@own("SELECT e.event_id, e.user_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) < (e.ts, e.event_id)) AS last_purchase FROM events e")
def asof_event(spark: SparkSession, folder: str) -> DataFrame:
    rows = joins.as_of(table(spark, folder, "events"), F.col("event_type") == "purchase", "event_id", "user_id", ["ts", "event_id"], "last_purchase")
    return rows.select("event_id", "user_id", "last_purchase")


@own("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS amount, count(*) AS calls FROM lineitem GROUP BY ALL")
def ledger_sums(spark: SparkSession, folder: str) -> DataFrame:
    return ask.spending(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").withColumn("amount", F.round("amount", 2))

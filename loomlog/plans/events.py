"""The event view of delivered session records, in the columns that all read plans share.

``events``: event_index, source_id, line, session, written, instant_us, event_date, project, cwd, record_type,
role, kind, sender, via, call_id, text, human_text, reply_text. The same is written in SQL for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants_sql import timed
from ..operators.timestamps import with_instant

# Opening tags of texts that no person typed, and who sent them (sender, via).
_TAGS = [
    ("system", "notification", "task-notification"),
    ("agent", "agent_message", "agent-message|cross-session-message|teammate-message"),
    ("system", "command_output", "local-command-stdout|local-command-stderr|local-command-caveat|bash-stdout|bash-stderr"),
    ("system", "hook", "user-prompt-submit-hook"),
    ("human", "slash_command", "command-name|command-message|command-args"),
    ("human", "shell_command", "bash-input"),
]
_INTERRUPTED = r"^[\s]*\[Request interrupted by user[^\n]*\]\s*$"


def _tag(names: str) -> str:
    return rf"^\s*<({names})[>\s/]"


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def session_events(claude_session: DataFrame, sources: DataFrame) -> DataFrame:
    """One event per record. Instants are those written in the records; one that can't be read is undated, null texts stay null."""
    c = F.col
    text = F.coalesce("item_text", "item_content", "attachment_prompt")
    output = c("item_type").eqNullSafe("tool_result")
    user, attachment = c("record_type") == "user", c("record_type") == "attachment"
    kind = (
        F.when(_flag("is_compact_summary"), "summary").when(output, "output").when(c("item_type") == "tool_use", "command")
        .when(user | (attachment & c("attachment_prompt").isNotNull()), "user").when(c("record_type") == "assistant", "assistant").otherwise("unknown")
    )
    rules = [(c("record_type") == "assistant", "assistant", ""), (~user & ~attachment, "system", F.when(c("subtype") == "compact_boundary", "compact_boundary").otherwise("")),
             (attachment & c("attachment_prompt").isNull(), "system", "attachment"), (_flag("is_compact_summary"), "summary", "compact_summary"), (output, "system", "tool_result"),
             (_flag("is_meta"), "system", "meta"), (_flag("is_sidechain"), "agent", "subagent_prompt"), (F.coalesce(F.trim(text), F.lit("")) == "", "system", "injected"),
             (text.rlike(_INTERRUPTED), "system", "interrupted"), *[(text.rlike(_tag(t)), s, v) for s, v, t in _TAGS]]
    sender, via = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, s, v in rules:
        test = F.coalesce(test, F.lit(False))
        sender, via = sender.when(test, s), via.when(test, v)
    sender, via = sender.otherwise("human"), via.otherwise(F.when(attachment, "queued").otherwise("typed"))
    out = claude_session.select(
        c("record_id").alias("event_index"), "source_id", c("line_no").alias("line"), c("session_id").alias("session"), c("written_at").alias("written"),
        "project", "cwd", "record_type", "subtype", "item_type", c("msg_role").alias("role"), kind.alias("kind"), sender.alias("sender"), via.alias("via"), c("tool_use_id").alias("call_id"), text.alias("text"),
    )
    out = with_instant(out, "written", sources)
    day = F.date_format(F.date_from_unix_date(F.floor(c("instant_us") / 86_400_000_000).cast("int")), "yyyy-MM-dd")
    return out.withColumns({
        "event_date": F.coalesce(day, F.lit("undated")),
        "human_text": F.when(c("sender") == "human", c("text")),
        "reply_text": F.when((c("sender") == "assistant") & (c("item_type") == "text"), c("text")),
    })


def _events_sql() -> str:
    text = "coalesce(item_text, item_content, attachment_prompt)"
    pairs = [
        ("record_type = 'assistant'", "'assistant'", "''"), ("record_type NOT IN ('user', 'attachment')", "'system'", "CASE WHEN subtype = 'compact_boundary' THEN 'compact_boundary' ELSE '' END"),
        ("record_type = 'attachment' AND attachment_prompt IS NULL", "'system'", "'attachment'"), ("is_compact_summary", "'summary'", "'compact_summary'"), ("item_type = 'tool_result'", "'system'", "'tool_result'"),
        ("is_meta", "'system'", "'meta'"), ("is_sidechain", "'agent'", "'subagent_prompt'"), (f"coalesce(trim({text}), '') = ''", "'system'", "'injected'"),
        (f"regexp_matches({text}, '{_INTERRUPTED}')", "'system'", "'interrupted'"), *[(f"regexp_matches({text}, '{_tag(t)}')", f"'{s}'", f"'{v}'") for s, v, t in _TAGS],
    ]
    case = lambda i, rest: "CASE " + " ".join(f"WHEN {p[0]} THEN {p[i]}" for p in pairs) + f" ELSE {rest} END"
    return f"""
    {timed("SELECT *, written_at AS written FROM claude_session", "dated")},
    raw_ev AS (SELECT record_id AS event_index, source_id, line_no AS line, session_id AS session, written, instant_us,
        coalesce(strftime(make_timestamp(instant_us), '%Y-%m-%d'), 'undated') AS event_date,
        project, cwd, record_type, subtype, item_type, msg_role AS role, tool_use_id AS call_id, {text} AS text,
        CASE WHEN is_compact_summary THEN 'summary' WHEN item_type = 'tool_result' THEN 'output' WHEN item_type = 'tool_use' THEN 'command'
            WHEN record_type = 'user' OR (record_type = 'attachment' AND attachment_prompt IS NOT NULL) THEN 'user'
            WHEN record_type = 'assistant' THEN 'assistant' ELSE 'unknown' END AS kind,
        {case(1, "'human'")} AS sender, {case(2, "CASE WHEN record_type = 'attachment' THEN 'queued' ELSE 'typed' END")} AS via
        FROM dated),
    ev AS MATERIALIZED (SELECT *, CASE WHEN sender = 'human' THEN text END AS human_text, CASE WHEN sender = 'assistant' AND item_type = 'text' THEN text END AS reply_text FROM raw_ev)"""


EVENTS_SQL = _events_sql()

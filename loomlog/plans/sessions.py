"""What is known of each session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import said


def summary(events: DataFrame, query: str | None = None) -> DataFrame:
    """One row per session: span, records, agent records, compactions, logs, the person's messages and characters.

    Person's messages are counted without copies, across sessions in log order; ``matched`` counts those that
    contain ``query`` (all without one). Sessions come whole, those without a person's message too.
    """
    whole = events.groupBy("session").agg(
        F.min("instant_us").alias("started"), F.max("instant_us").alias("ended"), F.count("*").alias("records"), F.count_if(F.col("sender") == "assistant").alias("agent_records"),
        F.count_if(F.col("via") == "compact_boundary").alias("compactions"), F.count_distinct("source_id").alias("sources"),
    )
    order = F.struct(F.col("instant_us"), F.col("source_id"), F.col("event_index"))
    hit = F.lit(True) if query is None else F.coalesce(F.contains("human_text", F.lit(query)), F.lit(False))
    own = said.first_copies(said.person(events)).groupBy("session").agg(
        F.count("*").alias("person_messages"), F.sum(F.char_length("human_text")).cast("long").alias("person_chars"), F.count_if(hit).alias("matched_messages"),
        F.min_by("event_index", order).alias("first_message"), F.max_by("event_index", order).alias("last_message"),
    )
    return whole.join(own, "session", "left").fillna(0, ["person_messages", "person_chars", "matched_messages"])


def places(events: DataFrame) -> DataFrame:
    """(session, place, first_seen): working directories as paths; equal ones merged, those inside another dropped.

    Either slash parts, ``file://`` is decoded, a trailing slash is no part. A session has few places, so its
    list is compared in one row.
    """
    path = F.regexp_replace(F.regexp_replace(F.when(F.col("cwd").startswith("file://"), F.try_url_decode(F.substring("cwd", 8, 1 << 30))).otherwise(F.col("cwd")), r"\\", "/"), r"(.)/+$", "$1")
    seen = events.filter("cwd is not null and cwd <> ''").groupBy("session", path.alias("place")).agg(F.min("instant_us").alias("first_seen"))
    every = seen.groupBy("session").agg(F.collect_list(F.struct("place", "first_seen")).alias("all"))
    outer = F.filter("all", lambda x: ~F.exists("all", lambda y: x["place"].startswith(F.concat(y["place"], F.lit("/")))))
    return every.select("session", F.inline(outer))


def worked_in(events: DataFrame, directory: str) -> DataFrame:
    """Sessions with an event in ``directory``, as written or as a path, or below it."""
    clean = directory.replace("\\", "/").rstrip("/")
    path = F.regexp_replace(F.col("cwd"), r"\\", "/")
    inside = (path == clean) | path.startswith(clean + "/") | T.contains(F.col("cwd"), F.lit(directory), ignore_case=True)
    return events.filter(inside).select("session").distinct()


def page(sessions: DataFrame, limit: int = 30, offset: int = 0, newest_first: bool = True) -> DataFrame:
    """By start, undated last in either direction, ties by id."""
    start = F.col("started").desc_nulls_last() if newest_first else F.col("started").asc_nulls_last()
    return sessions.orderBy(start, F.asc("session")).offset(offset).limit(limit)


def number_events(events: DataFrame) -> DataFrame:
    return events.withColumn("n_in_log", F.row_number().over(Window.partitionBy("source_id").orderBy("line", "event_index")))


def neighbours(events: DataFrame, wanted: DataFrame, before: int, after: int) -> DataFrame:
    """(hit, event_index, distance): events up to ``before`` before and ``after`` after each wanted one in its log.

    Each wanted event is spread over the places it asks for, and those are met by an equi-join. Where ``wanted``
    names its logs only those are numbered.
    """
    if "source_id" in wanted.columns:
        events = events.join(wanted.select("source_id").distinct(), "source_id", "left_semi")
    numbered = number_events(events).select("source_id", "event_index", "n_in_log")
    hits = numbered.join(wanted.select("event_index"), "event_index", "left_semi")
    asked = hits.select("source_id", F.col("event_index").alias("hit"), F.col("n_in_log").alias("at"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("distance"))
    asked = asked.withColumn("n_in_log", F.col("at") + F.col("distance"))
    return asked.join(numbered, ["source_id", "n_in_log"]).select("hit", "event_index", "distance")

"""Literal search over events: many strings in one pass, facets, date maps, pages."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Values of a facet that are listed.
FACET_VALUES = 50
#: Values that are listed of each date.
DATE_VALUES = 12


def check_page(limit: int, offset: int = 0) -> None:
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")


def bound(name: str, text: str, last: bool, zone: str = "UTC") -> Column:
    """The test of one end of a range: a day (``2026-01-31``), inclusive, or a time with or without a zone, to the microsecond."""
    text = text.strip()
    try:
        if len(text) == 10:
            day = date.fromisoformat(text).isoformat()
            return F.col("event_date") <= day if last else (F.col("event_date") >= day) & (F.col("event_date") != "undated")
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{name} must be a date (yyyy-mm-dd) or a time (yyyy-mm-ddThh:mm:ss, with or without a zone), got {text}") from None
    at = at if at.tzinfo else at.replace(tzinfo=ZoneInfo(zone))
    us = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.col("instant_us") <= us if last else F.col("instant_us") >= us


def where(events: DataFrame, *, source_id: str | None = None, session: str | None = None, cwd: str | None = None, kind: str | None = None, sender: str | None = None, role: str | None = None,
          since: str | None = None, until: str | None = None, skip_imported: bool = False, zone: str = "UTC") -> DataFrame:
    """The header filters together. ``cwd`` is a substring without ASCII case; both ends of a range (``bound``) are inclusive and leave undated events out."""
    tests: list[Column] = []
    for name, value in (("source_id", source_id), ("session", session), ("kind", kind), ("sender", sender), ("role", role)):
        if value is not None:
            tests.append(F.col(name) == value)
    if cwd is not None:
        tests.append(T.contains(F.col("cwd"), F.lit(cwd), ignore_case=True))
    tests += [bound("since", since, False, zone)] if since is not None else []
    tests += [bound("until", until, True, zone)] if until is not None else []
    if skip_imported:
        tests.append(F.col("via") != "imported")
    return events.filter(reduce(lambda a, b: a & b, tests)) if tests else events


def matches(events: DataFrame, queries: list[str], ignore_case: bool = False, column: str = "text") -> DataFrame:
    """Events with the queries they contain, one row per event and query: columns of ``events`` and ``query``.

    One scan for all queries; events that contain none leave before they are multiplied. Empty queries are errors.
    """
    if not queries or not all(queries):
        raise ValueError("a query must not be empty")
    value = T.fold(F.col(column)) if ignore_case else F.col(column)
    wanted = [(q, T.ascii_lower(q) if ignore_case else q) for q in dict.fromkeys(queries)]
    hit = F.filter(F.array(*[F.when(F.contains(value, F.lit(w)), F.lit(q)) for q, w in wanted]), lambda x: x.isNotNull())
    any_of = reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for _, w in wanted])
    return events.filter(any_of).withColumn("query", F.explode(hit))


def field_matches(events: DataFrame, queries: list[str], ignore_case: bool = False) -> DataFrame:
    """The same for events with ``fields``: each value is searched by itself, so a match never spans two.

    Adds ``query`` and ``field``, the path of the first value that contains it.
    """
    if not queries or not all(queries):
        raise ValueError("a query must not be empty")
    value = lambda x: T.fold(x["value"]) if ignore_case else x["value"]
    wanted = [(q, T.ascii_lower(q) if ignore_case else q) for q in dict.fromkeys(queries)]
    holds = lambda w: lambda x: F.contains(value(x), F.lit(w))
    first = [F.struct(F.lit(q).alias("query"), F.try_element_at(F.filter("fields", holds(w)), F.lit(1))["path"].alias("field")) for q, w in wanted]
    any_of = F.exists("fields", lambda x: reduce(lambda a, b: a | b, [F.contains(value(x), F.lit(w)) for _, w in wanted]))
    out = events.filter(any_of).withColumn("__hit", F.explode(F.filter(F.array(*first), lambda x: x["field"].isNotNull())))
    return out.withColumns({"query": F.col("__hit.query"), "field": F.col("__hit.field")}).drop("__hit")


def raw_matches(raw_records: DataFrame, query: str) -> DataFrame:
    """Records whose original bytes contain the query's bytes: (raw_id, source_id, line_no, at_byte), the first place each."""
    if not query:
        raise ValueError("a query must not be empty")
    body, needle = F.encode("body", "utf-8"), F.encode(F.lit(query), "utf-8")
    found = raw_records.filter(F.contains(body, needle))
    return found.select("raw_id", "source_id", "line_no", (F.octet_length(F.substring_index("body", query, 1))).cast("long").alias("at_byte"))


def _order(hits: DataFrame, newest_first: bool) -> list[Column]:
    """By instant, then as written, then by place; newest first is the reverse, but for undated events, which come last either way."""
    keys = ["instant_us", "written", "source_id", "event_index"] if "written" in hits.columns else ["instant_us", "source_id", "event_index"]
    columns = {k: F.nullif(F.col(k), F.lit("")) if k == "written" else F.col(k) for k in keys}
    if newest_first:
        return [columns[k].desc_nulls_first() if k == "written" else columns[k].desc_nulls_last() for k in keys]
    return [columns[k].asc_nulls_last() for k in keys]


def page(hits: DataFrame, limit: int, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """One page in the order of time; undated events come last in either direction, ties go by what was written, source and index."""
    check_page(limit, offset)
    return hits.orderBy(*_order(hits, newest_first)).offset(offset).limit(limit)


def page_with_facts(hits: DataFrame, limit: int, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """The page with ``position`` (from 1), ``truncated`` (more hits follow) and ``next_offset`` (NULL at the end)."""
    check_page(limit, offset)
    rows = hits.orderBy(*_order(hits, newest_first)).offset(offset).limit(limit + 1)
    order = Window.orderBy(*_order(hits, newest_first))
    more = F.count("*").over(Window.partitionBy()) > limit
    rows = rows.select("*", (F.row_number().over(order) + offset).alias("position"), more.alias("truncated")).filter(F.col("position") <= offset + limit)
    return rows.withColumn("next_offset", F.when(F.col("truncated"), F.lit(offset + limit)))


def _counted(hits: DataFrame, names: list[str], within: list[str]) -> DataFrame:
    value = F.coalesce(*[F.when(F.grouping(n) == 0, F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])
    facet = reduce(lambda acc, n: acc.when(F.grouping(n) == 0, n), names, F.when(F.lit(False), ""))
    return hits.groupingSets([[F.col(c) for c in [*within, n]] for n in names], *within, *names).agg(F.count("*").alias("n"), facet.alias("facet"), value.alias("value")).select(*within, "facet", "value", "n")


def facets(hits: DataFrame, names: list[str], most: int = FACET_VALUES) -> DataFrame:
    """(query, facet, value, n, distinct_values): counts by each of ``names`` in one pass, the most frequent first.

    At most ``most`` values per facet are listed (count down, then value); ``distinct_values`` counts all. Each
    task keeps the best of its values before they meet, and the values are counted apart from that.
    """
    counted = _counted(hits, names, ["query"])
    rank = F.row_number().over(Window.partitionBy("query", "facet").orderBy(F.desc("n"), "value"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
    # The sum keeps the counts in both branches, so that they are worked out once.
    sizes = counted.groupBy("query", "facet").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("hits")).filter("hits > 0").drop("hits")
    return top.join(sizes, ["query", "facet"]).select("query", "facet", "value", "n", "distinct_values")


def history(hits: DataFrame) -> DataFrame:
    """(query, event_date, matched, sources, sessions): the date map of the matches, for paging by date."""
    return hits.groupBy("query", "event_date").agg(F.count("*").alias("matched"), F.count_distinct("source_id").alias("sources"), F.count_distinct("session").alias("sessions"))


def history_facets(hits: DataFrame, names: list[str] | None = None, most: int = DATE_VALUES) -> DataFrame:
    """(query, event_date, facet, value, n, rank): of each date the ``most`` frequent sources, sessions and kinds."""
    counted = _counted(hits, names or ["source_id", "session", "kind"], ["query", "event_date"])
    rank = F.row_number().over(Window.partitionBy("query", "event_date", "facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most)


def date_page(dates: DataFrame, limit: int = 12, offset: int = 0) -> DataFrame:
    """The newest dates first, undated last."""
    check_page(limit, offset)
    return dates.orderBy(F.col("event_date") == "undated", F.desc("event_date"), "query").offset(offset).limit(limit)


def busiest_dates(dates: DataFrame, limit: int = 12, offset: int = 0) -> DataFrame:
    """Where to look next: the dates with the most matches first, of equal ones the newest."""
    check_page(limit, offset)
    return dates.orderBy(F.desc("matched"), F.col("event_date") == "undated", F.desc("event_date"), "query").offset(offset).limit(limit)


def in_declared_sources(events: DataFrame, session: str) -> DataFrame:
    """A session's events: first the sources that declare it, then the records that name it."""
    declaring = events.filter(F.col("session") == session).select("source_id").distinct()
    return events.join(declaring, "source_id", "left_semi").filter(F.col("session") == session)

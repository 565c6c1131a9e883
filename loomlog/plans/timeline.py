"""Runs of one date in a log (gaps and islands), and the map of dates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import check_page


def runs(events: DataFrame) -> DataFrame:
    """(source_id, run_no, event_date, events, sessions, first_index, last_index): maximal runs of one date in log order.

    Log order is line, then index. Sessions are distinct within the run; undated events form runs of their own.
    """
    w = Window.partitionBy("source_id").orderBy("line", "event_index")
    change = (~F.lag("event_date").over(w).eqNullSafe(F.col("event_date"))).cast("int")
    run = events.withColumn("change", change).withColumn("run_no", F.sum("change").over(w))
    order = F.struct("line", "event_index")
    return run.groupBy("source_id", "run_no", "event_date").agg(
        F.count("*").alias("events"), F.count_distinct("session").alias("sessions"), F.min_by("event_index", order).alias("first_index"), F.max_by("event_index", order).alias("last_index")
    )


def date_map(events: DataFrame) -> DataFrame:
    """(event_date, events, session_runs, sources, runs): ``session_runs`` adds up the sessions of every run."""
    return runs(events).groupBy("event_date").agg(F.sum("events").alias("events"), F.sum("sessions").alias("session_runs"), F.count_distinct("source_id").alias("sources"), F.count("*").alias("runs"))


def kinds_by_date(events: DataFrame) -> DataFrame:
    return events.groupBy("event_date", "kind").agg(F.count("*").alias("n"))


def day(events: DataFrame, date: str, limit: int = 50, offset: int = 0, newest_first: bool = True) -> DataFrame:
    """One page of a day's events."""
    check_page(limit, offset)
    keys = ["instant_us", "source_id", "event_index"]
    order = [F.col(k).desc_nulls_last() if newest_first else F.col(k).asc_nulls_last() for k in keys]
    return events.filter(F.col("event_date") == date).orderBy(*order).offset(offset).limit(limit)

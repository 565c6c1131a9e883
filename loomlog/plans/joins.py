"""Joins of events with what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``log_app`` and ``log_path`` of each row's log; rows of logs unknown or null keep NULL."""
    known = sources.groupBy("source_id").agg(F.min(F.struct(F.col("app").alias("log_app"), F.col("log_path"))).alias("log"))
    return rows.join(known, "source_id", "left").select(*rows.columns, "log.log_app", "log.log_path")


def answered(events: DataFrame) -> DataFrame:
    """(session, call_id, call, answer): each tool call of a session with its first result, NULL without one. Ids are those of their session."""
    first = lambda kind, name: events.filter((F.col("kind") == kind) & F.col("call_id").isNotNull()).groupBy("session", "call_id").agg(F.min("event_index").alias(name))
    return first("command", "call").join(first("output", "answer"), ["session", "call_id"], "left")


def carried(rows: DataFrame, column: str, within: str, order: list[str]) -> DataFrame:
    """``column`` taken over from the last row before that has it, in each ``within``."""
    w = Window.partitionBy(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, True).over(w))


def as_of(rows: DataFrame, wanted: Column, value: str, within: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the largest ``value`` of the rows before it in its ``within`` for which ``wanted`` holds."""
    w = Window.partitionBy(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.max(F.when(wanted, F.col(value))).over(w))

"""Original records in a table: fields, classification, and the fold over each log."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flatten import flatten
from ..runtime import arrow_schema
from .classify import classify, describe, project
from .fold import HEADER, LogFold, row
from .fold import batch as as_batch

_FIELDS = "raw_id long, place int, path string, value string, kind string"


def fields(raw_records: DataFrame) -> DataFrame:
    """(raw_id, place, path, value, kind): every scalar of every readable body, in order."""
    schema = arrow_schema(_FIELDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw_id, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(raw_id, i, *f) for i, f in enumerate((flatten(body) if body else None) or [])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return raw_records.select("raw_id", "body").mapInArrow(run, _FIELDS)


_HEAD = "raw_id long, source_id string, line long, session string, kind string, event_type string, sender string, via string, timestamp string, cwd string, call_id string, images int, opens boolean, starts boolean"


def headers(raw_records: DataFrame, origin: str = "claude_main") -> DataFrame:
    """One row per body: what it is and who sent it, from the record alone. Null bodies are invalid records."""
    schema = arrow_schema(_HEAD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw_id, source, line, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = project(classify(origin, describe(flatten(body or ""))), raw=(body or "").encode())
                t = (r.event_type or "").lower()
                rows.append((raw_id, source, line, r.session, r.kind, r.event_type, r.sender, r.via, r.timestamp, r.cwd, r.call_id, r.images, r.opens_user_turn, "turn_start" in t or "turnstarted" in t))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return raw_records.select("raw_id", "source_id", F.col("line_no").alias("line"), "body").mapInArrow(run, _HEAD)


def inherited(heads: DataFrame, fallback: str = "source_id") -> DataFrame:
    """Session and directory taken over from earlier records of the log, and turns of logs without turn ids.

    A turn begins with a log's first record, with a turn start, and with each person's message but the first
    after such a start: windows say the same as the fold, so a long log spills instead of filling a task.
    """
    w = Window.partitionBy("source_id").orderBy("line", "raw_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = heads.withColumn("session", F.coalesce(F.last(F.nullif("session", F.lit("")), True).over(so_far), F.col(fallback))).withColumn("cwd", F.last(F.nullif("cwd", F.lit("")), True).over(so_far))
    s = Window.partitionBy("source_id", "session").orderBy("line", "raw_id")
    out = out.withColumn("part", F.count(F.when(F.col("starts"), 1)).over(s))
    user_no = F.count(F.when(F.col("opens"), 1)).over(Window.partitionBy("source_id", "session", "part").orderBy("line", "raw_id"))
    begins = (F.row_number().over(s) == 1) | F.col("starts") | (F.col("opens") & (user_no > 1))
    out = out.withColumn("begins", begins)
    return out.withColumn("turn_line", F.last(F.when(F.col("begins"), F.col("line")), True).over(s.rowsBetween(Window.unboundedPreceding, 0))).drop("part", "begins", "opens", "starts")


def folded(raw_records: DataFrame, origin: str = "claude_main", output_chars: int = 300) -> DataFrame:
    """The events of logs that lie in a table, by the same fold as ingest; a log's records are taken in order of line.

    A partition holds whole logs, sorted, and is folded as it streams by: no log is held in memory.
    """
    schema = arrow_schema(HEADER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, fold, at = object(), None, 0
        for batch in batches:
            rows = []
            for source_id, line, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if source_id != source:
                    source, fold, at = source_id, LogFold(origin, source_id or "", output_chars=output_chars), 0
                raw = (body or "").encode() + b"\n"
                record = fold.take(raw, at)
                rows.append(row(record, source_id, line, at, len(raw), fold.state.index - 1))
                at += len(raw)
            if rows:
                yield as_batch(rows, schema)

    lines = raw_records.groupBy("source_id", F.col("line_no").cast("long").alias("line")).agg(F.min_by("body", F.struct("received_at", "raw_id")).alias("body"))
    return lines.repartition("source_id").sortWithinPartitions("source_id", "line").mapInArrow(run, HEADER)

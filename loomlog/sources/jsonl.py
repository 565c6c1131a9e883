"""JSONL logs as a Spark data source, in batch and as a stream.

``spark.read.format("loomlog_jsonl").load(folder)`` gives one row per finished line: source_id, path, line,
byte_start, byte_len, bytes, oversized. One partition is one log, so what follows without a shuffle sees a
log's lines in order. ``readStream`` takes new lines as logs grow; its offset is the byte end of every log.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .discovery import collect, describe
from .lines import Undecodable, records

SCHEMA = "source_id string, path string, line long, byte_start long, byte_len long, bytes binary, oversized boolean"


class LogPart(InputPartition):
    def __init__(self, source_id: str, path: str, start: int, end: int | None, line: int = 1) -> None:
        self.source_id, self.path, self.start, self.end, self.line = source_id, path, start, end, line


def _rows(part: LogPart) -> Iterator[tuple]:
    try:
        for line, at, size, raw, over in records(part.path, part.start, first_line=part.line):
            if part.end is not None and at + size > part.end:
                return
            yield part.source_id, part.path, line, at, size, raw, over
    except Undecodable:
        return  # the records before the damage stand


class _Reader(DataSourceReader):
    def __init__(self, inputs: list[str]) -> None:
        self.inputs = inputs

    def partitions(self) -> list[LogPart]:
        return [LogPart(s.source_id, s.path, 0, None) for s in describe(collect(self.inputs)[0])]

    def read(self, partition: LogPart) -> Iterator[tuple]:
        return _rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {source_id: [path, byte end, lines]}; the driver reads the ends, the tasks the lines."""

    def __init__(self, inputs: list[str]) -> None:
        self.inputs = inputs
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for s in describe(collect(self.inputs)[0]):
            path, end, lines = self.known.get(s.source_id, [s.path, 0, 0])
            try:
                for line, at, size, _, _ in records(s.path, end, first_line=lines + 1):
                    end, lines = at + size, line
            except Undecodable:
                pass
            self.known[s.source_id] = out[s.source_id] = [s.path, end, lines]
        return out

    def partitions(self, start: dict, end: dict) -> list[LogPart]:
        out = []
        for source_id, (path, to, _) in end.items():
            _, at, lines = start.get(source_id, [path, 0, 0])
            if to > at:
                out.append(LogPart(source_id, path, at, to, lines + 1))
        return out

    def read(self, partition: LogPart) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        self.known = {k: list(v) for k, v in end.items()}


class JsonlSource(DataSource):
    """Option ``path`` or ``load(...)``: a log, a folder, or several parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "loomlog_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def _inputs(self) -> list[str]:
        return [p for p in (self.options.get("path") or "").split(",") if p]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._inputs())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self._inputs())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonlSource)

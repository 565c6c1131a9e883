"""Following logs: new records as they are written, and one wait for the next messages of one log."""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flatten import flatten
from ..operators.classify import Record, classify, describe, project, reply_text
from ..runtime import arrow_schema
from ..sources.discovery import app_of, origin_of
from ..sources.jsonl import register
from ..sources.lines import aligned, records

POLL_SECONDS = 0.5
#: Records before the cursor that are looked at for copies of the first new message.
LOOK_BACK = 16
LOOK_BACK_BYTES = 1 << 20

_MESSAGE = "source_id string, path string, line long, byte_start long, byte_len long, kind string, sender string, via string, timestamp string, text string, images int"
_ARROW = arrow_schema(_MESSAGE)


def new_records(spark: SparkSession, inputs: str) -> DataFrame:
    """A stream of the finished lines of growing logs; unfinished last lines come once they end."""
    register(spark)
    return spark.readStream.format("loomlog_jsonl").load(inputs)


def classified(lines: DataFrame) -> DataFrame:
    """Lines (batch or stream) with kind, sender, via, time and text of each; needs nothing from earlier lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origins: dict[str, str] = {}
        for batch in batches:
            rows = []
            for source_id, path, line, at, size, raw, over in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                origin = origins.setdefault(path, origin_of(source_id.split("-", 1)[0], path))
                r = describe(None if over else flatten(raw))
                r.cut = over
                r = project(classify(origin, r), raw=raw)
                rows.append((source_id, path, line, at, size, r.kind, r.sender, r.via, r.timestamp, _text(r), r.images))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return lines.mapInArrow(run, _MESSAGE)


def _text(r: Record) -> str | None:
    if r.sender == "assistant":
        return reply_text(r)
    return "\n".join(v for _, v in r.body).strip() or None


def messages(lines: DataFrame, sender: str = "assistant", prefix: str = "") -> DataFrame:
    """The messages of one sender (``any`` for all) that open with ``prefix``, without blank ones."""
    out = classified(lines).filter("text is not null")
    out = out if sender == "any" else out.filter(F.col("sender") == sender)
    return out.filter(F.ltrim("text").startswith(prefix)) if prefix else out


def follow(path: str, after_byte: int | None = None, sender: str = "assistant", prefix: str = "", seconds: float = 55, limit: int = 20, poll: float = POLL_SECONDS) -> dict:
    """Wait for the next messages of one log: {received, after_byte, messages}.

    Returns with the first messages after ``after_byte`` (the end of the log by default), or without any after
    ``seconds``. ``after_byte`` of the answer is where the next call goes on; it stands before a message that
    ``limit`` left over. A message that repeats one of the records before the cursor is not new.
    """
    if limit < 1 or seconds < 0:
        raise ValueError("limit must be at least 1 and seconds not negative")
    origin = origin_of(app_of(path), path)
    cursor, before = _before(path, after_byte)
    seen = {key for raw in before if (key := _key(_message(origin, raw)))}
    stop = time.monotonic() + seconds
    while True:
        out: list[dict] = []
        for line, at, size, raw, over in records(path, cursor):
            r = _message(origin, raw, over)
            key = _key(r)
            wanted = key and key not in seen and (sender == "any" or r.sender == sender) and key[1].startswith(prefix)
            if wanted and len(out) == limit:
                break
            cursor = at + size
            if key:
                seen.add(key)
            if wanted:
                out.append({"sender": r.sender, "via": r.via, "timestamp": r.timestamp, "text": _text(r), "images": r.images, "byte_start": at, "byte_len": size})
        if out or time.monotonic() >= stop:
            return {"received": bool(out), "after_byte": cursor, "messages": out}
        time.sleep(min(poll, max(0.0, stop - time.monotonic())))


def _before(path: str, after_byte: int | None) -> tuple[int, list[bytes]]:
    """Where to go on (the begin of the record at ``after_byte``, or the end) and the last records before it.

    Of a plain log only what lies shortly before is read.
    """
    plain = not path.endswith(".zst")
    target = after_byte if after_byte is not None else os.path.getsize(path) if plain else float("inf")
    cursor = aligned(path, int(min(target, os.path.getsize(path))) - LOOK_BACK_BYTES) if plain else 0
    held: deque[tuple[int, bytes]] = deque(maxlen=LOOK_BACK)
    for _, at, size, raw, _ in records(path, cursor):
        if at + size > target:
            break
        held.append((at, raw))
        cursor = at + size
    return cursor, [raw for at, raw in held if cursor - at <= LOOK_BACK_BYTES]


def _message(origin: str, raw: bytes, oversized: bool = False) -> Record:
    r = describe(None if oversized else flatten(raw))
    r.cut = oversized
    return project(classify(origin, r), raw=raw)


def _key(r: Record) -> tuple | None:
    text = _text(r)
    return (r.timestamp, text.lstrip(), r.sender) if text and text.strip() and r.kind != "invalid" else None

"""The corpus: events of all logs in Parquet, kept current as logs grow, move, are rewritten or go away.

Layout: ``events/read=<number>`` for each sync that read something, ``sources/<version>`` the catalog, and
the registries ``inputs``, ``imports`` and ``availability`` beside it. The catalog says which reads make up a
log; a version is whole before the pointer file names it. So readers see one state, and what a failed sync
wrote belongs to no log. A log that only grew is read from its checkpoint on, which adds a read; one whose
past changed is read anew and has one read again.
"""

from __future__ import annotations

import json
import os
import shutil
import socket
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instants
from ..functions.text import project_from_cwd
from ..operators.classify import RULES_VERSION
from ..operators.fold import HEADER, LogFold, LogState, row
from ..operators.fold import batch as as_batch
from ..runtime import arrow_schema, broadcast_if_small
from ..sources.discovery import Source, app_of, collect, describe, normalize_input
from ..sources.lines import Undecodable, read_range, read_ranges, records

FORMAT_VERSION = 1
#: Rows of a log that are given on at a time.
BATCH = 2_000
#: First and last records compared to tell an appended log from a rewritten one.
WITNESSES = 8
#: After so long without renewal a writer's lease is over.
LEASE_SECONDS = 600
# How a read of a log ended.
DISPOSITIONS = ["complete", "source_appended", "source_rebuilt", "source_rewritten", "source_moved", "tail_incomplete", "source_undecodable"]

_ARROW = arrow_schema(HEADER)


@dataclass
class Entry:
    """The catalog's row of a log."""

    source_id: str
    app: str
    origin: str
    path: str
    fallback_session: str
    size: int
    mtime_us: int
    inode: int
    reads: str = "[]"
    committed_byte_end: int = 0
    events: int = 0
    lines: int = 0
    disposition: str = "complete"
    state: str = "{}"
    witnesses: str = "[]"
    output_chars: int = 300
    rules: int = RULES_VERSION


_CATALOG = "source_id string, app string, origin string, path string, fallback_session string, size long, mtime_us long, inode long, reads string, committed_byte_end long, events long, lines long, disposition string, state string, witnesses string, output_chars long, rules long"


def _read(entry: Entry) -> Iterator[tuple]:
    """The events of a log from the entry's place on; the entry is brought up to date on the way."""
    fold = LogFold(entry.origin, entry.fallback_session, LogState.load(entry.state) if entry.committed_byte_end else None, entry.output_chars)
    seen: list[list] = json.loads(entry.witnesses) if entry.committed_byte_end else []
    try:
        for line, at, size, raw, over in records(entry.path, entry.committed_byte_end, first_line=entry.lines + 1):
            record = fold.take(raw, at, over)
            yield row(record, entry.source_id, line, at, size, fold.state.index - 1)
            witness = [at, size, record.timestamp]
            seen = [*seen, witness] if len(seen) < 2 * WITNESSES else [*seen[:WITNESSES], *seen[WITNESSES + 1 :], witness]
            entry.committed_byte_end, entry.lines, entry.events = at + size, line, fold.state.index
        if entry.committed_byte_end < entry.size and not entry.path.endswith(".zst"):
            entry.disposition = "tail_incomplete"
    except Undecodable:
        entry.disposition = "source_undecodable"
    entry.state, entry.witnesses = fold.state.dump(), json.dumps(seen)


def _same_past(entry: Entry) -> bool:
    """Whether the first and last known records still lie where they lay."""
    try:
        for at, size, timestamp in json.loads(entry.witnesses):
            raw = read_range(entry.path, at, size, most=64 << 20)
            if not raw.endswith(b"\n") or raw.count(b"\n") != 1 or (timestamp and timestamp.encode() not in raw):
                return False
    except (ValueError, OSError):
        return False
    return True


class Corpus:
    def __init__(self, spark: SparkSession, path: str, zone: str = "UTC") -> None:
        """``zone`` serves times written without one, and dates are its calendar's."""
        self.spark, self.path, self.zone = spark, Path(path), zone
        self.path.mkdir(parents=True, exist_ok=True)

    # --- state ------------------------------------------------------------------------------------------
    def _pointer(self) -> dict:
        try:
            return json.loads((self.path / "CURRENT").read_text())
        except FileNotFoundError:
            return {"version": 0, "format": FORMAT_VERSION, "rules": RULES_VERSION}

    def _lock(self) -> threading.Event:
        """Take the writer's lease, renewed until the event is set; that of a writer that died is taken over.

        It has died if its process on this machine is gone, or the lease was not renewed for ``LEASE_SECONDS``.
        """
        lock, own = self.path / "LOCK", self.path / f"LOCK.{uuid.uuid4().hex}"
        own.write_text(json.dumps({"host": socket.gethostname(), "pid": os.getpid()}))
        try:
            for _ in range(2):
                try:
                    os.link(own, lock)
                    break
                except FileExistsError:
                    if not self._stale(lock):
                        raise RuntimeError(f"another writer holds {lock}") from None
                    lock.rename(own.with_suffix(".stale"))  # of several that see it stale one succeeds
                    own.with_suffix(".stale").unlink()
            else:
                raise RuntimeError(f"another writer holds {lock}")
        except FileNotFoundError:
            raise RuntimeError(f"another writer holds {lock}") from None
        finally:
            own.unlink()
        done = threading.Event()

        def renew() -> None:
            while not done.wait(LEASE_SECONDS / 4):
                os.utime(lock)

        threading.Thread(target=renew, daemon=True).start()
        return done

    @staticmethod
    def _stale(lock: Path) -> bool:
        try:
            text, age = lock.read_text(), time.time() - lock.stat().st_mtime
        except FileNotFoundError:
            return False
        owner = json.loads(text) if text else {}
        if owner.get("host") == socket.gethostname():
            try:
                os.kill(owner["pid"], 0)
            except ProcessLookupError:
                return True
        return age > LEASE_SECONDS

    def catalog(self) -> dict[str, Entry]:
        version = self._pointer()["version"]
        if not version:
            return {}
        return {r["source_id"]: Entry(**r.asDict()) for r in self.spark.read.schema(_CATALOG).parquet(f"{self.path}/sources/{version}").collect()}

    def sources(self) -> DataFrame:
        version = self._pointer()["version"]
        return self.spark.read.schema(_CATALOG).parquet(f"{self.path}/sources/{version}") if version else self.spark.createDataFrame([], _CATALOG)

    def events(self) -> DataFrame:
        """All events of the current version, in the columns that the read plans share.

        With app, origin and path of the log; ``instant_us`` (microseconds), ``event_date`` (or ``undated``),
        ``project`` of the directory, and ``text``, all kept values by line.
        """
        entries = self.catalog().values()
        reads = [(e.source_id, n, e.app, e.origin, e.path) for e in entries for n in json.loads(e.reads)]
        current = self.spark.createDataFrame(reads, "source_id string, read long, app string, origin string, path string")
        folders = [f"{self.path}/events/read={n}" for n in sorted({r[1] for r in reads})]
        if not folders:
            return self._shared(self.spark.createDataFrame([], HEADER + ", app string, origin string, path string"))
        rows = self.spark.read.schema(HEADER + ", read long").option("basePath", f"{self.path}/events").parquet(*folders).filter("kind <> 'checkpoint'")
        return self._shared(rows.join(broadcast_if_small(current), ["source_id", "read"]).drop("read"))

    def _shared(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({
            "instant_us": instants.from_parts(instants.parse(F.col("timestamp")), F.lit(self.zone)),
            "project": project_from_cwd(F.col("cwd")),
            "text": F.array_join("fields.value", "\n"),
        })
        day = F.date_format(F.from_utc_timestamp(F.timestamp_micros("instant_us"), self.zone), "yyyy-MM-dd")
        return rows.withColumn("event_date", F.coalesce(day, F.lit("undated")))

    # --- sync ---------------------------------------------------------------------------------------------
    def sync(self, inputs: list[str], rebuild: bool | list[str] = False, output_chars: int = 300) -> dict:
        """Bring the corpus up to date with the logs below ``inputs`` and those registered before; a report.

        ``rebuild`` reads all logs anew, or those whose source_id it lists.
        """
        done = self._lock()
        try:
            return self._sync(inputs, rebuild, output_chars)
        finally:
            done.set()
            (self.path / "LOCK").unlink()

    def _sync(self, inputs: list[str], rebuild: bool | list[str], output_chars: int) -> dict:
        pointer, old = self._pointer(), self.catalog()
        registered = list(dict.fromkeys([*self._registry("inputs"), *map(normalize_input, inputs)]))
        managed = [str(self.path / "imported")] if (self.path / "imported").exists() else []
        paths, found = collect([*registered, *managed])
        anew = set(rebuild) if isinstance(rebuild, list) else set()
        rebuild = rebuild is True or pointer["format"] != FORMAT_VERSION or pointer["rules"] != RULES_VERSION
        moved = self._moved(old, paths)
        by_path = {e.path: e for e in old.values()} | {new: old[ident] for ident, new in moved.items()}
        number = max([0, *(n for e in old.values() for n in json.loads(e.reads)), *self._read_folders()]) + 1
        plan: list[tuple[Entry, bool]] = []
        for s in describe(paths, {p: e.source_id for p, e in by_path.items()}):
            plan.append(self._decide(s, old.get(s.source_id), s.source_id in moved, rebuild or s.source_id in anew, output_chars))
        todo = [e for e, read in plan if read]
        done = self._ingest(todo, number) if todo else {}
        kept = {e.source_id: done.get(e.source_id, e) for e, _ in plan}
        # Logs that are gone stay in the corpus: what they said was said.
        gone = {k: e for k, e in old.items() if k not in kept}
        self._publish({**gone, **kept}, pointer["version"] + 1)
        self._write_registry("inputs", registered)
        self._write_registry("availability", [asdict(f) for f in found])
        self._forget({n for e in (gone | kept).values() for n in json.loads(e.reads)})
        changed = [e.source_id for e, read in plan if read and (e.source_id not in old or done[e.source_id].reads != old[e.source_id].reads)]
        return {"sources": len(kept) + len(gone), "read": len(todo), "reused": len(plan) - len(todo), "gone": len(gone), "moved": len(moved), "events": sum(e.events for e in (gone | kept).values()), "changed": sorted(changed)[:64],
                "dispositions": {d: n for d in DISPOSITIONS if (n := sum(e.disposition == d for e in kept.values()))}}

    def _decide(self, s: Source, known: Entry | None, moved: bool, rebuild: bool, output_chars: int) -> tuple[Entry, bool]:
        fresh = Entry(**asdict(s), output_chars=output_chars)
        if known is None or rebuild or known.output_chars != output_chars or known.rules != RULES_VERSION:
            fresh.disposition = "complete" if known is None else "source_rebuilt"
            return fresh, True
        now = Entry(**{**asdict(known), **asdict(s)})
        if moved:
            now.disposition = "source_moved"
        if (known.size, known.mtime_us, known.inode) == (s.size, s.mtime_us, s.inode):
            return now, False
        if not s.path.endswith(".zst") and s.size < known.committed_byte_end or not _same_past(now):
            fresh.disposition = "source_rewritten"
            return fresh, True
        if not moved:
            now.disposition = "source_appended" if s.size > known.size else known.disposition
        return now, True

    def _moved(self, old: dict[str, Entry], paths: list[str]) -> dict[str, str]:
        """Logs that are gone and whose records lie in a new log of the same app and name: {source_id: new path}."""
        here, known = set(paths), {e.path for e in old.values()}
        new: dict[str, list[str]] = {}
        for p in paths:
            if p not in known:
                new.setdefault(os.path.basename(p).removesuffix(".zst"), []).append(p)
        out: dict[str, str] = {}
        for e in old.values():
            for p in new.get(os.path.basename(e.path).removesuffix(".zst"), []) if e.path not in here else []:
                if p not in out.values() and app_of(p) == e.app and _same_past(Entry(**{**asdict(e), "path": p})):
                    out[e.source_id] = p
                    break
        return out

    def _ingest(self, todo: list[Entry], number: int) -> dict[str, Entry]:
        """Read logs, one task each, in one pass: flatten, classify, fold, write. No shuffle of events."""
        tasks = min(len(todo), 4 * self.spark.sparkContext.defaultParallelism)
        work = self.spark.createDataFrame([(json.dumps(asdict(e)),) for e in todo], "entry string").repartition(tasks)

        def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    entry = Entry(**json.loads(text))
                    known = entry.events
                    for r in _read(entry):
                        rows.append(r)
                        if len(rows) >= BATCH:
                            yield as_batch(rows, _ARROW)
                            rows = []
                    if entry.events > known:
                        entry.reads = json.dumps([*json.loads(entry.reads), number])
                    # The last row of a log is its entry, brought up to date.
                    end = dict.fromkeys(_ARROW.names) | {"source_id": entry.source_id, "kind": "checkpoint", "event_type": json.dumps(asdict(entry))}
                    rows.append(tuple(end.values()))
            if rows:
                yield as_batch(rows, _ARROW)

        target = f"{self.path}/events/read={number}"
        work.mapInArrow(read, HEADER).write.mode("overwrite").parquet(target)
        rows = self.spark.read.schema(HEADER).parquet(target).filter("kind = 'checkpoint'").select("event_type").collect()
        return {e.source_id: e for e in (Entry(**json.loads(r[0])) for r in rows)}

    def _read_folders(self) -> list[int]:
        return [int(p.name.removeprefix("read=")) for p in (self.path / "events").glob("read=*")]

    def _forget(self, used: set[int]) -> None:
        """Drop reads that no log has: of failed syncs and of logs that were read anew."""
        for n in self._read_folders():
            if n not in used:
                shutil.rmtree(self.path / "events" / f"read={n}", ignore_errors=True)

    def _publish(self, entries: dict[str, Entry], version: int) -> None:
        self.spark.createDataFrame([asdict(e) for e in entries.values()], _CATALOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sources/{version}")
        part = self.path / "CURRENT.partial"
        part.write_text(json.dumps({"version": version, "format": FORMAT_VERSION, "rules": RULES_VERSION}))
        part.rename(self.path / "CURRENT")

    def _registry(self, name: str) -> list:
        p = self.path / f"{name}.json"
        return json.loads(p.read_text()) if p.exists() else []

    def _write_registry(self, name: str, rows: list) -> None:
        part = self.path / f"{name}.json.partial"
        part.write_text(json.dumps(rows))
        part.rename(self.path / f"{name}.json")

    # --- managed copies -------------------------------------------------------------------------------------
    def import_logs(self, folder: str, label: str, provenance: str = "copied") -> dict:
        """Copy the logs below ``folder`` into the corpus and note where they came from; links are refused."""
        root = Path(normalize_input(folder))
        paths, _ = collect([str(root)])
        target = self.path / "imported" / label
        if target.exists():
            raise ValueError(f"there is an import {label} already")
        part = target.with_name(f".{label}.partial")
        files = []
        for p in map(Path, paths):
            if p.is_symlink():
                raise ValueError(f"{p} is a link")
            before = p.stat()
            to = part / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(p, to)
            after = p.stat()
            if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
                shutil.rmtree(part)
                raise ValueError(f"{p} changed while it was copied")
            files.append({"path": str(p.relative_to(root)), "size": after.st_size})
        if not files:
            raise ValueError(f"no logs below {root}")
        part.rename(target)
        entry = {"label": label, "provenance": provenance, "from": str(root), "files": files}
        self._write_registry("imports", [*self._registry("imports"), entry])
        return entry

    # --- status ---------------------------------------------------------------------------------------------
    def freshness(self) -> DataFrame:
        """(source_id, freshness, unscanned_bytes): current, behind, rewritten or unreachable, from the files' sizes and times."""
        rows = []
        for e in self.catalog().values():
            try:
                s = os.stat(e.path)
            except OSError:
                rows.append((e.source_id, "unreachable", 0))
                continue
            same = (s.st_size, s.st_mtime_ns // 1000) == (e.size, e.mtime_us)
            state = "current" if same else "behind" if s.st_size >= e.size else "rewritten"
            rows.append((e.source_id, state, max(0, s.st_size - e.size)))
        return self.spark.createDataFrame(rows, "source_id string, freshness string, unscanned_bytes long")

    def status(self) -> dict:
        """Totals over the catalog and how it compares with the logs on disk."""
        whole = self.sources().agg(F.count("*"), F.sum("events"), F.sum("committed_byte_end"), F.count_if(F.col("disposition").isin("tail_incomplete", "source_undecodable"))).first()
        fresh = {r[0]: (r[1], r[2]) for r in self.freshness().groupBy("freshness").agg(F.count("*"), F.sum("unscanned_bytes")).collect()}
        missing = [a for a in self._registry("availability") if a["availability"] != "present"]
        return {"sources": whole[0], "events": whole[1] or 0, "bytes": whole[2] or 0, "incomplete": whole[3], "freshness": {k: n for k, (n, _) in fresh.items()}, "unscanned_bytes": sum(b for _, b in fresh.values()), "unavailable": missing, "imports": len(self._registry("imports"))}

    def original(self, source_id: str, byte_start: int, byte_len: int) -> bytes:
        """The bytes of a record as they lie in its log."""
        return read_range(self.catalog()[source_id].path, byte_start, byte_len)

    def originals(self, events: DataFrame) -> DataFrame:
        """(source_id, event_index, raw): the bytes of many records as they lie in their logs, NULL where they no longer do.

        The records of a log are read in order of their place, parted by range, so that a log with a third of
        them is several tasks'; each task opens a log once.
        """
        placed = events.select("source_id", "event_index", "path", "byte_start", "byte_len").repartitionByRange("path", "byte_start").sortWithinPartitions("path", "byte_start")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                source, index, path, start, size = (c.to_pylist() for c in batch.columns)
                raw = list(read_ranges(zip(path, start, size, strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["source_id", "event_index", "raw"])

        return placed.mapInArrow(run, "source_id string, event_index long, raw binary")

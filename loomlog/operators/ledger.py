"""Problem 6: a work-item ledger, so that each run gets only what is new or changed.

An item is a stretch of bytes of one log. It is ``pending`` until a worker leases it, ``leased`` until it
commits or its lease expires, and ``done`` after a commit. Every lease has a fencing token that only grows;
a commit with an older token than the item's is rejected. Outputs lie at paths named by the item alone, so a
retry writes over what a failed attempt left. ``revision`` is the run whose bytes an item holds: offered
again with a later one, a done item is pending again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Versions, drop_path, scratch

#: Dispositions whose attempt read the log from its first byte.
WHOLE = ("source_rewritten", "source_rebuilt")
#: How long an attempt that has not ended holds its lease.
LEASE_SECONDS = 6 * 3600
#: Changes of the ledger that are merged into one table.
MERGE_CHANGES = 16

_KEYS = ["source_id", "from_byte", "to_byte"]


def ledger(changes: DataFrame, lease_seconds: float = LEASE_SECONDS) -> DataFrame:
    """One row per work item (source_id, from_byte, to_byte): state, fencing_token, attempts, revision, expires_at.

    A committed attempt makes the item done, with the run of its last commit as revision. One that ended
    otherwise is an expired lease, and the item is pending again. An attempt without a state has not ended: it
    holds its lease for ``lease_seconds`` from its report, as seen at the table's last report. The fencing
    token is that of the latest attempt: run and attempt number. Reports that came late or again make no
    difference; null runs and attempts count as 0.
    """
    start = F.when(F.col("disposition").isin(*WHOLE), F.lit(0)).otherwise(F.col("previous_byte_end"))
    run = F.coalesce(F.col("run_no"), F.lit(0)).cast("long")
    state = F.coalesce(F.col("run_state"), F.lit(""))
    now = changes.agg(F.max(F.unix_micros("reported_at"))).first()[0] or 0
    attempts = changes.select(
        "source_id", start.cast("long").alias("from_byte"), F.col("committed_byte_end").cast("long").alias("to_byte"), (run * 1_000_000 + F.coalesce(F.col("attempt_no"), F.lit(0))).alias("token"),
        F.when(state == "committed", F.col("run_no").cast("int")).alias("revision"), (state == "committed").alias("ok"), (state == "").alias("open"), F.unix_micros("reported_at").alias("at"),
    ).groupBy(*_KEYS, "token").agg(F.max("revision").alias("revision"), F.max("ok").alias("ok"), F.min("open").alias("open"), F.max("at").alias("at"))
    until = F.col("at") + F.lit(int(lease_seconds * 1_000_000))
    held = F.max_by(F.when(F.col("open") & (until > now), until), "token")
    items = attempts.groupBy(*_KEYS).agg(F.max("ok").alias("ok"), held.alias("until"), F.max("token").alias("fencing_token"), F.count("*").alias("attempts"), F.max("revision").alias("revision"))
    state = F.when(F.col("ok"), "done").when(F.col("until").isNotNull(), "leased").otherwise("pending")
    return items.select(*_KEYS, state.alias("state"), "fencing_token", "attempts", "revision", F.when(state == "leased", F.col("until") / 1e6).alias("expires_at"))


def pending_records(changes: DataFrame, records: DataFrame) -> DataFrame:
    """(source_id, byte_start) of each finished record that lies wholly in no done item of its log whose revision is not before the record's change.

    The reports are entered into a durable ledger as attempts on work items, and its done items decide.
    """
    book = WorkLedger(changes.sparkSession)
    book.enter(changes)
    return book.pending(records)


class WorkLedger:
    """A durable ledger: every change is a small table of the items it changed, published as the next version.

    Opened on a folder that has a ledger it goes on from the newest version: done items stay done and tokens
    grow on, whenever a writer broke off. Writers may work at once: a change that another one overtook is made
    anew on what that one left, so no lease is given twice and no stale commit gets through.
    """

    COLUMNS = "source_id string, from_byte long, to_byte long, state string, token long, expires_at double, revision int, output string, version long"
    _ITEM = ["state", "token", "expires_at", "revision", "output"]

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark, "ledger")
        self.versions = Versions(spark, self.path)

    @property
    def version(self) -> int:
        return self.versions.newest()[0]

    def table(self) -> DataFrame:
        """Every item as its last change left it."""
        return self._read(self.versions.newest()[1].get("data", []))

    def _read(self, data: list[str]) -> DataFrame:
        if not data:
            return self.spark.createDataFrame([], self.COLUMNS)
        parts = [self.spark.read.schema(self.COLUMNS).parquet(f"{self.path}/{d}") for d in data]
        if len(parts) == 1:  # an item is in each change once
            return parts[0]
        rows = reduce(DataFrame.unionByName, parts)
        last = rows.groupBy(*_KEYS).agg(F.max_by(F.struct(*self._ITEM, "version"), "version").alias("i"))
        return last.select(*_KEYS, "i.*")

    def _change(self, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Publish ``make`` of the present items as their change; returns (items before, changed items)."""
        while True:
            number, state = self.versions.newest()
            data, name = state.get("data", []), self.versions.fresh()
            before = self._read(data)
            rows = make(before).select(*_KEYS, *self._ITEM, F.lit(number + 1).cast("long").alias("version"))
            rows.write.parquet(f"{self.path}/{name}")
            if self.versions.add(number + 1, {"data": [*data, name]}):
                if len(data) >= MERGE_CHANGES:
                    self._merge()
                return before, self.spark.read.schema(self.COLUMNS).parquet(f"{self.path}/{name}")
            drop_path(self.spark, f"{self.path}/{name}")

    def _merge(self) -> None:
        number, state = self.versions.newest()
        name = self.versions.fresh()
        self._read(state["data"]).write.parquet(f"{self.path}/{name}")
        if not self.versions.add(number + 1, {"data": [name]}):  # someone went on; the next change merges
            drop_path(self.spark, f"{self.path}/{name}")

    def offer(self, items: DataFrame) -> None:
        """Add work items (source_id, from_byte, to_byte, perhaps revision) that the ledger does not have yet, or has of an earlier revision.

        Items with a null among their keys or without bytes are left out.
        """
        items = items if "revision" in items.columns else items.withColumn("revision", F.lit(0))
        items = items.filter("source_id is not null and from_byte < to_byte").groupBy(*_KEYS).agg(F.coalesce(F.max("revision").cast("int"), F.lit(0)).alias("revision"))
        path = F.concat_ws("/", F.lit("out"), F.col("source_id"), F.format_string("%016d-%016d", "from_byte", "to_byte"))

        def make(table: DataFrame) -> DataFrame:
            held = table.select(*_KEYS, F.col("token").alias("t"), F.coalesce("revision", F.lit(0)).alias("r"))
            new = items.join(held, _KEYS, "left").filter("r is null or r < revision")
            return new.select(*_KEYS, F.lit("pending").alias("state"), F.coalesce("t", F.lit(0)).cast("long").alias("token"), F.lit(None).cast("double").alias("expires_at"), "revision", path.alias("output"))

        self._change(make)

    def enter(self, changes: DataFrame, lease_seconds: float = LEASE_SECONDS) -> None:
        """Enter sync reports as what they tell of their items (``ledger``); items the ledger has as done stay so."""
        path = F.concat_ws("/", F.lit("out"), F.col("source_id"), F.format_string("%016d-%016d", "from_byte", "to_byte"))
        items = ledger(changes, lease_seconds).filter("source_id is not null and from_byte < to_byte")
        items = items.select(*_KEYS, "state", F.col("fencing_token").alias("token"), "expires_at", "revision", path.alias("output"))

        def make(table: DataFrame) -> DataFrame:
            held = table.select(*_KEYS, F.col("state").alias("s"), F.col("revision").alias("r"), F.col("token").alias("t"))
            new = items.join(held, _KEYS, "left").filter("s is null or s <> 'done' or (state = 'done' and coalesce(r, 0) < coalesce(revision, 0))")
            return new.withColumn("token", F.greatest("token", F.coalesce("t", F.lit(0)))).drop("s", "r", "t")

        self._change(make)

    def lease(self, now: float, seconds: float, most: int | None = None) -> DataFrame:
        """Lease items that are pending or whose lease has expired, all or the first ``most`` by place; returns them with their new tokens."""
        free = (F.col("state") == "pending") | ((F.col("state") == "leased") & (F.col("expires_at") <= now))

        def make(table: DataFrame) -> DataFrame:
            rows = table.filter(free)
            rows = rows if most is None else rows.orderBy(*_KEYS).limit(most)
            return rows.withColumns({"state": F.lit("leased"), "token": F.col("token") + 1, "expires_at": F.lit(float(now + seconds))})

        return self._change(make)[1].drop("version")

    def commit(self, results: DataFrame, now: float) -> DataFrame:
        """Finish leased items (source_id, from_byte, to_byte, token); returns those rejected: stale token, expired or unknown."""
        results = results.select(*_KEYS, "token").distinct()
        live = lambda table: table.filter((F.col("state") == "leased") & (F.col("expires_at") > now))
        before, _ = self._change(lambda table: live(table).join(results, [*_KEYS, "token"], "left_semi").withColumn("state", F.lit("done")))
        return results.join(live(before), [*_KEYS, "token"], "left_anti")

    def pending(self, records: DataFrame) -> DataFrame:
        """(source_id, byte_start) of each finished record that no done item holds in its present writing.

        A record is held where it lies wholly inside the item and the item's revision is not before the
        record's ``changed_run``. The done items of a log (one per sync run, about) are one array. Each record
        looks into the array of its log, so no record-item pairs are made and the rows of a log with a third of
        all records stay narrow; the skewed join splits them. Repeated records count once; a null
        ``changed_run`` counts as 0, records without place or length are never pending.
        """
        done = self.table().filter("state = 'done' and revision is not null")
        per_log = done.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("from_byte", "to_byte", "revision"))).alias("done"))
        finished = (
            records.filter(F.col("ends_line") & F.col("byte_start").isNotNull() & F.col("byte_len").isNotNull())
            .groupBy("source_id", F.col("byte_start").cast("long").alias("byte_start"))
            .agg(F.max_by(F.struct((F.col("byte_start") + F.col("byte_len")).alias("end"), F.coalesce(F.col("changed_run"), F.lit(0)).alias("run")), F.coalesce("observed_at", F.timestamp_seconds(F.lit(0)))).alias("r"))
            .select("source_id", "byte_start", F.col("r.end").alias("byte_end"), F.col("r.run").alias("changed_run"))
        )
        held = F.exists("done", lambda x: (x["from_byte"] <= F.col("byte_start")) & (x["to_byte"] >= F.col("byte_end")) & (x["revision"] >= F.col("changed_run")))
        return finished.join(per_log, "source_id", "left").filter(F.col("done").isNull() | ~held).select("source_id", "byte_start")

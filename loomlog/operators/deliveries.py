"""Problem 7: messages delivered more than once; exactly one copy stays.

Identifiers are kept as sorted arrays, one set per hash prefix, in immutable runs. An incoming batch is
de-duplicated in itself and looked up by binary search in the runs of its prefixes; what is new becomes a new
run, and only when runs are many are they merged. The copy with the earliest ``received_at`` stays, then
the smallest ``record_id``; a late delivery that is earlier than the copy held so far displaces it.

A hot identifier never meets in one task: every map task first keeps only its best copy of an identifier
and passes the others on as surplus, spread over all reducers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Versions, discard, drop_path, scratch, settle
from .timestamps import with_instant

# The characters of Unicode white space.
WHITE = "".join(map(chr, [*range(9, 14), 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Identifiers of one prefix that one task holds at a time, about.
BUCKET_ROWS = 60_000
#: Rows of a prefix looked up together (whole delivery batches, at least).
SLAB_ROWS = 4096
#: Runs that are merged into one when there are more.
MERGE_RUNS = 4
#: Prefixes up to which an ingestion asks for the runs of its own only.
ASKED_PREFIXES = 1000
#: Ingestions in which ``surplus_copies`` takes a stored table, by delivery batch.
INGESTIONS = 4
#: Rows a map task de-duplicates at a time before the shuffle.
CHUNK_ROWS = 200_000


def bare(name: str):
    """A text column without surrounding white space."""
    return F.btrim(F.col(name), F.lit(WHITE))


def normal_id(name: str):
    """An identifier without case and surrounding white space; NULL where blank."""
    return F.nullif(F.lower(bare(name)), F.lit(""))


def copy_keys(claude_session: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``k1`` and ``k2``, 128 bits that copies of one message share, and ``instant_us``.

    A record with an identifier: session and identifier. One without (null or blank): session, type,
    instant, and both texts trimmed; two unreadable times count as the same. A null session is one session.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    named = normal_id("uuid").isNotNull()
    by_id = [F.lit("id"), blank(F.col("session_id")), normal_id("uuid")]
    by_text = [F.lit("text"), blank(F.col("session_id")), blank(F.col("record_type")), blank(bare("item_text")), blank(bare("item_content"))]
    k = lambda *salt: F.when(named, F.xxhash64(*salt, *by_id)).otherwise(F.xxhash64(*salt, *by_text))
    # Texts are hashed before the join with the sources, so they don't travel.
    df = claude_session.withColumns({"__k1": k(), "__k2": k(F.lit("second")), "__named": named})
    df = with_instant(df, "written_at", sources)
    at = blank(F.col("instant_us").cast("string"))
    whole = lambda c: F.when(F.col("__named"), F.col(c)).otherwise(F.xxhash64(c, at))
    return df.withColumns({"k1": whole("__k1"), "k2": whole("__k2")}).drop("__k1", "__k2", "__named")


_ROW = "record_id long, k1 long, k2 long, received_us long, batch_no long"
_FIELDS = [pa.field(x.split()[0], pa.int64()) for x in _ROW.split(", ")]
_SENT = pa.schema([*_FIELDS, pa.field("lost", pa.bool_())])
_OUT = pa.schema([("kind", pa.string()), ("record_id", pa.int64()), ("prefix", pa.int64()), ("run", pa.int64()), ("keys", pa.binary()), ("held", pa.binary())])
OUT = "kind string, record_id long, prefix long, run long, keys binary, held binary"
_HELD = np.dtype([("at", "<i8"), ("id", "<i8")])


def _firsts(k1: np.ndarray, k2: np.ndarray, at: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, then earliest, then smallest; and which of the ordered rows are the first of their key."""
    order = np.lexsort((ident, at, k2, k1))
    a, b = k1[order], k2[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, first


def _thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a map task: mark all but the best copy of each identifier as lost."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        cols = [t.column(i).to_numpy() for i in range(5)]
        order, first = _firsts(cols[1], cols[2], cols[3], cols[0])
        lost = np.zeros(len(order), bool)
        lost[order[~first]] = True
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(lost)], schema=_SENT)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        if (n := n + batch.num_rows) >= CHUNK_ROWS:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def _wide(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Keys as 16 big-endian bytes whose order is that of the unsigned pair."""
    out = np.empty((len(k1), 2), ">u8")
    out[:, 0], out[:, 1] = k1.view("u8"), k2.view("u8")
    return np.ascontiguousarray(out).view("V16").ravel().view("S16")


def _newest(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of several, oldest first; the newest that has a key speaks for it."""
    keys, held = np.concatenate([k for k, _ in runs]), np.concatenate([h for _, h in runs])
    age = np.concatenate([np.full(len(k), -i) for i, (k, _) in enumerate(runs)])
    order = np.lexsort((age, keys))
    keys, held = keys[order], held[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], held[first]


class Runs:
    """Immutable sorted runs of one prefix, oldest first; the newest run that has a key speaks for it."""

    def __init__(self, runs: Iterable[tuple[np.ndarray, np.ndarray]] = ()) -> None:
        self.runs = [r for r in runs if len(r[0])]
        #: the runs from here on are of this ingestion
        self.own = len(self.runs)

    def add(self, keys: np.ndarray, held: np.ndarray) -> None:
        if len(keys):
            self.runs.append((keys, held))
        if len(self.runs) - self.own > MERGE_RUNS:
            self.runs[self.own :] = [self.fresh()]

    def fresh(self) -> tuple[np.ndarray, np.ndarray]:
        """What this ingestion brought, as one run."""
        own = self.runs[self.own :]
        return _newest(own) if own else (np.zeros(0, "S16"), np.zeros(0, _HELD))

    def ingest(self, keys: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Take one batch; returns the record ids that are surplus because of it."""
        order = np.lexsort((rows["id"], rows["at"], keys))
        keys, rows = keys[order], rows[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        surplus = [rows["id"][~first]]
        keys, rows = keys[first], rows[first]
        novel = np.ones(len(keys), bool)
        better = np.zeros(len(keys), bool)
        for known, held in reversed(self.runs):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = novel & (known[at] == keys)
            old = held[at]
            wins = hit & ((rows["at"] < old["at"]) | ((rows["at"] == old["at"]) & (rows["id"] < old["id"])))
            same = hit & (rows["id"] == old["id"])  # a batch that is read again after a failure
            surplus += [rows["id"][hit & ~wins & ~same], old["id"][wins & ~same]]
            novel &= ~hit
            better |= wins
        fresh = novel | better
        self.add(keys[fresh], rows[fresh])
        return surplus


def _stored(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """The runs of one prefix, oldest first."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("run", "keys", "held")), strict=True), key=lambda x: x[0])
    return [(np.frombuffer(keys, "S16"), np.frombuffer(held, _HELD)) for _, keys, held in rows]


def _run_row(prefix: int, run: int, keys: np.ndarray, held: np.ndarray) -> pa.Table:
    return pa.table([["run"], pa.array([None], pa.int64()), [prefix], [run], [keys.tobytes()], [held.tobytes()]], schema=_OUT)


def _bucket(prefix: int, number: int, table: pa.Table, old: pa.Table) -> pa.Table:
    """One ingestion's rows of one prefix: what is surplus because of them, and their run."""
    if not table.num_rows:
        return _OUT.empty_table()
    cols = {n: table.column(n).to_numpy() for n in ("record_id", "k1", "k2", "received_us", "batch_no")}
    lost = table.column("lost").to_numpy()
    surplus = [cols["record_id"][lost]]
    cols = {n: c[~lost] for n, c in cols.items()}
    runs = Runs(_stored(old))
    keys = _wide(cols["k1"], cols["k2"])
    rows = np.empty(len(keys), _HELD)
    rows["at"], rows["id"] = cols["received_us"], cols["record_id"]
    order = np.argsort(cols["batch_no"], kind="stable")
    keys, rows, batch = keys[order], rows[order], cols["batch_no"][order]
    ends, i = np.flatnonzero(np.append(batch[1:] != batch[:-1], True)) + 1 if len(batch) else [], 0
    for end in ends:
        if end - i >= SLAB_ROWS or end == len(keys):
            surplus += runs.ingest(keys[i:end], rows[i:end])
            i = end
    ids = np.concatenate(surplus)
    out = [pa.table([pa.repeat(pa.scalar("surplus"), len(ids)), pa.array(ids), *[pa.nulls(len(ids), f.type) for f in list(_OUT)[2:]]], schema=_OUT)]
    keys, held = runs.fresh()
    if len(keys):
        out.append(_run_row(prefix, number, keys, held))
    return pa.concat_tables(out)


def _first(number: int):
    return lambda key, table: _bucket(key[0], number, table, _OUT.empty_table())


def _looked_up(number: int):
    return lambda key, table, old: _bucket(key[0], number, table, old)


def _merged(number: int, prefixes: int):
    """All runs of a prefix as one, split where the index has more prefixes now."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, held = _newest(_stored(table))
        k1 = keys.view(">u8")[::2].astype("u8").view("i8") if len(keys) else np.zeros(0, "i8")
        place = np.mod(k1 >> 20, prefixes)
        return pa.concat_tables([_run_row(int(p), number, keys[place == p], held[place == p]) for p in np.unique(place)] or [_OUT.empty_table()])

    return run


class IdentifierIndex:
    """The persisted index: folders of immutable runs, one per ingestion, and numbered states that list them.

    Opened on a folder an index goes on from its newest state. An ingestion writes a run of what it brought and
    reads the runs of the prefixes it touches; when there are more than ``MERGE_RUNS``, they are merged into
    one. Prefixes double as identifiers grow, so that one prefix always fits a task. Several may ingest at
    once: one that another overtook looks its rows up again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rows_expected: int = 0) -> None:
        """``rows_expected`` sets the number of prefixes that a new index begins with."""
        self.spark, self.path = spark, path or scratch(spark, "identifiers")
        self.versions = Versions(spark, self.path)
        if not self.versions.newest()[0]:
            self.versions.add(1, {"prefixes": max(1, -(-rows_expected // BUCKET_ROWS)), "ids": 0, "data": []})

    @property
    def prefixes(self) -> int:
        return self.versions.newest()[1]["prefixes"]

    def _runs(self, state: dict) -> DataFrame:
        return self.spark.read.schema(OUT).parquet(*[f"{self.path}/{d}" for d in state["data"]]).filter("kind = 'run'").drop("kind", "record_id")

    def ingest(self, keyed: DataFrame) -> DataFrame:
        """Take the records of ``copy_keys``; returns (record_id) of every copy that is surplus now.

        Records without a time of receipt count as received last; those without a record_id are left out. An empty table gives no surplus. Taking the
        same records again gives none either: the copy that is held is never its own surplus.
        """
        narrow = keyed.select(
            F.col("record_id").cast("long").alias("record_id"), "k1", "k2",
            F.coalesce(F.unix_micros("received_at"), F.lit(2**62)).alias("received_us"),
            F.coalesce(F.col("batch_no").cast("long"), F.lit(2**31)).alias("batch_no"),
        )
        thin = settle(narrow.filter("record_id is not null").mapInArrow(_thin, _ROW + ", lost boolean"), "batch")
        n = thin.count()
        while True:
            number, state = self.versions.newest()
            if state["ids"] + n > 2 * BUCKET_ROWS * state["prefixes"]:
                self._merge(state["ids"] + n)
                continue
            name, prefixes = self.versions.fresh(), state["prefixes"]
            # Surplus copies go anywhere; the best copies go to the prefix of their identifier.
            rows = thin.withColumn("prefix", F.pmod(F.when(F.col("lost"), F.col("record_id")).otherwise(F.shiftright("k1", 20)), F.lit(prefixes)))
            if state["data"]:
                old = self._runs(state)
                if prefixes > ASKED_PREFIXES // 10:
                    touched = [r[0] for r in rows.select("prefix").distinct().limit(ASKED_PREFIXES + 1).collect()]
                    old = old.filter(F.col("prefix").isin(touched)) if len(touched) <= ASKED_PREFIXES else old
                out = rows.groupBy("prefix").cogroup(old.groupBy("prefix")).applyInArrow(_looked_up(number + 1), OUT)
            else:
                out = rows.groupBy("prefix").applyInArrow(_first(number + 1), OUT)
            out.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
            if self.versions.add(number + 1, state | {"ids": state["ids"] + n, "data": [*state["data"], name]}):
                break
            drop_path(self.spark, f"{self.path}/{name}")
        discard(thin)
        if len(state["data"]) >= MERGE_RUNS:
            self._merge()
        return self.spark.read.schema(OUT).parquet(f"{self.path}/{name}").filter("kind = 'surplus'").select("record_id")

    def _merge(self, expected: int = 0) -> None:
        """Make one run of all, and more prefixes if ``expected`` identifiers need them."""
        number, state = self.versions.newest()
        prefixes = state["prefixes"]
        while expected > BUCKET_ROWS * prefixes:
            prefixes *= 2
        if not state["data"]:
            self.versions.add(number + 1, state | {"prefixes": prefixes})
            return
        name = self.versions.fresh()
        merged = self._runs(state).groupBy("prefix").applyInArrow(_merged(number + 1, prefixes), OUT)
        merged.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        ids = self.spark.read.schema(OUT).parquet(f"{self.path}/{name}").agg(F.sum(F.octet_length("keys"))).first()[0] or 0
        if not self.versions.add(number + 1, {"prefixes": prefixes, "ids": ids // 16, "data": [name]}):
            drop_path(self.spark, f"{self.path}/{name}")


#: Columns that tell copies.
NEEDED = ["record_id", "source_id", "session_id", "uuid", "record_type", "written_at", "item_text", "item_content", "received_at", "batch_no"]


def surplus_copies(claude_session: DataFrame, sources: DataFrame, ingestions: int = INGESTIONS) -> DataFrame:
    """(record_id) of every surplus copy: the delivery batches are ingested one group after the other.

    The groups follow ``batch_no`` and are about equal in rows; each ingestion opens the identifier index anew
    on its folder, as runs of different days do. How many there are changes no result. Rows without a
    record_id are left out.
    """
    spark = claude_session.sparkSession
    claude_session = claude_session.select(*NEEDED).filter("record_id is not null")
    cuts = claude_session.agg(F.percentile_approx("batch_no", [i / ingestions for i in range(1, ingestions)], 1000)).first()[0] if ingestions > 1 else []
    group = sum([(F.col("batch_no") > c).cast("int") for c in sorted(set(cuts or []))], F.lit(0))
    keyed = copy_keys(claude_session, sources).select("record_id", "k1", "k2", "received_at", "batch_no", F.coalesce(group, F.lit(0)).alias("ingestion"))
    keyed = settle(keyed, "keyed", "ingestion")
    path, out = scratch(spark, "identifiers"), []
    for i in range(len(set(cuts or [])) + 1):
        out.append(IdentifierIndex(spark, path).ingest(keyed.filter(F.col("ingestion") == i)))
    discard(keyed)
    return reduce(DataFrame.unionByName, out)


def first_copies(keyed: DataFrame, keep: list[str]) -> DataFrame:
    """The copies that stay, with the columns ``keep``; for use inside other operators (one aggregation)."""
    order = F.struct(F.coalesce(F.unix_micros("received_at"), F.lit(2**62)), F.col("record_id"))
    best = keyed.groupBy("k1", "k2").agg(F.min(F.struct(order.alias("o"), F.struct(*keep).alias("r"))).alias("b"))
    return best.select("b.r.*")

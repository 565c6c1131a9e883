"""Session helpers: shared work folder, table access, size-checked broadcasts."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to this many rows and bytes (both are counted, never assumed).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; an own one only where that is unset and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loomlog-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/loomlog/{what}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def make_path(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)


def publish(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file, whole or not at all; False where there is one already. Of several writers one succeeds.

    Needs a file system on which a rename to an existing file fails (HDFS) or that has links (local).
    """
    fs, at = _hadoop(spark, path)
    own = f"{path}.{uuid.uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        target, made = at.toUri().getPath(), _hadoop(spark, own)[1].toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(made, "w") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(made, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(made)
        return True
    made = _hadoop(spark, own)[1]
    out = fs.create(made)
    out.write(bytearray(content.encode()))
    out.close()
    if not fs.exists(at) and fs.rename(made, at):
        return True
    fs.delete(made, False)
    return False


class Versions:
    """Numbered states of a folder, each a small JSON value that names the sub-folders with its data.

    A state counts from the moment its file is published, under a number that nobody has taken. Of two writers
    that start from one state one gets the next number; the other is told and begins anew from the newer state.
    What a writer that broke off has left is in no state and is never read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def newest(self) -> tuple[int, dict]:
        """(number, state); 0 and an empty state in a new folder."""
        fs, at = _hadoop(self.spark, f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        number = max((int(n) for n in names if n.isdecimal()), default=0)
        if not number:
            return 0, {}
        stored = fs.open(_hadoop(self.spark, f"{self.path}/versions/{number:010d}")[1])
        try:
            return number, json.loads(bytes(stored.readAllBytes()))
        finally:
            stored.close()

    def add(self, number: int, state: dict) -> bool:
        return publish(self.spark, f"{self.path}/versions/{number:010d}", json.dumps(state))

    def fresh(self) -> str:
        """A name for new data below the folder."""
        return f"data-{uuid.uuid4().hex}"

    def sweep(self) -> None:
        """Delete the data that the newest state doesn't name; for when nobody reads or writes."""
        _, state = self.newest()
        fs, at = _hadoop(self.spark, self.path)
        for f in fs.listStatus(at) if fs.exists(at) else []:
            name = f.getPath().getName()
            if name.startswith("data-") and name not in state.get("data", []):
                fs.delete(f.getPath(), True)


def settle(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a settled table once everything made from it is settled too."""
    drop_path(df.sparkSession, df.settled_at)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes (of their JSON); reads no further than it must."""
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= rows and held <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes; larger sides are left to a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df


_PLAIN = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
_PAIRS = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL of plain columns and ``array<struct<path:string,value:string>>``; needs no session."""
    columns = [c.strip().split(" ", 1) for c in ddl.replace("array<struct<path:string,value:string>>", "pairs").split(",")]
    return pa.schema([(name, _PAIRS if kind == "pairs" else _PLAIN[kind]) for name, kind in columns])

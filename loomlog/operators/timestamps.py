"""Problem 3: mixed timestamp formats and zones to one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import instants
from ..runtime import broadcast_if_small, is_small


def with_instant(df: DataFrame, value: str, sources: DataFrame, out: str = "instant_us") -> DataFrame:
    """Add ``out``: microseconds since 1970 UTC of ``df[value]``, NULL where it can't be read.

    Needs ``source_id``; ``sources`` gives the zone of the machine that wrote a value without one (no such
    source, or a null zone: UTC). Row count and other columns stay, also columns that share names with those
    of ``sources``. A source listed twice counts once (its smallest zone name). Where the sources are too many
    to be broadcast ``df`` is evaluated twice.
    """
    written = F.col(value)
    plain = instants.is_canonical(written)
    read = lambda zone: F.when(plain, instants.from_canonical(written)).otherwise(instants.from_parts(instants.parse(written), zone))
    zones = _zones(sources)
    if is_small(zones):
        return _with_zone(df, F.broadcast(zones)).withColumn(out, read(F.col("__zone"))).drop("__zone")
    # Few values are wall time: only those meet the sources, so the rest isn't shuffled for it.
    local = F.coalesce(~plain & instants.needs_zone(written), F.lit(False))
    settled = df.filter(~local).withColumn(out, read(F.lit("UTC")))
    walls = _with_zone(df.filter(local), zones).withColumn(out, read(F.col("__zone"))).drop("__zone")
    return settled.unionByName(walls)


def _zones(sources: DataFrame) -> DataFrame:
    return sources.groupBy(F.col("source_id").alias("__src")).agg(F.min("zone_name").alias("__zone")).filter("__src is not null and __zone is not null")


def _with_zone(df: DataFrame, zones: DataFrame) -> DataFrame:
    return df.join(zones, df["source_id"] == F.col("__src"), "left").drop("__src")


def normalised(claude_session: DataFrame, hits: DataFrame, sources: DataFrame) -> DataFrame:
    """(table_name, row_key, written, instant_us) of the values that are not yet in the one written form."""

    def part(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
        df = df.select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), "source_id", F.col(value).alias("written"))
        return df.filter(F.col("written").isNotNull() & ~instants.is_canonical(F.col("written")))

    rows = part(claude_session, "claude_session", "record_id", "written_at").unionByName(part(hits, "hits", "hit_id", "hit_at"))
    read = F.array(instants.from_parts(instants.parse(F.col("written")), F.col("__zone")))
    rows = _with_zone(rows, broadcast_if_small(_zones(sources)))
    return rows.withColumn("instant_us", F.explode(F.filter(read, lambda x: x.isNotNull()))).drop("__zone")

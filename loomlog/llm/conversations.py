"""Problem 4: rebuilding conversations from message rows, with keyed streaming state.

Two streaming queries. In the first the state of a session and stretch of event time buffers its messages, late
arrivals included, until the watermark closes the stretch; it gives them out in order, with the ids that it
has and the parents that it names and does not have. In the second the state of a session is what validation
needs of its stretches, of one size however long the session is; it is closed by a timeout, when the watermark
has passed the session's last message by ``idle``, and the conversation is kept or dropped with a reason. A
session is many keys of the first query, so no session, not even one with a third of all rows, is ever one
state or one task with its messages.

``Live`` runs them on a stream. A stored table is one source among others: its rows are replayed with a delay
and a timeout of its whole span, so none is late and no session is cut, and records from after its end close all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.deliveries import bare, copy_keys, first_copies, normal_id
from ..runtime import broadcast_if_small, drop_path, make_path, scratch, settle

#: Event time that one key of the first state spans, and lines of a log that one key of undated messages does.
STRETCH = "10 minutes"
BLOCK = 1000
#: Files taken into one micro-batch.
FILES_PER_BATCH = 1000
_SECOND, _DAY = 1_000_000, 86_400

ROWS = "session_id string, record_id long, source_id string, line_no long, instant_us long, speaker string, broken boolean, own long, parent long, event_time timestamp"
_TURN = "struct<instant_us:long,source_id:string,line_no:long,record_id:long,speaker:string>"
STRETCHES = f"session_id string, log string, block long, start timestamp, turns array<{_TURN}>, broken boolean, owns array<long>, refs array<long>"
VERDICTS = "session_id string, opened timestamp, closed timestamp, messages long, kept boolean, reason string"
_STATE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _narrow(claude_session: DataFrame, sources: DataFrame) -> DataFrame:
    """``ROWS`` of every record, with the keys of its copies and its time of receipt."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    said = F.col("record_type").isin("user", "assistant")
    text = F.coalesce(F.col("item_type") == "text", F.lit(True)) & (F.length(bare("item_text")) > 0)
    spoken = said & off("is_sidechain") & off("is_meta") & off("is_compact_summary") & text
    queued = (F.col("record_type") == "attachment") & (F.length(bare("attachment_prompt")) > 0)
    mark = lambda c: F.when(normal_id(c).isNotNull(), F.xxhash64(normal_id(c)))
    return copy_keys(claude_session, sources).select(
        "k1", "k2", "received_at", "record_id", F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("source_id", F.lit("")).alias("source_id"),
        F.coalesce(F.col("line_no").cast("long"), F.lit(0)).alias("line_no"), F.col("instant_us").cast("long").alias("instant_us"),
        F.when(spoken, F.col("record_type")).when(queued, "user").alias("speaker"),
        (F.coalesce(spoken, F.lit(False)) & ~F.col("msg_role").eqNullSafe(F.col("record_type"))).alias("broken"),
        mark("uuid").alias("own"), mark("parent_uuid").alias("parent"),
        F.coalesce(F.timestamp_micros("instant_us"), "received_at", F.timestamp_seconds(F.lit(0))).alias("event_time"),
    )


_KEPT = [c.strip().split(" ")[0] for c in ROWS.split(",")]


def message_rows(claude_session: DataFrame, sources: DataFrame) -> DataFrame:
    """The copies that stay, narrowed: speaker (NULL for no message), broken role, marks of own and parent id.

    ``event_time`` is the instant, without a readable one the time of receipt; such rows come first in their
    session. Rows without a session share the empty one. Null flags mean false, blank parents name nothing.
    """
    return first_copies(_narrow(claude_session, sources), _KEPT)


def live_rows(claude_session: DataFrame, sources: DataFrame, delay: str) -> DataFrame:
    """``message_rows`` of a stream: of the copies that arrive within ``delay`` of each other the first stays."""
    return _narrow(claude_session, sources).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["k1", "k2"]).select(*_KEPT)


def stretches(rows: DataFrame, stretch: str = STRETCH) -> DataFrame:
    """The first state (``STRETCHES``): per session and stretch of event time its messages in order, given out when it closes.

    ``rows`` are ``ROWS`` with a watermark. Messages without an instant are in order of their place instead, so
    they have keys of their own, by log and block of lines. ``refs`` are the parents that are not in the stretch.
    """
    turn = F.struct("instant_us", "source_id", "line_no", "record_id", "speaker")
    dated = F.col("instant_us").isNotNull() | F.col("speaker").isNull()
    keyed = rows.withColumns({"log": F.when(dated, "").otherwise(F.concat(F.lit("/"), F.col("source_id"))), "block": F.when(dated, F.lit(0)).otherwise(F.floor(F.col("line_no") / BLOCK)).cast("long")})
    return (
        keyed.groupBy("session_id", "log", "block", F.window("event_time", stretch).alias("w"))
        .agg(F.array_sort(F.collect_list(F.when(F.col("speaker").isNotNull(), turn))).alias("turns"), F.max("broken").alias("broken"), F.collect_set("own").alias("owns"), F.collect_set("parent").alias("refs"))
        .select("session_id", "log", "block", F.col("w.start").alias("start"), "turns", "broken", "owns", F.array_except("refs", "owns").alias("refs"))
    )


def verdicts(closed: DataFrame, idle: str) -> DataFrame:
    """The second state (``VERDICTS``): a session's conversation, closed once the watermark passes its last stretch by ``idle``.

    ``closed`` are ``STRETCHES`` with a watermark on ``start``. A session that goes on after ``idle`` has a
    second conversation. Parents are looked for afterwards, in ``kept_turns``.
    """
    told = closed.groupBy("session_id", F.session_window("start", idle).alias("s")).agg(
        F.max("broken").alias("broken"), F.sum(F.size("turns").cast("long")).alias("messages"), F.min(F.try_element_at("turns", F.lit(1))).alias("first"), F.max(F.try_element_at("turns", F.lit(-1))).alias("last")
    )
    reason = F.when(F.col("messages") == 0, "empty").when(F.col("broken"), "role").when(F.col("first.speaker") != "user", "opens without the user").when(F.col("last.speaker") != "assistant", "unanswered")
    return told.select("session_id", F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "messages", reason.isNull().alias("kept"), reason.alias("reason"))


def kept_turns(parts: DataFrame, told: DataFrame) -> DataFrame:
    """(session_id, turn_no, record_id, speaker) of the kept conversations whose parents are all there.

    Only parents that lie in another stretch are looked for, among the ids of all stretches of their session.
    """
    here = F.xxhash64("session_id").alias("here")
    refs = broadcast_if_small(settle(parts.filter("size(refs) > 0").select(here, "session_id", F.explode("refs").alias("ref")).distinct(), "refs"))
    found = parts.filter("size(owns) > 0").select(here, F.explode("owns").alias("ref")).join(refs.select("here", "ref"), ["here", "ref"], "left_semi").distinct()
    missing = refs.join(found, ["here", "ref"], "left_anti").select("session_id").distinct()
    kept = broadcast_if_small(settle(told.filter("kept").select("session_id", "opened", "closed").join(missing, "session_id", "left_anti"), "kept"))
    mine = parts.filter("size(turns) > 0").join(kept, "session_id").filter("start >= opened and start < closed").select("session_id", "opened", "log", "block", "start", "turns")
    # A block of undated messages may have come in several stretches.
    key = ["session_id", "opened", "log", "block", "start"]
    undated = mine.filter("log <> ''").groupBy("session_id", "opened", "log", "block").agg(F.min("start").alias("start"), F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    mine = mine.filter("log = ''").unionByName(undated)
    sizes = mine.select(*key, F.size("turns").alias("n"), F.col("turns")[0].alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id", "opened").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select(*key, before.alias("before"))
    turns = mine.join(places, key).select("session_id", "before", F.posexplode("turns").alias("i", "t"))
    return turns.select("session_id", (F.col("before") + F.col("i") + 1).alias("turn_no"), F.col("t.record_id").alias("record_id"), F.col("t.speaker").alias("speaker"))


class Live:
    """Conversations of a stream of claude_session rows; its states and results lie in ``folder``, and it goes on there when started again.

    ``delay`` is how late a message may come behind the newest one; later ones are dropped and counted
    (``late``). ``idle`` is the time without messages after which a session's conversation is closed. State is
    in RocksDB, which the session is set to.
    """

    def __init__(self, claude_session: DataFrame, sources: DataFrame, folder: str, delay: str = "1 hour", idle: str = "1 day", stretch: str = STRETCH) -> None:
        self.spark, self.folder, self.idle, self.stretch, self.late = claude_session.sparkSession, folder.rstrip("/"), idle, stretch, 0
        self.spark.conf.set(*_STATE)
        for name in ("stretches", "verdicts"):
            make_path(self.spark, f"{self.folder}/{name}")
        self.rows = live_rows(claude_session, sources, delay)

    def process(self) -> None:
        """Take in what has arrived, and give out what is closed by it."""
        self.late += _run(stretches(self.rows, self.stretch), self.folder, "stretches")
        _run(verdicts(_arriving(self.spark, self.folder, STRETCHES), self.idle), self.folder, "verdicts")

    def verdicts(self) -> DataFrame:
        """What was decided so far, of dropped conversations with the reason."""
        return _written(self.spark, self.folder, "verdicts", VERDICTS)

    def conversations(self) -> DataFrame:
        """(session_id, turn_no, record_id, speaker) of the conversations that are closed and kept so far."""
        return kept_turns(_written(self.spark, self.folder, "stretches", STRETCHES), self.verdicts())


def _arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    # A batch of stretches is committed whole, so one stretch of delay orders them.
    return spark.readStream.schema(schema).parquet(f"{folder}/stretches").withWatermark("start", "0 seconds")


def _written(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _run(stream: DataFrame, folder: str, name: str) -> int:
    """Run a query until it has taken all there is; returns how many rows were dropped as late."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state-{name}").trigger(availableNow=True).start(f"{folder}/{name}")
    query.awaitTermination()
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def replay(rows: DataFrame, folder: str, stretch: str = STRETCH) -> tuple[DataFrame, DataFrame]:
    """Run stored rows (``ROWS``) through both states; returns their stretches and verdicts, written to ``folder``."""
    spark, path = rows.sparkSession, f"{folder}/rows"
    rows.write.parquet(path)
    first, last = spark.read.schema(ROWS).parquet(path).agg(F.min(F.unix_micros("event_time")), F.max(F.unix_micros("event_time"))).first()
    if first is None:
        return spark.createDataFrame([], STRETCHES), spark.createDataFrame([], VERDICTS)
    span = (last - first) // _SECOND + _DAY
    step = (span + 2 * _DAY) * _SECOND
    # Two records from after the end: the first closes all sessions, the second the first one's stretch.
    ends = spark.range(1, 3).select(F.lit("").alias("session_id"), F.lit(None).cast("long").alias("record_id"), F.lit("").alias("source_id"), F.lit(0).cast("long").alias("line_no"), F.lit(0).cast("long").alias("instant_us"), F.lit(None).cast("string").alias("speaker"), F.lit(False).alias("broken"), F.lit(None).cast("long").alias("own"), F.lit(None).cast("long").alias("parent"), F.timestamp_micros(F.lit(last) + F.col("id") * F.lit(2 * step)).alias("event_time"))
    ends.coalesce(1).write.mode("append").parquet(path)
    own = spark.newSession()  # so that settings of the caller's stay as they are
    for setting in (_STATE, ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))):
        own.conf.set(*setting)
    stored = own.readStream.schema(ROWS).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path).withWatermark("event_time", f"{span} seconds")
    _run(stretches(stored, stretch), folder, "stretches")
    drop_path(spark, path)
    _run(verdicts(_arriving(own, folder, STRETCHES), f"{span} seconds"), folder, "verdicts")
    drop_path(spark, f"{folder}/state-stretches")
    drop_path(spark, f"{folder}/state-verdicts")
    return _written(spark, folder, "stretches", STRETCHES), _written(spark, folder, "verdicts", VERDICTS)


def conversations(claude_session: DataFrame, sources: DataFrame, stretch: str = STRETCH) -> DataFrame:
    """(session_id, turn_no, record_id, speaker): the messages of the whole conversations, in order.

    Order: instant, then source_id, then line_no, then record_id. Dropped are sessions without a message, with
    a missing parent, with a message whose role is missing or not its type's, whose first message is not the
    user's or whose last is not the assistant's. An empty table gives none.
    """
    return kept_turns(*replay(message_rows(claude_session, sources), scratch(claude_session.sparkSession, "conversations"), stretch))

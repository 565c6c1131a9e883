"""The person's own messages, without copies, with the replies around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def person(events: DataFrame) -> DataFrame:
    return events.filter((F.col("sender") == "human") & (F.col("human_text").isNotNull()))


def of_app(messages: DataFrame, sources: DataFrame, app: str) -> DataFrame:
    """Messages from the logs of one app."""
    return messages.join(sources.filter(F.col("app") == app).select("source_id"), "source_id", "left_semi")


def copy_key(events: DataFrame) -> list[Column]:
    """What copies of a message share: the instant (as written where it can't be read), the trimmed text, and of an answer to a question the call it answers.

    Two questions can get one answer at one time; those are two messages.
    """
    has = lambda c: c in events.columns
    at = F.coalesce(F.col("instant_us").cast("string"), F.concat(F.lit("as written: "), F.coalesce("written" if has("written") else "timestamp" if has("timestamp") else F.lit(""), F.lit(""))))
    answers = F.when(F.col("via") == "question_reply", F.col("call_id")) if has("call_id") else F.lit(None).cast("string")
    return [at.alias("at"), T.strip(F.col("human_text")).alias("said"), answers.alias("answers")]


def first_copies(messages: DataFrame) -> DataFrame:
    """Of the copies of a message (``copy_key``) only the first, by source and index; how many there were as ``copies``.

    One aggregation with map-side folding, so a text that a third of all rows repeat is no one task's sort.
    """
    names = messages.columns
    order = F.struct("source_id", "event_index")
    best = messages.groupBy(*copy_key(messages)).agg(F.min(F.struct(order.alias("o"), F.struct(*names).alias("r"))).alias("b"), F.count("*").alias("copies"))
    return best.select("b.r.*", "copies")


def page(messages: DataFrame, limit: int = 30, offset: int = 0, newest_first: bool = True) -> DataFrame:
    """Newest first is the plain reverse of oldest first, so undated messages then come first."""
    keys = ["instant_us", "source_id", "event_index"]
    order = [F.col(k).desc_nulls_first() if newest_first else F.col(k).asc_nulls_last() for k in keys]
    return messages.orderBy(*order).offset(offset).limit(limit)


def budget_page(rows: list[dict], chars: int = 15_000) -> list[dict]:
    """Of a page as many messages as ``chars`` hold: the first always, cut to what is left; context counts too."""
    out, left = [], chars
    for row in rows:
        around, text = len(row.get("context") or ""), row["human_text"] or ""
        if out and around + len(text) > left:
            break
        room = max(0, left - around)
        out.append(row | {"human_text": text[:room], "text_truncated": len(text) > room})
        left -= around + min(len(text), room)
    return out


def _talk(events: DataFrame) -> DataFrame:
    """Person's messages and replies in log order, the message's own second writing left out."""
    w = Window.partitionBy("source_id").orderBy("line", "event_index")
    talk = events.filter((F.col("human_text").isNotNull() | F.col("reply_text").isNotNull()) & (F.col("via") != "imported"))
    said = F.when(F.col("human_text").isNotNull(), F.struct(*copy_key(events)))
    before = F.last(said, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return talk.withColumn("said", said).withColumn("copy", F.coalesce(F.col("said").isNotNull() & F.col("said").eqNullSafe(before), F.lit(False))).filter(~F.col("copy")).drop("said", "copy")


def with_reply_before(events: DataFrame) -> DataFrame:
    """Each person's message with the agent's last visible reply before it in its log (an as-of join)."""
    w = Window.partitionBy("source_id").orderBy("line", "event_index")
    out = _talk(events).withColumn("before", F.last("reply_text", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return out.filter("human_text is not null")


def replies_after(events: DataFrame, most: int = 3) -> DataFrame:
    """(source_id, opener, replies, last_replies): the replies between a message and the next, equal neighbours once."""
    w = Window.partitionBy("source_id").orderBy("line", "event_index")
    talk = _talk(events).withColumn("turn_no", F.count("human_text").over(w)).withColumn("opener", F.last(F.when(F.col("human_text").isNotNull(), F.col("event_index")), True).over(w))
    replies = talk.filter("reply_text is not null and opener is not null")
    inner = Window.partitionBy("source_id", "turn_no").orderBy("line", "event_index")
    replies = replies.withColumn("again", F.coalesce(F.lag("reply_text").over(inner) == F.col("reply_text"), F.lit(False))).filter("not again")
    ranked = replies.withColumn("rank", F.row_number().over(Window.partitionBy("source_id", "turn_no").orderBy(F.desc("line"), F.desc("event_index"))))
    return ranked.groupBy("source_id", "opener").agg(F.count("*").alias("replies"), F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("line", "event_index", "reply_text")))).alias("last_replies"))


def turns(events: DataFrame) -> DataFrame:
    """Turns of logs without explicit ids: a turn opens with each person's message; ``turn_no`` 0 is before the first."""
    w = Window.partitionBy("source_id").orderBy("line", "event_index")
    return events.withColumn("turn_no", F.count(F.when(F.col("sender") == "human", 1)).over(w))

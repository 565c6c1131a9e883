"""The latest state of a session: last records by category, current and previous turn, compactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keep: int = 32) -> DataFrame:
    """(session, category, rank, event_index): the last ``keep`` events of every category of every session.

    Categories: human, reply, command, output, patch, summary. Latest first by line, then index.
    """
    category = F.when(F.col("human_text").isNotNull(), "human").when(F.col("reply_text").isNotNull(), "reply").when(F.col("kind").isin("command", "output", "patch", "summary"), F.col("kind"))
    w = Window.partitionBy("session", "category").orderBy(F.desc_nulls_last("instant_us"), F.desc("line"), F.desc("event_index"))
    return events.withColumn("category", category).filter("category is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).select("session", "category", "rank", "event_index")


def compactions(events: DataFrame) -> DataFrame:
    """(session, compactions, last_compaction, summaries)."""
    boundary = F.col("via") == "compact_boundary"
    return events.groupBy("session").agg(F.count_if(boundary).alias("compactions"), F.max(F.when(boundary, F.col("instant_us"))).alias("last_compaction"), F.count_if(F.col("kind") == "summary").alias("summaries"))


def current_and_previous(turns: DataFrame) -> DataFrame:
    """(session, current, previous, reentered) of events with ``turn``: islands of one turn, the last two distinct ones.

    A turn that comes back is current again and the one before it previous; ``reentered`` tells that the
    current turn had been left before.
    """
    w = Window.partitionBy("session").orderBy("instant_us", "line", "event_index")
    island = turns.filter("turn is not null").withColumn("new", ~F.lag("turn").over(w).eqNullSafe(F.col("turn"))).filter("new")
    order = F.struct("instant_us", "line", "event_index")
    by_turn = island.groupBy("session", "turn").agg(F.max(order).alias("at"), F.count("*").alias("islands"))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("at")))
    top = by_turn.withColumn("rank", rank).filter("rank <= 2")
    pick = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    return top.groupBy("session").agg(pick(1, "turn").alias("current"), pick(2, "turn").alias("previous"), (pick(1, "islands") > 1).alias("reentered"))


def snapshots(turns: DataFrame, most: int = 128) -> DataFrame:
    """(session, place, turn, records, last_events, directories, projects, completed, reentered): what is known of the current and previous turn.

    ``last_events`` are the indexes of the turn's last ``most`` events in order of time; directories and
    projects are the distinct ones of all its events, parted by line breaks; ``completed`` tells that one of its
    events ends the turn. Each task keeps the last events of a turn before they meet, so a long turn is no one
    task's sort.
    """
    known = current_and_previous(turns)
    place = known.select("session", F.explode(F.array(F.struct(F.lit("current").alias("place"), F.col("current").alias("turn"), "reentered"), F.struct(F.lit("previous").alias("place"), F.col("previous").alias("turn"), F.lit(False).alias("reentered")))).alias("p")).select("session", "p.*").filter("turn is not null")
    mine = turns.join(place, ["session", "turn"])
    ended = F.col("via").isin("turn_completed", "completion") | F.lower(F.coalesce("subtype" if "subtype" in turns.columns else F.lit(""), F.lit(""))).isin("turn_duration", "task_complete", "turn_complete", "turn_completed")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "\n")
    whole = mine.groupBy("session", "place", "turn").agg(F.count("*").alias("records"), names("cwd").alias("directories"), names("project").alias("projects"), F.max(F.coalesce(ended, F.lit(False))).alias("completed"), F.max("reentered").alias("reentered"))
    order = [F.desc_nulls_last("instant_us"), F.desc("line"), F.desc("event_index")]
    last = mine.withColumn("rank", F.row_number().over(Window.partitionBy("session", "place").orderBy(*order))).filter(F.col("rank") <= most)
    last = last.groupBy("session", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "event_index"))), lambda x: x["event_index"]).alias("last_events"))
    return whole.join(last, ["session", "place"]).select("session", "place", "turn", "records", "last_events", "directories", "projects", "completed", "reentered")


def candidates(sessions: DataFrame, most: int = 50) -> DataFrame:
    """Sessions that could be meant, the latest first."""
    return sessions.orderBy(F.desc_nulls_last("ended"), "session").limit(most)

"""The deterministic half of answering a question from records: retrieve, rank, spread, sample, digest, check.

What a language model would judge is behind ``Scorer``; the default one counts terms, so every step runs
without a network.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


class Scorer(Protocol):
    def plan(self, question: str) -> list[str]: ...

    def screen(self, question: str, texts: list[str]) -> list[int]: ...


class LexicalScorer:
    """Scores 0 to 3 by the number of the question's words in the text."""

    def plan(self, question: str) -> list[str]:
        return T.distinct_terms([w for w in question.split() if len(w) > 3])

    def screen(self, question: str, texts: list[str]) -> list[int]:
        words = {T.ascii_lower(w) for w in self.plan(question)}
        return [min(3, sum(w in T.ascii_lower(t) for w in words)) for t in texts]


def screened(pieces: DataFrame, question: str, scorer: Scorer, chunk: int = 40) -> DataFrame:
    """``pieces`` (with ``piece_text``) and a ``score``, judged ``chunk`` at a time.

    A chunk whose call fails twice keeps its first third with score 2 and the rest without a score.
    """
    schema = pieces.schema.simpleString()[7:-1] + ",score:int"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores: list[int | None] = []
            for i in range(0, len(batch), chunk):
                texts = batch["piece_text"].iloc[i : i + chunk].fillna("").tolist()
                for attempt in (1, 2):
                    try:
                        scores += scorer.screen(question, texts)
                        break
                    except Exception:  # a remote judge may fail in any way
                        if attempt == 2:
                            scores += [2 if j < -(-len(texts) // 3) else None for j in range(len(texts))]
            yield batch.assign(score=pd.array(scores, dtype="Int32"))

    return pieces.mapInPandas(run, schema)


def sweep(messages: DataFrame, size: int = 500, overlap: int = 100, whole: int = 600) -> DataFrame:
    """Long messages as overlapping pieces: (event_index, piece_no, start, piece_text)."""
    starts = F.posexplode(T.pieces(F.col("human_text"), size, overlap, whole)).alias("piece_no", "start")
    out = messages.filter("human_text is not null").select("event_index", "human_text", starts)
    text = F.when(F.char_length("human_text") <= whole, F.col("human_text")).otherwise(F.substring(F.col("human_text"), F.col("start") + 1, F.lit(size)))
    return out.select("event_index", "piece_no", "start", text.alias("piece_text"))


def best_piece(scored: DataFrame) -> DataFrame:
    """Per message the piece with the highest score, the earliest on ties."""
    return scored.groupBy("event_index").agg(F.max("score").alias("score"), F.min_by("start", F.struct(-F.coalesce("score", F.lit(-1)), F.col("piece_no"))).alias("focus"))


def union_of_terms(hits: DataFrame) -> DataFrame:
    """Hits of several terms as one row per record, its terms gathered: (event_index, terms, n_terms)."""
    return hits.groupBy("event_index").agg(F.sort_array(F.collect_set("query")).alias("terms")).withColumn("n_terms", F.size("terms"))


def per_term(hits: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` hits of each term, with their rank."""
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("instant_us"), F.desc("source_id"), F.desc("event_index"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def idf_scores(hits: DataFrame) -> DataFrame:
    """(event_index, idf): the sum over a record's terms of ln(1 + (N - df + 0.5) / (df + 0.5)).

    Terms count once after ``normalize``; N is the number of records among the hits.
    """
    groups = hits.select("event_index", T.normalize(F.col("query")).alias("term")).distinct()
    total = groups.select("event_index").distinct().agg(F.count("*").alias("total"))
    df = groups.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("rarity"))
    return groups.join(df, "term").groupBy("event_index").agg(F.sum("rarity").alias("idf"))


def month_quota(sizes: dict[str, int], quota: int) -> dict[str, int]:
    """Shares of months: half in equal parts, half by size, rounded, never above the size; what is left goes to the roomiest."""
    total, months = max(1, sum(sizes.values())), max(1, len(sizes))
    share = {m: min(n, math.floor(quota * (0.5 / months + 0.5 * n / total) + 0.5)) for m, n in sorted(sizes.items())}
    left = quota - sum(share.values())
    while left > 0 and any(share[m] < sizes[m] for m in share):
        for m in sorted(share, key=lambda m: share[m] - sizes[m]):
            if left > 0 and share[m] < sizes[m]:
                share[m] += 1
                left -= 1
    return share


def select_by_month(scores: DataFrame, quota: int) -> DataFrame:
    """Of (event_index, event_date, instant_us, idf) the best of each month, as many as its quota.

    Only the months' sizes reach the driver; they are as many as there are months.
    """
    dated = scores.withColumn("month", F.when(F.col("event_date") == "undated", "undated").otherwise(F.substring("event_date", 1, 7)))
    share = month_quota({r["month"]: r["n"] for r in dated.groupBy("month").agg(F.count("*").alias("n")).collect()}, quota)
    w = Window.partitionBy("month").orderBy(F.desc("idf"), F.desc_nulls_last("instant_us"), "event_index")
    limit = F.coalesce(F.create_map(*[F.lit(x) for p in share.items() for x in p])[F.col("month")], F.lit(0)) if share else F.lit(0)
    return dated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def ranked(hits: DataFrame) -> DataFrame:
    """Most terms first, the person's before the agent's, then the newest."""
    return hits.orderBy(F.desc("n_terms"), F.desc(F.col("sender") == "human"), F.desc_nulls_last("instant_us"), "event_index")


def spread_order(scored: DataFrame) -> DataFrame:
    """``place`` by score, then one session at a time: (…, place) over columns score, session and pos."""
    own = Window.partitionBy("score", "session").orderBy("pos")
    scored = scored.withColumn("turn", F.row_number().over(own)).withColumn("first", F.min("pos").over(Window.partitionBy("score", "session")))
    return scored.orderBy(F.desc("score"), "turn", "first")


def take_in_turn(claims: DataFrame, most: int = 12) -> DataFrame:
    """Candidates of several claims taken in turn, each record once, at most ``most``: over claim, pos and event_index."""
    turn = F.row_number().over(Window.partitionBy("claim").orderBy("pos"))
    once = claims.withColumn("turn", turn).groupBy("event_index").agg(F.min(F.struct("turn", "claim")).alias("at"))
    return once.select("event_index", "at.*").orderBy("turn", "claim", "event_index").limit(most)


def even_sample(rows: DataFrame, size: int, order: list[str], by: list[str]) -> DataFrame:
    """Of each group of ``by`` ``size`` evenly spaced rows with both ends: places floor(i * (n - 1) / (size - 1))."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy(*order)) - 1)
    steps = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.floor(k * (F.col("n") - 1) / F.lit(max(1, size - 1))).cast("int"))
    return rows.filter((F.col("n") <= size) | F.array_contains(steps, F.col("i"))).drop("n", "i")


def half_cap(rows: DataFrame, most: int, order: list[str], by: list[str]) -> DataFrame:
    """Of each group the earliest and the latest halves, together at most ``most``."""
    late = most // 2
    w = Window.partitionBy(*by)
    rows = rows.withColumn("i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    return rows.filter((F.col("i") <= most - late) | (F.col("n") - F.col("i") < late)).drop("i", "n")


def digest(messages: DataFrame) -> DataFrame:
    """Messages that say the same (``normalize``) once: (said, copies, score, first_index)."""
    return messages.groupBy(T.normalize(F.col("human_text")).alias("said")).agg(F.count("*").alias("copies"), F.max("score").alias("score"), F.min("event_index").alias("first_index"))


def within_budget(rows: list[dict], budget: int = 36_000, line: int = 240, extra: int = 60) -> list[dict]:
    """Greedy over one page in order: a row that doesn't fit is passed over, later ones may still fit."""
    out, used = [], 0
    for row in rows:
        cost = min(len(row["text"]), line) + extra
        if used + cost <= budget:
            used += cost
            out.append(row)
    return out


def take_new(hits: DataFrame, seen: DataFrame) -> DataFrame:
    return hits.join(seen.select("event_index"), "event_index", "left_anti")


def in_sessions_of(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.join(sessions.select("session").distinct(), "session", "left_semi")


def unread_sessions(events: DataFrame, read: DataFrame) -> DataFrame:
    """(session, records, ended) of sessions of which nothing was read."""
    return events.join(read.select("session").distinct(), "session", "left_anti").groupBy("session").agg(F.count("*").alias("records"), F.max("instant_us").alias("ended"))


def written_after(claims: DataFrame, messages: DataFrame, most: int = 6) -> DataFrame:
    """(claim, event_index) of messages after each claim: at most ``most`` claims, so the claims are broadcast.

    After means a later day, or the same day and a later instant; the claim's own record is not after it.
    """
    few = F.broadcast(claims.orderBy("claim").limit(most).select("claim", F.col("instant_us").alias("from_us"), F.col("event_index").alias("own")))
    later = (F.col("instant_us") > F.col("from_us")) & (F.col("event_index") != F.col("own"))
    return messages.select("event_index", "instant_us").join(few, later).select("claim", "event_index")


def verified(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(finding, quote, event_index, found): whether the quote is in the record it is said to come from."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def found(quote: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([bool(q and t and T.quote_found(q, t)) for q, t in zip(quote, text, strict=True)], dtype="boolean")

    return findings.join(evidence.select("event_index", "text"), "event_index", "left").select("finding", "quote", "event_index", found("quote", "text").alias("found"))


def spending(ledger: DataFrame, keys: list[str], amount: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(F.sum(amount).alias("amount"), F.count("*").alias("calls"))

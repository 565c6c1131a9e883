"""Commits that texts mention by their hex names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The shortest name; names and commits meet on so many leading digits.
SHORTEST = 7


def names(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name): the distinct hex names of each text, as written."""
    return df.select(key, F.explode(T.hex_names(F.col(column))).alias("name"))


def mentions(found: DataFrame, key: str) -> DataFrame:
    """(name, mentions, forms): per name in lower case how many texts have it, and the ways it is written."""
    return found.groupBy(F.lower("name").alias("name")).agg(F.count_distinct(key).alias("mentions"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("forms"))


def resolve(found: DataFrame, commits: DataFrame) -> DataFrame:
    """(name, commit): names that begin exactly one commit. They meet on their first digits, not by a cross join."""
    wanted = found.select(F.lower("name").alias("name")).distinct().withColumn("head", F.substring("name", 1, SHORTEST))
    known = commits.select(F.lower("commit").alias("commit")).distinct().withColumn("head", F.substring("commit", 1, SHORTEST))
    met = wanted.join(known, "head").filter(F.col("commit").startswith(F.col("name")))
    return met.groupBy("name").agg(F.min("commit").alias("commit"), F.count("*").alias("n")).filter("n = 1").select("name", "commit")


def mentioned_commits(found: DataFrame, commits: DataFrame, key: str, order: str, most: int = 16) -> DataFrame:
    """(commit, mentions, earliest): commits with the number of texts and the ``most`` earliest of them."""
    named = found.withColumn("name", F.lower("name")).join(resolve(found, commits), "name").groupBy("commit", key).agg(F.min(order).alias("at"))
    rank = F.row_number().over(Window.partitionBy("commit").orderBy(F.asc_nulls_last("at"), key))
    ranked = named.withColumn("rank", rank)
    return ranked.groupBy("commit").agg(F.count("*").alias("mentions"), F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", key)))).alias("e")).select("commit", "mentions", F.array_join(F.transform("e", lambda x: x[key].cast("string")), ",").alias("earliest"))

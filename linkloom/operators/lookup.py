"""Lookups by title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles that a completion lists at most.
COMPLETIONS = 100


def exact(nodes: DataFrame, title: str) -> DataFrame:
    return nodes.where(F.col("title") == title)


def by_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.startswith("title", F.lit(prefix)))


def prefix_range(nodes: DataFrame, prefix: str) -> DataFrame:
    """One row (first, last): the ids of titles with the prefix, -1 and -1 without any."""
    return by_prefix(nodes, prefix).agg(F.coalesce(F.min("id"), F.lit(-1)).alias("first"), F.coalesce(F.max("id"), F.lit(-1)).alias("last"))


def complete(nodes: DataFrame, prefix: str, limit: int = COMPLETIONS) -> DataFrame:
    """The first titles with the prefix; one that is longer by a byte at most is left out if there are others."""
    first = by_prefix(nodes, prefix).select("title").orderBy("title").limit(limit + 1)
    n = first.agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("low"))
    near = F.octet_length("low") <= F.octet_length(F.lit(prefix)) + 1
    rows = first.join(F.broadcast(n)).where(~((F.col("n") > 1) & near & (F.col("title") == F.col("low"))))  # one row
    return rows.select("title").orderBy("title").limit(limit)


def hint(nodes: DataFrame, prefix: str) -> DataFrame:
    """One row (hint): what is lacking to the first match, or to the second where the first is longer by a byte at most."""
    two = by_prefix(nodes, prefix).select("title").orderBy("title").limit(2)
    m = two.agg(F.min("title").alias("a"), F.max("title").alias("b"), F.count(F.lit(1)).alias("n"))
    near = F.octet_length("a") <= F.octet_length(F.lit(prefix)) + 1
    pick = F.when((F.col("n") > 1) & near, F.col("b")).otherwise(F.col("a"))
    return m.select(F.when(F.col("n") == 0, " (not found)").otherwise(pick.substr(F.lit(len(prefix) + 1), F.length(pick))).alias("hint"))

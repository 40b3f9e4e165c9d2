"""Connected components by Spark joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans.tables import drop_table, materialize


def _facts(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; a component is named by its least node.

    ``edges``: columns a and b of one ordered type; self-loops and nulls count
    for nothing, repeated edges once. Each round takes minima per node, which
    combine before the shuffle, so a hub costs no more than its edges; the
    joins that follow are left to adaptive skew splitting. A round's edges are
    written out, so that a lost executor repeats one round at most. Raises
    when ``max_rounds`` do not suffice (a round at least halves a path).
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _facts(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: for each node, larger neighbours point to the least of its neighbours and itself
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        # small star: smaller neighbours and the node itself point to the least neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = materialize(small, "small")
        drop_table(large)
        drop_table(e)
        e, now = new, _facts(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

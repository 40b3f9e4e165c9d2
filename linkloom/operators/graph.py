"""The link graph: dense ids, adjacency, degrees, totals, and pruning of dead ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans.tables import drop_table, materialize, with_position


def dense_ids(pages: DataFrame) -> DataFrame:
    """(new_id, old_id, title): 0-based rank of the title in byte order."""
    return with_position(pages.select("old_id", "title"), ["title", "old_id"], "new_id").select(F.col("new_id").cast("int").alias("new_id"), "old_id", "title")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, links): targets in ascending order, repeated ones kept."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("links"))


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree), zeros too."""
    return _degree(nodes, edges, "src")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _degree(nodes, edges, "dst")


def _degree(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    n = edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_pages, total_links, total_title_bytes."""
    a = nodes.agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.octet_length("title")), F.lit(0)).alias("total_title_bytes"))
    b = edges.agg(F.count(F.lit(1)).alias("total_links"))
    return a.join(F.broadcast(b)).select("n_pages", "total_links", "total_title_bytes")  # one row each


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes without links out."""
    return nodes.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def trim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Remove nodes without links out, and links to them, until none is left.

    Nodes are (id, ...), edges (src, dst). Also gives how many each round
    removed. Ids stay as they are. Only the first round looks at all nodes;
    later ones at the sources of the links just removed.
    """
    e = materialize(edges, "edges")
    gone = materialize(dead_ends(nodes, e), "gone")
    removed, dead = [], []
    while n := gone.count():
        removed.append(n)
        dead.append(gone)
        kept = materialize(e.join(gone, e.dst == gone.id, "left_anti"), "edges")
        # who lost a link and has none left
        lost = e.join(gone, e.dst == gone.id, "left_semi").select(F.col("src").alias("id")).distinct()
        old_dead = gone
        gone = materialize(lost.join(kept.select(F.col("src").alias("id")), "id", "left_anti").join(old_dead, "id", "left_anti"), "gone")
        drop_table(e)
        e = kept
    alive = nodes.join(reduce(DataFrame.unionByName, dead), "id", "left_anti") if dead else nodes
    return alive, e, removed


def reindex(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense ids in the order of the old ones: nodes (id, title), edges (src, dst)."""
    ranked = materialize(with_position(nodes.select("id", "title"), ["id"], "new"), "ids")
    ids = ranked.select(F.col("id"), F.col("new").cast("int").alias("new"))
    out = edges.join(ids.withColumnsRenamed({"id": "src", "new": "s"}), "src").join(ids.withColumnsRenamed({"id": "dst", "new": "d"}), "dst")
    return ranked.select(F.col("new").cast("int").alias("id"), "title"), out.select(F.col("s").alias("src"), F.col("d").alias("dst"))

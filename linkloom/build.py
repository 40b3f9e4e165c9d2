"""Build a graph from dumps: (nodes, edges) with dense ids, dead ends removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import graph, resolve
from linkloom.plans.tables import materialize


def from_tables(pages: DataFrame, redirects: DataFrame, links: DataFrame, redirect_mode: str = "strict", drop_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """From decoded dump tables (see ``sources.dumps``).

    ``strict`` keeps a redirect only if its source is an article row itself;
    ``resolve`` follows redirects for the sources and targets of links.
    """
    articles = materialize(resolve.article_pages(pages), "articles")
    ids = materialize(graph.dense_ids(articles), "ids")
    known = pages.where("ns = 0").select("old_id", "title") if redirect_mode == "resolve" else articles
    closed = resolve.close_redirects(resolve.resolve_redirects(redirects, known, redirect_mode))
    by_id = materialize(closed.join(ids.select(F.col("old_id").alias("dst"), "new_id"), "dst").select(F.col("src").alias("src_old_id"), F.col("new_id").alias("dst_new_id")), "redirects")
    sourced = resolve.remap_sources(links, by_id, ids)
    via = None
    if redirect_mode == "resolve":
        via = by_id.join(pages.where("ns = 0").select(F.col("old_id").alias("src_old_id"), "title"), "src_old_id").join(ids.select(F.col("new_id").alias("dst_new_id"), F.col("title").alias("target")), "dst_new_id").select("title", "target")
        sourced = sourced.where("ns = 0")
    edges = resolve.resolve_targets(sourced, ids, via, drop_self)
    nodes, edges, _ = graph.trim(ids.select(F.col("new_id").alias("id"), "title"), edges)
    return graph.reindex(nodes, edges)


def from_xml(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From XML pages (see ``sources.dumps.read_xml``); self links stay and one redirect is followed."""
    texts, redirects = resolve.xml_links(pages)
    titles = pages.where("ns = 0 and redirect is null").select("title").distinct()
    ids = materialize(graph.dense_ids(titles.withColumn("old_id", F.lit(0).cast("long"))), "ids")
    links = texts.join(ids.select("title", F.col("new_id").alias("src")), "title").select("src", F.col("target").alias("title"))
    edges = resolve.resolve_targets(links, ids, redirects, drop_self=False)
    nodes, edges, _ = graph.trim(ids.select(F.col("new_id").alias("id"), "title"), edges)
    return graph.reindex(nodes, edges)

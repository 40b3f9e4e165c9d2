"""Resolving redirects and link titles by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import extract_links
from linkloom.plans.tables import drop_table, materialize

#: Links of the longest redirect chain that is followed.
CHAIN = 101


def article_pages(pages: DataFrame) -> DataFrame:
    """(old_id, title) of articles that are no redirects."""
    return pages.where((F.col("ns") == 0) & ~F.col("is_redirect")).select("old_id", "title")


def last_by_title(pages: DataFrame, position: str) -> DataFrame:
    """One row per title, the one that comes last."""
    return pages.groupBy("title").agg(F.max_by("old_id", position).alias("old_id")).select("old_id", "title")


def resolve_redirects(redirects: DataFrame, pages: DataFrame, mode: str = "strict") -> DataFrame:
    """(src, dst) old ids of redirects whose target title is known.

    ``strict``: the source is one of ``pages`` too. ``resolve``: any source.
    A source with several targets keeps the greatest.
    """
    r = redirects.where(F.col("ns") == 0)
    if mode == "strict":
        r = r.join(pages, r.src_old_id == pages.old_id, "left_semi")
    hit = r.join(pages.withColumnRenamed("old_id", "dst"), "title")
    return hit.groupBy(F.col("src_old_id").alias("src")).agg(F.max("dst").alias("dst"))


def close_redirects(edges: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(src, dst, hops): redirects followed to their ends by pointer doubling.

    What lies on or leads into a cycle, or takes more than ``chain`` links, is
    dropped. Sources are unique.
    """
    r = materialize(edges.select("src", "dst", F.lit(1).alias("hops")), "redirects")
    for _ in range(max(1, chain).bit_length()):
        nxt = r.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("hops").alias("more"))
        new = materialize(
            r.join(nxt, "dst", "left").select("src", F.coalesce("end", "dst").alias("dst"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("end").isNotNull().alias("moved")),
            "redirects",
        )
        drop_table(r)
        r = new.drop("moved")
        if new.where("moved").isEmpty():
            break
        r._linkloom_path = new._linkloom_path
    starts = edges.select(F.col("src").alias("dst"))
    return r.where(F.col("hops") <= chain).join(starts, "dst", "left_anti").select("src", "dst", "hops")


def remap_sources(links: DataFrame, redirects: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``src``: the redirect's target, else the page itself; links of neither go.

    ``redirects``: (src_old_id, dst_new_id); ``ids``: (new_id, old_id, title).
    """
    out = links.join(redirects, "src_old_id", "left").join(ids.select(F.col("old_id").alias("src_old_id"), F.col("new_id").alias("own")), "src_old_id", "left")
    return out.withColumn("src", F.coalesce("dst_new_id", "own")).where("src is not null").drop("dst_new_id", "own")


def resolve_targets(links: DataFrame, ids: DataFrame, redirects: DataFrame | None = None, drop_self: bool = True) -> DataFrame:
    """(src, dst) of links to articles; with ``redirects`` (title, target) one redirect is
    followed where no page has the title. A page goes before a redirect."""
    names = ids.select("title", F.col("new_id").alias("dst"))
    if redirects is None:
        out = links.where("ns = 0").join(names, "title").select("src", "dst")
    else:
        via = redirects.join(names.withColumnRenamed("title", "target"), "target").groupBy("title").agg(F.max("dst").alias("via"))
        out = links.join(names, "title", "left").join(via, "title", "left").select("src", F.coalesce("dst", "via").alias("dst")).where("dst is not null")
    return out.where("src <> dst") if drop_self else out


def xml_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From XML pages: (title, target) distinct link texts of articles, and (title, target) redirects."""
    art = pages.where("ns = 0")
    texts = art.where("redirect is null").select("title", F.explode("texts").alias("text"))
    links = texts.select("title", F.explode(extract_links("text")).alias("target")).distinct()
    return links, art.where("redirect is not null").select("title", F.col("redirect").alias("target"))

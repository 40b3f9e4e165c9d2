"""Shortest paths for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans.tables import drop_table, materialize

#: Links of the longest path that is looked for.
MAX_LINKS = 10


def bfs_levels(edges: DataFrame, starts: DataFrame, depth: int = MAX_LINKS) -> DataFrame:
    """(start, id, k): the fewest links from each start (column ``start``) to what it reaches within ``depth``."""
    e = edges.select("src", "dst").distinct()
    level = materialize(starts.select("start", F.col("start").alias("id")).distinct(), "level")
    levels = [level.withColumn("k", F.lit(0))]
    for k in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, [x.select("start", "id") for x in levels])
        nxt = level.join(e, level.id == e.src).select("start", F.col("dst").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        level = materialize(nxt, "level")
        if level.isEmpty():
            break
        levels.append(level.withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, levels)


def shortest_paths(nodes: DataFrame, edges: DataFrame, queries: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """(query_id, status, hops, path): the fewest links from start to target title.

    Of equally short paths that with the least ids from the start on, which
    are the least titles as ids follow titles. ``status``: ok, start_missing,
    target_missing (the start is looked at first) or no_path.

    One loop goes backwards from the targets, all queries together. A node
    that is reached keeps the least next node, and with it the least path, so
    no second walk is needed. Targets whose starts have all been reached take
    part no longer.
    """
    title = nodes.select("id", "title")
    asked = queries.join(title.withColumnsRenamed({"id": "s", "title": "start"}), "start", "left").join(title.withColumnsRenamed({"id": "t", "title": "target"}), "target", "left")
    asked = materialize(asked.select("query_id", "s", "t"), "asked")
    pairs = asked.where("s is not null and t is not null").select("s", "t").distinct()
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    level = materialize(pairs.select("t", F.col("t").alias("id"), F.array("t").alias("path")).distinct(), "level")
    levels, found = [level], []
    open_pairs = pairs
    for _ in range(max_links + 1):
        hit = materialize(open_pairs.join(level.withColumnRenamed("id", "s"), ["s", "t"]), "hit")
        found.append(hit)
        open_pairs = materialize(open_pairs.join(hit, ["s", "t"], "left_anti"), "open")
        if len(levels) > max_links or open_pairs.isEmpty():
            break
        live = level.join(open_pairs.select("t").distinct(), "t", "left_semi").withColumnRenamed("id", "dst")
        seen = reduce(DataFrame.unionByName, [x.select("t", "id") for x in levels])
        best = e.join(live, "dst").groupBy("t", F.col("src").alias("id")).agg(F.min_by("path", "dst").alias("path"))
        level = materialize(best.join(seen, ["t", "id"], "left_anti").select("t", "id", F.concat(F.array("id"), "path").alias("path")), "level")
        if level.isEmpty():
            break
        levels.append(level)
    paths = reduce(DataFrame.unionByName, found)
    steps = paths.select("s", "t", F.posexplode("path").alias("step", "id")).join(title, "id")
    named = steps.groupBy("s", "t").agg(F.array_sort(F.collect_list(F.struct("step", "title"))).alias("p")).select("s", "t", F.col("p.title").alias("path"))
    status = F.when(F.col("s").isNull(), "start_missing").when(F.col("t").isNull(), "target_missing").when(F.col("path").isNull(), "no_path").otherwise("ok")
    drop_table(e)
    return asked.join(named, ["s", "t"], "left").select("query_id", status.alias("status"), (F.size("path") - 1).alias("hops"), "path").withColumn("hops", F.when(F.col("status") == "ok", F.col("hops")))


def path_steps(paths: DataFrame) -> DataFrame:
    """(query_id, step, title)."""
    return paths.where("status = 'ok'").select("query_id", F.posexplode("path").alias("step", "title"))


def show_path(paths: DataFrame) -> DataFrame:
    """(query_id, line): the path by arrows, or that there is none."""
    return paths.select("query_id", F.when(F.col("status") == "ok", F.array_join("path", " -> ")).when(F.col("status") == "no_path", "No path found").when(F.col("status") == "start_missing", "start is not in the graph").otherwise("target is not in the graph").alias("line"))

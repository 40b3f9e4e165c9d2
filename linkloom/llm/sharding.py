"""Balanced label propagation (operator 10).

Documents that share a group are linked. Every document starts in a shard by
its id; in each round joins count, for every document and shard, the linked
documents there, and documents move to the shard with most of their
neighbours, within quotas that keep every shard at its capacity. Counts are
per (group, shard), so that no pair of documents is ever made, and a group of
any size costs one row per shard. A last step cuts the order (shard, document)
into equal runs, which makes the counts differ by one at most; documents
without links lie at the ends of a shard's run, so cuts fall among these.

Defined cases: a null text counts as the empty text; an empty table gives no
rows; repeated texts form a group; repeated doc_ids are spread like other
rows, ordered by text; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.plans.tables import drop_table, materialize, with_position

#: Steps in which a quota's share is measured out.
_GRAIN = 1 << 20


def _share(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(_GRAIN))


def propagate(members: DataFrame, total: int, shards: int = 8, rounds: int = 5) -> DataFrame:
    """(id, shard) for every linked id.

    ``members``: (id, group), a row for each document of each group of two or
    more; ids may be in several groups. ``total``: all documents, linked or
    not. A shard's capacity is its even part of all documents: those without
    links fill what the linked ones leave.
    """
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    nodes = members.join(sizes, "group").groupBy("id").agg(F.min_by("group", F.struct(-F.col("size"), F.col("group"))).alias("home"), F.max("size").alias("size"))
    # whole groups start together where they are small against a shard
    whole = F.col("size") <= F.lit(max(2, total // (shards * 8)))
    unit = F.when(whole, F.xxhash64("home")).otherwise(F.xxhash64("id"))
    state = materialize(nodes.select("id", unit.alias("unit"), F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int").alias("turn"), F.pmod(F.xxhash64(F.lit(-1), "id"), F.lit(shards)).cast("int").alias("shard")), "labels")
    for step in range(rounds):
        at = members.join(state, "id")
        count = at.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
        # a group's counts as one array of ``shards`` numbers: a row per group
        row = count.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("counts"))
        seen = (
            members.join(row, "group")
            .groupBy("id")
            .agg(*[F.sum(F.coalesce(F.col("counts")[s], F.lit(0))).alias(f"n{s}") for s in range(shards)])
            .withColumn("counts", F.array(*[f"n{s}" for s in range(shards)]))
        )
        # the document itself counts, and ties go by an order of the shards that its
        # largest group fixes: members of one group agree, so none swap for ever
        best = F.expr(f"array_max(transform(counts, (x, k) -> struct(x as n, pmod(k + turn, {shards}) as p, k as k)))")
        moves = materialize(
            state.join(seen, "id")
            .withColumn("best", best)
            .select(
                "id",
                "unit",
                "turn",
                "shard",
                F.col("best.k").alias("to"),
            ),
            "moves",
        )
        flow = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most shards ** 2 rows
        drop_table(state)
        held = [sum(n for (s, _), n in flow.items() if s == k) for k in range(shards)]
        cap = total / shards
        wish = {k: n for k, n in flow.items() if k[0] != k[1]}
        take = dict(wish)
        for _ in range(20):  # shrink what flows into full shards until all fit
            over = False
            for t in range(shards):
                into = sum(n for (_, b), n in take.items() if b == t)
                out = sum(n for (a, _), n in take.items() if a == t)
                room = max(0.0, cap - held[t] + out)
                if into > room:
                    over = True
                    take = {k: n * room / into if k[1] == t else n for k, n in take.items()}
            if not over:
                break
        accept = F.lit(0)
        for (a, b), n in take.items():
            accept = F.when((F.col("shard") == a) & (F.col("to") == b), F.lit(int(_GRAIN * n / wish[a, b]))).otherwise(accept)
        moved = F.when((F.col("shard") != F.col("to")) & (_share(F.lit(step), "unit") < accept), F.col("to")).otherwise(F.col("shard"))
        state = materialize(moves.select("id", "unit", "turn", moved.alias("shard")), "labels")
        drop_table(moves)
        if not wish:
            break
    return state.select("id", "shard")


def even_runs(labelled: DataFrame, shards: int = 8) -> DataFrame:
    """Cut (id, key, shard or null) into ``shards`` runs whose counts differ by one at most.

    Adds the final shard and slot. A null shard marks rows without links: they
    fill up the shards by a hash of their id, at one of the two ends of a run.
    """
    free = F.col("shard").isNull()
    lot = F.xxhash64(F.lit(7), "id")
    held = {r["shard"]: r["n"] for r in labelled.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards + 1 rows
    even = sum(held.values()) / shards
    room = [max(0.0, even - held.get(k, 0)) for k in range(shards)]
    fill, below = F.lit(shards - 1), 0.0
    bounds = []
    for k in range(shards - 1):
        below += room[k] / (sum(room) or 1)
        bounds.append((k, int(_GRAIN * below)))
    for k, bound in reversed(bounds):
        fill = F.when(_share(F.lit(8), "id") < bound, k).otherwise(fill)
    ordered = with_position(
        labelled.withColumn("__phase", F.when(free, F.when(F.pmod(lot, F.lit(2)) == 0, 0).otherwise(2)).otherwise(1))
        .withColumn("__shard", F.coalesce("shard", fill))
        .drop("shard"),
        ["__shard", "__phase", "key", "id"],
    )
    n = ordered._linkloom_total
    # the first position of shard s is the least p with floor(p * shards / n) = s
    shard = F.expr(f"position * {shards} div {max(n, 1)}").cast("int")
    starts = F.expr(f"(cast(position * {shards} div {max(n, 1)} as bigint) * {n} + {shards - 1}) div {shards}")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col("position") - starts).drop("__phase", "__shard", "position")


def assign(docs: DataFrame, shards: int = 8, rounds: int = 5) -> DataFrame:
    """A shard and slot for every document by the law ``rows``; groups are equal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(
        docs.select(
            F.col("doc_id").alias("id"),
            F.unhex(F.md5(text.cast("binary"))).alias("key"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "sizes",
    )
    total = base.count()
    groups = base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("group"))
    members = materialize(base.join(groups, base.key == groups.group, "left_semi").select("id", F.col("key").alias("group")).distinct(), "members")
    labels = propagate(members, total, shards, rounds)
    labelled = materialize(base.join(labels, "id", "left"), "labelled")
    return even_runs(labelled, shards).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def cut_edges(assigned: DataFrame) -> DataFrame:
    """Links and cut links over (group, shard) rows, from counts alone: one row."""
    per = assigned.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("kept"))
    return whole.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("links"), F.sum(F.expr("n * (n - 1) div 2 - kept")).alias("cut"))


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))

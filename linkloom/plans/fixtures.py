"""A link graph over customers and orders, and dumps rendered from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.plans.tables import materialize, with_position

CONDITIONS = {"urgent": "o_orderpriority = '1-URGENT'", "F": "o_orderstatus = 'F'", "all": "true"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(old_id, title): customers."""
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old_id"), F.col("c_name").alias("title"))


def links(spark: SparkSession, sf_dir: str, which: str = "urgent") -> DataFrame:
    """(src, dst): from an order's customer to that of the next order. Positions, and
    a join with the next one, take the place of a window over all rows."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    ranked = materialize(with_position(o, ["o_orderkey"]), "orders")
    after = ranked.select((F.col("position") - 1).alias("position"), F.col("o_custkey").alias("dst"))
    kept = ranked.where(CONDITIONS[which])
    return kept.join(after, "position").where("o_custkey <> dst").select(F.col("o_custkey").alias("src"), "dst")


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): machinery customers to the next customer, the last to the first."""
    c = load(spark, sf_dir, "customer")
    n = c.count()
    return c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") + 1) % n).alias("dst"))


def graph(spark: SparkSession, sf_dir: str, which: str = "urgent") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, title) and edges (src, dst); ids are customer keys, which ascend with titles."""
    nodes = pages(spark, sf_dir).select(F.col("old_id").alias("id"), "title")
    return nodes, links(spark, sf_dir, which)


def render(rows: DataFrame, table: str, key: str, fields: list, size: int = 500) -> DataFrame:
    """Lines (value) of INSERT statements, ``size`` consecutive keys in each."""
    t = F.concat(F.lit("("), F.concat_ws(",", *[f.cast("string") for f in fields]), F.lit(")"))
    made = rows.select(F.expr(f"{key} div {size}").alias("line"), F.col(key).alias("k"), t.alias("t"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), ",")
    return made.groupBy("line").agg(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), line, F.lit(";")).alias("value")).select("value")


def quoted(title) -> F.Column:
    """A title as a dump has it."""
    return F.concat(F.lit("'"), F.regexp_replace(F.translate(title, " ", "_"), r"([\\'\"])", r"\\$1"), F.lit("'"))

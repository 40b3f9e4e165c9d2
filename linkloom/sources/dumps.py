"""Readers for dumps: the index, SQL statements line by line, and XML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import clean_title, dump_date, to_id

#: Fields of a tuple by statement; vintages differ, so these are settings.
ARITY = {"page": 12, "redirect": 5, "pagelinks": 4}

_FIELD = r"(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^',()]*+)"
_TUPLE = rf"\(({_FIELD}(?:,{_FIELD})*+)\)"

INDEX_SCHEMA = "wikis map<string, struct<jobs: map<string, struct<status: string, files: map<string, struct<url: string>>>>>>"


def dump_index(index: DataFrame, wiki: str, mirror: str = "") -> DataFrame:
    """(job, url, dump_date) of the page, redirect and link tables of a wiki.

    ``index``: one row per whole JSON text, column ``value``. Fails where a job
    is not done or has other than one file.
    """
    doc = index.select(F.from_json("value", INDEX_SCHEMA).alias("i"))
    jobs = doc.select(F.explode(F.col("i.wikis")[wiki]["jobs"]).alias("job", "state")).where(F.col("job").isin("pagetable", "redirecttable", "pagelinkstable"))
    sound = (F.col("state.status") == "done") & (F.size("state.files") == 1)
    file = F.map_entries("state.files")[0]
    checked = F.when(sound, file["key"]).otherwise(F.raise_error(F.concat(F.lit("dump is not complete: "), F.col("job"))))
    return jobs.select("job", checked.alias("name"), F.concat(F.lit(mirror), file["value"]["url"]).alias("url")).select("job", "url", dump_date(F.col("name")).alias("dump_date"))


def read_lines(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Lines of (gzipped) SQL. A gzip file is one task, so lines are spread right after reading."""
    lines = spark.read.text(path)
    return lines.repartition(parts) if parts else lines


def statements(lines: DataFrame, table: str) -> DataFrame:
    """Lines that insert into ``table``; all others are ignored."""
    return lines.where(F.startswith("value", F.lit(f"INSERT INTO `{table}` VALUES ")))


def tuples(lines: DataFrame, table: str) -> DataFrame:
    """(fields) of every tuple; commas and brackets within quotes split nothing."""
    body = statements(lines, table).select(F.explode(F.regexp_extract_all("value", F.lit(_TUPLE), F.lit(1))).alias("t"))
    return body.select(F.regexp_extract_all("t", F.lit(rf"(?:^|,)({_FIELD})"), F.lit(1)).alias("fields"))


def checked(rows: DataFrame, arity: int, mode: str = "FAILFAST") -> DataFrame:
    """Tuples with ``arity`` fields; others fail the query or are dropped."""
    good = F.size("fields") == arity
    if mode == "DROPMALFORMED":
        return rows.where(good)
    return rows.select(F.when(good, F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.to_json("fields")))).alias("fields"))


def bad_tuples(lines: DataFrame, table: str, arity: int | None = None) -> DataFrame:
    """Tuples with another number of fields: (n_fields, fields)."""
    return tuples(lines, table).where(F.size("fields") != (arity or ARITY[table])).select(F.size("fields").alias("n_fields"), "fields")


def read_pages(lines: DataFrame, mode: str = "FAILFAST", arity: int = ARITY["page"]) -> DataFrame:
    """(old_id, ns, title, is_redirect) of ``page`` statements."""
    f = checked(tuples(lines, "page"), arity, mode)
    return f.select(to_id(F.col("fields")[0]).alias("old_id"), to_id(F.col("fields")[1]).cast("int").alias("ns"), clean_title(F.col("fields")[2]).alias("title"), F.startswith(F.col("fields")[4], F.lit("1")).alias("is_redirect"))


def _sources(lines: DataFrame, table: str, mode: str, arity: int) -> DataFrame:
    f = checked(tuples(lines, table), arity, mode)
    return f.select(to_id(F.col("fields")[0]).alias("src_old_id"), to_id(F.col("fields")[1]).cast("int").alias("ns"), clean_title(F.col("fields")[2]).alias("title"))


def read_redirects(lines: DataFrame, mode: str = "FAILFAST", arity: int = ARITY["redirect"]) -> DataFrame:
    """(src_old_id, ns, title) of ``redirect`` statements."""
    return _sources(lines, "redirect", mode, arity)


def read_links(lines: DataFrame, mode: str = "FAILFAST", arity: int = ARITY["pagelinks"]) -> DataFrame:
    """(src_old_id, ns, title) of ``pagelinks`` statements."""
    return _sources(lines, "pagelinks", mode, arity)


XML_SCHEMA = "title string, ns int, redirect struct<_title: string>, revision array<struct<text: string>>"


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, redirect, texts) of the pages of an XML dump; all revisions' texts."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(XML_SCHEMA).load(path)
    return raw.select("title", "ns", F.col("redirect._title").alias("redirect"), F.coalesce(F.col("revision.text"), F.array().cast("array<string>")).alias("texts"))

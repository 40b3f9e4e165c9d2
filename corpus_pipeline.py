"""Corpus pipeline: toxicity, near-dedup, decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result
is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``docs``. Null texts pass every stage and have no
ids; empty tables pass as they are; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.bpe import encode_decode
from linkloom.llm.common import small_batches, table
from linkloom.llm.fmindex import cut
from linkloom.llm.neardup import keep_one
from linkloom.llm.pii import redact
from linkloom.llm.toxicity import fit, keep_clean, training_rows
from linkloom.plans.tables import drop_table, materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the labelled ones, rejects go."""
    small_batches(spark)
    return keep_clean(docs, fit(*training_rows(docs, table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays."""
    small_batches(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of benchmark items are cut from the texts; a document of nothing else goes."""
    small_batches(spark)
    return cut(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    small_batches(spark)
    return redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and in place of the text what these decode to."""
    small_batches(spark)
    return encode_decode(docs).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", personal_data),
    ("bpe", token_ids),
]

#: A trained classifier, MinHash and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, held = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = materialize(stage(spark, docs, sf_dir), f"stage{k}-{name}")
        drop_table(held)
        docs = held = out
    return docs

"""Queries of the corpus operators by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.bitplanes import op2_bitplane_ids
from linkloom.llm.bpe import op6_bpe
from linkloom.llm.fmindex import SQL as OP3_SQL
from linkloom.llm.fmindex import op3_fm_decontaminate
from linkloom.llm.neardup import op4_containment_ensemble
from linkloom.llm.pii import op9_semi_crf_pii
from linkloom.llm.sharding import op10_balanced_shards
from linkloom.llm.substrings import SQL as OP8_SQL
from linkloom.llm.substrings import op8_cover_dedup
from linkloom.llm.toxicity import op1_ssk_toxicity
from linkloom.llm.urls import SQL as OP7_SQL
from linkloom.llm.urls import op7_redirect_filter
from linkloom.llm.webp import op5_lossless_webp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ssk_toxicity": op1_ssk_toxicity,
    "op2_bitplane_ids": op2_bitplane_ids,
    "op3_fm_decontaminate": op3_fm_decontaminate,
    "op4_containment_ensemble": op4_containment_ensemble,
    "op5_lossless_webp": op5_lossless_webp,
    "op6_bpe": op6_bpe,
    "op7_redirect_filter": op7_redirect_filter,
    "op8_cover_dedup": op8_cover_dedup,
    "op9_semi_crf_pii": op9_semi_crf_pii,
    "op10_balanced_shards": op10_balanced_shards,
}

ORACLE_SQL: dict[str, str] = {
    "op3_fm_decontaminate": OP3_SQL,
    "op7_redirect_filter": OP7_SQL,
    "op8_cover_dedup": OP8_SQL,
}

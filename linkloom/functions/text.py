"""Column expressions for titles, ids and dates, and link extraction from wiki markup."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unquote(field: Column) -> Column:
    """The inside of a quoted SQL field; other fields stay."""
    return F.regexp_replace(field, "^'|'$", "")


def unescape(title: Column) -> Column:
    """Backslash, quote and double quote without the backslash before them; other escapes stay."""
    return F.regexp_replace(title, r"\\([\\'\"])", "$1")


def trim_space(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def clean_title(field: Column) -> Column:
    """A dump's title field as shown to people: unquoted, unescaped, spaces for underscores, trimmed."""
    return trim_space(F.translate(unescape(unquote(field)), "_", " "))


def first_upper(title: Column) -> Column:
    """Upper case for a first ASCII letter alone."""
    return F.when(title.rlike("^[a-z]"), F.concat(F.upper(F.substring(title, 1, 1)), title.substr(F.lit(2), F.length(title)))).otherwise(title)


def before_alias(link: Column) -> Column:
    return F.substring_index(link, "|", 1)


def before_fragment(link: Column) -> Column:
    return F.substring_index(link, "#", 1)


def to_id(field: Column) -> Column:
    """A number, or 0 for what is none."""
    return F.coalesce(field.try_cast("long"), F.lit(0).cast("long"))


def dump_date(name: Column) -> Column:
    """yyMMdd from a file name like ``xxwiki-20221201-page.sql.gz``."""
    return F.split_part(name, F.lit("-"), F.lit(2)).cast("int") - F.lit(20000000)


def show_date(date: Column) -> Column:
    return F.date_format(F.to_date((date + F.lit(20000000)).cast("string"), "yyyyMMdd"), "yyyy.MM.dd")


def slice_text(s: Column, start: int, end: int | None = None) -> Column:
    """Characters from start up to end; negative numbers count from the end, all are clamped."""
    n = F.length(s)
    at = lambda k: F.lit(k) if k >= 0 else n + F.lit(k)
    a = F.least(F.greatest(at(start), F.lit(0)), n)
    b = n if end is None else F.least(F.greatest(at(end), F.lit(0)), n)
    return s.substr(a + 1, F.greatest(b - a, F.lit(0)))


def find_text(s: Column, needle: Column, start: int = 0) -> Column:
    """0-based place of the needle from ``start`` on, -1 without one; an empty needle is at ``start``."""
    return F.when(F.length(needle) == 0, F.lit(start)).otherwise(F.call_function("locate", needle, s, F.lit(start + 1)) - 1)


def show_duration(ms: Column) -> Column:
    """Whole milliseconds below a second, at least one; tenths of seconds from there."""
    return F.when(ms < 1, F.lit("1ms")).when(ms < 1000, F.format_string("%dms", ms.cast("long"))).otherwise(F.format_string("%.1f sec", (ms / 1000).cast("double")))


_BRACE = re.compile(r"\{\{|\}\}")


def links_of(text: str | None) -> list[str]:
    """Distinct link targets of a wiki text, outside templates, in order of place.

    Bodies with a colon are no article links. An unclosed template is skipped
    up to its last brace pair.
    """
    if not text:
        return []
    out: dict[str, None] = {}
    at = 0
    while (opened := text.find("[[", at)) >= 0:
        brace = text.find("{{", at, opened)
        if brace >= 0:
            depth, end = 1, brace + 2
            for m in _BRACE.finditer(text, brace + 2):
                depth += 1 if m.group() == "{{" else -1
                end = m.end()
                if not depth:
                    break
            at = end
            continue
        close = text.find("]]", opened)
        if close < 0:
            break
        body = text[opened + 2 : close]
        if ":" not in body:
            if body[:1].isascii():
                body = body[:1].upper() + body[1:]
            out[body.split("|", 1)[0].split("#", 1)[0]] = None
        at = close + 2
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_links(text: pd.Series) -> pd.Series:
    """``links_of`` by Arrow batches: balanced braces are beyond regular expressions."""
    return text.map(links_of)

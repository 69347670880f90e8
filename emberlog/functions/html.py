"""Reference pages: titles, headings, link targets and visible text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), 1), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)


def visible_text(html: Column) -> Column:
    """Text without comments, scripts, styles and tags; white space as single spaces."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)[^>]*>.*?</\1>|<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))

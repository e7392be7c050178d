"""Substring search over notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import contains_ci


def by_title_or_body(notes: DataFrame, query: str) -> DataFrame:
    """An empty query finds all."""
    if not query:
        return notes
    return notes.filter(contains_ci(F.col("title"), query) | contains_ci(F.col("markdown_content"), query))


def by_tag(notes: DataFrame, query: str) -> DataFrame:
    return notes.filter(F.exists("tags", lambda tag: contains_ci(tag, query)))


def by_all(notes: DataFrame, query: str) -> DataFrame:
    """Title, body or any tag."""
    tagged = F.exists("tags", lambda tag: contains_ci(tag, query))
    return notes.filter(contains_ci(F.col("title"), query) | contains_ci(F.col("markdown_content"), query) | tagged)

"""Text of notes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed (fixed values): not U+0085, but U+FEFF.
TRIMMED = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
PREVIEW_CHARS = 60
#: A link of a Markdown text, whose first group is what it shows (fixed value).
LINK = r"\[([^\]]+)\]\([^)]+\)"


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(TRIMMED))


def contains_ci(c: Column, query: str) -> Column:
    """Literal, case-insensitive containment; no character of the query is special."""
    return F.lower(c).contains(F.lower(F.lit(query)))


def strip_markdown(c: Column) -> Column:
    """Without heading marks at line starts, bold, italic and code marks; links leave their text."""
    c = F.regexp_replace(c, r"(?<![^\n\r\x{2028}\x{2029}])#+ ", "")
    for mark in ("**", "*", "`"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return trim(F.regexp_replace(c, LINK, "$1"))


def preview(c: Column) -> Column:
    """The first line that isn't blank, of the stripped text, cut to 60 code points and then marked with dots."""
    lines = F.split(strip_markdown(F.coalesce(c, F.lit(""))), "\n")
    first = F.coalesce(F.get(F.filter(lines, lambda x: trim(x) != ""), 0), F.lit(""))
    return F.when(F.length(first) > PREVIEW_CHARS, F.concat(F.substring(first, 1, PREVIEW_CHARS), F.lit("..."))).otherwise(first)


def initial(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 1))


def or_default(c: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def grouped_number(c: Column) -> Column:
    """With thousands separators and up to three decimals; null for zero."""
    return F.when(c != 0, F.call_function("format_number", c, F.lit("#,##0.###")))


def new_id() -> Column:
    """A random version 4 UUID, another in each row and at each evaluation: write it before it is used twice."""
    return F.expr("uuid()")


def slot_char(typed: Column, at: Column) -> Column:
    """The character of what was typed that the slot with this index shows, or null; indices start at 0."""
    return F.nullif(F.substring(typed, at.cast("int") + 1, F.lit(1)), F.lit(""))


def without(props: Column, *names: str) -> Column:
    """A struct without the named fields; the rest is passed on."""
    return props.dropFields(*names)

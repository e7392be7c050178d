"""Dates relative to a given moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def days_between(t: Column, now: Column) -> Column:
    """Whole periods of 24 hours from ``t`` to ``now``; negative if ``t`` is later."""
    return F.floor((F.unix_millis(now) - F.unix_millis(t)) / DAY_MS).cast("bigint")


def label(t: Column, now: Column) -> Column:
    """Today, Yesterday, "N days ago" below seven (and for later moments), else month and day."""
    days = days_between(t, now)
    return (
        F.when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .otherwise(F.date_format(t, "MMM d"))
    )

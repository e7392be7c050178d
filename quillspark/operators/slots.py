"""The slot that names the current note, for each of many sessions: rows (session, id); a session without row has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.views import first_by_position


def written(slots: DataFrame, writes: DataFrame) -> DataFrame:
    """The slots after ``writes`` (session, seq, id), the last of a session counting; a null or empty id clears."""
    last = writes.groupBy("session").agg(F.max(F.struct("seq", F.coalesce("id", F.lit("")).alias("id"))).alias("last"))
    kept = slots.join(last.select("session"), "session", "left_anti").select("session", "id")
    return kept.unionByName(last.select("session", F.col("last.id").alias("id")).filter("id <> ''"))


def selected(slots: DataFrame, selections: DataFrame, notes: DataFrame) -> DataFrame:
    """The slots after ``selections`` (session, seq, id); those of unknown notes do nothing."""
    return written(slots, selections.join(notes.select("id").distinct(), "id", "left_semi"))


def loaded(slots: DataFrame, sessions: DataFrame, notes: DataFrame) -> DataFrame:
    """(session, current, id): what each of ``sessions`` (session) shows first, and its slot then.

    The note that the slot names is shown, else the first of the list. A missing slot is given
    that note's id; one that names no note any more stays as it is.
    """
    known = notes.select(F.col("id").alias("known")).distinct()
    first = first_by_position(notes).select("id").scalar()
    named = sessions.join(slots, "session", "left").join(known, F.col("id") == F.col("known"), "left")
    return named.select("session", F.coalesce("known", first).alias("current"), F.coalesce("id", first).alias("id"))

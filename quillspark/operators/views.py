"""Lists, counts and single rows of notes. Order is the column ``position``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import reltime, text

RECENT = 10
SHOWN_PEOPLE = 3
STATUS_TEXT = {"saved": "Saved", "saving": "Saving...", "unsaved": "Unsaved"}


def first_by_position(notes: DataFrame) -> DataFrame:
    return notes.orderBy("position").limit(1)


def recent(notes: DataFrame, n: int = RECENT) -> DataFrame:
    return notes.orderBy("position").limit(n)


def by_id(notes: DataFrame, wanted: str) -> DataFrame:
    return first_by_position(notes.filter(F.col("id") == wanted))


def index_of(notes: DataFrame, wanted: str) -> DataFrame:
    """(position): the first place of an id, or -1."""
    return notes.filter(F.col("id") == wanted).agg(F.coalesce(F.min("position"), F.lit(-1)).cast("bigint").alias("position"))


def list_view(notes: DataFrame, now: Column, current: str | None) -> DataFrame:
    """One card for each note: id, title, preview, date label and whether it is the current one. A preview that is kept is read
    instead of the body."""
    preview = F.col("preview") if "preview" in notes.columns else text.preview(F.col("markdown_content"))
    return notes.select(
        "id", "title", preview.alias("preview"), reltime.label(F.col("updated_at"), now).alias("label"),
        F.col("id").eqNullSafe(F.lit(current)).alias("active"), "position",
    )


def current_or_first(notes: DataFrame, pointer: DataFrame) -> DataFrame:
    """The note that ``pointer`` (id, one row) names, else the first; an empty id names none."""
    named = notes.join(pointer.select(F.nullif("id", F.lit("")).alias("wanted")), F.col("id") == F.col("wanted"), "left_semi")
    both = first_by_position(named).withColumn("choice", F.lit(0)).unionByName(first_by_position(notes).withColumn("choice", F.lit(1)))
    return both.orderBy("choice").limit(1).drop("choice")


def empty_state(shown: DataFrame, query: str) -> DataFrame:
    """(empty, message): the message stands for a list without notes."""
    message = "No notes found" if query else "No notes yet"
    return shown.agg((F.count("*") == 0).alias("empty")).select("empty", F.when(F.col("empty"), message).alias("message"))


def status_text(status: Column) -> Column:
    """What a save status shows; null for an unknown one."""
    shown = F.create_map(*(F.lit(x) for pair in STATUS_TEXT.items() for x in pair))
    return F.element_at(shown, status)


def shown_people(names: Column, n: int = SHOWN_PEOPLE) -> tuple[Column, Column]:
    """The initials of the first ``n`` names, and how many are left over (null if none)."""
    initials = F.transform(F.slice(names, 1, n), text.initial)
    over = F.size(names) - n
    return initials, F.when(over > 0, over.cast("bigint"))


def percent_left(value: Column) -> Column:
    return 100 - F.coalesce(value, F.lit(0))

"""Changes to collections: each gives the collection as it is afterwards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.functions import text
from quillspark.operators.views import first_by_position

#: What a patch may set: any field but updated_at. A new id comes as ``new_id``, as ``id`` says which note is meant.
PATCHED = ["id", "title", "markdown_content", "folder_id", "tags", "created_at", "owner_id"]


def new_note(at: DataFrame, note_id: str, now: Column, given: Mapping[str, object] | None = None) -> DataFrame:
    """One note at the position in ``at`` (position, one row). Null fields take their defaults; empty ones stay."""
    given = given or {}

    def field(name: str, default: Column) -> Column:
        value = given.get(name)
        return default if value is None else F.lit(value)

    return at.select(
        F.lit(note_id).alias("id"), field("title", F.lit(schema.DEFAULT_TITLE)).alias("title"),
        field("markdown_content", F.lit(schema.DEFAULT_BODY)).alias("markdown_content"), field("folder_id", F.lit(None)).cast("string").alias("folder_id"),
        field("tags", F.array()).cast("array<string>").alias("tags"), now.alias("created_at"), now.alias("updated_at"),
        field("owner_id", F.lit(schema.DEFAULT_OWNER)).alias("owner_id"), "position",
    )


def with_previews(notes: DataFrame) -> DataFrame:
    """``notes`` with their previews as a column, which creates and patches keep from then on, so that lists read no bodies."""
    return notes.withColumn("preview", text.preview(F.col("markdown_content")))


def create_note(notes: DataFrame, note_id: str, now: Column, given: Mapping[str, object] | None = None) -> DataFrame:
    """The new note comes before all others."""
    front = notes.agg((F.coalesce(F.min("position"), F.lit(0)) - 1).cast("bigint").alias("position"))
    return _joined(notes, new_note(front, note_id, now, given))


def _joined(notes: DataFrame, new: DataFrame) -> DataFrame:
    return notes.unionByName(with_previews(new) if "preview" in notes.columns else new)


def update_notes(notes: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """``patches``: id, set_mask (the names of the fields it sets, to null perhaps), those fields
    (a new id as ``new_id``), and seq where an id has several: then a field is that of the last
    that sets it. Positions stay; updated_at is ``now``; patches of unknown ids do nothing. Previews
    that are kept (``with_previews``) are made anew for patched bodies only."""
    given = {c: "new_id" if c == "id" else c for c in PATCHED}
    fields = [c for c, name in given.items() if name in patches.columns]
    seq = F.col("seq") if "seq" in patches.columns else F.lit(0)
    last = [F.max(F.when(F.array_contains("set_mask", c), F.struct(seq.alias("seq"), F.col(given[c]).alias("value")))).alias(f"set_{c}") for c in fields]
    p = patches.groupBy(F.col("id").alias("patch_id")).agg(F.count("*").alias("n_patches"), *last)
    joined = notes.join(p, notes.id == p.patch_id, "left")
    changed = {c: F.when(F.col(f"set_{c}").isNotNull(), F.col(f"set_{c}")["value"]).otherwise(F.col(c)) for c in fields}
    if "preview" in notes.columns and "markdown_content" in fields:
        changed["preview"] = F.when(F.col("set_markdown_content").isNotNull(), text.preview(F.col("set_markdown_content")["value"])).otherwise(F.col("preview"))
    changed["updated_at"] = F.when(F.col("patch_id").isNotNull(), now).otherwise(F.col("updated_at"))
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in notes.columns))


def delete_notes(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Without all rows whose id is in ``ids`` (id)."""
    return notes.join(ids.select("id"), "id", "left_anti").select(*notes.columns)


def deleted_any(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """(removed): whether a row goes."""
    return notes.join(ids.select("id"), "id", "left_semi").agg((F.count("*") > 0).alias("removed"))


def reselect(left: DataFrame, current: str, deleted: str, new_id: str, now: Column) -> DataFrame:
    """The current note after ``deleted`` went: still ``current``, or the first left, or else a new one."""
    if current != deleted:
        return first_by_position(left.filter(F.col("id") == current))
    none_left = left.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(0).cast("bigint").alias("position"))
    return _joined(first_by_position(left), new_note(none_left, new_id, now))


def _at_end(rows: DataFrame) -> DataFrame:
    return rows.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).cast("bigint").alias("position"))


def create_folder(folders: DataFrame, folder_id: str, name: str, now: Column, parent_id: str | None = None) -> DataFrame:
    new = _at_end(folders).select(
        F.lit(folder_id).alias("id"), F.lit(name).alias("name"), F.lit(parent_id).cast("string").alias("parent_id"),
        F.lit(schema.DEFAULT_OWNER).alias("owner_id"), now.alias("created_at"), now.alias("updated_at"), "position",
    )
    return folders.unionByName(new)


def create_tag(tags: DataFrame, tag_id: str, name: str, color: str = schema.DEFAULT_TAG_COLOR) -> DataFrame:
    new = _at_end(tags).select(F.lit(tag_id).alias("id"), F.lit(name).alias("name"), F.lit(color).alias("color"), F.lit(schema.DEFAULT_OWNER).alias("owner_id"), "position")
    return tags.unionByName(new)

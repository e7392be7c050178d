"""Collections stored as JSON text under a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.schema import STORED_NOTE

TO_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSX", "ignoreNullFields": "false"}


def decode(value: Column, item: T.StructType) -> Column:
    """The items of a stored collection; empty for a missing, empty, ``null`` or broken text."""
    kind = T.ArrayType(item)
    return F.coalesce(F.from_json(F.nullif(value, F.lit("")), kind), F.array().cast(kind))


def broken(value: Column, item: T.StructType) -> Column:
    """Whether a text is there but can't be decoded: such rows must be set aside before a write."""
    there = F.coalesce(value, F.lit("")) != ""
    return there & (F.trim(value) != "null") & F.from_json(value, T.ArrayType(item)).isNull()


def encode(items: Column) -> Column:
    return F.to_json(items, TO_JSON)


def decode_notes(stored: DataFrame) -> DataFrame:
    """(key, value) to one row for each note, with its place in the list as position."""
    return as_notes(stored.select("key", F.posexplode(decode(F.col("value"), STORED_NOTE)).alias("position", "n")))


def as_notes(rows: DataFrame) -> DataFrame:
    """Rows (n, position, ..) with a stored note each as rows of notes."""
    others = [c for c in rows.columns if c not in ("n", "position")]
    return rows.select(
        *others, F.col("n.id").alias("id"), F.col("n.title").alias("title"), F.col("n.markdownContent").alias("markdown_content"),
        F.col("n.folderId").alias("folder_id"), F.col("n.tags").alias("tags"), F.col("n.createdAt").alias("created_at"),
        F.col("n.updatedAt").alias("updated_at"), F.col("n.ownerId").alias("owner_id"), F.col("position").cast("bigint").alias("position"),
    )


#: Under these names JSON texts are dates, at whatever depth (fixed names).
DATES = ["createdAt", "updatedAt"]


def nested_dates(stored: DataFrame) -> DataFrame:
    """(key, path, at) of every date in ``stored`` (key, value): what stands under one of ``DATES`` in the JSON text, at whatever depth and under
    whatever names and places, null where it is no date. Texts that can't be parsed have none.

    Texts are parsed once to variants, and these are exploded a level at a time while any has a level left.
    """
    level = stored.select("key", F.lit("$").alias("path"), F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    found = None
    while found is None or not level.isEmpty():
        inner = level.select("key", "path", "v").alias("l").lateralJoin(stored.sparkSession.tvf.variant_explode(F.col("l.v").outer()).toDF("pos", "name", "value"))
        place = F.coalesce(F.concat(F.lit("."), "name"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        inner = inner.select("key", F.concat("path", place).alias("path"), "name", "value")
        is_date = F.coalesce(F.col("name").isin(DATES), F.lit(False))
        dates = inner.filter(is_date).select("key", "path", F.try_variant_get("value", "$", "string").try_cast("timestamp").alias("at"))
        found = dates if found is None else found.unionByName(dates)
        level = inner.filter(~is_date & F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")).select("key", "path", F.col("value").alias("v"))
    return found


def stored_note() -> Column:
    """A row of notes as the struct that is stored."""
    return F.struct(
        "id", "title", F.col("markdown_content").alias("markdownContent"), F.col("folder_id").alias("folderId"), "tags",
        F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"), F.col("owner_id").alias("ownerId"),
    )


def encode_each(notes: DataFrame) -> DataFrame:
    """(key, value): each note as a collection of one under its own id, so no collection is gathered whole."""
    return notes.select(F.col("id").alias("key"), encode(F.array(stored_note())).alias("value"))

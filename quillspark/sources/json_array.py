"""A collection stored as one JSON array, of any size, read by as many tasks as its bytes need."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.codec import TO_JSON
from quillspark.sources.files import put_in_place


@dataclass(frozen=True)
class Items:
    """``good`` (file, position, item) and ``broken`` (file, position, text), which a write must not lose."""

    good: DataFrame
    broken: DataFrame


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _before(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """``pieces`` with the sum of ``value`` over all pieces of the file before each: within its split, and over the splits before."""
    earlier = [Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for keys, order in ((["file", "split"], "at"), (["file"], "split"))]
    valued = pieces.withColumn("_value", value.cast("bigint"))
    sums = valued.groupBy("file", "split").agg(F.sum("_value").alias("_sum"))
    heads = sums.select("file", "split", F.coalesce(F.sum("_sum").over(earlier[1]), F.lit(0)).alias("_head"))
    return valued.join(heads, ["file", "split"]).withColumn(name, F.col("_head") + F.coalesce(F.sum("_value").over(earlier[0]), F.lit(0))).drop("_value", "_head")


def read_array(spark: SparkSession, path: str, item: T.StructType) -> Items:
    """The objects of the JSON arrays in the files at ``path``, with their place in the array.

    The files are cut at every closing brace, by byte ranges and without regard to what the brace closes. Whether a
    cut lies within a string follows from the quotes before it, how deep it lies from the braces outside strings, and which
    item it belongs to from the cuts at depth 0; each is a running sum, first over the splits of a file and then
    within each. So no task reads more than a split, and what is gathered is one item.

    An item that can't be parsed is broken by itself and costs no other; so is what stands between items, or an end that is cut off.
    Commas at the end, files without brackets and empty files are fine. Wrong types give null fields, as in ``codec.decode``.
    """
    meta = F.col("_metadata")
    cuts = spark.read.option("lineSep", "}").text(path).select(
        "value", meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("at")
    )
    # every piece but perhaps the last of a file stood before a brace
    placed = _before(cuts, F.octet_length("value") + 1, "byte").withColumn("braced", F.col("byte") + F.octet_length("value") < F.col("size"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quoted = _before(placed.withColumn("plain", plain), _count(plain, '"'), "quotes")
    rest = F.when(F.col("quotes") % 2 == 1, F.regexp_replace("plain", r'(?s)^[^"]*("|$)', "")).otherwise(F.col("plain"))
    outside = F.regexp_replace(rest, r'(?s)"[^"]*("|$)', "")
    closes = F.col("braced") & ((F.col("quotes") + _count(F.col("plain"), '"')) % 2 == 0)
    known = quoted.select("file", "split", "at", "value", "braced", _count(outside, "{").alias("opens"), closes.alias("closes"))
    deep = _before(known, F.col("opens") - F.col("closes").cast("int"), "depth")
    ended = deep.withColumn("ends", F.col("closes") & (F.col("depth") + F.col("opens") - 1 <= 0))
    numbered = _before(ended, F.col("ends"), "position")
    text = F.concat("value", F.when(F.col("braced"), F.lit("}")).otherwise(F.lit("")))
    gathered = numbered.groupBy("file", "position").agg(F.sort_array(F.collect_list(F.struct("split", "at", text.alias("text")))).alias("parts"))
    whole = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), ""), r"^\s*[\[,]?\s*", "")
    items = gathered.select("file", "position", whole.alias("text")).filter(~F.col("text").rlike(r"^\s*\]?\s*$"))
    parses = F.get_json_object("text", "$").isNotNull() & F.col("text").startswith("{")
    good = items.filter(parses).select("file", "position", F.from_json("text", item).alias("item"))
    return Items(good, items.filter(~F.coalesce(parses, F.lit(False))))


def write_items(items: DataFrame, path: str) -> None:
    """``items`` (one struct column) as files of JSON objects with commas between them, which ``read_array`` reads again."""
    (column,) = items.columns
    items.select(F.to_json(column, TO_JSON).alias("value")).write.option("lineSep", ",\n").text(path)


def rewrite(spark: SparkSession, path: str, item: T.StructType, change: Callable[[DataFrame], DataFrame], aside: str) -> None:
    """Replace the collection at ``path`` by ``change(items)``, from and to one struct column ``item``. Broken items are added to ``aside``
    (file, position, text) first, as the write would lose them. A failed write leaves the collection as it was."""
    items = read_array(spark, path, item)
    items.broken.write.mode("append").parquet(aside)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    write_items(change(items.good.select("item")), staged)
    put_in_place(spark, staged, path)

"""Writing a collection that may be the one that was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources import codec


def write_collection(df: DataFrame, path: str) -> None:
    """Overwrite ``path``: written beside it first and then swapped, through Spark's own file
    systems. A failed write or swap leaves the old rows in place and is raised."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    put_in_place(df.sparkSession, staged, path)


def put_in_place(spark: SparkSession, staged: str, path: str) -> None:
    """What was written to ``staged`` takes the place of ``path``, which is missing between two renames; ``NoteFiles`` publishes by one."""
    old, jvm = f"{path}.old-{uuid.uuid4().hex}", spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        fs.delete(at(staged), True)
        raise OSError(f"could not move {path} aside")
    if not fs.rename(at(staged), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"could not put {staged} in place")
    fs.delete(at(old), True)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def set_aside(stored: DataFrame, item: T.StructType, path: str) -> DataFrame:
    """``stored`` (key, value) without the collections that can't be decoded; those are added to
    ``path`` first, as a write that follows would lose them."""
    broken = codec.broken(F.col("value"), item)
    stored.filter(broken).write.mode("append").parquet(path)
    return stored.filter(~broken)


def write_slot(spark: SparkSession, path: str, value: str | None) -> None:
    """Overwrite a one-row table; null or the empty string clears it."""
    write_collection(spark.range(1).select(F.lit(value).cast("string").alias("id")).filter(F.coalesce("id", F.lit("")) != "").coalesce(1), path)


def read_slot(spark: SparkSession, path: str) -> DataFrame:
    """(id): one row, or none where the slot is clear."""
    return spark.read.schema("id string").parquet(path)

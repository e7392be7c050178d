"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_cleared: set[str] = set()


def _path(spark: SparkSession, path: str) -> tuple:
    """A path as Spark's file systems have it, with its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the checkpoint folder. It's removed when the application ends, as nothing else can read what is there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(shared)
    folder = sc.getCheckpointDir()
    if folder not in _cleared:
        fs, at = _path(spark, folder)
        fs.deleteOnExit(at)
        _cleared.add(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, and where, so that it can be removed after its last reader."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no DataFrame refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_name(prefix: str) -> str:
    """A table name that no other run uses."""
    return f"{prefix}_{uuid.uuid4().hex}"


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, converted a slice at a time so that long texts don't add up."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            yield from zip(*(column.to_pylist() for column in piece.columns), strict=True)


def batched(rows: Iterable[tuple], schema: pa.Schema, weight, rows_max: int = 4096, weight_max: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows_max`` rows and about ``weight_max`` bytes; ``weight(row)`` gives a row's bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= rows_max or size >= weight_max:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

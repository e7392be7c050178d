"""Numbering rows in a global order without bringing them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import written

_ROW_BITS = 33  # monotonically_increasing_id has the partition above these


def numbered(df: DataFrame, *order: str, at: str = "at") -> DataFrame:
    """``df`` with ``at``: each row's place, from 0, by the columns ``order`` ascending (nulls first).

    The rows are dealt to ranges, sorted there and written to the shared folder with their places
    within the range; only the ranges' sizes, one for each partition, reach the driver. ``df`` is
    read twice, so it should be a written table. Rows that agree in all of ``order`` share
    a range and get neighbouring places.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows, _ = written(ranges.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1).alias("_range_row")))
    starts, n = [], 0
    for r in rows.groupBy("_range").count().orderBy("_range").collect():
        starts.append((r["_range"], n))
        n += r["count"]
    known = spark.createDataFrame(starts, "_range int, _range_start bigint")
    return rows.join(F.broadcast(known), "_range").withColumn(at, F.col("_range_start") + F.col("_range_row")).drop("_range", "_range_row", "_range_start")

"""Connected components as DataFrame rounds; no links or labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import remove, written
from quillspark.llm.columns import joined_apart


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to rows (node, label): the smallest node that each linked node reaches.

    Rounds of two star steps: each node hands its larger neighbours to the smallest node of its neighbourhood, then
    itself and its smaller neighbours to the smallest of these. Long chains shrink by a share each round, until all links
    lead to the smallest node. Rounds are written to the shared checkpoint folder, as Parquet: checkpointed DataFrames keep the
    sizes that were estimated for them, and joins multiply these, so after some rounds planning never ends. A node with very many links can be split among tasks.
    Loops and repeated links are fine; no links give no rows.
    """
    # of each link ``a`` is the larger node
    edges, path = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large, large_path = written(joined_apart(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = joined_apart(large, least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, new_path = written(handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        for old in (path, large_path):
            remove(links.sparkSession, old)
        path = new_path
        ends = edges.groupBy("a").agg(F.count("*").alias("n"))
        roots = edges.select("b").distinct()
        if ends.filter("n > 1").isEmpty() and roots.join(ends, roots.b == ends.a, "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("label")))

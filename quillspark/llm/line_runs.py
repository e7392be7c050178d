"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.cluster import cut, fresh_name
from quillspark.llm.columns import ascii_lower, strip_white, text_key

KEY = ["h0", "h1"]
UNION_SHORTCUT = "spark.sql.unionOutputPartitioning"


class LevelledRuns:
    """Sorted runs (h0, h1, n, owner), each a bucketed table, in levels.

    A batch merge-anti-joins the runs: the keys that no run has become a run of level 0, and
    the counts of the keys that some run has are noted apart. Runs are bucketed and sorted
    by key, so these joins move no run. Once a level has ``fanout`` runs they are compacted
    into one of the next level; keys of different runs are distinct.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.noted: list[str] = []
        self.staged: str | None = None

    def _save(self, df: DataFrame, kind: str) -> str:
        name = fresh_name(f"line_{kind}")
        df.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")

    def add(self, batch: DataFrame) -> None:
        """``batch`` (h0, h1, n, owner): each key once."""
        staged = self.staged = self._save(batch.select(*KEY, "n", "owner"), "staged")
        runs = [self.spark.table(name).select(*KEY) for level in self.levels for name in level]
        fresh = self.spark.table(staged)
        for run in runs:
            fresh = fresh.join(run, KEY, "left_anti")
        self.levels[0].append(self._save(fresh, "run"))
        if runs:
            seen = None
            for run in runs:
                part = self.spark.table(staged).join(run, KEY, "left_semi")
                seen = part if seen is None else seen.unionByName(part)
            self.noted.append(self._save(seen, "noted"))
        self._drop([staged])
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            if k + 1 == len(self.levels):
                self.levels.append([])
            merged = self.spark.table(level[0])
            for name in level[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.levels[k + 1].append(self._save(merged, "run"))
            self._drop(level)
            self.levels[k] = []

    def totals(self) -> DataFrame:
        """(h0, h1, n, owner): counts over all batches, and the largest owner."""
        tables = [self.spark.table(name) for name in [*self.noted, *(name for level in self.levels for name in level)]]
        every = tables[0]
        for table in tables[1:]:
            every = every.unionByName(table)
        return every.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def close(self) -> None:
        """Drop all tables, those of a batch that failed too."""
        self._drop([*([self.staged] if self.staged else []), *self.noted, *(name for level in self.levels for name in level)])


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(strip_white(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(line: Column) -> Column:
    first, second = text_key(line_key(line))
    return F.struct(first.alias("h0"), second.alias("h1"))


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h0, h1, owner) of the keys to thin out: found in ``min_docs`` rows; owner is the largest doc_id."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("at")).first()["at"] if batches > 1 else None
    edges = sorted(set(cuts or []), reverse=True)
    doc = F.col("doc_id")
    ranges = []
    for k in range(len(edges) + 1):
        above = doc > edges[k] if k < len(edges) else F.lit(True)
        below = doc <= edges[k - 1] if k else F.lit(True)
        ranges.append(above & below if k < len(edges) else F.coalesce(below, F.lit(True)))
    # Spark 4.1 gives wrong rows where a union of bucketed tables keeps their partitioning
    # but reads them unbucketed, so that shortcut is off while runs are joined.
    before = spark.conf.get(UNION_SHORTCUT, None)
    spark.conf.set(UNION_SHORTCUT, "false")
    runs = LevelledRuns(spark, fanout)
    try:
        return _collect_runs(docs, ranges, runs, min_chars, min_docs)
    finally:
        runs.close()
        spark.conf.unset(UNION_SHORTCUT) if before is None else spark.conf.set(UNION_SHORTCUT, before)


def _collect_runs(docs: DataFrame, ranges: list[Column], runs: LevelledRuns, min_chars: int, min_docs: int) -> DataFrame:
    for among in ranges:  # from the largest ids down: the first to bring a key owns it
        long_lines = F.filter(_lines(F.col("text")), lambda x: F.length(strip_white(x)) >= min_chars)
        keys = docs.filter(among).select("doc_id", F.explode(F.array_distinct(F.transform(long_lines, _hashed))).alias("k"))
        runs.add(keys.groupBy(F.col("k.h0").alias("h0"), F.col("k.h1").alias("h1")).agg(F.count("*").alias("n"), F.max("doc_id").alias("owner")))
    return cut(runs.totals().filter(F.col("n") >= min_docs).select(*KEY, "owner"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Every row of ``docs`` with all its columns in ``row``, and (doc_id, n_lines, n_dropped, kept).

    Lines whose key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents go, except those of the largest doc_id that holds the key. Each
    row counts as one document, so rows that repeat a doc_id count one each and, at the
    largest doc_id, all keep their lines. A null or empty text is one empty line. A row
    without doc_id counts but never loses lines. Lines kept are joined by a newline. Texts of
    any length are split whole; no rows give no rows.
    """
    own = docs.select("doc_id", "text")
    found = repeated_keys(own, min_chars, min_docs, batches, fanout)
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    each = (
        own.select("doc_id", tag.alias("tag"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
        .filter(F.length(strip_white(F.col("line"))) >= min_chars)
        .select("doc_id", "tag", "at", _hashed(F.col("line")).alias("k"))
        .select("doc_id", "tag", "at", "k.h0", "k.h1")
    )
    gone = each.join(found, KEY).filter("doc_id <> owner").groupBy("doc_id", "tag").agg(F.collect_set("at").alias("gone"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), tag.alias("tag"))
    joined = whole.join(gone, ["doc_id", "tag"], "left")
    lines = _lines(F.col("row.text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(
        F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")
    )
    return joined.select("row", "doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))

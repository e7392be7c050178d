"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the
last return the columns of ``documents``, and other columns of ``docs`` as they are, whatever
their names. Null doc_ids and texts, empty and very long texts and repeated rows pass through as
each stage says; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import compression, line_runs, near_sets, packing, tiling
from quillspark.llm.cluster import remove, written
from quillspark.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at least one half. Null and empty texts
    score by the constant term alone; without labels of both classes all documents stay or all go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return compression.keep_good(docs, compression.train_on(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without their repeated lines, n_chars counted anew; a text that loses nothing stays as it is, a null one too.
    No row goes; rows that repeat a doc_id count one each."""
    thinned = line_runs.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row")["text"])
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return thinned.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard 0.8 or more) the document with the smallest doc_id: SimHash by multi-index hashing brings
    up candidates, which whole sets confirm, and an exact search joins what lies too far apart for it. See the module for ties and nulls."""
    return near_sets.one_of_each_group(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item to 0.8 or more of its words; null and empty texts hold none. Repeated rows go or stay together."""
    return tiling.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids; a null or empty text is its end id alone, each repeated row is packed."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_copies),
    ("packing", pack),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is written to the shared checkpoint folder
    before the next, and removed once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

"""Each stage of the pipeline against what it should keep, on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import compression, simhash
from tests.llm.test_near_sets import _kept as kept_of_near_copies

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert all(s.count() > 0 for s in stages)


def test_near_copies_go(stages):
    """Five words and a similarity of 0.8 are what the stage is asked for, so no fingerprints are compared here."""
    before = [tuple(r) for r in stages[2].select("doc_id", "text").collect()]
    assert {r.doc_id for r in stages[3].collect()} == kept_of_near_copies(before)


def test_quality_goes_by_score(spark, stages):
    model = compression.train_on(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = compression.Scorer(model)
    expected = {r.doc_id for r in stages[0].collect() if scorer.score((r.text or "").encode()) >= 0.5}
    assert {r.doc_id for r in stages[1].collect()} == expected


def test_lines_go(stages):
    for r in stages[2].select("text", "n_chars").collect():
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in stages[2].collect()}


def test_benchmark_goes(spark, stages):
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [i for i in items if len(i.split()) >= 5]
    for r in stages[4].collect():
        text = " ".join(r.text.lower().split())
        assert not any(f" {i} " in f" {text} " for i in items)
    assert stages[4].count() >= 0.8 * stages[3].count()


def test_packing_keeps_all(stages):
    ends = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(ends) == stages[4].count() and all(r.n == r["all"] for r in ends)


@pytest.fixture(scope="module")
def odd_tables(spark, stages, tmp_path_factory):
    """Some given documents with odd rows and clashing columns, and none at all, each beside the given tables."""
    folder = tmp_path_factory.mktemp("odd")
    docs = stages[0].limit(20)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "a null id", "en", "s", 9), (900, "", "en", "s", 0), (900, "", "en", "s", 0), (901, None, "en", "s", None), (902, "word " * 40_000, "en", "s", 200_000), (903, "yes", None, None, 3)],
        docs.schema,
    )
    more = docs.unionByName(odd).select("*", *(F.lit(1).alias(c) for c in ("row", "fp", "t0", "t1", "label", "score", "kept", "k0", "g", "item_id", "tag")))
    for name, rows in (("odd", more), ("empty", more.limit(0))):
        rows.write.parquet(str(folder / name / "documents.parquet"))
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(folder / name / f"{table}.parquet"))
    return folder


def test_odd_rows_and_columns(spark, odd_tables):
    sf_dir = str(odd_tables / "odd")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, wide = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == columns, name
        assert kept.filter("row <> 1 OR score <> 1").count() == 0
        assert set(kept.select("doc_id").distinct().collect()) <= set(wide.select("doc_id").distinct().collect())
    once = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert once.filter("doc_id IN (900, 901) OR (doc_id IS NULL AND text IS NULL)").count() == 1  # null and empty texts are copies of each other
    assert once.filter("text = 'a null id'").count() == 1 and once.filter("doc_id = 902").count() == 1
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).filter("n % doc_tokens <> 0").count() == 0


def test_empty_table(spark, odd_tables):
    assert corpus_pipeline.run(spark, str(odd_tables / "empty")).count() == 0


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).drop("ids").count() == stages[5].count()
    assert simhash.MAX_DISTANCE == 2

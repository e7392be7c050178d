"""Drawing documents that look like a target, by importance weights of hashed word features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import remove, written
from quillspark.llm.columns import ascii_lower
from quillspark.llm.ranks import numbered

BUCKETS = 10_000
#: What stands between words: ASCII that is neither a digit nor a lower-case letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def buckets_of(text: Column) -> Column:
    """The bucket of each run of one or two consecutive words of a text, repeats included; none for null."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")

    def bucket(feature: Column) -> Column:
        return F.pmod(F.crc32(feature.cast("binary")), F.lit(BUCKETS)).cast("smallint")

    def after(words: Column) -> Column:
        # a pair is a word and the next; the last has none
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
        return F.concat(F.transform(words, bucket), pairs)

    # named once, or the words would be split for each use
    return F.element_at(F.transform(F.array(words), after), 1)


def counts_of(texts: DataFrame) -> DataFrame:
    """``texts`` (buckets) to (bucket, n). Tasks count first, so at most ``BUCKETS`` rows of each are shuffled."""
    return texts.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains_of(corpus: DataFrame, target: DataFrame) -> Column:
    """The gain of each bucket as a literal array, from the two counts (bucket, n). What reaches the driver are ``BUCKETS`` numbers at most each."""
    every = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    known = {r.bucket: (r.s, r.t) for r in every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    spark = corpus.sparkSession
    both = [known.get(k, (0, 0)) for k in range(BUCKETS)]
    s_all, t_all = (float(sum(x[k] for x in both)) for k in (0, 1))
    counts = spark.createDataFrame([(k, float(s), float(t)) for k, (s, t) in enumerate(both)], "bucket int, s double, t double")
    ratio = (F.col("t") + 1) * (s_all + BUCKETS) / ((F.col("s") + 1) * (t_all + BUCKETS))
    gains = [str(r.gain) for r in counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]
    return F.split(F.lit(",".join(gains)), ",").cast("array<bigint>")  # folded to one literal


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, fixed by the seed and the doc_id; a null doc_id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_features, weight, score, rank): of those with ``least_words`` words or more,
    ``percent`` in a hundred are drawn, those of the highest scores, and ranked from 1; the others' rank is null.

    A weight is the floored mean of the gains of a text's features, a gain the log ratio of a
    bucket's smoothed shares of ``target`` (text) and of ``docs``. Ties go to the smaller doc_id, null first, then to fewer features.
    A null or empty text has no features and weight 0, and isn't drawn while ``least_words`` is above 0. Rows that repeat count and are ranked one by one;
    other columns are ignored; an empty target leaves only the corpus's own shares; no rows give no rows.

    Bucket arrays are made once, without exploding for scores, and written to the shared folder: two bytes for a feature.
    Counting shuffles totals only; scoring looks up each bucket in a literal array; ranks come from sorted ranges.
    """
    spark = docs.sparkSession
    features = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), buckets_of(F.col("text")).alias("buckets"))
    held, held_path = written(features)
    gains = gains_of(counts_of(held), counts_of(target.select(buckets_of(F.col("text")).alias("buckets"))))
    n = F.size("buckets").cast("bigint")
    total = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda a, b: a + F.element_at(gains, b + 1))
    # n words have n - 1 pairs
    known = held.select("doc_id", n.alias("n_features"), total.alias("total")).withColumn("_drawn", F.col("n_features") >= (2 * least_words - 1 if least_words else 0))
    weighed = known.withColumn("weight", F.when(F.col("n_features") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")))
    scored, _ = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), "_drawn", (-F.col("weight") - noise(F.col("doc_id"), seed)).alias("_first")))
    remove(spark, held_path)
    eligible = scored.filter("_drawn")
    drawn = percent * eligible.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(eligible.drop("_drawn"), "_first", "doc_id", "n_features").select(*columns, F.when(F.col("at") < drawn, F.col("at") + 1).alias("rank"))
    return ranked.unionByName(scored.filter("NOT _drawn").select(*columns, F.lit(None).cast("bigint").alias("rank")))

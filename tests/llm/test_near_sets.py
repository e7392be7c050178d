"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from quillspark.llm import near_sets

SF = "/root/testdata/sf0.01"


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(rows):
    """Of each group the row with the least doc_id; all doc_ids differ."""
    sets = [(d, _shingles(t)) for d, t in sorted(rows, key=lambda r: r[0])]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            small, large = sorted((len(s), len(t)))
            if 5 * small >= 4 * large and 5 * len(s & t) >= 4 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in root if find(d) == d}


def _edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, out = say(40), [None, "", " \t", "one", "ONE ", "one two", "a b c d e", "a b c d E", "\u00e9 \u00c9", "x " * 300, "x " * 200]
    for size in (6, 9, 14, 30, 60, 300):
        base = say(size)
        out += [_edited(r, base, e % 4) for e in range(8)] + [" ".join(base[k:]) for k in range(3)]
    for base in (say(150), say(150)):
        out += [_edited(r, base, r.randrange(5)) for _ in range(60)]
    out += [" ".join(say(r.randrange(1, 60)) + passage + say(r.randrange(1, 20))) for _ in range(80)]
    # exactly 0.8: 16 of 20 shingles in all, and one less
    line = say(40)
    out += [" ".join(line[:22]), " ".join(line[2:24]), " ".join(line[:21]), " ".join(line[3:24])]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(
    ("lists", "sets", "grams"), [(near_sets.LISTS, near_sets.BLOCK_SETS, near_sets.BLOCK_GRAMS), (0, near_sets.BLOCK_SETS, near_sets.BLOCK_GRAMS), (0, 7, 1000), (3, 7, 1000)]
)
def test_stage_by_brute_force(spark, rows, lists, sets, grams):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [d.doc_id for d in near_sets.one_of_each_group(docs, lists=lists, block_sets=sets, block_grams=grams).collect()]
    assert len(found) == len(set(found)) and set(found) == _kept(rows)


@pytest.mark.parametrize("bucket", [near_sets.BUCKET, 1])
def test_simhash_brings_up_near_copies(spark, bucket):
    """Every link is of near sets; nearly all copies with an edit or two are found, whatever the exact search would add."""
    r = random.Random(5)
    bases = [[f"w{r.randrange(5000)}" for _ in range(200)] for _ in range(40)]
    texts = [_edited(r, base, e) for base in bases for e in (0, 1, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {near_sets._name(near_sets.shingles(t.encode())): k for k, t in enumerate(texts)}
    sets = near_sets._sets(docs.select("text"), near_sets.WIDTH)
    links = [(names[x.a], names[x.b]) for x in near_sets.simhash_links(sets, bucket).collect()]
    for a, b in links:
        s, t = _shingles(texts[a]), _shingles(texts[b])
        assert 5 * len(s & t) >= 4 * len(s | t)
    joined = {k for link in links for k in link}
    assert len(joined) >= (0.9 if bucket > 1 else 0.5) * len(texts)


def test_chain_of_texts(spark):
    """Each text shares most of its phrases with the next, but not enough to be near; then enough."""
    for step, kept in ((10, 150), (4, 1)):
        words = [f"w{k}" for k in range(60 + step * 150)]
        docs = spark.createDataFrame([(k, " ".join(words[step * k : step * k + 60])) for k in range(150)], "doc_id long, text string")
        assert near_sets.one_of_each_group(docs).count() == kept


def test_stage_on_given_documents(spark):
    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == _kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows_of_stage(spark):
    rows = [(1, "same text of a row"), (1, "same text of a row"), (1, "another text"), (None, "same text of a row"), (None, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, near_sets.one_of_each_group(docs).collect()), key=repr)
    assert found == [(1, "another text"), (1, "same text of a row"), (2, None)]
    assert near_sets.one_of_each_group(docs.limit(0)).count() == 0

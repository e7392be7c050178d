"""Operators 11 to 13 against the library and plain versions, with nulls, ties, repeated rows, long texts, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import importance, merkle, pieces, queries, ranks

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11 -----------------------------------------------------------------------------------------

ODD = ["", " ", "  a  b ", "\n", "a\x00b", "ＡＢ①", "é", "▁x", "▁▁▁ ▁", "a b\t c", "　x", "<s>", "</s>", "<0x0A>", "<unk>", "a" * 70, " " * 50, "x" * 3000, "ab " * 100, "😀́क्षि", "don't. won't, e.g. (it)", "1234567", "\r\n\x0b\x7f"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(queries.PIECES)


@pytest.fixture(scope="module")
def coders(vocabulary):
    return pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)


def _encoded(encoder, texts):
    ids, counts = encoder.encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts))[:-1]]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdehinrst   ▁.,'\n019éß中—"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=6))
def test_pieces_are_the_librarys(library, coders, texts):
    encoder, decoder = coders
    got = _encoded(encoder, texts)
    assert got == library.encode(texts)
    flat = np.array([i for ids in got for i in ids], np.int32)
    assert [t.decode() for t in decoder.decode(flat, np.cumsum([len(ids) for ids in got]))] == library.decode(got)


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262), st.sampled_from([0, 1, 2, 259, 28705])), max_size=14))
def test_decoding_of_any_ids(library, coders, ids):
    assert coders[1].decode(np.array(ids, np.int32), np.array([len(ids)]))[0].decode() == library.decode(ids)


def test_runs_whose_merges_make_earlier_pairs(library, coders):
    """Few letters give many pairs that overlap and merges whose results come before those that are left."""
    r = random.Random(3)
    texts = ["".join(r.choice(abc) for _ in range(r.randrange(1, 120))) for abc in ("ab", "aeit", "st e", " a", "no▁ ", "=-*", "0a") for _ in range(150)]
    assert _encoded(coders[0], texts) == library.encode(texts)


def test_long_words_by_queue(library, coders):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), " " * 20_000, "a" * 20_000, "the" * 9000 + "\x00"]
    assert _encoded(coders[0], texts) == library.encode(texts)


def test_texts_in_parts(library, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "PART", 5)
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    r = random.Random(5)
    texts = ["".join(r.choice("abc thé   ▁\n.") for _ in range(r.randrange(60))) for _ in range(200)] + ["x" * 40, "", " " * 30]
    got = _encoded(encoder, texts)
    assert got == library.encode(texts)
    flat = np.array([i for ids in got for i in ids], np.int32)
    assert [t.decode() for t in decoder.decode(flat, np.cumsum([len(ids) for ids in got]))] == library.decode(got)


def test_words_are_forgotten(library, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    encoder = pieces.Encoder(vocabulary)
    for texts in (["a b c d e"], ["d e f"], ["a b", ""], [""]):
        assert _encoded(encoder, texts) == library.encode(texts)


def test_pieces_of_documents(spark, library):
    texts = [None, *ODD, "word " * 20_000]
    rows = [*enumerate(texts), (None, "no id"), (1, "repeated"), (1, "repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("ids"), F.lit("x").alias("pieces")).repartition(3)
    encoded = pieces.encode_texts(docs, queries.PIECES)
    expected = [(d, library.encode(t or "")) for d, t in rows]
    assert _rows(encoded) == sorted(expected, key=repr)
    assert _rows(pieces.decode_ids(encoded, queries.PIECES)) == sorted(((d, i, library.decode(i)) for d, i in expected), key=repr)
    assert pieces.decode_ids(pieces.encode_texts(docs.limit(0), queries.PIECES), queries.PIECES).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decode_ids(none, queries.PIECES).collect()] == ["", ""]
    for bad in ([40_000], [-1], [None]):
        with pytest.raises(Exception, match="outside the vocabulary|a null id"):
            pieces.decode_ids(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), queries.PIECES).collect()


def test_query_11(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for d, t in docs:
        ids = library.encode(t or "")
        expected.append((d, len(ids), H(",".join(map(str, ids))), H(library.decode(ids))))
    assert _rows(queries.op11_sentencepiece(spark, SF)) == sorted(expected, key=repr)


# 12 -----------------------------------------------------------------------------------------


def _leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    """(root, proofs with the place in the run, of each node)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k in range(len(nodes)):
            run = at[k] // 16 * 16
            members = level[run : run + 16]
            proofs[k].append((members[: at[k] - run], members[at[k] - run + 1 :]))
            at[k] //= 16
        level = [H(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], proofs


def _manifest(rows):
    """(doc_id, source, leaf) to sorted (doc_id, leaf, subroot, root, proof)."""
    by = {}
    for doc_id, source, leaf in rows:
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(by[s])]) for s in sources}
    root, tops = _tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (_, _, leaf, doc_id), proof in zip(sorted(by[s]), trees[s][1], strict=True):
            out.append((doc_id, leaf, trees[s][0], root, "".join("".join(a + b) for a, b in proof + top)))
    return sorted(out, key=repr)


def test_manifest(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["hot"] * 6 + ["b", "", None, "é", "z"]), f"t{k}") for k in range(700)]
    rows += [(900 + k, f"one{k}", "x") for k in range(40)] + [(None, "b", "y"), (None, None, "y"), (5, "b", "same"), (5, "b", "same"), (5, "b", None)]
    rows = [(d, s, _leaf(d, s, t)) for d, s, t in rows]
    frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string").select("*", *(F.lit(7).alias(c) for c in ("place", "n", "at", "tree", "digest", "kids", "level"))).repartition(5)
    made = merkle.manifest(frame)
    proven = made.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("steps")).alias("proof"))
    assert _rows(proven) == _manifest(rows)
    assert made.columns == [*frame.columns, "subroot", "root", "steps"]
    assert made.filter(merkle.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    assert made.filter(merkle.folded(F.sha2("leaf", 256), F.col("steps")) == F.col("root")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_small_manifests(spark, n):
    """A single source of n rows: nothing, a lone leaf, one run, a run of one, three levels."""
    rows = [(k, "s", _leaf(k)) for k in range(n)]
    made = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, leaf string"))
    assert _rows(made.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("steps")).alias("proof"))) == (_manifest(rows) if n else [])
    assert made.filter(merkle.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0


def test_leaves(spark):
    rows = [(1, "é", None, 5, "A\nb"), (None, None, None, None, None), (2, "", "", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = docs.select(merkle.leaf(*map(F.col, merkle.FIELDS)).alias("leaf")).collect()
    assert sorted(r.leaf for r in got) == sorted(_leaf(*r) for r in rows)


# 13 -----------------------------------------------------------------------------------------


def _features(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def _drawn(docs, target, percent=25, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in _features(text)[1]:
                counts[b] += 1
    gains = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000.0) / ((s[b] + 1) * (sum(t) + 10_000.0)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        n, features = _features(text)
        weight = sum(gains[b] for b in features) // len(features) if features else 0
        h = int(H(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        rows.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    eligible = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resample(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(300)] + ["Éa", "été", "中文", "A", "x_y", "3d"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 19, 20, 21, 80])))) for k in range(150)]
    docs += [(500, None), (501, ""), (502, "...!\n"), (503, "İI ẞ K"), (504, "word " * 30_000), (7, docs[7][1]), (7, docs[7][1]), (None, "a b " * 30), (None, None)]
    target = [" ".join(r.choice(words[:60]) for _ in range(40)) for _ in range(5)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", "text", *(F.lit(3).alias(c) for c in ("rank", "score", "buckets", "at", "n", "total", "weight"))).repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert _rows(importance.resample(frame, goal)) == _drawn(docs, target)
    assert _rows(importance.resample(frame, goal, percent=100, least_words=0)) == _drawn(docs, target, 100, 0)
    assert _rows(importance.resample(frame, goal.limit(0))) == _drawn(docs, [])
    assert importance.resample(frame.limit(0), goal).count() == 0


def test_numbered(spark):
    rows = [(k % 7 if k % 11 else None, k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    got = {r.b: r.at for r in ranks.numbered(df, "a", "b").collect()}
    assert [b for b, _ in sorted(got.items(), key=lambda x: x[1])] == [b for _, b in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]
    assert sorted(got.values()) == list(range(500)) and ranks.numbered(df.limit(0), "a").count() == 0


@pytest.mark.parametrize("name", ["op12_merkle", "op13_importance"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.select(*columns)) == sorted(found.fetchall(), key=repr)
    if name == "op12_merkle":
        assert 0 < df.filter("verified").count() < df.count()

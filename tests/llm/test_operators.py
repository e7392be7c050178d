"""The numbered operators against plain versions, with nulls, ties, repeated rows, long texts and empty tables."""

import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from quillspark.llm import anchors, components, compression, jpeg, line_runs, packing, personal_data, queries, simhash, suffix_array, suffix_trees, tiling, url_cascade
from tests.llm import brute

SF = "/root/testdata/sf0.01"
#: Columns whose names the operators use inside.
CLASHING = ["fp", "g", "h0", "h1", "n", "tag", "row", "t0", "t1", "spans", "key", "owner", "node", "label", "source", "n_chars", "media", "score"]


def _words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    passage = _words(r, 60)
    line = "A line that comes in very many of the documents here."
    out = [None, "", "   ", "one", "one two", "a b c", "ab " * 300, "x" * 2000, "é" * 500, "\n\n", "\t tab \x0b\x0c\r end", _words(r, 9000)]
    for k in range(40):
        body = _words(r, r.randrange(5, 200))
        if k % 3 == 0:
            body = f"{body} {passage} {_words(r, r.randrange(1, 30))}"
        if k % 4 == 0:
            body += f"\n  {line.upper() if k % 8 else line}\t\nend {k}"
        out.append(body)
    near = _words(r, 150).split()
    for k in range(8):
        changed = list(near)
        changed[r.randrange(150)] = f"new{k}"
        out.append(" ".join(changed))
    out += [out[20], out[20], out[20].upper(), "one"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", *(F.lit(1).alias(c) for c in CLASHING)).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat a doc_id or lack one."""
    rows = [(1, "same text of a row"), (1, "same text of a row"), (1, "another text"), (None, "same text of a row"), (None, None), (2, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 ------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://A.Org/x", "https://b.example.org/es/1?q#f", "http://example.org/en/12", "http://x.com/fr/", "http://x.com/de/a#b", "http://notexample.org/es/", "a://org?x", "x://free-bets.example.net", "x://free-bets.example.net/", "y://É.COM/fr/É?"]


def test_urls(spark, none):
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(URLS * 2)], "page_id long, url string, key string, listed int")
    got = {r.page_id: r for r in url_cascade.judge_urls(pages, queries.RULES, _listed(pages)).collect()}
    assert len(got) == 2 * len(URLS)
    for k, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        listed = any(label in queries.LISTED_LABELS for label in host.split("."))
        expected = (host, path, rule and rule.text, rule.verdict if rule else "block" if listed else "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == expected
    assert url_cascade.judge_urls(pages.limit(0), queries.RULES, _listed(pages)).count() == 0
    assert url_cascade.judge_urls(pages, [], _listed(pages).limit(0)).filter("verdict = 'block'").count() == 0


def test_rules_of_the_contract(spark):
    """Each rule's word and, where rules overlap, the longest one's, spelled out here and not read off ``queries``."""
    words = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {r.text: r.verdict for r in queries.RULES} == words
    urls = {"http://a.org/x": "org/", "http://b.example.org/es/1": "example.org/es/", "http://example.org/en/12?q": "example.org/en/1", "http://example.org/en/2": "org/", "http://spam-farm.com/fr/": "com/fr/", "http://x.com/de/": "com/de/"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_cascade.judge_urls(pages, queries.RULES, _listed(pages)).collect()}
    assert got == {k: (rule, words[rule]) for k, rule in enumerate(urls.values())}


def _listed(pages):
    return url_cascade.hosts_of(pages).filter(F.col("key").rlike(queries.LISTED))


def test_listed_domains(spark):
    """A listed host stands for its subdomains, by whole labels; hosts of very many labels have a result too."""
    hosts = ["bad.org", "x.bad.org", "y.x.bad.org", "notbad.org", "org", "", "bad.org.com", "a." * 5000 + "bad.org", "é.bad.org", ".bad.org", "bad.org."]
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate([*hosts, *hosts])] + [(99, None)], "page_id long, url string")
    listed = spark.createDataFrame([("bad.org",), ("bad.org",), (None,), ("",), ("elsewhere.net",)], "key string")
    got = {r.page_id: (r.host, r.verdict) for r in url_cascade.judge_urls(pages, [], listed).collect()}
    assert len(got) == 2 * len(hosts) + 1 and got[99] == ("", "allow")
    for k, host in enumerate([*hosts, *hosts]):
        assert got[k] == (host, "block" if host == "bad.org" or host.endswith(".bad.org") else "allow")


@pytest.mark.parametrize("share", [0.0, 0.1, 0.9, 1.0])
def test_cascade_is_exact(spark, share, monkeypatch):
    monkeypatch.setattr(url_cascade, "CHUNK", 8)
    keys = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("key"), (F.rand(3) < share).alias("listed")).cache()
    levels = url_cascade.build_cascade(keys)
    assert keys.filter(url_cascade.in_cascade(levels, F.col("key")) != F.col("listed")).count() == 0
    if 0 < share < 1:
        assert len(levels) > 1 and url_cascade.build_cascade(keys, max_bits=64) is None


def test_urls_beyond_the_bound(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    ways = [_rows(url_cascade.judge_urls(pages, queries.RULES, _listed(pages), max_bits=b)) for b in (1, 1 << 20)]
    assert ways[0] == ways[1]


# 2 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [5000, 1])
def test_simhash(docs, texts, bucket):
    found = simhash.near_duplicates(docs, bucket=bucket).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert _rows(found) == sorted(brute.simhash(texts), key=repr)


def test_simhash_links(spark):
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        fps += [f ^ sum(1 << b for b in r.sample(range(64), n)) for n in (1, 2, 3, 4)]
    signed = sorted({int(np.uint64(f).astype(np.int64)) for f in fps})
    prints = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {tuple(x) for x in simhash.near_links(prints).collect()} == pairs
    groups = [{x.node: x.label for x in components.connected_components(simhash.near_links(prints, bucket=b)).collect()} for b in (0, 5000)]
    assert groups[0] == groups[1]


def test_components(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(chain.limit(0)).count() == 0


def test_simhash_odd(odd, none):
    got = _rows(simhash.near_duplicates(odd).select("doc_id", "component_id"))
    assert got == sorted([(1, 1), (1, 1), (1, 1), (None, 1), (None, 2), (2, 2)], key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_group(spark, docs, texts, odd, none):
    keep = {d for d, _, c in brute.simhash(texts) if d == c}
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and _rows(kept.select("doc_id")) == sorted(((d,) for d in keep), key=repr)
    got = _rows(simhash.one_of_each_group(odd))
    # three texts with different fingerprints: the repeated one, "another text" under the same id, and the empty one
    assert got in ([(1, "another text"), (1, "same text of a row"), (2, None)], [(1, "same text of a row"), (1, "another text"), (2, None)])
    near = spark.createDataFrame([(4, "Same Text"), (4, "same text"), (None, "same text"), (None, "SAME text")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.one_of_each_group(near).collect()] == [4]
    assert simhash.one_of_each_group(none).count() == 0


# 3 and 10 -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "group"), [(400, 20_000), (50, 20_000), (50, 1), (7, 20_000)])
def test_byte_repeats(docs, texts, length, group):
    assert _rows(suffix_array.remove_repeats(docs, length, group)) == brute.repeats(texts, length)


@pytest.mark.parametrize(("length", "group"), [(20, 20_000), (20, 1), (4, 20_000), (1, 20_000)])
def test_word_repeats(docs, texts, length, group):
    assert _rows(suffix_trees.remove_repeated_words(docs, length, group)) == brute.repeated_words(texts, length)


@pytest.mark.parametrize("group", [1, 2, 6, 5_000])
def test_frequent_repeats(spark, group):
    """Passages in very many texts, in others whole and in others cut, so that grams, pieces and passages are split."""
    r = random.Random(8)
    common = _words(r, 30, 9999)
    texts = [f"{_words(r, r.randrange(9), 9999)} {common[r.randrange(3):][: r.randrange(60, 140)]} {_words(r, r.randrange(9), 9999)}" for _ in range(60)] + [common * 3, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert _rows(suffix_array.remove_repeats(docs, 40, group)) == brute.repeats(list(enumerate(texts)), 40)
    assert _rows(suffix_trees.remove_repeated_words(docs, 6, group)) == brute.repeated_words(list(enumerate(texts)), 6)
    found = suffix_array.remove_repeats(docs, 60, group, shared=40)
    assert _rows(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute.repeats(list(enumerate(texts)), 60)
    assert _rows(found.select("doc_id", "n_shared")) == sorted([(d, n) for d, _, n, _, _ in brute.repeats(list(enumerate(texts)), 40)], key=repr)


def test_repeat_groups(spark):
    """Every pair of equal passages is in a group, groups hold equal strings, and can't be extended."""
    r = random.Random(9)
    a, b = _words(r, 8, 99), _words(r, 5, 99)
    texts = [f"x{a}y{b}", f"z{a}y{b[:9]}", f"{b}{a}q", f"u{b}v", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {(x.t0, x.t1): (x.text or "").encode() for x in anchors.distinct_texts(docs).withColumn("text", F.col("text").cast("string")).collect()}
    length, groups = 12, {}
    for x in suffix_array.repeat_groups(docs, length).collect():
        groups.setdefault((x.repeat, x.places), set()).add((keys[x.t0, x.t1], x.start, x.n_bytes))
    held = set()
    for (_, places), found in groups.items():
        assert len(found) == places > 1 and len({t[p : p + n] for t, p, n in found}) == 1
        held |= {(t, q) for t, p, n in found for q in range(p, p + n - length + 1)}
    starts = {}
    for t in keys.values():
        for p in range(len(t) - length + 1):
            starts.setdefault(t[p : p + length], []).append((t, p))
    assert held == {x for found in starts.values() if len(found) > 1 for x in found}


def test_long_stretches():
    """Anchors are the same where texts are longer than a stretch of places."""
    kind = suffix_array.byte_passages(9)
    symbols = kind.symbols(random.Random(3).randbytes(3000))
    whole, kept = kind.anchors(symbols), anchors.PLACE
    low = whole[0] >> np.uint64(kept)  # hashes that agree above the places' bits would be ties
    assert len(np.unique(low)) == len(np.unique(whole[0]))
    try:
        anchors.PLACE = 8
        parts = kind.anchors(symbols)
    finally:
        anchors.PLACE = kept
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


def test_repeats_odd(odd, none):
    rows = _rows(suffix_array.remove_repeats(odd, 10).select("doc_id", "n_removed"))
    assert rows == sorted([(1, 18), (1, 18), (1, 0), (None, 18), (None, 0), (2, 0)], key=repr)
    rows = _rows(suffix_trees.remove_repeated_words(odd, 3).select("doc_id", "n_removed"))
    assert rows == sorted([(1, 0), (1, 0), (1, 0), (None, 5), (None, 0), (2, 0)], key=repr)
    assert suffix_array.remove_repeats(none).count() == 0 == suffix_trees.remove_repeated_words(none).count()


def test_interval_tree():
    r = random.Random(2)
    members = [(bytes(r.choices(b"ab", k=r.randrange(6))), bytes(r.choices(b"ab", k=r.randrange(8)))) for _ in range(40)]
    best = [0] * len(members)
    for before, after, found in suffix_array.maximal_repeats(members, 4):
        assert before + after >= 4 and len(found) > 1
        for k in found:
            best[k] = max(best[k], before + after)
    same = suffix_array.common_prefix
    for k, (a, b) in enumerate(members):
        most = max(same(a, c) + same(b, d) for j, (c, d) in enumerate(members) if j != k)
        assert best[k] == (most if most >= 4 else 0)


def test_word_hashes(texts):
    seen = {}
    for _, text in texts:
        raw = (text or "").encode()
        hashes = suffix_trees.word_hashes(raw).tolist()
        assert len(hashes) == len(raw.split())
        for word, h in zip(raw.split(), hashes, strict=True):
            assert seen.setdefault(h, word) == word
    assert len(seen) > 100


@pytest.mark.parametrize("kind", [suffix_array.byte_passages(9), suffix_trees.word_passages(4), suffix_trees.word_passages(1)])
def test_anchors_of_many(texts, kind):
    parts = [s for s in (kind.symbols((text or "").encode()) for _, text in texts) if len(s) >= kind.length]
    found = kind.anchors_of_many(np.concatenate(parts), np.array([len(s) for s in parts]))
    alone = [(g, k) for k, s in enumerate(parts) for g in kind.anchors(s)[0].tolist()]
    assert list(zip(*(c.tolist() for c in found), strict=True)) == alone


def test_minima():
    values = np.random.default_rng(0).integers(0, 50, 200, dtype=np.uint64)
    for w in (1, 2, 7, 200):
        assert anchors.sliding_min(values, w).tolist() == [values[k : k + w].min() for k in range(200 - w + 1)]


# 4 ------------------------------------------------------------------------------------------


def test_classifier(spark, docs, none, odd):
    r = random.Random(7)
    rows = [(k, _words(r, 80) if k % 2 else " ".join(f"{w}$$$" for w in _words(r, 80).upper().split())) for k in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = compression.train_on(labelled, labels)
    held = compression.score(labelled, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert sum(r.predicted == r.doc_id % 2 for r in held if r.held_out) > 0.95 * sum(r.held_out for r in held)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(compression.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.train_on(labelled, flipped) == model
    assert all(0 <= r.score <= 1 for r in compression.score(docs, model).collect())
    assert compression.score(none, model).count() == 0 and compression.score(odd, model).count() == 6
    assert compression.keep_good(docs, model).columns == docs.columns
    assert compression.score(odd, compression.train_on(none, labels.limit(0))).first().score == 0.5


def test_sizes_and_calibration(spark):
    """Features against plain compression, and held-out scores that mean what they say."""
    import duckdb
    import zstandard

    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = compression.train_on(docs, labels)
    scorer = compression.Scorer(model)
    text = docs.orderBy(F.desc("n_chars")).first().text.encode()
    pieces = [text[k : k + 2048] for k in range(0, len(text), 2048)]
    sizes = []
    for d in (model.good, model.bad):
        way = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(way.compress(p)) for p in pieces))
    assert abs(scorer.features(pieces)[1] - 100 * (sizes[1] - sizes[0]) / sum(sizes)) < 1
    assert scorer.features([b""]) == scorer.features([b" \n"]) == [1.0, 0.0]
    marks = dict(duckdb.sql(f"SELECT doc_id, min(quality) FROM '{SF}/labels.parquet' GROUP BY doc_id").fetchall())
    held = [(r.score, marks[r.doc_id]) for r in compression.score(docs, model).collect() if r.held_out and r.doc_id in marks]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    wins = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.95
    assert abs(sum(s for s, _ in held) - len(good)) < 0.1 * len(held)


def test_pieces_of_long_texts():
    pieces = [bytes([k]) for k in range(100)]
    firsts = [compression.drawn(d, pieces, 1)[0][0] for d in range(2000)]
    assert set(firsts) == set(range(100)) and 40 < sum(firsts) / 2000 < 60
    assert sorted(compression.drawn(7, pieces[:5], 8)) == pieces[:5] and compression.drawn(7, pieces, 3)[:1] == compression.drawn(7, pieces, 1)


def test_training_reads_whole_texts(spark):
    """What tells the classes apart stands anywhere in long texts, neither at their start nor at their end."""
    r = random.Random(12)
    rows = []
    for k in range(240):
        good = k % 2
        same = _words(r, 900)
        middle = " ".join(r.choice(["lucid prose here", "well formed clause"] if good else ["buy pills now", "click win cash"]) for _ in range(900))
        rows.append((k, f"{same} {middle} {same[::-1]}", good))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    held = [x for x in compression.score(docs, compression.train_on(docs, labels)).collect() if x.held_out]
    assert sum(x.predicted == x.doc_id % 2 for x in held) > 0.95 * len(held)


# 5 ------------------------------------------------------------------------------------------


def test_decontamination(spark, odd, none):
    r = random.Random(3)
    item = [f"q{k}" for k in range(40)]
    swapped = item[20:] + ["between"] + item[:20]
    rows = [
        (0, " ".join([_words(r, 30), *item, _words(r, 9)])), (1, " ".join([_words(r, 9), *swapped])), (2, " ".join(item[:20])), (3, _words(r, 90)),
        (4, None), (5, ""), (6, " ".join(item).upper()), (7, " ".join(w for k in range(0, 40, 4) for w in [*item[k : k + 4], "x"])),
    ]
    docs = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(0, " ".join(item), 1), (1, "too short", 1), (2, None, 1), (3, _words(r, 50), 1)], "item_id long, text string, doc_id int")
    found = tiling.contaminated(docs, bench).collect()
    assert sorted((x.doc_id, x.item_id, x.covered_words, x.tiles) for x in found) == [(0, 0, 40, 1), (1, 0, 40, 2), (6, 0, 40, 1)]
    for most in (1 << 20, 0):
        assert {x.doc_id for x in tiling.without_contaminated(docs, bench, max_broadcast=most).collect()} == {2, 3, 4, 5, 7}
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0 == tiling.contaminated(none, bench).count()
    assert tiling.without_contaminated(odd, bench).count() == 6


def _plain_tiles(a, b, width):
    """Words of ``b`` that greedy string tiling covers: the longest match first, the first of several, by trying all."""
    used_a, used_b, lengths = set(), set(), []
    while True:
        best, at = 0, None
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and p + n not in used_a and q + n not in used_b:
                    n += 1
                if n > best:
                    best, at = n, (p, q)
        if best < width:
            return lengths
        lengths.append(best)
        used_a.update(range(at[0], at[0] + best))
        used_b.update(range(at[1], at[1] + best))


def test_decontamination_by_brute_force(spark):
    """The whole operator: reordered, cut, repeated and short passages, common phrases in many documents and items."""
    r = random.Random(12)
    phrase = _words(r, 6).split()
    items = [_words(r, r.randrange(5, 40), 5000).split() for _ in range(12)]
    items += [[*i[:4], *phrase, *i[4:]] for i in items[:6]] + [["yes", "no"], phrase[:5], phrase * 4]
    texts = []
    for k in range(60):
        item = r.choice(items)
        parts = [item[a : a + 9] for a in range(0, len(item), 9)]
        r.shuffle(parts)
        body = [w for p in parts[: r.randrange(len(parts) + 1)] for w in [*p, *_words(r, r.randrange(2)).split()]]
        texts.append(" ".join([*_words(r, r.randrange(20)).split(), *(phrase if k % 2 else []), *(item if k % 5 == 0 else body)]))
    texts += ["yes no", "YES  no", "yes no yes", "no", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    expected = []
    for d, t in enumerate(texts):
        words = (t or "").lower().split()
        for k, item in enumerate(items):
            if len(item) < 5:
                lengths = [len(item)] if words == item else []
            else:
                lengths = _plain_tiles(words, item, 5)
            if lengths and sum(lengths) >= 0.8 * len(item):
                expected.append((d, k, len(item), sum(lengths)))
    found = tiling.contaminated(docs, bench)
    assert len(expected) > 20 and _rows(found.select("doc_id", "item_id", "item_words", "covered_words")) == sorted(expected, key=repr)
    gone = {d for d, *_ in expected}
    assert {x.doc_id for x in tiling.without_contaminated(docs, bench).collect()} == set(range(len(texts))) - gone


def test_common_phrases_are_cheap(spark):
    """One document against very many items that share a phrase with it: no pair is tiled."""
    r = random.Random(13)
    phrase = _words(r, 6)
    bench = spark.createDataFrame([(k, f"{_words(r, 47, 10**6)} {phrase} {_words(r, 47, 10**6)}") for k in range(400)], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"{_words(r, 150)} {phrase} {_words(r, 150)}")] * 50, "doc_id long, text string")
    assert tiling.contaminated(docs, bench).count() == 0
    text = (" ".join([phrase] * 2000)).encode()
    item, began = text.split()[:48], time.perf_counter()
    tiles = tiling.tiles_of(text.split(), item, 5, (suffix_trees.word_hashes(text), suffix_trees.word_hashes(b" ".join(item))))
    assert [n for _, _, n in tiles] == [len(item)] and time.perf_counter() - began < 1


def test_tiles_by_brute_force():
    """The longest match first, over and over, by trying all of them."""
    r = random.Random(4)
    for _ in range(60):
        a, b = [[r.choice([b"x", b"y", b"z"]) for _ in range(25)] for _ in range(2)]
        seeds = [(i, j) for i in range(24) for j in range(24) if a[i : i + 2] == b[j : j + 2] and i < 24 and j < 24]
        if not seeds:
            continue
        i, j = map(np.array, zip(*seeds, strict=True))
        tiles = tiling.tile(a, b, tiling.matches(i, j, 2), 2)
        used_a, used_b, lengths = set(), set(), []
        while True:
            best = 0
            for p in range(25):
                for q in range(25):
                    n = 0
                    while p + n < 25 and q + n < 25 and a[p + n] == b[q + n] and p + n not in used_a and q + n not in used_b:
                        n += 1
                    if n > best:
                        best, at = n, (p, q)
            if best < 2:
                break
            lengths.append(best)
            # the same one of several longest matches
            p, q, n = tiles[len(lengths) - 1]
            assert n == best and a[p : p + n] == b[q : q + n], at
            used_a.update(range(p, p + n))
            used_b.update(range(q, q + n))
        assert [n for _, _, n in tiles] == lengths
        hashes = tuple(suffix_trees.word_hashes(b" ".join(side)) for side in (a, b))
        assert sorted(n for _, _, n in tiling.tiles_of(a, b, 2, hashes))[-1] == lengths[0]


# 6 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("window", "group"), [(2048, 8_000_000), (64, 500)])
def test_packing(docs, texts, odd, none, window, group):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    ids = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    pieces = packing.pack_documents(docs, path, window, group_tokens=group).collect()
    for d, own in ids.items():
        mine = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert [x for p in mine for x in p.ids] == own and all(p.doc_tokens == len(own) for p in mine)
    used = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0) and p.length == len(p.ids)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        used[p.sequence_id] = p.offset + p.length
    assert max(used.values()) <= window
    assert packing.pack_documents(none, path).count() == 0 and packing.pack_documents(odd, path).count() == 6


def test_ids_of_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encode = tokenizers.Tokenizer.from_file(path), packing.Encoder(path, 1)
    for t in ["a.b, c. D.\nE", "x... y., z", "<|endoftext|> <|ENDOFTEXT|>", "I'm 12,5. \x1c\x85\xa0q İΣ", "é. É, ", "don't. it's, a.\tb"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("letter", ["\u0130", "\u09df", "\u0958", "\ufb2a", "e\u0301", "\u0915\u093c", "\u00e9", "z"])
def test_ids_of_points_after_letters(letter):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encode = tokenizers.Tokenizer.from_file(path), packing.Encoder(path, 1)
    for t in [f"a{letter}{point}{blank}b" for point in (".", ",", ".,") for blank in (" ", "\n", "\t", "")]:
        assert np.frombuffer(encode(t), "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


def test_ids_of_all_letters():
    """Every code point up to U+2FFFF before a point or comma, and text in scripts with combining marks."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encode = tokenizers.Tokenizer.from_file(path), packing.Encoder(path, 1)
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 512):
        text = "".join(f"{c}{'.,'[k % 2]} b " for k, c in enumerate(letters[at : at + 512]))
        assert np.frombuffer(encode(text), "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
    for text in ("\u0939\u093f\u0928\u094d\u0926\u0940, \u092a\u095d\u0928\u093e. \u0915\u0958, ", "\u09ac\u09be\u0982\u09b2\u09be, \u09b9\u09df. ", "\u0a2a\u0a70\u0a1c\u0a3e\u0a2c\u0a40, \u0a17\u0a5e. "):
        assert np.frombuffer(encode(text * 3), "<u4").tolist() == [*plain.encode(text * 3, add_special_tokens=False).ids, 1]


def test_least_squares():
    r = np.random.default_rng(1)
    a, x = r.integers(0, 3, (12, 20)).astype(float), np.maximum(0, r.normal(size=20))
    assert np.allclose(a @ packing.nnls(a, a @ x), a @ x, atol=1e-6)
    got = packing.nnls(a, r.normal(size=12) * 5)
    assert (got >= 0).all()
    lengths = [int(n) for n in r.integers(1, 2048, 3000)]
    sequences = list(packing.pack(lengths, 2048))
    assert sum(lengths) / 2048 / len(sequences) > 0.999
    # the plan of all lengths serves a part of them, another kind of part, and one document
    ways = packing.solve(np.bincount([-(-(n % 2048) * 128 // 2048) - 1 for n in lengths if n % 2048], minlength=128).astype(float))
    for part in (lengths[:500], sorted(lengths)[:500], lengths[:1], []):
        sequences = list(packing.pack(part, 2048, ways))
        assert sorted(p[:2] for s in sequences for p in s)[:1] == [(0, 0)][: len(part)]
        assert sum(n for s in sequences for _, _, n in s) == sum(part)
        assert len(sequences) <= sum(part) / 2048 + 1


def test_words_go_straight_to_the_pairing():
    """Words of all letters below U+0100, in both cases, with points, and parts forgotten and met again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encode = tokenizers.Tokenizer.from_file(path), packing.Encoder(path, 1)
    encode.KEPT = 100
    r = np.random.default_rng(2)
    letters = [chr(c) for c in range(0x21, 0x100)]
    for _ in range(300):
        words = ["".join(r.choice(letters[: r.integers(60, len(letters))], r.integers(1, 9))) + str(r.choice(["", ".", ",", "'s"])) for _ in range(20)]
        text = " ".join(words)
        assert np.frombuffer(encode(text), "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_histogram(spark):
    lengths = [0, 1, 15, 16, 17, 2032, 2033, 2047, 2048, 2049, 5000]
    got = packing.histogram(spark.createDataFrame([(n,) for n in lengths], "n bigint"), 2048)
    want = np.zeros(128)
    for n in lengths:
        if n % 2048:
            want[-(-(n % 2048) // 16) - 1] += 1
    assert (got == want).all()
    assert packing.histogram(spark.createDataFrame([], "n bigint"), 7).tolist() == [0.0] * 7


# 7 ------------------------------------------------------------------------------------------


def test_media(docs, texts, odd, none):
    got = {r.doc_id: r for r in jpeg.read_media(jpeg.store_texts(docs)).collect()}
    for d, t in texts:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-16:]))
        assert len(r.rgb) == 3 * r.height * r.width
    assert got[20].feature == got[[d for d, t in texts if t == texts[20][1]][-1]].feature
    assert jpeg.store_texts(none).count() == 0 and jpeg.store_texts(odd).count() == 6


def test_wide_media():
    payload = random.Random(1).randbytes(192 * (2 * jpeg.MAX_HIGH + 5))
    stored, rgb = jpeg.decode(jpeg.encode(payload))
    assert stored[: len(payload)] == payload and rgb.shape[1] == 32


def test_odd_media(spark):
    whole = jpeg.encode(b"a" * 192)
    rows = [(1, 192, whole), (2, 192, None), (3, 192, b""), (4, 192, whole[:200]), (5, 192, whole[: len(whole) - 2]), (6, 192, b"\xff\xd8\xff\xd9"), (7, None, whole)]
    got = {r.doc_id: r for r in jpeg.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].payload_sha256 == brute.sha(b"a" * 192) and got[7].payload_bytes == 384
    assert all(got[k].payload_sha256 is None and got[k].rgb is None for k in (2, 3, 4, 5, 6)) and got[2].media_bytes is None and got[4].media_bytes == 200


def test_general_scans_agree():
    """The bit-by-bit reader of DC gives what the reader for codes of one width gives."""
    data = jpeg.encode(random.Random(2).randbytes(192 * 40))
    quick, kept = jpeg.decode_coefficients(data), jpeg._two_bits
    try:
        jpeg._two_bits = lambda *a: False
        slow = jpeg.decode_coefficients(data)
    finally:
        jpeg._two_bits = kept
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(quick.components.values(), slow.components.values(), strict=True))


class _Writer:
    """Scans of AC coefficients by the general rules; every symbol has nine bits, its own number."""

    table = jpeg._table(1, 0, {9: list(range(255))})

    def __init__(self):
        self.bits, self.run, self.late = [], 0, []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def flush(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.put(n << 4, 9)
            self.put(self.run - (1 << n), n)
            self.bits += self.late
            self.run, self.late = 0, []

    def first(self, blocks, low):
        for block in blocks:
            zeros = 0
            for c in block:
                size = (abs(c) >> low).bit_length()
                if not size:
                    zeros += 1
                    continue
                self.flush()
                while zeros > 15:
                    self.put(0xF0, 9)
                    zeros -= 16
                self.put(zeros << 4 | size, 9)
                self.put(abs(c) >> low if c > 0 else (abs(c) >> low) ^ (1 << size) - 1, size)
                zeros = 0
            self.run += zeros > 0
        self.flush()
        return jpeg._entropy(np.array(self.bits, np.uint8))

    def refine(self, blocks, low):
        for block in blocks:
            now = [abs(c) >> low for c in block]
            newest = max((k for k, v in enumerate(now) if v == 1), default=-1)
            zeros, late = 0, []
            for k, v in enumerate(now):
                if not v:
                    zeros += 1
                    continue
                while zeros > 15 and k <= newest:
                    self.flush()
                    self.put(0xF0, 9)
                    self.bits += late
                    zeros, late = zeros - 16, []
                if v > 1:
                    late.append(v & 1)
                    continue
                self.flush()
                self.put(zeros << 4 | 1, 9)
                self.put(int(block[k] > 0), 1)
                self.bits += late
                zeros, late = 0, []
            if zeros or late:
                self.run += 1
                self.late += late
        self.flush()
        return jpeg._entropy(np.array(self.bits, np.uint8))


@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
def test_general_scans(share):
    """Sparse and dense coefficients in spectral bands and successive bits, with runs over many blocks, read back as they were."""
    r = np.random.default_rng(3)
    blocks = (r.integers(-70, 70, (90, 64)) * (r.random((90, 64)) < share)).astype(int)
    blocks[20:60] = 0
    blocks[:, 0] = 0
    frame = bytes((8,)) + (8 * 90).to_bytes(2) + (8).to_bytes(2) + bytes((1, 1, 0x11, 0))
    out = [jpeg._HEAD, jpeg._segment(0xC2, frame), _Writer.table]
    for first, last in ((1, 5), (6, 63)):
        band = blocks[:, first : last + 1].tolist()
        out.append(jpeg._scan([0], first, last, 0, 2, _Writer().first(band, 2)))
        out += [jpeg._scan([0], first, last, low + 1, low, _Writer().refine(band, low)) for low in (1, 0)]
    image = jpeg.decode_coefficients(b"".join(out) + b"\xff\xd9")
    assert (image.components[1].coefficients == blocks).all()


def test_rgb_by_the_plain_transform():
    """Every pixel by its own sum of 64 terms, chroma repeated, against the tensor; and the feature from its words."""
    payload = random.Random(4).randbytes(384 * 2)
    image = jpeg.decode_coefficients(jpeg.encode(payload))
    rgb = jpeg.to_rgb(image)
    scale = [np.sqrt(0.5), *[1.0] * 7]

    def sample(component, y, x):
        c = image.components[component]
        block = c.coefficients[(y // 8) * c.wide + x // 8]
        total = 0.0
        for k, at in enumerate(jpeg.ZIGZAG.tolist()):
            v, u = divmod(at, 8)
            total += scale[u] * scale[v] / 4 * block[k] * np.cos((2 * (y % 8) + 1) * v * np.pi / 16) * np.cos((2 * (x % 8) + 1) * u * np.pi / 16)
        return min(255.0, max(0.0, total + 128))

    assert rgb.shape == (32, 16, 3)
    for y in range(0, 32, 3):
        for x in range(16):
            light, blue, red = sample(1, y, x), sample(2, y // 2, x // 2) - 128, sample(3, y // 2, x // 2) - 128
            plain = [light + 1.402 * red, light - 0.344136 * blue - 0.714136 * red, light + 1.772 * blue]
            assert all(abs(min(255, max(0, p)) - got) <= 0.51 for p, got in zip(plain, rgb[y, x].tolist(), strict=True))
    means, lighter = jpeg.feature(rgb).split(":")
    assert all(abs(float(m) - rgb[:, :, k].mean()) < 0.011 for k, m in enumerate(means.split(",")))
    lines = rgb.reshape(32, -1).astype(int).sum(1)
    assert lighter == np.packbits(np.repeat(lines, 2) > lines.mean()).tobytes().hex()


def test_subsampled_chroma():
    """A picture with one chroma sample for four: a grey one stays grey at full resolution."""
    dc = jpeg._table(0, 0, {1: [0], 2: [3]})
    frame = bytes((8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    # luminance differences 5 (code 10, bits 101), then zeros; 1 MCU of 4 + 1 + 1 blocks
    bits = np.array([int(b) for b in "10101" + "0" * 5], np.uint8)
    data = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + b"\x08" * 64) + jpeg._segment(0xC2, frame) + dc + jpeg._scan([0, 1, 2], 0, 0, 0, 0, jpeg._entropy(bits)) + b"\xff\xd9"
    rgb = jpeg.to_rgb(jpeg.decode_coefficients(data))
    assert rgb.shape == (16, 16, 3) and (rgb == 133).all()


# 8 ------------------------------------------------------------------------------------------

PERSONAL = [
    None, "", "a@b.c", "a@b.c_d@e.f x.y@z", "..a@b-c.d.e. @x.y a@b a@.b", "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 1 2 3",
    "+1 (555) 123-4567. +12 +49 30 1234567 ext +1234567890123456", "é@x.y 😀 a@b.c 😀 4111111111111111", "token = \"da39a3ee5e6b4b0d3255bfef95601890afd80709\" ok", "Dr. Anna Smith wrote",
    "9" * 500 + " " + "1.1." * 400 + "a" * 3000 + "@", "a@" + "b." * 3000, "ssn 123-45-6789 +1-1",
]


def test_personal_data(spark, odd, none):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(PERSONAL * 3)], "doc_id long, text string, spans int")
    for r in personal_data.find_personal_data(docs).collect():
        base = [(s.start, s.rank, personal_data.KINDS[s.rank], s.stop) for s in r.spans if s.rank < 4]
        assert base == brute.personal_data(PERSONAL[r.doc_id % len(PERSONAL)])
    secrets = personal_data.find_personal_data(docs).select(F.expr("exists(spans, s -> s.rank = 4)").alias("s"), "doc_id").filter("s").collect()
    assert {r.doc_id % len(PERSONAL) for r in secrets} == {9}
    assert personal_data.find_personal_data(none).count() == 0 and personal_data.find_personal_data(odd).count() == 6


def test_planted_personal_data(spark):
    """Of what is planted in prose nine tenths and more come back, and prose alone gives no span."""
    r = random.Random(8)
    planted, rows = {}, []
    for k in range(400):
        value = [
            lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
            lambda: f"{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}",
            lambda: f"{r.choice(personal_data.GIVEN_NAMES)} {r.choice(['Okafor', 'Lindqvist', 'Moreau', 'Tanaka'])}",
            lambda: f"Dr. {r.choice(personal_data.GIVEN_NAMES)} {r.choice(['Okafor', 'Lindqvist', 'Moreau', 'Tanaka'])}",
            lambda: f"{r.choice('aeiou')}{r.randrange(99)}@mail.example.com",
        ]
        cue = ["token", "ssn", "from", "contact", "mail"]
        kind = k % 8
        text = _words(r, 60)
        if kind < 5:
            value = value[kind]()
            planted[k] = (["secret", "ssn", "person", "person", "email"][kind], len(text) + 2 + len(cue[kind]), value)
            text = f"{text} {cue[kind]} {value} {_words(r, 20)}"
        elif kind == 5:
            text += " The Apache License and New York. Orre Orre, Mark Twain's Will, 2024-10-11 and 1.2.3, version 12-34."
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: {(personal_data.KINDS[s.rank], s.start, s.stop) for s in x.spans} for x in personal_data.find_personal_data(docs).collect()}
    caught = sum((kind, at, at + len(value)) in found[k] for k, (kind, at, value) in planted.items())
    assert caught >= 0.9 * len(planted)
    assert not any(found[k] for k, _ in rows if k not in planted)


def test_reliabilities():
    """Labelers of known reliability, told apart without any truth."""
    r = random.Random(6)
    counts = {}
    for _ in range(20_000):
        true = r.random() < 0.4
        votes = tuple(int(r.random() < (yes if true else no)) for yes, no in ((0.9, 0.1), (0.8, 0.3), (0.7, 0.2), (0.95, 0.05)))
        counts[4, votes] = counts.get((4, votes), 0) + 1
    found = personal_data.estimate(counts)
    assert abs(found.prior[4] - 0.4) < 0.05 and abs(found.yes_true["strict"] - 0.9) < 0.05 and abs(found.yes_false["gazetteer"] - 0.3) < 0.05


# 9 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_lines(docs, texts, odd, none, batches):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for d, t in texts:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    gone = {k: max(ds) for k, ds in holders.items() if len(k) >= 20 and len(ds) >= 3}
    assert gone
    got = {r.doc_id: r for r in line_runs.dedup_lines(docs, 20, 3, batches).collect()}
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == d]
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_runs.dedup_lines(none).count() == 0
    assert _rows(line_runs.dedup_lines(odd, 5, 3).select("doc_id", "n_dropped")) == sorted([(1, 0)] * 3 + [(2, 0)] + [(None, 0)] * 2, key=repr)


def _around(r, n, length, letters):
    """Members of one key: an anchor with contexts that agree for random lengths on both sides; some have copies."""
    core = bytes(r.choice(letters) for _ in range(4 * length))
    out = []
    for k in range(n):
        off, agree = r.randrange(length // 2), r.randrange(length)
        left = bytes(r.choice(letters) for _ in range(length)) + core[2 * length - agree : 2 * length]
        right = core[2 * length : 2 * length + r.randrange(1, 2 * length)] + bytes(r.choice(letters) for _ in range(r.randrange(length)))
        text = left[len(left) - off :] + right
        out += [(k + copy, 0, k, off + 7, 7, text) for copy in ([0, 10_000] if r.random() < 0.2 else [0])]
    return out


def test_large_groups_of_suffixes(monkeypatch):
    """Cuts of the trees give what the trees give node by node."""
    r = random.Random(3)
    for trial in range(150):
        length = r.choice([6, 8, 12])
        search = suffix_array._search(length, length + r.choice([0, 4, 6]))
        members = _around(r, r.randrange(2, 60), length, b"ab" if trial % 2 else b"abcd")
        monkeypatch.setattr(suffix_array, "SMALL", 10**9)
        by_node = sorted(search(members))
        monkeypatch.setattr(suffix_array, "SMALL", 1)
        assert sorted(search(members)) == by_node


def test_a_full_group_of_suffixes():
    r = random.Random(5)
    members = _around(r, 17_000, 256, b"abcdefghijkl ")
    began = time.perf_counter()
    assert sum(1 for _ in suffix_array._search(256, 400)(members)) > 17_000
    assert time.perf_counter() - began < 60


def test_very_many_spans_in_one_text(spark):
    """Places and contexts of matches far into a long text, with characters of every width."""
    parts, expected, at = [], [], 0
    r = random.Random(8)
    for k in range(3000):
        gap = r.choice(["é mail ", "😀 to: ", "\n", " ip ", "x" * 300 + " "])
        value = r.choice(["ab@example.org", "10.1.2.3"])
        expected.append((at + len(gap), int(value[0] == "1"), at + len(gap) + len(value)))
        at += len(gap) + len(value) + 1
        parts.append(f"{gap}{value} ")
    text = "".join(parts)
    docs = spark.createDataFrame([(1, text), (2, "short ab@example.org")], "doc_id long, text string")
    spans = {x.doc_id: x.spans for x in docs.select("doc_id", personal_data._candidates(F.col("text")).alias("spans")).collect()}
    assert [(s.start, s.rank, s.stop) for s in spans[1] if s.rank < 2] == expected
    for s in spans[1]:
        before = text[max(0, s.start - personal_data.CONTEXT) : s.start].lower()
        if s.rank == 0:
            assert s.context == bool(re.search(r"(?:^|[^^\W\d_])(?:mail|e-mail|contact|write)[^^\W\d_]*$".replace("[^^\\W\\d_]", r"[\W\d_]"), before))
    assert [(s.start, s.stop) for s in spans[2]] == [(6, 20)]
    began = time.perf_counter()
    hostile = spark.createDataFrame([(1, "a.b@example.org, " * 200_000)], "doc_id long, text string")
    assert hostile.select(F.size(personal_data._candidates(F.col("text"))).alias("n")).first().n == 200_000
    assert time.perf_counter() - began < 90

"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.anchors import gram_hashes, mixed
from quillspark.llm.cluster import batched, cut, rows_of
from quillspark.llm.columns import UPPER, text_key
from quillspark.llm.suffix_trees import word_hashes

#: Bits of the filter for seeds (16 MB at most) and those set for each seed; a larger benchmark lets more pass to the join.
MAX_BITS = 1 << 27
BITS_PER_SEED = 64
PROBES = 4
#: Keys of texts, 16 bytes each, that may be broadcast; more are met by a shuffled join.
MAX_BROADCAST = 1 << 20


def matches(i: np.ndarray, j: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(i, j, length) of the maximal runs of seeds at i and j, each ``width`` words, along diagonals."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    breaks = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)])
    ends = np.r_[breaks[1:], len(i)]
    return [(int(i[a]), int(j[a]), int(z - a) + width - 1) for a, z in zip(breaks, ends, strict=True)]


def tile(document: list[bytes], item: list[bytes], found: list[tuple[int, int, int]], width: int, marked: tuple[set, set] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: again and again the longest match of unmarked words is marked on
    both sides. A match that marks have cut is put back as its unmarked parts of ``width`` words."""
    marked_d, marked_i = marked if marked is not None else (set(), set())
    heap = [(-n, i, j) for i, j, n in found]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [i + k not in marked_d and j + k not in marked_i and document[i + k] == item[j + k] for k in range(-n)]
        if all(free):
            tiles.append((i, j, -n))
            marked_d.update(range(i, i - n))
            marked_i.update(range(j, j - n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= width:
                    heapq.heappush(heap, (start - k, i + start, j + start))
                start = None
    return tiles


def _free_windows(hashes: np.ndarray, marked: set, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the runs of ``n`` words without marked ones; hashes run on from word to word."""
    marks = np.zeros(len(hashes) + 1, np.int64)
    marks[[k + 1 for k in marked]] = 1
    sums = np.cumsum(marks)
    start = np.flatnonzero(sums[n:] == sums[: len(sums) - n])
    return gram_hashes(hashes, n)[start], start


def tiles_of(document: list[bytes], item: list[bytes], width: int, hashes: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin hashes: (i, j, length) of each tile.

    Rounds search for matches of a falling length, from the whole item down to ``width``
    words, among the words that no tile covers yet, and mark the longest first; so what is
    long never comes to be searched in its many short pieces. ``hashes``: those of the words.
    """
    marked: tuple[set, set] = set(), set()
    n, tiles = max(1, min(len(document), len(item))), []
    width = min(width, n)
    while True:
        (a, i), (b, j) = (_free_windows(h, m, n) for h, m in zip(hashes, marked, strict=True))
        order = np.argsort(b, kind="stable")
        b, j = b[order], j[order]
        first, last = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        many = last - first
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        if len(at):
            tiles += tile(document, item, matches(np.repeat(i, many), j[at], n), n, marked)
        if n == width or len(marked[1]) > len(item) - width:
            return tiles
        n = max(width, n // 2)


def seeds(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; of a shorter text the whole, which matches none but such a text."""
    n = min(width, len(words))
    return mixed(gram_hashes(words, n) ^ np.uint64(n)) if n else np.zeros(0, np.uint64)


def _probe(grams: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each seed in a filter of ``bits``, a power of two."""
    return mixed(grams + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(bits - 1)


_ITEMS = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("n", pa.int64()), ("item_text", pa.binary()), ("grams", pa.list_(pa.int64()))])
_HITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("grams", pa.list_(pa.int64()))])
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("tiles", pa.int64()), ("coverage", pa.float64())])
_FOUND_DDL = "row bigint, doc_id bigint, item_id bigint, item_words bigint, covered_words bigint, tiles bigint, coverage double"


def _numbered() -> Iterator[int]:
    """Numbers that no other row of the DataFrame has, until its next evaluation."""
    n = TaskContext.get().partitionId() << 40
    while True:
        yield n
        n += 1


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, item_id, n, item_text, grams): the items with words, lower-cased, and the seed at each of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered()
        texts = ((key, (text or b"").lower()) for key, text in rows_of(batches))
        words = ((key, text, word_hashes(text)) for key, text in texts)
        rows = ((next(number), key, len(w), text, seeds(w, width).view(np.int64)) for key, text, w in words if len(w))
        return batched(rows, _ITEMS, lambda row: 32 + len(row[3]) + 8 * len(row[4]))

    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "item bigint, item_id bigint, n bigint, item_text binary, grams array<bigint>")


def _filter(items: DataFrame) -> np.ndarray:
    """A Bloom filter of all seeds; its bits are gathered on the executors, words of 64 come to the driver, 16 MB at most."""
    n = items.agg(F.sum(F.size("grams"))).first()[0] or 0
    bits = 1 << min(MAX_BITS, max(64, n * BITS_PER_SEED)).bit_length() - 1
    schema = pa.schema([("word", pa.int64()), ("mask", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(PROBES):
                at = _probe(grams, k, bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], schema=schema)

    words = items.select("grams").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def _hits(docs: DataFrame, width: int, filter_words: np.ndarray, least: int) -> DataFrame:
    """(row, doc_id, text, grams): the documents of which ``least`` places pass the filter, with the seeds that do."""
    bits = 64 * len(filter_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered()

        def rows() -> Iterator[tuple]:
            for doc, text in rows_of(batches):
                text = (text or b"").lower()
                words = word_hashes(text)
                grams = seeds(words, width)
                for k in range(PROBES):  # each sees only what the ones before let through
                    at = _probe(grams, k, bits)
                    grams = grams[(filter_words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                if len(grams) >= (least if len(words) >= width else 1):
                    yield next(number), doc, text, np.unique(grams).view(np.int64)

        return batched(rows(), _HITS, lambda row: 24 + len(row[2]) + 8 * len(row[3]))

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "row bigint, doc_id bigint, text binary, grams array<bigint>")


def _found(docs: DataFrame, benchmark: DataFrame, width: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """What :func:`contaminated` gives, with the number of the row, and the rows (row, text) that came into question."""
    items = cut(_items(benchmark, width))
    # tiles of ``width`` words or more that cover c words have c / width seeds at least
    need = F.when(F.col("n") < width, 1).otherwise(F.ceil(F.ceil(F.col("n") * coverage - 1e-9) / width)).cast("bigint")
    least = items.agg(F.min(F.when(F.col("n") >= width, need))).first()[0] or 1
    hits = cut(_hits(docs, width, _filter(items), int(least)))
    held = hits.select("row", F.explode("grams").alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("df"))
    # A document that counts lacks few of an item's places, so it holds one of the rarest of
    # them; the commonest, of which it may hold all without holding the item, bring up nothing.
    places = items.select("item", need.alias("need"), F.explode("grams").alias("g")).groupBy("item", "need", "g").agg(F.count("*").alias("times"))
    ranked = places.join(often, "g").groupBy("item", "need").agg(F.sort_array(F.collect_list(F.struct(F.col("df"), "g", "times")), asc=False).alias("by"))
    start = F.struct(F.lit(0).cast("bigint").alias("past"), F.array().cast("array<bigint>").alias("kept"))
    rare = F.aggregate(
        "by", start,
        lambda state, x: F.struct(
            (state["past"] + x["times"]).alias("past"),
            F.when(state["past"] + x["times"] >= F.col("need"), F.array_append(state["kept"], x["g"])).otherwise(state["kept"]).alias("kept"),
        ),
        lambda state: state["kept"],
    )
    pairs = held.join(ranked.select("item", F.explode(rare).alias("g")), "g").select("row", "item").distinct()
    whole = pairs.join(items.select("item", "item_id", "item_text"), "item").join(hits.select("row", "doc_id", "text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, words, hashes = None, [], np.zeros(0, np.uint64)
            for row, doc, text, item_id, item_text in rows_of(batches):
                if row != last:
                    last, words, hashes = row, text.split(), word_hashes(text)
                item = item_text.split()
                if len(item) < width and len(words) != len(item):
                    continue
                tiles = tiles_of(words, item, width, (hashes, word_hashes(item_text)))
                covered = sum(n for _, _, n in tiles)
                if covered >= coverage * len(item) - 1e-9:
                    yield row, doc, item_id, len(item), covered, len(tiles), covered / len(item)

        return batched(rows(), _FOUND, lambda row: 56)

    return whole.select("row", "doc_id", "text", "item_id", "item_text").mapInArrow(run, _FOUND_DDL), hits.select("row", "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, coverage) of each document and
    benchmark item of whose words tiles cover a share of ``coverage`` or more.

    Words are lower-cased (A-Z) and split at ASCII white space; seeds are runs of ``width``
    words that both hold; tiles have ``width`` words or more and may come in any order.
    Whole texts of any length are searched. One pass over the documents keeps those with seeds
    that a filter knows; their seeds meet the items' rarest ones in a join, and each pair that
    comes up is tiled by itself. An item of fewer than ``width`` words matches the documents
    that consist of it. Null and empty texts on either side match nothing; repeated rows give
    repeated results; no items or documents give no rows. Other columns are ignored.
    """
    return _found(docs, benchmark, width, coverage)[0].drop("row")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item to ``coverage``; see :func:`contaminated`.

    Rows go by their text's key, lower-cased, so all copies go; up to ``max_broadcast`` keys are
    broadcast, more are met by a shuffled join.
    """
    found, hits = _found(docs, benchmark, width, coverage)
    k0, k1 = text_key(F.col("text"))
    keys = cut(hits.join(found.select("row").distinct(), "row", "left_semi").select(k0.alias("k0"), k1.alias("k1")).distinct())
    n = keys.count()
    own = text_key(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()).cast("binary"))
    side = F.broadcast(keys) if n <= max_broadcast else keys
    marked = docs.select(F.struct(*docs.columns).alias("row"), own[0].alias("k0"), own[1].alias("k1"))
    return marked.join(side, ["k0", "k1"], "left_anti").select("row.*")

"""Repeated passages: where a passage of a fixed length starts in more than one place.

Passages are found by anchors that their own content chooses. With passages of ``length``
symbols, the anchor of a passage is the smallest hash among its first ``reach`` grams of
``length - reach + 1`` symbols (the leftmost at a tie), so equal passages have equal anchors
at equal distances, and each passage has just one. Only about two in ``reach`` places are
anchors. A first pass counts the grams at anchors; a second ships the surroundings of those
that occur again, grouped by gram, and each group is searched in one task.

A gram that occurs more than ``group`` times is split by longer keys: its passages are dealt
into pieces by their distance to the anchor, and a piece's key is all that its passages have
in common, nearly a whole passage. Pieces are counted and searched like grams. What is still
too frequent is split into the passages themselves; there nothing is left to sort, as all
members are the same string, and Spark's partial aggregation counts them. So a passage in a
third of all rows loads no single task.

Texts are processed once each, however many rows hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import batched, rows_of
from quillspark.llm.columns import text_key

#: Odd multipliers of the rolling hashes (fixed values, any odd numbers do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Low bits of a packed hash that hold the place within a stretch of this many passages.
PLACE = 28
#: Pieces of a frequent gram.
PIECES = 8
#: One random number for each byte, from a seeded generator.
BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below n at least."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        held = _powers[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return held


def mixed(h: np.ndarray) -> np.ndarray:
    """``h`` with its bits spread."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def run_hashes(symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of symbols from ``starts`` to ``stops`` (uint64)."""
    n = len(symbols)
    up, down = _power_tables(BASES[0], n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * down[starts] ^ (stops - starts).astype(np.uint64))


def gram_hashes(symbols: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` symbols (uint64)."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` successive values, from running minima in blocks of ``w``."""
    n = len(values)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


@dataclass(frozen=True)
class Passages:
    """What a passage is. ``symbols`` gives a text's symbols as uint64 numbers, ``cut`` the
    bytes of some of its symbols from the text as ``split`` made it. Surroundings reach so far
    that they hold strings of ``long`` symbols that begin with a passage."""

    length: int
    reach: int
    long: int
    split: Callable
    symbols: Callable
    cut: Callable

    def places(self, symbols: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The anchor of the passage at each start, found a stretch at a time, so that places fit beside hashes."""
        mask = np.uint64((1 << PLACE) - 1)
        step = (1 << PLACE) - self.reach
        found = []
        for at in range(0, len(symbols) - self.length + 1, step):
            part = grams[at : at + step + self.reach - 1]
            packed = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
            found.append((sliding_min(packed, self.reach) & mask).astype(np.int64) + at)
        return found[0] if len(found) == 1 else np.concatenate(found)

    def anchors(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram, place, first, last): ``place`` is the anchor of the passages that start from first to last."""
        grams = gram_hashes(symbols, self.length - self.reach + 1)
        if len(symbols) < self.length:
            empty = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), empty, empty, empty
        place = self.places(symbols, grams)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, len(place) - 1]
        return grams[place[first]], place[first], first, last

    def pieces(self, symbols: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, place, first, last): the passages at each anchor dealt by their distance to it; the key stands for what those of a piece share."""
        width = -(-self.reach // PIECES)
        out = []
        for low in range(0, self.reach, width):
            high = min(low + width, self.reach) - 1  # distances low to high
            a, z = np.maximum(first, place - high), np.minimum(last, place - low)
            some = a <= z
            p = place[some]
            key = mixed(run_hashes(symbols, p - low, p - high + self.length) ^ np.uint64(low + 1))
            out.append((key, p, a[some], z[some]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def anchors_of_many(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, text): the grams at the anchors of texts of ``length`` symbols or more that
        follow each other in ``symbols``, each with the number of its text."""
        grams = gram_hashes(symbols, self.length - self.reach + 1)
        place = self.places(symbols, grams)
        ends = np.cumsum(lengths)
        inside = np.ones(len(symbols), bool)
        for k in range(1, self.length):  # passages that would run on into the next text
            inside[ends - k] = False
        place = place[inside[: len(place)]]
        place = place[np.r_[True, place[1:] != place[:-1]]]
        return grams[place], np.searchsorted(ends, place, "right")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(t0, t1, copies, first_doc, text): each text once; null counts as empty."""
    t0, t1 = text_key(F.coalesce("text", F.lit("")))
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), t0.alias("t0"), t1.alias("t1"))
        .groupBy("t0", "t1")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.first("text").alias("text"))
    )


_GRAMS = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("t0", pa.int64()), ("t1", pa.int64())])
_AROUND = pa.schema([("g", pa.int64()), ("t0", pa.int64()), ("t1", pa.int64()), ("first_doc", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("around", pa.binary())])
_PASSAGES = pa.schema([(name, pa.int64()) for name in ("w0", "w1", "n", "t0", "t1", "first_doc", "start")])
#: ``places``: how often the string starts anywhere; ``long``: whether it has ``Passages.long`` symbols (1) or less (0).
_SPANS = pa.schema([(name, pa.int64()) for name in ("t0", "t1", "start", "stop", "long", "places")])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint'}" for f in schema)


def _columns(schema: pa.Schema, parts: Iterable[tuple], rows_max: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches from tuples of arrays; a single number stands for its column."""
    held: list[tuple] = []
    size = 0
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)

    for part in parts:
        n = len(part[0])
        held.append(tuple(c if isinstance(c, np.ndarray) else np.full(n, c, np.int64) for c in part))
        size += n
        if size >= rows_max:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _stretches(batches: Iterable[pa.RecordBatch], kind: Passages) -> Iterator[tuple]:
    """Keys, lengths and symbols of successive texts, so many that array operations pay."""
    rows, parts, size = [], [], 0
    for t0, t1, _, _, text in rows_of(batches):
        symbols = kind.symbols(text)
        if len(symbols) >= kind.length:
            rows.append((t0, t1))
            parts.append(symbols)
            size += len(symbols)
        if size >= 1 << 16:
            yield rows, np.array([len(p) for p in parts]), np.concatenate(parts)
            rows, parts, size = [], [], 0
    if rows:
        yield rows, np.array([len(p) for p in parts]), np.concatenate(parts)


def _counted(key: np.ndarray, text: np.ndarray, rows: list[tuple[int, int]]) -> tuple:
    """(key, n, t0, t1): how often each text has each key."""
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)])
    keys = np.array(rows, np.int64)[text[first]]
    return key[first].view(np.int64), np.diff(np.r_[first, len(key)]), keys[:, 0], keys[:, 1]


def _wanted(counted: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """(t0, t1, few) and (t0, t1, many): the keys of each text that occur again, up to ``group`` times and oftener.

    Counted by the complement, so that the joins' both sides come straight from shuffles of their
    own, which adaptive execution can split where one key is very frequent, or drop where none is.
    """
    again = counted.groupBy(F.bitwise_not("g").alias("k")).agg(F.sum("n").alias("count")).filter("count > 1").select(F.bitwise_not("k").alias("g"), "count")
    ways = {"few": F.col("count") <= group, "many": F.col("count") > group}
    return tuple(counted.join(again.filter(among), "g").groupBy("t0", "t1").agg(F.collect_set("g").alias(name)) for name, among in ways.items())


def repeated_spans(texts: DataFrame, kind: Passages, search: Callable, first_stays: bool, group: int = 20_000) -> DataFrame:
    """(t0, t1, start, stop, long, places): the runs of symbols that are repeats in each text, maybe overlapping.

    ``search(members)`` gets the members (t0, t1, first_doc, place, first, around) of one
    key and yields spans. ``first_stays``: the first occurrence of a passage (by document,
    then start) is not marked.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _columns(_GRAMS, (_counted(*kind.anchors_of_many(symbols, lengths), rows) for rows, lengths, symbols in _stretches(batches, kind)))

    def anchors(symbols: np.ndarray, wanted: list[int]) -> tuple[np.ndarray, ...]:
        gram, *rest = kind.anchors(symbols)
        keep = np.isin(gram.view(np.int64), np.array(wanted, np.int64))
        return gram[keep], *(c[keep] for c in rest)

    def split(symbols: np.ndarray, grams: list[int], wanted: list[int]) -> tuple[np.ndarray, ...]:
        key, *rest = kind.pieces(symbols, *anchors(symbols, grams)[1:])
        keep = np.isin(key.view(np.int64), np.array(wanted, np.int64))
        return key[keep], *(c[keep] for c in rest)

    def piece_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for t0, t1, _, _, text, frequent in rows_of(batches):
                symbols = kind.symbols(text)
                key = kind.pieces(symbols, *anchors(symbols, frequent)[1:])[0]
                yield _counted(key, np.zeros(len(key), np.int64), [(t0, t1)])

        return _columns(_GRAMS, parts())

    def around(key: tuple, text: bytes, places: tuple[np.ndarray, ...]) -> Iterator[tuple]:
        t0, t1, doc = key
        symbols = kind.split(text)
        for g, p, a, z in zip(places[0].view(np.int64).tolist(), *(c.tolist() for c in places[1:]), strict=True):
            yield g, t0, t1, doc, p, a, kind.cut(symbols, a, z + kind.long)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for t0, t1, _, doc, text, few in rows_of(batches):
                yield from around((t0, t1, doc), text, anchors(kind.symbols(text), few))

        return batched(rows(), _AROUND, lambda row: 60 + len(row[-1]))

    def piece_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for t0, t1, _, doc, text, frequent, few in rows_of(batches):
                yield from around((t0, t1, doc), text, split(kind.symbols(text), frequent, few))

        return batched(rows(), _AROUND, lambda row: 60 + len(row[-1]))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for t0, t1, _, doc, text, frequent, many in rows_of(batches):
                symbols = kind.symbols(text)
                _, _, first, last = split(symbols, frequent, many)
                every = np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last, strict=True)])
                for n in {kind.length, kind.long}:
                    start = every[every <= len(symbols) - n]
                    yield *(gram_hashes(symbols, n, base).view(np.int64)[start] for base in BASES), n, t0, t1, (1 << 63) - 1 if doc is None else doc, start

        return _columns(_PASSAGES, parts())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, members in groupby(rows_of(batches), itemgetter(0)):
                held = [m[1:] for m in members]
                if len(held) > 1:
                    yield from search(held)

        return batched(rows(), _SPANS, lambda row: 48)

    def in_groups(rows: DataFrame) -> DataFrame:
        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(searched, _ddl(_SPANS))

    few, frequent = _wanted(texts.mapInArrow(grams, _ddl(_GRAMS)), group)
    split_up = texts.join(frequent.withColumnRenamed("many", "frequent"), ["t0", "t1"])
    few_pieces, many_pieces = _wanted(split_up.mapInArrow(piece_keys, _ddl(_GRAMS)), group)
    around_all = texts.join(few, ["t0", "t1"]).mapInArrow(surroundings, _ddl(_AROUND))
    around_all = around_all.unionByName(split_up.join(few_pieces, ["t0", "t1"]).mapInArrow(piece_surroundings, _ddl(_AROUND)))
    spans = around_all.repartition("g").sortWithinPartitions("g").mapInArrow(searched, _ddl(_SPANS))
    return spans.unionByName(_same_passages(split_up.join(many_pieces, ["t0", "t1"]).mapInArrow(passages, _ddl(_PASSAGES)), kind.long, first_stays))


def _same_passages(alike: DataFrame, long: int, first_stays: bool) -> DataFrame:
    """Spans of the passages in ``alike`` whose hashes occur again; by the complement again, for the same reason."""
    order = F.struct("first_doc", "t0", "t1", "start")
    counted = (
        alike.groupBy(F.bitwise_not("w0").alias("k0"), F.bitwise_not("w1").alias("k1"), "n")
        .agg(F.count("*").alias("places"), F.min(order).alias("least"))
        .filter("places > 1")
        .select(F.bitwise_not("k0").alias("w0"), F.bitwise_not("k1").alias("w1"), "n", "least", "places")
    )
    common = alike.join(counted, ["w0", "w1", "n"])
    if first_stays:
        common = common.filter(order != F.col("least"))
    return common.select("t0", "t1", "start", (F.col("start") + F.col("n")).alias("stop"), (F.col("n") == long).cast("bigint").alias("long"), "places")


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with the sorted starts, stops and kinds of each text's spans, or null, and the most places of one."""
    by_text = spans.groupBy("t0", "t1").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "long"))).alias("spans"), F.max("places").alias("places"))
    return texts.join(by_text, ["t0", "t1"], "left").select("t0", "t1", "copies", "first_doc", "text", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"), F.col("spans.long").alias("long"), "places")


def merged(starts: Iterable[int] | None, stops: Iterable[int] | None) -> list[tuple[int, int]]:
    """Maximal runs that the spans, sorted by start, cover."""
    runs: list[list[int]] = []
    for a, z in zip(starts or [], stops or [], strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    return [(a, z) for a, z in runs]

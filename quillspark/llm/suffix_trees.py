"""Removal of repeated word sequences, by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.anchors import BYTES, Passages, distinct_texts, merged, repeated_spans, run_hashes, with_spans
from quillspark.llm.cluster import batched, rows_of
from quillspark.llm.columns import WHITE, text_key

#: Whether a byte is ASCII white space, where ``bytes.split`` splits too.
_WHITE = np.isin(np.arange(256), list(WHITE.encode()))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (uint64)."""
    raw = np.frombuffer(text, np.uint8)
    white = np.ones(len(raw) + 2, np.int8)
    white[1:-1] = _WHITE[raw]
    edges = np.flatnonzero(np.diff(white))
    return run_hashes(BYTES[raw], edges[::2], edges[1::2])


def word_passages(length: int) -> Passages:
    return Passages(
        length=length, reach=max(1, length * 3 // 5), long=length, split=bytes.split,  # at ASCII white space
        symbols=word_hashes, cut=lambda words, a, z: b" ".join(words[a:z]),
    )


def deep_nodes(suffixes: list[tuple[list[bytes], int]], depth: int) -> Iterator[list[int]]:
    """The suffix tree of ``suffixes`` (words, number), by its nodes at ``depth`` words: the
    numbers of the suffixes below each node that has two or more.

    Children are split off word by word, but only while a node has two suffixes, so paths
    with one suffix stay unbuilt and a branch of equal words is walked once.
    """
    stack = [(0, suffixes)]
    while stack:
        at, below = stack.pop()
        if at == depth:
            yield [number for _, number in below]
            continue
        head = below[0][0]
        while at < depth and all(words[at] == head[at] for words, _ in below):
            at += 1
        if at == depth:
            yield [number for _, number in below]
            continue
        children: dict[bytes, list] = {}
        for suffix in below:
            children.setdefault(suffix[0][at], []).append(suffix)
        stack.extend((at + 1, child) for child in children.values() if len(child) > 1)


def _search(length: int):
    def search(members: list[tuple]) -> Iterator[tuple]:
        """The first occurrence of each passage stays; the gram is a prefix of every suffix at the anchor."""
        members.sort(key=lambda m: (m[2] is None, m[2] or 0, m[0], m[1], m[4]))
        first_with: dict[tuple, tuple] = {}
        for m in members:
            t0, t1, _, place, first, text = m
            if (place - first, text) in first_with:  # all its passages have come before
                yield t0, t1, first, first + text.count(b" ") + 1, 1, 2
            else:
                first_with[place - first, text] = m
        if len(first_with) == 1:
            return
        # passages at the same distance from the anchor start alike or differ: a subtree for each distance
        subtrees: dict[int, list[tuple[list[bytes], int]]] = {}
        kept = list(first_with.values())
        for number, (_, _, _, place, first, text) in enumerate(kept):
            words = text.split(b" ")
            for start in range(len(words) - length + 1):
                subtrees.setdefault(place - first - start, []).append((words[start : start + length], number))
        for before, suffixes in subtrees.items():
            if len(suffixes) > 1:
                for below in deep_nodes(suffixes, length):
                    for number in sorted(below)[1:]:  # members are in order of occurrence
                        t0, t1, _, place, _, _ = kept[number]
                        yield t0, t1, place - before, place - before + length, 1, len(below)

    return search


_CLEAN = pa.schema([("t0", pa.int64()), ("t1", pa.int64()), ("first_doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
_EMPTY = hashlib.sha256(b"").hexdigest()


def remove_repeated_words(docs: DataFrame, length: int = 20, group: int = 20_000, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_words, n_removed, kept_sha256), and kept
    (binary) with ``keep_text``.

    Each word goes that a window of ``length`` words covers whose words also start earlier:
    in a smaller doc_id, or earlier in the same text. A later copy of a text goes wholly if
    it has ``length`` words. Rows that repeat the smallest doc_id of a text all count as its
    first; different texts under one doc_id are ordered by their hashes; a null doc_id
    comes after all others. Null and empty texts have no words; texts of any length are read
    whole; no rows give no rows. Other columns are ignored.
    """
    kind = word_passages(length)
    texts = distinct_texts(docs)
    spans = repeated_spans(texts, kind, _search(length), first_stays=True, group=group)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for t0, t1, _, doc, text, starts, stops, _, _ in rows_of(batches):
                words = text.split()
                edges = [0, *(e for run in merged(starts, stops) for e in run), len(words)]
                kept = b" ".join(w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z])
                gone = sum(z - a for a, z in zip(edges[1::2], edges[2::2], strict=False))
                yield t0, t1, doc, len(words), gone, kept if keep_text else None, hashlib.sha256(kept).hexdigest()

        return batched(rows(), _CLEAN, lambda row: 120 + len(row[5] or b""))

    cleaned = with_spans(texts, spans).mapInArrow(clean, "t0 bigint, t1 bigint, first_doc bigint, n_words bigint, n_removed bigint, kept binary, kept_sha256 string")
    t0, t1 = text_key(F.coalesce("text", F.lit("")))
    joined = docs.select("doc_id", t0.alias("t0"), t1.alias("t1")).join(cleaned, ["t0", "t1"])
    later = ~F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("n_words") >= length)
    return joined.select(
        "doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *[F.when(later, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] * keep_text,
    )

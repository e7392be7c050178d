"""Removal of repeated byte strings, by interval trees over enhanced suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.anchors import BYTES, Passages, distinct_texts, merged, repeated_spans, with_spans
from quillspark.llm.cluster import batched, rows_of
from quillspark.llm.columns import text_key


def common_prefix(a: bytes, b: bytes) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, left, right), ends included: the nodes of the interval tree over the sorted
    suffixes of which ``lcp[i]`` leading symbols of suffix i equal those of suffix i - 1
    (``lcp[0]`` is ignored). Children come before their parents."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        height = lcp[i] if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > height:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if not stack or stack[-1][0] < height:
            stack.append((height, left))


def maximal_repeats(members: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(before, after, occurrences): the maximal repeats of ``length`` bytes or more among members
    (reversed left context, right context): groups that agree in ``before`` bytes to the left and
    ``after`` to the right, and in no further byte on either side.

    The right contexts are the suffix array. At each node of its interval tree the left
    contexts, sorted in reverse, are a suffix array of their own, whose intervals are
    left-diverse: some members differ in the byte before. One that isn't right-diverse, as all
    its members lie below one child of the node, is left to that child.
    """
    order = sorted(range(len(members)), key=lambda m: members[m][1])
    lcp = [0, *(common_prefix(members[a][1], members[b][1]) for a, b in zip(order, order[1:], strict=False))]
    for after, left, right in intervals(lcp):
        if right == left:
            continue
        inside = sorted(order[left : right + 1], key=lambda m: members[m][0])
        back = [0, *(common_prefix(members[a][0], members[b][0]) for a, b in zip(inside, inside[1:], strict=False))]
        if max(back) + after < length:
            continue
        for before, lo, hi in intervals(back):
            if hi > lo and before + after >= length and diverse(members[m][1][after : after + 1] for m in inside[lo : hi + 1]):
                yield before, after, inside[lo : hi + 1]


def diverse(following: Iterable[bytes]) -> bool:
    """Whether the next bytes differ; an end counts as different from all, another end too."""
    seen = None
    for b in following:
        if not b or seen is not None and b != seen:
            return True
        seen = b
    return False


def repeats_at_anchor(members: list[tuple], length: int) -> Iterator[tuple[int, int, int, list[tuple]]]:
    """(before, after, places, occurrences) of each maximal repeat around the anchor that ``members`` (t0, t1, first_doc, place, first, around) share."""
    # members with the same surroundings are one row of the suffix array
    alike: dict[tuple[int, bytes], list[tuple]] = {}
    for t0, t1, _, place, first, text in members:
        alike.setdefault((place - first, text), []).append((t0, t1, place))
    rows = sorted(alike)
    for off, text in rows:
        held = alike[off, text]
        if len(held) > 1 and len(text) >= length:
            yield off, len(text) - off, len(held), held
    if len(rows) > 1:
        for before, after, found in maximal_repeats([(text[:off][::-1], text[off:]) for off, text in rows], length):
            occurrences = [m for k in found for m in alike[rows[k]]]
            yield before, after, len(occurrences), occurrences


#: Groups of more rows than this are searched by cuts of their trees instead of node by node.
SMALL = 48


def _reaches(rows: list[tuple[int, bytes]], counts: np.ndarray, lengths: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """(before, after, places) of each of ``rows`` (offset of the anchor, text) for each of ``lengths``: how far its repeats of so many bytes
    reach to the left and to the right of the anchor, together one run, and how often the commonest starts; (0, 0, 0) without any.

    Right contexts and reversed left contexts are each a sorted suffix array with common prefixes. A cut
    of the right tree at depth ``length - a`` and of the left tree at depth ``a`` puts rows into the same interval of both
    exactly if they share the string of ``length`` bytes that begins ``a`` before the anchor. So the work is that of one sort for
    each distance to the anchor, whatever the number of repeats nested in each other.
    """
    n = len(rows)
    trees = []
    for contexts in ([text[:off][::-1] for off, text in rows], [text[off:] for off, text in rows]):
        order = sorted(range(n), key=contexts.__getitem__)
        common = np.array([0, *(common_prefix(contexts[x], contexts[y]) for x, y in zip(order, order[1:], strict=False))])
        trees.append((np.array(order), common))
    (left, left_common), (right, right_common) = trees
    # the longest prefix that each right context shares with another
    shared = np.zeros(n, np.int64)
    shared[right] = np.maximum(right_common, np.append(right_common[1:], 0))

    def cut(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
        """The number of each row's interval at a depth."""
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    for length in lengths:
        first, last, places = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
        for distance in range(min(int(left_common.max()), length) + 1):
            both = cut(left, left_common, distance) * (n + 1) + cut(right, right_common, length - distance)
            order = np.argsort(both, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(both[order]) > 0)))
            sizes = np.diff(np.append(starts, n))
            if sizes.max() == 1:
                continue
            several = order[np.repeat(sizes > 1, sizes)]
            first[several] = np.where(first[several] < 0, distance, first[several])
            last[several] = distance
            total = np.repeat(np.add.reduceat(counts[order], starts), sizes)[np.repeat(sizes > 1, sizes)]
            places[several] = np.maximum(places[several], total)
        # a string that could begin later would have been found there, but for one that begins at the anchor
        after = np.where(first == 0, shared, length - first)
        yield [(b, a, p) if b >= 0 else (0, 0, 0) for b, a, p in zip(last.tolist(), after.tolist(), places.tolist(), strict=True)]


def _search(length: int, long: int):
    def in_large(members: list[tuple]) -> Iterator[tuple]:
        alike: dict[tuple[int, bytes], list[tuple]] = {}
        for t0, t1, _, place, first, text in members:
            alike.setdefault((place - first, text), []).append((t0, t1, place))
        rows = sorted(alike)
        counts = np.array([len(alike[r]) for r in rows])
        for is_long, found in enumerate(_reaches(rows, counts, [length] if long == length else [length, long])):
            kinds = (0, 1) if long == length else (is_long,)
            for row, (before, after, places) in zip(rows, found, strict=True):
                held = alike[row]
                if len(held) > 1 and len(row[1]) >= (long if is_long else length):  # copies share all there is
                    before, after, places = row[0], len(row[1]) - row[0], max(places, len(held))
                if places:
                    yield from ((t0, t1, place - before, place + after, kind, places) for t0, t1, place in held for kind in kinds)

    def search(members: list[tuple]) -> Iterator[tuple]:
        if len(members) > SMALL:
            yield from in_large(members)
            return
        # all repeats of a member hold the anchor, so together they are one run
        runs: dict[tuple[tuple, int], list[int]] = {}
        for before, after, places, occurrences in repeats_at_anchor(members, length):
            for member in occurrences:
                for is_long in (0, 1) if before + after >= long else (0,):
                    run = runs.setdefault((member, is_long), [0, 0, 0])
                    run[:] = max(run[0], before), max(run[1], after), max(run[2], places)
        for ((t0, t1, place), is_long), (before, after, places) in runs.items():
            yield t0, t1, place - before, place + after, is_long, places

    return search


def byte_passages(length: int, long: int | None = None) -> Passages:
    return Passages(
        length=length, reach=max(1, length // 2), long=long or length, split=lambda text: text,
        symbols=lambda text: BYTES[np.frombuffer(text, np.uint8)], cut=lambda text, a, z: text[a:z],
    )


def repeat_groups(docs: DataFrame, length: int = 256, group: int = 20_000) -> DataFrame:
    """(repeat, n_bytes, places, t0, t1, start): the maximal repeats of ``length`` bytes or more
    with all their occurrences, a row for each; ``repeat`` stands for the string, (t0, t1) for
    the text, and places counts the occurrences in distinct texts.

    Repeats are maximal within the surroundings of an anchor, up to twice ``length``; a longer
    one shows as several that overlap. Those of a passage in more than ``group`` places are its
    ``length`` bytes. Null and empty texts have none; rows with the same text are one; no rows give no rows; other columns are ignored.
    """

    def search(members: list[tuple]) -> Iterator[tuple]:
        for before, after, places, occurrences in repeats_at_anchor(members, length):
            yield from ((t0, t1, place - before, place + after, 1, places) for t0, t1, place in occurrences)

    texts = distinct_texts(docs)
    spans = repeated_spans(texts, byte_passages(length, length), search, first_stays=False, group=group)
    string = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    return spans.join(texts, ["t0", "t1"]).select(F.xxhash64(string).alias("repeat"), (F.col("stop") - F.col("start")).alias("n_bytes"), "places", "t0", "t1", "start").distinct()


_CLEAN = pa.schema([
    ("t0", pa.int64()), ("t1", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()),
    ("n_shared", pa.int64()), ("longest_shared", pa.int64()), ("most_places", pa.int64()),
])
_CLEAN_DDL = "t0 bigint, t1 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string, n_shared bigint, longest_shared bigint, most_places bigint"


def remove_repeats(docs: DataFrame, length: int = 400, group: int = 20_000, keep_text: bool = False, shared: int | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_bytes, n_removed, n_spans, kept_sha256),
    kept (binary) with ``keep_text``, and (n_shared, longest_shared, most_places) with ``shared``.

    Each byte goes that a string of ``length`` bytes covers which also starts anywhere else,
    in this text or another row's; a null text is empty. All copies of a text of ``length``
    bytes or more go wholly, and rows that repeat a doc_id, or have none, are copies like any
    other. Texts shorter than ``length`` stay, however long others are. n_shared counts the
    bytes that repeats of only ``shared`` bytes (at most ``length``) cover, longest_shared those
    of the longest run, and most_places how often the commonest of them starts in distinct
    texts, or a copied text in rows; they remove nothing. No rows give no rows. Other columns are ignored.
    """
    kind = byte_passages(min(shared or length, length), length)
    texts = distinct_texts(docs)
    spans = repeated_spans(texts, kind, _search(kind.length, length), first_stays=False, group=group)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for t0, t1, copies, _, text, starts, stops, long, places in rows_of(batches):
                spans = list(zip(starts or [], stops or [], long or [], strict=True))
                runs = merged([a for a, _, is_long in spans if is_long], [z for _, z, is_long in spans if is_long])
                found = merged(starts, stops)
                if copies > 1 and len(text) >= kind.length:
                    found, places = [(0, len(text))], max(copies, places or 0)
                    runs = found if len(text) >= length else runs
                edges = [0, *(e for run in runs for e in run), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                sizes = [z - a for a, z in found]
                yield t0, t1, len(text), len(text) - len(kept), len(runs), kept if keep_text else None, hashlib.sha256(kept).hexdigest(), sum(sizes), max(sizes, default=0), places or 0

        return batched(rows(), _CLEAN, lambda row: 150 + len(row[5] or b""))

    cleaned = with_spans(texts, spans).mapInArrow(clean, _CLEAN_DDL)
    t0, t1 = text_key(F.coalesce("text", F.lit("")))
    out = docs.select("doc_id", t0.alias("t0"), t1.alias("t1")).join(cleaned, ["t0", "t1"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text, *["n_shared", "longest_shared", "most_places"] * (shared is not None))

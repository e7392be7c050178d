"""Packing of tokenised documents into windows, by non-negative least squares over length combinations."""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import batched, rows_of, written

#: Tokens that are packed together, at most; a group's last window alone may be padded much.
GROUP_TOKENS = 8_000_000
SLOTS = 128


class Encoder:
    """Ids of whole texts. No token of the vocabulary crosses white space, so a text's ids are
    those of its parts between blanks, and the ids of parts are kept for the next time. The
    vocabulary composes, lower-cases, splits off points and pairs bytes; a word of lower-case
    Latin letters is changed by none but the last of these, so its bytes go to the pairing at once."""

    #: After one of these letters a full stop or comma at a part's end is a token of its own. Others may
    #: become a letter and a combining mark, and the mark joins the point.
    LETTERS = frozenset(chr(c) for c in range(0x100) if chr(c).isalpha() and chr(c) not in "\xaa\xb5\xba")
    #: Parts kept: half of them as the newest generation, the others as the one before.
    KEPT = 1_000_000

    def __init__(self, path: str, end_id: int):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end = np.array(end_id, "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.points = dict(zip(",.", self._encode([",", "."]), strict=True))

    @classmethod
    def of_process(cls, path: str, end_id: int) -> Encoder:
        """This process's encoder: a Python worker serves one task after another, and knows more parts each time."""
        if (path, end_id) not in _encoders:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _encoders[path, end_id] = cls(path, end_id)
        return _encoders[path, end_id]

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return np.array([token.id for token in self.model.tokenize(letters)], "<u4").tobytes()

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _stem(self, part: str) -> str:
        """The part without a point that is a token of its own."""
        return part[:-1] if part[-1:] in self.points and part[-2:-1] in self.LETTERS else part

    def _learn(self, parts: set[str]) -> None:
        known, older = self.known, self.older
        fresh = []
        for part in parts:
            if part in older:
                known[part] = older[part]
            else:
                fresh.append(part)
        others = []
        for stem in {self._stem(part) for part in fresh}.difference(known):
            if stem.islower() and self.LETTERS.issuperset(stem):
                known[stem] = self._word(stem)
            else:
                others.append(stem)
        known.update(zip(others, self._encode(others), strict=True))
        for part in fresh:
            if part not in known:
                known[part] = known[self._stem(part)] + self.points[part[-1]]

    def __call__(self, text: str) -> bytes:
        """The ids and the end id, four little-endian bytes each."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if "<|" not in text and _latin(text):
            text = text.lower()  # as the vocabulary does; more parts are then known
        parts = text.split(" ")
        if len(self.known) > self.KEPT // 2:
            self.known, self.older = {}, self.known
        new = set(parts).difference(self.known)
        if new:
            self._learn(new)
        return b"".join(map(self.known.__getitem__, parts)) + self.end


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: itself if it's printable and no blank, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: 0x100 + at for at, byte in enumerate(b for b in range(0x100) if b not in plain)}


_BYTE_LETTERS = _byte_letters()


def _latin(text: str) -> bool:
    """Whether all code points are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[tuple[str, int], Encoder] = {}


def combinations(slots: int = SLOTS, depth: int = 3) -> np.ndarray:
    """Columns of counts: the ways to fill ``slots`` with at most ``depth`` lengths of 1 to ``slots``."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], least: int, left: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < depth:
            for n in range(least, left + 1):
                if n == left or (left - n >= n and len(head) + 2 <= depth):
                    extend((*head, n), n, left - n)

    extend((), 1, slots)
    a = np.zeros((slots, len(found)))
    for k, parts in enumerate(found):
        for n in parts:
            a[n - 1, k] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that makes |a x - b| least: the column with the steepest descent joins the
    positive set; where its least-squares solution turns negative, the step is cut and the
    columns at zero leave."""
    x = np.zeros(a.shape[1])
    inside = np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).sum()))
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[inside] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= tolerance:
            break
        inside[k] = True
        while True:
            at = np.flatnonzero(inside)
            wanted = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (wanted > 0).all():
                x[:] = 0
                x[at] = wanted
                break
            low = wanted <= 0
            part = x[at][low] / np.maximum(x[at][low] - wanted[low], 1e-300)
            x[at] += part.min() * (wanted - x[at])
            inside[at[low & (x[at] <= 1e-12 * max(1.0, x.max()))]] = False
            x[~inside] = 0
            if not inside.any():
                break
    return x


def solve(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], float]]:
    """The combinations to pack by, for a histogram of remainders: ((class, how many), ..) of each with its
    repeats for one remainder, the most frequent first."""
    a = combinations(len(counts))
    repeats = nnls(a, counts) / max(1.0, counts.sum())
    return [([(int(m), int(a[m, k])) for m in np.flatnonzero(a[:, k])], float(repeats[k])) for k in np.argsort(-repeats, kind="stable") if repeats[k] > 0]


def pack(lengths: list[int], window: int, ways: list[tuple[list[tuple[int, int]], float]] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length), at most ``window`` together.

    Full windows are cut off first. The remainders are counted in classes of window / 128
    tokens; the repeat counts of the combinations that fill a window are these documents' share of
    ``ways`` (by default :func:`solve` for their own histogram), rounded, down to what there is.
    What no combination took fills the small gaps and then further windows, cut where a window ends.
    """
    slots = min(SLOTS, window)
    unit = window / slots
    classes: list[deque] = [deque() for _ in range(slots)]
    for document, n in enumerate(lengths):
        start = 0
        while n - start >= window:
            yield [(document, start, window)]
            start += window
        if n > start:
            classes[int(np.ceil((n - start) / unit)) - 1].append((document, start, n - start))
    counts = np.array([len(c) for c in classes], float)
    filled: list[list[tuple[int, int, int]]] = []
    for need, repeats in solve(counts) if ways is None else ways:
        for _ in range(min(int(np.rint(repeats * counts.sum())), *(len(classes[m]) // n for m, n in need))):
            filled.append([classes[m].popleft() for m, n in need for _ in range(n)])
    rest = deque(piece for c in reversed(classes) for piece in c)
    for sequence in chain(filled, iter(lambda: [], None)):
        room = window - sum(n for _, _, n in sequence)
        while room and rest:
            document, start, n = rest.popleft()
            taken = min(n, room)
            sequence.append((document, start, taken))
            room -= taken
            if taken < n:
                rest.appendleft((document, start + taken, n - taken))
        if sequence:
            yield sequence
        elif not rest:
            break


_TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_TOKENS_DDL = "doc_id bigint, n bigint, ids binary"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
])
_PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n, ids): the ids and the end id, four little-endian bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of_process(tokenizer, end_id)
        rows = ((doc, encode(text or "")) for doc, text in rows_of(batches))
        return batched(((doc, len(ids) // 4, ids) for doc, ids in rows), _TOKENS, lambda row: 32 + len(row[-1]))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _TOKENS_DDL)


def histogram(tokens: DataFrame, window: int) -> np.ndarray:
    """How many rows of ``tokens`` have a remainder of each class; at most 128 counts."""
    slots = min(SLOTS, window)
    left = F.pmod("n", F.lit(window))
    found = tokens.filter(left > 0).groupBy((F.ceil(left * slots / window) - 1).cast("int").alias("at")).count().collect()
    counts = np.zeros(slots)
    for at, n in found:
        counts[at] = n
    return counts


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, group_tokens: int = GROUP_TOKENS, with_ids: bool = True) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text), one row each: (doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset), and ids (null without ``with_ids``).

    Each id is in exactly one piece; a null or empty text is the id ``end_id`` alone, and a text
    may have 2^29 ids, as many as a value of 2^31 bytes holds; one with more fails the job. The ids are written once to the shared folder; the repeat counts are solved once, from the
    histogram of all rows, and each partition packs what it reads, in groups of at most
    ``group_tokens`` (or one document) that take their share of them. So nothing but counts is shuffled;
    sequence_ids hold the partition. Rows that repeat a doc_id are packed each. Other columns are
    ignored; no rows give no pieces.
    """
    tokens, _ = written(tokenized(docs, tokenizer, end_id))
    ways = solve(histogram(tokens, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()

        def groups() -> Iterator[list[tuple[int, int, bytes]]]:
            held, size = [], 0
            for row in rows_of(batches):
                if held and size + row[1] > group_tokens:
                    yield held
                    held, size = [], 0
                held.append(row)
                size += row[1]
            if held:
                yield held

        def rows() -> Iterator[tuple]:
            sequence_id = partition << 40
            for group in groups():
                for sequence in pack([n for _, n, _ in group], window, ways):
                    offset = 0
                    for document, start, n in sequence:
                        doc, whole, ids = group[document]
                        piece = memoryview(ids)[4 * start : 4 * (start + n)]
                        yield doc, start, n, zlib.crc32(piece), whole, sequence_id, offset, np.frombuffer(piece, "<u4").tolist() if with_ids else None
                        offset += n
                    sequence_id += 1

        return batched(rows(), _PIECES, lambda row: 80 + 8 * len(row[-1] or ()))

    return tokens.mapInArrow(run, _PIECES_DDL)

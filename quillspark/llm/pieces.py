"""SentencePiece byte-pair encoding and decoding, in vectorised merge rounds."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from quillspark.llm.cluster import rows_of

#: What stands for a space in pieces (fixed value).
SPACE = "▁"
#: Beyond every rank.
NONE = np.iinfo(np.int32).max
#: Words of more symbols are merged with a queue instead of rounds, whose number grows with a word's length.
LONG = 4096
#: Words that a task remembers.
REMEMBERED = 400_000
CODES = 0x110000
#: The pattern of words where pieces may reach over anything.
WHOLE = "(?s:.+)"
#: Characters that are split into words, and ids that are written out, at once.
PART = 1 << 20
#: Pairs are looked up in a table of so many bits of their hashes.
SLOT_BITS = 19


@dataclass(frozen=True)
class Vocabulary:
    """A model as arrays. Symbols below ``size`` are pieces; ``size`` plus a code point is a character without piece."""

    size: int
    pieces: list[bytes]  # what a decoder writes for each id
    control: np.ndarray  # ids that write nothing
    bytes_at: np.ndarray  # the id of each byte's piece
    is_byte: np.ndarray
    chars: dict[int, int]  # code points that are pieces
    pairs: np.ndarray  # sorted: left symbol * size + right symbol
    merged: np.ndarray  # the piece that each pair makes
    ranks: np.ndarray  # its rank; pieces of one score share one
    inner: np.ndarray  # sorted: code point pairs that stand side by side in some piece, first << 21 | second
    early: np.ndarray  # pieces that are part of a pair that comes no later than they themselves
    words: str  # pattern of the words, between which no piece can reach


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model of the kind BPE, with byte fallback, a dummy prefix and no other normalisation.

    Models of other kinds, with a normaliser or with user-defined pieces, raise ValueError.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    odd = [model.is_control(i) or model.is_byte(i) or model.is_unknown(i) for i in range(size)]
    normal = {names[i]: i for i in range(size) if not odd[i]}
    byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
    probe = " ａ  b\t"
    if len(byte_ids) != 256 or any(model.is_unused(i) for i in range(size)) or model.decode(model.encode(probe)) != probe or any(c not in normal for name in normal for c in name):
        raise ValueError("not a byte-fallback BPE model without normalisation")
    scores = np.array([model.get_score(i) for i in range(size)])
    rank_of = np.unique(-scores, return_inverse=True)[1]
    pairs, merged = [], []
    for name, made in normal.items():
        for k in range(1, len(name)):
            left, right = normal.get(name[:k]), normal.get(name[k:])
            if left is not None and right is not None:
                pairs.append(left * size + right)
                merged.append(made)
    order = np.argsort(np.array(pairs, np.int64))
    inner = {ord(a) << 21 | ord(b) for name in normal for a, b in zip(name, name[1:], strict=False)}
    made_of = np.array(merged, np.int32)[order]
    lefts, rights = np.divmod(np.array(pairs, np.int64)[order], size)
    early = np.zeros(size, bool)
    for side in (lefts, rights):
        early[side[rank_of[made_of] <= rank_of[side]]] = True
    surface = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(size)]
    for byte, i in byte_ids.items():
        surface[i] = bytes([byte])
    return Vocabulary(
        size, surface, np.array([model.is_control(i) for i in range(size)]), np.array([byte_ids[b] for b in range(256)], np.int32), np.array([model.is_byte(i) for i in range(size)]),
        {ord(name): i for name, i in normal.items() if len(name) == 1}, np.array(pairs, np.int64)[order], made_of, rank_of[made_of].astype(np.int32), np.array(sorted(inner), np.int64), early, _words(inner),
    )


def _words(inner: set[int]) -> str:
    """A pattern of words that no piece reaches over: spaces, marks and then other characters, each if there are any."""
    sides = [(chr(x >> 21), chr(x & 0x1FFFFF)) for x in inner]
    if any(b == SPACE != a for a, b in sides):
        return WHOLE
    marks = {chr(c) for c in range(128) if not chr(c).isalnum()}
    while mixed := {b for a, b in sides if a != SPACE and a not in marks and b in marks}:
        marks -= mixed
    if not marks:
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    m = "".join(f"\\x{ord(c):02x}" for c in sorted(marks))
    return f"{SPACE}*[{m}]*[^{SPACE}{m}]+|{SPACE}*[{m}]+|{SPACE}+"


class Encoder:
    """Texts to ids. Words that were encoded before are remembered, up to ``REMEMBERED``."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.symbols = np.arange(vocabulary.size, vocabulary.size + CODES, dtype=np.int32)
        self.symbols[list(vocabulary.chars)] = list(vocabulary.chars.values())
        self.split = re.compile(vocabulary.words).findall
        # where every piece ends before the space, texts may be cut there
        self.edge = None if vocabulary.words == WHOLE else re.compile(f"(?<!{SPACE}){SPACE}")
        self.known: dict[str, int] = {}  # the number of each word
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)  # the ids of all words, and where each word's begin
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)  # a place of ``pairs`` for each hash
        self.slots[_slot(vocabulary.pairs)] = np.arange(len(vocabulary.pairs), dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        held, owners, size = [], [], 0

        def flush() -> None:
            found, n = self._encode_parts(held)
            ids.append(found)
            np.add.at(counts, owners, n)
            held.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for part in self._parts(text):
                held.append(part)
                owners.append(k)
                size += len(part)
                if size >= PART:
                    flush()
                    size = 0
        if held:
            flush()
        return np.concatenate(ids), counts

    def _parts(self, text: str) -> Iterator[str]:
        """A text as the model sees it, in parts of about ``PART`` characters that begin with the space before a word."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)
        at = 0
        while self.edge is not None and len(text) - at > PART and (found := self.edge.search(text, at + PART)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(part) for part in parts]
        if len(self.known) > REMEMBERED:
            self.known, self.ids, self.first = {}, self.ids[:0], self.first[:1]
        if new := list(set(chain.from_iterable(split)).difference(self.known)):
            ids, first = self._encode_words(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.first = np.concatenate((self.first, first[1:] + len(self.ids)))
            self.ids = np.concatenate((self.ids, ids))
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        counts = self.first[words + 1] - self.first[words]
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.first[words] - upto[:-1], counts)]
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.diff(upto[ends], prepend=0)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Their ids one after the other, and where each word's begin and the last one's end."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.zeros(len(codes), bool)
        starts[0] = True
        starts[ends[:-1]] = True
        # no merge reaches over two characters that aren't neighbours in any piece
        starts[1:] |= ~_held(self.v.inner, codes[:-1] << 21 | codes[1:])
        ids, at = self._merge(self.symbols[codes], np.cumsum(starts) - 1)
        return self._with_bytes(ids, np.searchsorted(at, np.concatenate(([0], ends))))

    def _merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of the words that ``word`` numbers in ascending order: symbols, and where each starts."""
        done_symbols, done_at = [], []
        at = np.arange(len(symbols))
        lengths = np.bincount(word)
        if (lengths > LONG).any():
            for w in np.flatnonzero(lengths > LONG):
                a, b = np.searchsorted(word, [w, w + 1])
                merged, starts = self._merge_by_queue(symbols[a:b].tolist())
                done_symbols.append(np.array(merged, np.int32))
                done_at.append(at[a] + np.array(starts))
            rest = lengths[word] <= LONG
            symbols, word, at = symbols[rest], word[rest], at[rest]
        ranks, made = self._pairs(symbols, word)
        while len(symbols):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(ranks, begins)  # of each word
            sizes = np.diff(np.append(begins, len(symbols)))
            active = np.repeat(least < NONE, sizes)
            if not active.all():
                done_symbols.append(symbols[~active])
                done_at.append(at[~active])
                symbols, word, at, ranks, made = symbols[active], word[active], at[active], ranks[active], made[active]
                least, sizes = least[least < NONE], sizes[least < NONE]
                if not len(symbols):
                    break
            chosen = self._leftmost(np.flatnonzero(ranks == np.repeat(least, sizes)))
            chosen = self._safe(chosen, symbols, word, ranks, made)
            symbols[chosen] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, word, at, ranks, made = symbols[keep], word[keep], at[keep], ranks[keep], made[keep]
            # the pairs of what was merged, with what comes before and after it
            changed = chosen - np.arange(len(chosen))
            changed = np.concatenate((changed, np.maximum(changed - 1, 0)))
            after = np.minimum(changed + 1, len(symbols) - 1)
            within = (after > changed) & (word[after] == word[changed])
            ranks[changed] = NONE
            changed, after = changed[within], after[within]
            ranks[changed], made[changed] = self._look_up(symbols[changed], symbols[after])
        found, where = np.concatenate(done_symbols), np.concatenate(done_at)
        order = np.argsort(where)
        return found[order], where[order]

    def _pairs(self, left: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each symbol with the next of its word, and what they make."""
        ranks, made = np.full(len(left), NONE, np.int32), np.zeros(len(left), np.int32)
        if len(left) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            ranks[same], made[same] = self._look_up(left[same], left[same + 1])
        return ranks, made

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.v.size
        keys = np.where((left < size) & (right < size), left.astype(np.int64) * size + right, -1)
        at = self.slots[_slot(keys)]
        hit = (self.v.pairs[at] == keys) & (at >= 0)
        if len(other := np.flatnonzero(~hit & (at >= 0))):  # another pair has the slot
            at[other] = np.minimum(np.searchsorted(self.v.pairs, keys[other]), len(self.v.pairs) - 1)
            hit[other] = self.v.pairs[at[other]] == keys[other]
        return np.where(hit, self.v.ranks[at], NONE), np.where(hit, self.v.merged[at], 0)

    @staticmethod
    def _leftmost(places: np.ndarray) -> np.ndarray:
        """Of places that follow each other every second one, as their pairs overlap."""
        begins = np.concatenate(([True], places[1:] != places[:-1] + 1))
        run = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
        return places[(np.arange(len(places)) - run) % 2 == 0]

    def _safe(self, chosen: np.ndarray, symbols: np.ndarray, word: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> np.ndarray:
        """``chosen``, but only a word's first where a merge would make a pair that comes before the word's other merges."""
        if not self.v.early[made[chosen]].any():
            return chosen
        n, new = len(symbols), made[chosen]
        after = np.concatenate(([False], (chosen[1:] == chosen[:-1] + 2)))  # the symbol to the left is itself merged in this round
        left = np.where(after, np.concatenate(([0], new[:-1])), symbols[np.maximum(chosen - 1, 0)])
        has_left = (chosen > 0) & (word[np.maximum(chosen - 1, 0)] == word[chosen])
        right = np.minimum(chosen + 2, n - 1)
        has_right = (chosen + 2 < n) & (word[right] == word[chosen])
        limit = ranks[chosen]
        early = (has_left & (self._look_up(left, new)[0] <= limit)) | (has_right & (self._look_up(new, symbols[right])[0] <= limit))
        if not early.any():
            return chosen
        first = np.concatenate(([True], word[chosen[1:]] != word[chosen[:-1]]))
        return chosen[first | ~np.isin(word[chosen], word[chosen[early]])]

    def _merge_by_queue(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same merges one at a time, the least rank first and the leftmost of it."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks, made = (x.tolist() for x in self._pairs(np.array(symbols, np.int32), np.zeros(n, np.int32)))
        queue = [(rank, k, k + 1, symbols[k], symbols[k + 1], made[k]) for k, rank in enumerate(ranks) if rank != NONE]
        heapq.heapify(queue)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(a: int, b: int) -> None:
            key = symbols[a], symbols[b]
            if key not in known:
                rank, piece = self._look_up(np.array(key[:1]), np.array(key[1:]))
                known[key] = int(rank[0]), int(piece[0])
            rank, piece = known[key]
            if rank != NONE:
                heapq.heappush(queue, (rank, a, b, *key, piece))

        while queue:
            _, a, b, left, right, piece = heapq.heappop(queue)
            if symbols[a] != left or symbols[b] != right or after[a] != b:
                continue
            symbols[a], symbols[b] = piece, -1
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        starts = [k for k in range(n) if symbols[k] >= 0]
        return [symbols[k] for k in starts], starts

    def _with_bytes(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without piece become the pieces of their bytes; ``first`` moves along."""
        unknown = np.flatnonzero(ids >= self.v.size)
        if not len(unknown):
            return ids, first
        spelled = [chr(c).encode("utf-8", "replace") for c in (ids[unknown] - self.v.size).tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[unknown] = list(map(len, spelled))
        out = np.repeat(ids, counts)
        out[np.repeat(ids >= self.v.size, counts)] = self.v.bytes_at[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.concatenate(([0], np.cumsum(counts)))[first]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _held(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


class Decoder:
    """Ids to texts, many at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.data = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.lengths = np.array(list(map(len, vocabulary.pieces)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spaced = np.array([p[:1] == b" " for p in vocabulary.pieces]) & ~vocabulary.is_byte
        self.spaced[[i for i, p in enumerate(vocabulary.pieces) if p == " ⁇ ".encode()]] = False

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The text of each run of ``ids`` up to the next of ``ends``, in UTF-8."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.v.size):
            raise ValueError("an id outside the vocabulary")
        upto = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        data = b"".join(self._written(ids[k : k + PART]) for k in range(0, len(ids), PART))
        out = []
        for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
            text = data[upto[a] : upto[b]]
            shown = a
            while shown < b and self.v.control[ids[shown]]:
                shown += 1
            if shown < b and self.spaced[ids[shown]]:  # the space before the first word is no part of the text
                text = text[1:]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = mended(text)
            out.append(text)
        return out

    def _written(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        return self.data[np.arange(upto[-1]) + np.repeat(self.starts[ids] - upto[:-1], lengths)].tobytes()


def mended(data: bytes) -> bytes:
    """With U+FFFD for each byte that is no part of a character."""
    out, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[k : k + n].decode().encode())
            except UnicodeDecodeError:
                continue
            k += n
            break
        else:
            out.append("�".encode())
            k += 1
    return b"".join(out)


def sent_out(df: DataFrame, model: str) -> Broadcast:
    """The fields of the vocabulary; plain values, as executors need not have the package."""
    return df.sparkSession.sparkContext.broadcast(tuple(vars(load(model)).values()))


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, ids): the ids that the SentencePiece model at ``model`` gives each whole text,
    without begin or end ids.

    A null or empty text has no ids. Rows are encoded one by one, repeated or not, with null doc_ids or not; other columns
    are ignored; no rows give no rows. A text of any length is encoded whole: it is at most cut where no piece reaches over, so that memory
    doesn't grow with it, and words of over ``LONG`` symbols merge in n log n time. The arrays of the model, some megabytes
    whatever the corpus, are read on the driver and broadcast.
    """
    sent = sent_out(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*sent.value))
        for rows in sliced(rows_of(batches)):
            ids, counts = encoder.encode([(t or b"").decode("utf-8", "replace") for _, t in rows])
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    own = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS BINARY) AS text")
    return own.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` (doc_id, ids, ..) to (doc_id, ids, text): what the ids stand for.

    The space before a first word goes; control ids stand for nothing, bytes that are no part of a
    character for U+FFFD. Null or empty ids stand for the empty text; an id outside the vocabulary, or a null one, fails the job.
    """
    sent = sent_out(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(*sent.value))
        for whole in batches:
            upto, at = np.cumsum(whole.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
            while at < whole.num_rows:  # rows of about PART ids together
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART, "right")))
                batch, at = whole.slice(at, stop - at), stop
                ids = batch.column(1)
                counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = ids.flatten()
                if flat.null_count:
                    raise ValueError("a null id")
                texts = decoder.decode(flat.to_numpy(), np.cumsum(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")


def sliced(rows: Iterator[tuple], most: int = 256, size: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows in lists of at most ``most``, and of about ``size`` bytes of text."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[1] or b"")
        if len(held) >= most or total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held

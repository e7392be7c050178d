"""Quality classifier from the sizes that two zstandard dictionaries give a text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import batched, rows_of

LEVEL = 3


@dataclass(frozen=True)
class Sample:
    """The bound of the training sample: so many marked rows of each class at most, chosen by a hash of doc_id. Half of them make
    the dictionaries, from so many pieces each, drawn by a hash from all pieces of the text; the whole texts of the other half
    calibrate. One piece a row lets no text outweigh another, and did best in cross-validation on training rows."""

    rows: int = 2500
    pieces: int = 1
    dictionary_bytes: int = 112_640


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    chunk: int = 2048


def chunks(text: bytes, size: int) -> list[bytes]:
    """The whole text in pieces, so that a dictionary counts as much late in a text as early."""
    return [text[k : k + size] for k in range(0, len(text), size)] or [b""]


def drawn(doc_id: int, pieces: list[bytes], n: int) -> list[bytes]:
    """``n`` of the pieces at most, those of the smallest hashes; all places of a text are as likely."""
    return [pieces[k] for k in sorted(range(len(pieces)), key=lambda k: (zlib.crc32(b"%d:%d" % (doc_id, k)), k))[:n]]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        dictionaries = [zstandard.ZstdCompressionDict(d) if d else None for d in (model.good, model.bad)]
        for d in dictionaries:
            if d is not None:
                d.precompute_compress(level=LEVEL)
        self.ways = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=LEVEL) for d in dictionaries]

    def features(self, pieces: list[bytes]) -> list[float]:
        """One, and the normalised difference of the sizes in percent."""
        if not any(p.strip() for p in pieces):
            return [1.0, 0.0]
        good, bad = (sum(len(way.compress(p)) for p in pieces) for way in self.ways)
        return [1.0, 100 * (bad - good) / (bad + good)]

    def score(self, text: bytes) -> float:
        w = self.model.weights
        if len(w) == 1:
            return w[0]
        z = sum(a * b for a, b in zip(w, self.features(chunks(text, self.model.chunk)), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton steps for a logistic regression, without weights for class sizes: scores are calibrated."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _sample_ids(marks: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of ``marks`` (doc_id, label), by a hash of doc_id. What is far from being chosen
    is left out before the sort, so that few rows for each task reach the driver."""
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = min(1.0, 4 * n / max(1, marks.count()))
    return marks.filter(spread < int(share * 1_000_000) + 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


_PIECES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("pieces", pa.list_(pa.binary()))])
_SIZES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("feature", pa.float64())])


def _dictionary(pieces: list[bytes], most: int) -> bytes:
    pieces = [p for p in pieces if len(p) >= 8]
    size = min(most, max(1024, sum(map(len, pieces)) // 4))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to select from: take it as it is
        return b"".join(pieces)[-size:]


def train(docs: DataFrame, marks: DataFrame, sample: Sample = Sample(), chunk: int = 2048) -> Model:
    """A model from a bounded sample of ``docs`` (doc_id, text) that ``marks`` (doc_id once, label 0 or 1) marks.

    The ids are chosen first, from the marks alone: at most ``2 * sample.rows`` of them are
    sent to the executors. Of the half that makes dictionaries pieces are read back, of the half that calibrates
    one number for each whole text. With rows of one class
    only, or none, every score is the smoothed share of label 1.
    """
    ids = [_sample_ids(marks.filter(F.col("label") == label), sample.rows) for label in (0, 1)]
    usable = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    chosen = usable.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    calibrates = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, label, drawn(d, chunks(t, chunk), sample.pieces)) for d, label, t in rows_of(batches))
        return batched(rows, _PIECES, lambda row: 16 + sum(map(len, row[2])))

    # a doc_id that rows repeat counts once, so the bound holds
    each = chosen.filter(~calibrates).mapInArrow(cut, "doc_id bigint, label int, pieces array<binary>").groupBy("doc_id", "label").agg(F.min("pieces").alias("pieces"))
    read = sorted((r.label, r.doc_id, [bytes(p) for p in r.pieces]) for r in each.collect())
    bad, good = ([p for mark, _, pieces in read if mark == label for p in pieces] for label in (0, 1))
    made = (b"", b"")
    if good and bad:
        made = tuple(_dictionary(pieces, sample.dictionary_bytes) for pieces in (good, bad))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*made, (), chunk))
        return batched(((d, label, scorer.features(chunks(t, chunk))[1]) for d, label, t in rows_of(batches)), _SIZES, lambda row: 24)

    sizes = chosen.filter(calibrates).mapInArrow(sized, "doc_id bigint, label int, feature double").groupBy("doc_id", "label").agg(F.min("feature").alias("feature"))
    known = sorted((r.doc_id, r.label, r.feature) for r in sizes.collect())
    y = np.array([label for _, label, _ in known], float)
    rows_good, rows_bad = (len({d for mark, d, _ in read if mark == label}) + int((y == label).sum()) for label in (1, 0))
    if not (good and bad) or len(set(y)) < 2 or min(rows_good, rows_bad) < 4:
        return Model(b"", b"", ((rows_good + 1) / (rows_good + rows_bad + 2),), chunk)
    return Model(*made, _logistic(np.array([[1.0, feature] for _, _, feature in known]), y), chunk)


def held_out(doc_id=None):
    """Whether crc32 of the doc_id as text has remainder 1 of 3; false without a doc_id."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """From the rows of ``docs`` that ``labels`` (doc_id, quality) marks, without those held out.
    A doc_id with several labels has the smallest."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    return train(docs, marks, sample)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, held_out, score, predicted).

    Scores look at nothing but the whole text. A null text scores as an empty one, whose
    sizes say nothing: its score comes from the constant term. Texts of any length are scored
    whole, in pieces. Rows are scored one by one, repeated or not; a null doc_id isn't held
    out; no rows give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        return batched(((d, h, scorer.score(t or b"")) for d, h, t in rows_of(batches)), _SCORES, lambda row: 24)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores at least ``threshold``. A null text scores as an empty one, one of any length is
    scored whole; rows that repeat stay or go together; no rows give no rows."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            marks = [scorer.score((t or "").encode()) >= threshold for k in range(0, batch.num_rows, 256) for t in batch.column(at).slice(k, 256).to_pylist()]
            yield batch.filter(pa.array(marks, pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)

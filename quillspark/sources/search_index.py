"""Substring search by trigrams: which notes may hold a text, so that only their files are read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.note_files import NoteFiles


def grams(lowered: Column) -> Column:
    """The distinct runs of three code points of a text; none for a shorter one."""
    chars = F.split(lowered, "")

    def runs(c: Column) -> Column:
        return F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - 2, F.lit(0))), lambda first, k: F.concat(first, F.get(c, k + 1), F.get(c, k + 2)))

    # named once, or the text would be split for each use
    return F.array_distinct(F.element_at(F.transform(F.array(chars), runs), 1))


#: Trigrams that a task holds at once.
HELD = 1 << 20


def code(gram: str) -> int:
    """Three code points of 21 bits each as one number."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def codes(lowered: str) -> np.ndarray:
    """The distinct trigrams of a text, as numbers in order."""
    points = np.frombuffer(lowered.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """The ids and trigrams of the rows (id, text), some at a time."""
    ids, found, size = [], [], 0
    for batch in batches:
        for note_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(note_id.as_py())
            found.append(codes(text.as_py()))
            size += len(found[-1])
            if size >= HELD:
                yield ids, found
                ids, found, size = [], [], 0
    if ids:
        yield ids, found


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): in how many notes of a part of a task each trigram is."""
    for _, found in _gathered(batches):
        every, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _searched(notes: DataFrame) -> Column:
    """All that a search looks at. Runs over the seams only add candidates."""
    return F.lower(F.concat_ws("\n", "title", "markdown_content", "tags"))


class SearchIndex:
    """Trigrams of the notes in ``files``, kept as they are written: ``add`` what a change wrote.

    ``postings`` has (gram, id) for each trigram of a note, dealt by gram and sorted by it; ``counts`` has (gram, n, common); a gram is
    there as its ``code``. Texts are cut into trigrams twice, once for each of the two. Trigrams of more than
    ``common`` of the notes say little and would be most of the postings: they are only counted. Entries of
    notes that changed since only add candidates, as the text is looked at again.
    """

    def __init__(self, files: NoteFiles, path: str, common: float = 0.05):
        self.files, self.spark, self.path, self.common = files, files.spark, path, common

    def build(self) -> None:
        """From all notes of the current version."""
        notes = self.files.read()
        n = notes.count()
        counted = self._texts(notes).mapInArrow(_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).withColumn("common", F.col("n") > self.common * n)
        counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/counts")
        self._write(notes, "overwrite")

    def _texts(self, notes: DataFrame) -> DataFrame:
        return notes.select(F.col("id").cast("string").alias("id"), _searched(notes).alias("text"))

    def _write(self, notes: DataFrame, mode: str) -> None:
        # as a note has so many trigrams in the mean, at most that many over the share are common: some thousands of numbers
        common = np.array(sorted(r.gram for r in self.spark.read.parquet(f"{self.path}/counts").filter("common").select("gram").collect()), np.int64)

        def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, found in _gathered(batches):
                every, owner = np.concatenate(found), np.repeat(np.arange(len(ids)), [len(x) for x in found])
                kept = ~np.isin(every, common)
                yield pa.RecordBatch.from_arrays([pa.array(every[kept]), pa.array(ids, pa.string()).take(pa.array(owner[kept]))], names=["gram", "id"])

        # not by ranges, for which Spark would make them once more to see where they lie
        self._texts(notes).mapInArrow(rare, "gram bigint, id string").repartition("gram").sortWithinPartitions("gram", "id").write.mode(mode).parquet(f"{self.path}/postings")

    def add(self, notes: DataFrame) -> None:
        """Of notes that were created or changed."""
        self._write(notes, "append")

    def candidates(self, query: str, use: int = 3) -> DataFrame | None:
        """(id) of all notes that may hold ``query``, by its ``use`` rarest trigrams; None where it has fewer than three characters
        or only common trigrams, so that the index says nothing."""
        asked = self.spark.range(1).select(F.explode(grams(F.lower(F.lit(query)))).alias("gram"))
        names = [code(r.gram) for r in asked.collect()]  # at most as many as the query has characters
        known = {r.gram: (r.n, r.common) for r in self.spark.read.parquet(f"{self.path}/counts").filter(F.col("gram").isin(names)).collect()} if names else {}
        # one that isn't counted was in no note of the build, but may be in one added since
        rare = sorted((known.get(g, (0, False))[0], g) for g in names if not known.get(g, (0, False))[1])[:use]
        if not rare:
            return None
        postings = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("gram").isin([g for _, g in rare]))
        return postings.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rare)).select("id")

    def search(self, query: str, look: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """``look(notes, query)``, one of the functions of ``operators.search``, over the files that hold candidates, or over all where the index says nothing."""
        candidates = self.candidates(query)
        return look(self.files.read() if candidates is None else self.files.find(candidates), query)

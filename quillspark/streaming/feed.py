"""A feed of changes that any number of subscribers follow, each from where it stopped."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class News:
    """What a subscriber hasn't seen: with ``state`` the last row of each key, else the rows since, by batch. ``upto`` is the
    position to commit once they have been used."""

    state: bool
    rows: DataFrame
    upto: int


class Feed:
    """Changes of rows that ``key`` names, batch by batch: of notes, or of the message that each list shows.

    A sink for ``foreachBatch``: a batch is written under its number, so that one which is repeated overwrites itself. A new
    subscriber gets the state, that is the last row of each key, and then what follows. Positions are kept beside the data, so a
    reader that is started again goes on from its last commit; what it had read but not committed comes again. ``compact`` folds
    batches that all subscribers have seen into the state.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def _at(self, where: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, root = self._at(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _complete(self, folder: str) -> list[int]:
        return sorted(int(n.split("-")[1]) for n in self._names(folder) if self._at(f"{self.path}/{folder}/{n}/_SUCCESS")[0].exists(self._at(f"{self.path}/{folder}/{n}/_SUCCESS")[1]))

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/changes/batch-{number}")

    def position(self, subscriber: str) -> int | None:
        """The last batch that a subscriber has committed."""
        known = [int(n.split("-")[1]) for n in self._names(f"cursors/{subscriber}") if n.startswith("at-")]
        return max(known, default=None)

    def _rows(self, after: int, upto: int) -> DataFrame | None:
        base = max((n for n in self._complete("state") if after < n <= upto), default=None) if after < 0 else None
        paths = [] if base is None else [f"{self.path}/state/upto-{base}"]
        paths += [f"{self.path}/changes/batch-{n}" for n in self._complete("changes") if max(after, -1 if base is None else base) < n <= upto]
        return self.spark.read.parquet(*paths) if paths else None

    def state(self, upto: int | None = None) -> DataFrame | None:
        """The last row of each key after a batch, the last one if none is given."""
        rows = self._rows(-1, self._last() if upto is None else upto)
        if rows is None:
            return None
        others = [c for c in rows.columns if c not in (self.key, "batch")]
        last = rows.groupBy(self.key).agg(F.max(F.struct("batch", *others)).alias("last"))
        return last.select(self.key, *(F.col(f"last.{c}").alias(c) for c in (*others, "batch")))

    def _last(self) -> int:
        return max([*self._complete("changes"), *self._complete("state")], default=-1)

    def pull(self, subscriber: str) -> News | None:
        """What the subscriber hasn't committed yet; None if there is nothing."""
        at, upto = self.position(subscriber), self._last()
        if upto < 0 or at is not None and at >= upto:
            return None
        return News(True, self.state(upto), upto) if at is None else News(False, self._rows(at, upto), upto)

    def commit(self, subscriber: str, news: News) -> None:
        """Everything up to ``news`` has been used."""
        folder = f"{self.path}/cursors/{subscriber}"
        fs, at = self._at(f"{folder}/at-{news.upto}")
        fs.create(at, True).close()
        for name in self._names(f"cursors/{subscriber}"):
            if name.startswith("at-") and int(name.split("-")[1]) < news.upto:
                fs.delete(self._at(f"{folder}/{name}")[1], True)

    def compact(self) -> int | None:
        """Fold what all subscribers have committed into one state and remove those batches; the last batch in it."""
        positions = [self.position(s) for s in self._names("cursors")]
        upto = min([p for p in positions if p is not None], default=self._last())
        if None in positions or upto < 0 or upto in self._complete("state"):
            return None
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        self.state(upto).write.parquet(staged)
        fs, place = self._at(f"{self.path}/state/upto-{upto}")
        fs.mkdirs(place.getParent())
        if not fs.rename(self._at(staged)[1], place):
            raise OSError(f"could not put {staged} in place")
        for folder, name in (("changes", "batch"), ("state", "upto")):
            for n in self._complete(folder):
                if n < upto or n == upto and folder == "changes":
                    fs.delete(self._at(f"{self.path}/{folder}/{name}-{n}")[1], True)
        return upto

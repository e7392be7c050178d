"""A collection in many files, of which a change rewrites only those that hold what it changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import store
from quillspark.schema import NOTE


@dataclass(frozen=True)
class Change:
    """What a change did: the version it published, the files it dropped and those it wrote in their place."""

    version: int
    dropped: list[str]
    written: list[str]


class NoteFiles:
    """Notes in Parquet files that never change, dealt to ``buckets`` by a hash of their id.

    A version is a table of the files that are live, (bucket, file). It is written beside the others and put in
    place by one rename, so readers see the whole of one version or of the next; a
    version that was read stays readable until ``vacuum``. One writer at a time: a version that is there already raises.

    A change first reads the ids alone, and only of the buckets that its own ids fall into; then it
    copies the files in which some of them are. Unknown ids touch no file. The driver gets names of files, as many as those buckets
    have, and no rows.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._schema: T.StructType | None = None

    # ---- versions ----

    def _at(self, where: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, root = self._at(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("v-")) for n in names if n.startswith("v-"))

    def live(self, version: int | None = None) -> DataFrame:
        """(bucket, file) of a version, the last one if none is given."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no version in {self.path}")
        return self.spark.read.schema("bucket int, file string").parquet(f"{self.path}/versions/v-{known[-1] if version is None else version}")

    def _publish(self, files: DataFrame) -> int:
        number = (self.versions() or [-1])[-1] + 1
        staged, place = f"{self.path}/versions/staged-{uuid.uuid4().hex}", f"{self.path}/versions/v-{number}"
        files.select(F.col("bucket").cast("int").alias("bucket"), "file").write.parquet(staged)
        fs, at = self._at(place)
        if fs.exists(at) or not fs.rename(self._at(staged)[1], at):
            fs.delete(self._at(staged)[1], True)
            raise OSError(f"version {number} was published by another writer")
        return number

    # ---- reading ----

    def _of(self, files: list[str], columns: T.StructType | str) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*(f"{self.path}/{f}" for f in files))

    def _columns(self) -> T.StructType:
        if self._schema is None:
            first = self.live().select("file").first()
            if first is None:
                return NOTE
            self._schema = self.spark.read.parquet(f"{self.path}/{first.file}").schema
        return self._schema

    def read(self, version: int | None = None) -> DataFrame:
        """All notes of a version."""
        return self._of([r.file for r in self.live(version).select("file").collect()], self._columns())

    def bucket(self, note_id: Column) -> Column:
        return F.pmod(F.xxhash64(note_id), F.lit(self.buckets)).cast("int")

    def holding(self, ids: DataFrame) -> list[str]:
        """The live files that hold some of ``ids`` (id)."""
        wanted = ids.select(F.col("id").cast("string").alias("id")).filter("id IS NOT NULL").distinct()
        near = self.live().join(wanted.select(self.bucket(F.col("id")).alias("bucket")).distinct(), "bucket", "left_semi")
        files = [r.file for r in near.select("file").collect()]
        held = self._of(files, "id string").select("id", F.col("_metadata.file_path").alias("whole")) if files else None
        if held is None:
            return []
        found = {r.whole for r in held.join(wanted, "id", "left_semi").select("whole").distinct().collect()}
        return sorted(set(files) & {w[w.rindex("data/") :] for w in found})

    def find(self, ids: DataFrame) -> DataFrame:
        """The rows of the files that hold some of ``ids``, neighbours of theirs included."""
        return self._of(self.holding(ids), self._columns())

    # ---- writing ----

    def _write(self, notes: DataFrame) -> DataFrame:
        """(bucket, file) of the files that ``notes`` were written to, one for each bucket that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        self._schema = notes.schema
        bucket = self.bucket(F.col("id"))
        notes.withColumn("_bucket", bucket).repartition("_bucket").sortWithinPartitions("_bucket", "id").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, root = self._at(f"{self.path}/{folder}")
        rows = []
        for part in fs.listStatus(root):
            name = part.getPath().getName()
            if name.startswith("_bucket="):
                rows += [(int(name.split("=")[1]), f"{folder}/{name}/{f.getPath().getName()}") for f in fs.listStatus(part.getPath()) if f.getPath().getName().endswith(".parquet")]
        return self.spark.createDataFrame(rows, "bucket int, file string")

    def write(self, notes: DataFrame) -> Change:
        """Replace all notes."""
        files = self._write(notes)
        dropped = [r.file for r in self.live().collect()] if self.versions() else []
        return Change(self._publish(files), dropped, [r.file for r in files.collect()])

    def append(self, notes: DataFrame) -> Change:
        """Add notes, in files of their own."""
        files = self._write(notes)
        return Change(self._publish(self.live().unionByName(files)), [], [r.file for r in files.collect()])

    def _rewrite(self, files: list[str], change: Callable[[DataFrame], DataFrame]) -> Change:
        live = self.live()
        made = self._write(change(self._of(files, self._columns()))) if files else self.spark.createDataFrame([], "bucket int, file string")
        kept = live.filter(~F.col("file").isin(files)) if files else live
        return Change(self._publish(kept.unionByName(made)), files, [r.file for r in made.collect()])

    def patch(self, patches: DataFrame, now: Column) -> Change:
        """As ``store.update_notes``, on the files that hold a patched note."""
        return self._rewrite(self.holding(patches), lambda notes: store.update_notes(notes, patches, now))

    def delete(self, ids: DataFrame) -> Change:
        """As ``store.delete_notes``, on the files that hold one of ``ids``."""
        return self._rewrite(self.holding(ids), lambda notes: store.delete_notes(notes, ids))

    def compact(self, most: int = 4) -> Change:
        """Merge the files of each bucket that has more than ``most``."""
        many = self.live().groupBy("bucket").count().filter(F.col("count") > most)
        return self._rewrite([r.file for r in self.live().join(many, "bucket", "left_semi").collect()], lambda notes: notes)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions and the files that only those had; how many went."""
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        if not old:
            return 0
        needed = {r.file for v in kept for r in self.live(v).collect()}
        gone = {r.file for v in old for r in self.live(v).collect()} - needed
        for name in [*gone, *(f"versions/v-{v}" for v in old)]:
            fs, at = self._at(f"{self.path}/{name}")
            fs.delete(at, True)
        return len(gone)

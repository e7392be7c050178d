"""The same folds over streams of events."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators import changelog
from quillspark.operators.changelog import ID_WRAP

_log = logging.getLogger(__name__)


def save_sessions(edits: DataFrame, gap: str = "800 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """As the batch operator; in append mode a session comes out once the watermark passes its end."""
    return changelog.save_sessions(edits.withWatermark("ts", lateness), gap)


def event_log(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each batch of note events under its own number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def notes_of_log(spark: SparkSession, path: str) -> DataFrame:
    return changelog.fold_notes(spark.read.parquet(path))


class NoteTable:
    """A sink for ``foreachBatch`` that keeps the notes as clocks (``changelog.note_clocks``).

    A batch writes the clocks of its own notes only, under its number, so a batch that is
    repeated gives the same again. Every ``compact_every`` batches they are merged into a base, so states don't grow with
    the log; the clocks that went into a base are removed with the next one. As clocks merge in any order, late events count as they would
    have in time. Events without note or operation go to ``quarantine`` instead. Listeners get the
    current notes at once when they subscribe, and then after each batch; one that fails is reported and doesn't fail the batch.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 10):
        self.spark, self.path, self.compact_every = spark, path, compact_every
        self.listeners: list[Callable[[DataFrame], None]] = []

    def _at(self, where: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, kind: str) -> list[int]:
        """Of the complete folders of a kind."""
        fs, root = self._at(f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.split("-")[-1]) for n in names if fs.exists(self._at(f"{self.path}/{kind}/{n}/_SUCCESS")[1]))

    def clocks(self) -> DataFrame | None:
        """One row for each note that any batch had, tombstones included."""
        bases, batches = self._numbers("base"), self._numbers("clocks")
        base = bases[-1] if bases else -1
        paths = [f"{self.path}/base/upto-{base}"] if bases else []
        # a batch that is repeated after its base was made is merged into it again, which changes nothing
        paths += [f"{self.path}/clocks/batch-{n}" for n in batches if n > base]
        return changelog.merged_clocks(self.spark.read.parquet(*paths)) if paths else None

    def current(self) -> DataFrame | None:
        """The notes after the last batch."""
        clocks = self.clocks()
        return None if clocks is None else changelog.notes_of_clocks(clocks)

    def subscribe(self, listener: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Call ``listener`` with the current notes, now and after each batch; returns what ends that."""
        self.listeners.append(listener)
        if (state := self.current()) is not None:
            listener(state)
        return lambda: self.listeners.remove(listener) if listener in self.listeners else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        usable = F.col("note_id").isNotNull() & F.col("op").isin("create", "patch", "delete", "select")
        whole = F.coalesce(usable, F.lit(False))
        batch.filter(~whole).write.mode("overwrite").parquet(f"{self.path}/quarantine/batch={number}")
        changelog.note_clocks(batch.filter(whole)).write.mode("overwrite").parquet(f"{self.path}/clocks/batch-{number}")
        if (number + 1) % self.compact_every == 0:
            self._compact(number)
        for listener in list(self.listeners):
            try:
                listener(self.current())
            except Exception:
                _log.exception("a listener failed at batch %s", number)

    def _compact(self, number: int) -> None:
        before = self._numbers("base")
        if before and before[-1] >= number:
            return
        self.clocks().write.mode("overwrite").parquet(f"{self.path}/base/upto-{number}")
        # readers of the base before may still be at work: what only older ones need goes
        for kind, name, last in (("clocks", "batch", before[-1] if before else -1), ("base", "upto", (before[-1] if before else 0) - 1)):
            for n in self._numbers(kind):
                if n <= last:
                    fs, at = self._at(f"{self.path}/{kind}/{name}-{n}")
                    fs.delete(at, True)


class ToastProcessor(StatefulProcessor):
    """One message for each list: adds, updates, dismissals and removals, by id or of any, in the order of their moments
    within a batch, for which state is read and written once. A dismissal of an id starts the delay after which that message is removed, unless one
    is running for it; once it has ended, the next dismissal starts another. A removal comes before events of its own moment."""

    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.message = handle.getValueState("message", "toast_id string, title string, description string, open boolean")
        self.adds = handle.getValueState("adds", "n bigint")
        self.timers = handle.getMapState("timers", "toast_id string", "at bigint")

    def _read(self) -> None:
        """What is kept of the list, once for all that a batch does to it."""
        self.held, self.count = self.message.get(), (self.adds.get() or (0,))[0]
        self.running = {toast_id: at for (toast_id,), (at,) in self.timers.iterator()}
        self.before = self.held, self.count, dict(self.running)

    def _keep(self) -> None:
        """What has changed since it was read; a delay that is over by now never gets a timer."""
        held, count, running = self.before
        if self.held != held:
            self.message.clear() if self.held is None else self.message.update(self.held)
        if self.count != count:
            self.adds.update((self.count,))
        for toast_id, at in self.running.items():
            if running.get(toast_id) != at:
                self.timers.updateValue((toast_id,), (at,))
                self.handle.registerTimer(-(-at // 1000))
        for toast_id in running.keys() - self.running.keys():
            self.timers.removeKey((toast_id,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        self._read()
        for event in sorted(rows, key=lambda e: (e.ts_us, e.seq)):  # one batch's events of one list
            self._remove_due(event.ts_us)
            self._apply(event)
        self._keep()
        yield self._row(key)

    def _apply(self, event: Any) -> None:
        if event.type == "ADD":
            self.count += 1
            self.held = (event.toast_id or str(self.count % ID_WRAP), event.title, event.description, True)
            return
        held = self.held
        meant = held is not None and event.toast_id in (None, held[0])
        if event.type == "DISMISS" and (event.toast_id or held):
            self.running.setdefault(event.toast_id or held[0], event.ts_us + self.delay_us)
        if not meant:
            return
        if event.type == "UPDATE" and event.toast_id is not None:
            new = [old if given is None else given for old, given in zip(held[1:3], (event.title, event.description), strict=True)]
            self.held = (held[0], *new, held[3])
        elif event.type == "DISMISS":
            self.held = (*held[:3], False)
        elif event.type == "REMOVE":
            self.held = None

    def _remove_due(self, now: int) -> bool:
        """End the delays that are over, and remove their messages."""
        due = [toast_id for toast_id, at in self.running.items() if at <= now]
        for toast_id in due:
            del self.running[toast_id]
            if self.held is not None and self.held[0] == toast_id:
                self.held = None
        return bool(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self._read()
        if self._remove_due(expiredTimerInfo.getExpiryTimeInMs() * 1000):
            self._keep()
            yield self._row(key)

    def _row(self, key: Any) -> Row:
        held = self.held or (None,) * 4
        return Row(list_id=key[0], toast_id=held[0], title=held[1], description=held[2], open=held[3])

    def close(self) -> None:
        pass


def toasts(events: DataFrame, lateness: str = "10 seconds", delay_ms: int = 1_000_000) -> DataFrame:
    """(list_id, toast_id, title, description, open) after each batch that touches a list; nulls once the message is gone."""
    return (
        events.withColumn("ts_us", F.unix_micros("ts"))
        .withWatermark("ts", lateness)
        .groupBy("list_id")
        .transformWithState(ToastProcessor(delay_ms * 1000), "list_id string, toast_id string, title string, description string, open boolean", "Update", "EventTime")
    )

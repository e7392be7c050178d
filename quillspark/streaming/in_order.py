"""Events of a key in the order of their moments, whatever order they come in within the watermark."""

from __future__ import annotations

import json
from abc import abstractmethod
from collections.abc import Generator, Iterator, Sequence
from datetime import UTC, datetime, timedelta
from itertools import islice, pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Events that come in one row, and results that leave in one.
ENTRY = 1000
#: Characters of events from which an entry of a key's list is full.
FULL = 100_000
#: Bytes of events that a task puts together at once.
BUFFER = 64_000_000

_EPOCH, _MICROSECOND = datetime(1970, 1, 1, tzinfo=UTC), timedelta(microseconds=1)


def packed(*fields: str) -> Column:
    """The fields of an event as one column ``event``, since a row reaches Python value by value and moments take longest."""
    return F.to_json(F.struct(*fields)).alias("event")


def taken(events: DataFrame, key: str, lateness: str, processor: InOrder, **fields: str) -> DataFrame:
    """What a processor makes of a stream of ``events`` with moments ``ts``: the key as a text, and ``fields`` with their types. An event that comes after
    its moment was passed is dropped, by Spark or by what its key remembers."""
    plain = events.withColumn("ts_us", F.unix_micros("ts")).select(F.col(key).cast("string").alias(key), "ts_us", packed(*processor.EVENT))
    # dealt by key first, so that those of a key meet whatever the order of the input
    parts = plain.repartition(key).mapInArrow(_parts, f"{key} string, last_us bigint, first_us bigint, event string")
    timed = parts.select(key, F.timestamp_micros("last_us").alias("ts"), "first_us", "event").withWatermark("ts", lateness)
    lists = ", ".join([f"{key} string", *(f"{name} array<{kind}>" for name, kind in fields.items())])
    return timed.groupBy(key).transformWithState(_InLists(processor, key), lists, "Append", "EventTime").select(key, F.inline(F.arrays_zip(*fields)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, moment, event) as rows (key, last moment, first moment, events joined by commas), of those of a key that come within ``BUFFER`` bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= BUFFER:
            yield _joined(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield _joined(pa.Table.from_batches(held))


def _joined(rows: pa.Table) -> pa.RecordBatch:
    keys, moments, events = (column.combine_chunks() for column in rows.columns)
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    codes, moments, at = codes[order], moments.to_numpy()[order], np.arange(len(order))
    begins = np.r_[True, codes[1:] != codes[:-1]]
    starts = np.flatnonzero((at - np.maximum.accumulate(np.where(begins, at, 0))) % ENTRY == 0)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)], pa.int32()), events.take(pa.array(order)))
    first, last = np.minimum.reduceat(moments, starts), np.maximum.reduceat(moments, starts)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(order[starts])), pa.array(last), pa.array(first), pc.binary_join(lists, ",")], [rows.column_names[0], "last_us", "first_us", "event"])


class InOrder(StatefulProcessor):
    """Events wait in state until the watermark has passed their moment, and are then taken by (ts_us, seq), their first two fields. The last
    columns of a row are the moment of its first event and its events as ``packed`` makes them, joined by commas.

    What a batch brings of a key waits as JSON, some ``FULL`` characters in one entry of the list, since each row and entry is turned from Java to Python
    or back by itself, which takes far longer than the event. A batch that has nothing due for a key doesn't read what waits.
    A key has one timer, for the first moment at which something may happen: it is deleted and set again
    when that moment changes.
    """

    #: Names of the fields of an event: numbers, texts and booleans.
    EVENT: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")
        self.timer = handle.getValueState("timer", "at bigint")

    @abstractmethod
    def begin(self) -> int | None:
        """Read what is kept between batches; the ``upto`` that it was kept with."""

    @abstractmethod
    def take(self, key: Any, event: tuple) -> Iterator[Row]:
        """The next event."""

    def pass_time(self, key: Any, upto: int) -> Iterator[Row]:
        """No further event has a moment up to ``upto``."""
        return iter(())

    @abstractmethod
    def end(self, upto: int) -> int | None:
        """Keep what the next batch needs, and ``upto``, the moment that has been passed; the next moment at which time alone makes something happen."""

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        moments, new = zip(*((first, events) for *_, first, events in rows), strict=True)
        watermark, set_at = timerValues.getCurrentWatermarkInMs(), self._set_at()
        first = _first(moments)
        if first > watermark * 1000 and (set_at is None or set_at > watermark):
            self.waiting.appendList(_entries(new))
            at = -(-first // 1000)
            self._wake(set_at, at if set_at is None else min(at, set_at))
            return
        at = yield from self._settle(key, new, watermark * 1000)
        self._wake(set_at, at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        at = yield from self._settle(key, (), timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(at)  # Spark deletes the expired timer itself

    def _set_at(self) -> int | None:
        held = self.timer.get()
        return None if held is None else held[0]

    def _settle(self, key: Any, new: Sequence[str], upto: int) -> Generator[Row, None, int | None]:
        held = [entry for (entry,) in self.waiting.get()]
        whole = json.loads("[" + ",".join([*(entry[1:-1] for entry in held), *new]) + "]")
        passed = self.begin()
        fields = (tuple([e.get(name) for name in self.EVENT]) for e in whole)
        waiting = sorted((e for e in fields if passed is None or e[0] > passed), key=lambda e: e[:2])
        done = sum(e[0] <= upto for e in waiting)
        for event in waiting[:done]:
            yield from self.take(key, event)
        yield from self.pass_time(key, upto)
        left = waiting[done:]
        if left and (done or new):
            self.waiting.put(_entries([json.dumps(dict(zip(self.EVENT, e, strict=True))) for e in left]))
        elif held and not left:
            self.waiting.clear()
        due = self.end(upto)
        moments = [e[0] for e in left[:1]] + [due for _ in (1,) if due is not None]
        return -(-min(moments) // 1000) if moments else None

    def _wake(self, set_at: int | None, at: int | None) -> None:
        if at == set_at:
            return
        if set_at is not None:
            self.handle.deleteTimer(set_at)
        self._keep(at)

    def _keep(self, at: int | None) -> None:
        if at is None:
            self.timer.clear()
        else:
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class _InLists(StatefulProcessor):
    """A processor's rows as rows of lists, since each row leaves Python by itself."""

    def __init__(self, inner: InOrder, key: str):
        self.inner, self.key = inner, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        return self._listed(key, self.inner.handleInputRows(key, rows, timerValues))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        return self._listed(key, self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def _listed(self, key: Any, rows: Iterator[Row]) -> Iterator[Row]:
        while part := list(islice(rows, ENTRY)):
            lists = dict(zip(part[0].__fields__, map(list, zip(*part, strict=True)), strict=True))
            yield Row(**lists | {self.key: key[0]})

    def close(self) -> None:
        self.inner.close()


def _first(moments: Sequence[int | datetime]) -> int:
    first = min(moments)
    return first if isinstance(first, int) else (first - _EPOCH) // _MICROSECOND


def _entries(events: Sequence[str]) -> list[tuple[str]]:
    ends, size = [0], 0
    for k, event in enumerate(events, 1):
        size += len(event)
        if size >= FULL or k == len(events):
            ends, size = [*ends, k], 0
    return [("[" + ",".join(events[a:b]) + "]",) for a, b in pairwise(ends)]

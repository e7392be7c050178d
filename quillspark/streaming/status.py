"""What an editor shows of its saving, over a stream of events in any order within the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from quillspark.streaming.in_order import InOrder, taken


def _shown(key: Any, note_id: str, status: str, at: int, seq: int) -> Row:
    return Row(session=key[0], note_id=note_id, status=status, at_us=at, seq=seq)


class StatusProcessor(InOrder):
    """One session's editor. An edit sets the pending save to ``gap_us`` after it, in place of one that was pending; opening
    another note drops it."""

    EVENT = ("ts_us", "seq", "note_id", "edit")

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("editor", "opened string, at bigint, seq bigint, upto bigint")

    def begin(self) -> int | None:
        self.opened, *pending, upto = self.kept.get() or (None, None, None, None)
        self.pending = tuple(pending) if pending[0] is not None else None
        return upto

    def take(self, key: Any, event: tuple) -> Iterator[Row]:
        at, seq, note_id, edit = event
        yield from self.pass_time(key, at - 1)  # an event at the moment of a save comes before it
        if note_id != self.opened:
            self.opened, self.pending = note_id, None
        if edit:
            if self.pending is None:
                yield _shown(key, note_id, "saving", at, seq)
            self.pending = (at + self.gap_us, seq)

    def pass_time(self, key: Any, upto: int) -> Iterator[Row]:
        if self.pending and self.pending[0] <= upto:
            yield _shown(key, self.opened, "saved", *self.pending)
            self.pending = None

    def end(self, upto: int) -> int | None:
        if self.opened is not None:
            self.kept.update((self.opened, *(self.pending or (None, None)), upto))
        return self.pending[0] if self.pending else None


def statuses(events: DataFrame, gap_ms: int = 800, lateness: str = "10 seconds") -> DataFrame:
    """A stream of ``events`` (session, ts, seq, note_id, edit) to (session, note_id, status, at, seq), as ``changelog.save_statuses`` has them,
    each once the watermark has reached its moment."""
    known, processor = events.filter("note_id IS NOT NULL"), StatusProcessor(gap_ms * 1000)
    out = taken(known, "session", lateness, processor, note_id="string", status="string", at_us="bigint", seq="bigint")
    return out.select("session", "note_id", "status", F.timestamp_micros("at_us").alias("at"), "seq")

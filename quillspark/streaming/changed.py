"""Edits that change something, over a stream in any order within the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from quillspark.streaming.in_order import InOrder, taken


class ChangedProcessor(InOrder):
    """One note: an edit comes out if its value differs from the one before. The last value is kept; with ``keep_us`` only that long after its
    edit, so that notes which nobody edits any more cost nothing, and the first edit after that time counts as a change."""

    EVENT = ("ts_us", "seq", "value")

    def __init__(self, keep_us: int | None = None):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("last", "at bigint, value string, upto bigint")

    def begin(self) -> int | None:
        *last, upto = self.kept.get() or (None, None, None)
        self.last = tuple(last) if last[0] is not None else None
        return upto

    def take(self, key: Any, event: tuple) -> Iterator[Row]:
        at, seq, value = event
        yield from self.pass_time(key, at - 1)
        if value != (self.last[1] if self.last else None):
            yield Row(note_id=key[0], ts_us=at, seq=seq, value=value)
        self.last = (at, value)

    def pass_time(self, key: Any, upto: int) -> Iterator[Row]:
        if self.last and self.keep_us is not None and self.last[0] + self.keep_us <= upto:
            self.last = None
        return iter(())

    def end(self, upto: int) -> int | None:
        if self.last is None:
            self.kept.clear()
            return None
        self.kept.update((*self.last, upto))
        return None if self.keep_us is None else self.last[0] + self.keep_us


def changed_edits(edits: DataFrame, lateness: str = "10 seconds", keep_ms: int | None = None) -> DataFrame:
    """A stream of ``edits`` (note_id, ts, seq, value) to those whose value differs from the one before in the same note, as
    ``changelog.changed_edits`` has them, each once the watermark has passed it."""
    processor = ChangedProcessor(None if keep_ms is None else keep_ms * 1000)
    out = taken(edits, "note_id", lateness, processor, ts_us="bigint", seq="bigint", value="string")
    return out.select("note_id", F.timestamp_micros("ts_us").alias("ts"), "seq", "value")

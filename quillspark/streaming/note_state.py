"""A stream of note events into the notes that are there, with the state of each note under its own key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark import schema
from quillspark.operators.changelog import NOTE_FIELDS

_OUT = "note_id string, live boolean, title string, markdown_content string, folder_id string, tags array<string>, owner_id string, created_us bigint, updated_us bigint"
_DEFAULTS = {"title": schema.DEFAULT_TITLE, "markdown_content": schema.DEFAULT_BODY, "tags": [], "owner_id": schema.DEFAULT_OWNER}


class NoteProcessor(StatefulProcessor):
    """One note: the (ts, seq) of its last create or delete, of its last patch, and of the last patch of each field.

    An event counts only where it is later than what its part of the note has, so events may
    come in any order and more than once; a deleted note keeps its clock as a tombstone. A note's
    row comes out in each batch that changes it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "ts bigint, seq bigint, op string, given string")
        self.patched = handle.getValueState("patched", "ts bigint, seq bigint")
        self.fields = handle.getMapState("fields", "name string", "ts bigint, seq bigint, value string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        head = tuple(self.head.get()) if self.head.exists() else None
        patched = tuple(self.patched.get()) if self.patched.exists() else None
        fields = {name: tuple(value) for (name,), value in self.fields.iterator()}
        before, known = self._row(key, head, patched, fields), dict(fields)
        for e in rows:
            at, given = (e.ts_us, e.seq), json.loads(e.given)
            if e.op == "patch":
                patched = max(patched or at, at)
                for name, value in given.items():
                    if name not in fields or at > fields[name][:2]:
                        fields[name] = (*at, json.dumps(value))
            elif head is None or at > head[:2]:
                head = (*at, e.op, e.given)
        if head is not None:
            self.head.update(head)
        if patched is not None:
            self.patched.update(patched)
        for name, value in fields.items():
            if known.get(name) != value:
                self.fields.updateValue((name,), value)
        if (after := self._row(key, head, patched, fields)) != before:
            yield after

    def _row(self, key: Any, head: tuple | None, patched: tuple | None, fields: dict[str, tuple]) -> Row:
        if head is None or head[2] != "create":
            return Row(note_id=key[0], live=False, **dict.fromkeys(NOTE_FIELDS), created_us=None, updated_us=None)
        given = json.loads(head[3])
        values = {}
        for name in NOTE_FIELDS:
            if name in fields and fields[name][:2] > head[:2]:
                values[name] = json.loads(fields[name][2])
            else:
                values[name] = _DEFAULTS.get(name) if given.get(name) is None else given[name]
        updated = patched[0] if patched is not None and patched > head[:2] else head[0]
        return Row(note_id=key[0], live=True, **values, created_us=head[0], updated_us=updated)

    def close(self) -> None:
        pass


def note_changes(events: DataFrame) -> DataFrame:
    """A stream of ``events``, as ``changelog.note_clocks`` takes them, to (note_id, live, fields, created_at, updated_at): each
    note that a batch changes, as it is then; one that isn't there has nulls. Events without note, moment, seq or known operation are ignored."""
    mask = F.coalesce("set_mask", F.array().cast("array<string>"))
    fields = [c for c in NOTE_FIELDS if c in events.columns]
    # a JSON object with the fields that the event sets, null ones too
    pairs = [F.when(F.array_contains(mask, c), F.concat(F.lit(f'"{c}":'), F.coalesce(_json(c), F.lit("null")))) for c in fields]
    given = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    whole = F.col("note_id").isNotNull() & F.col("ts").isNotNull() & F.col("seq").isNotNull() & F.col("op").isin("create", "patch", "delete")
    plain = events.filter(whole).select("note_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("seq").cast("bigint").alias("seq"), "op", given.alias("given"))
    out = plain.groupBy("note_id").transformWithState(NoteProcessor(), _OUT, "Update", "None")
    return out.select("note_id", "live", *NOTE_FIELDS, F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("updated_us").alias("updated_at"))


def _json(name: str):
    """A field as a JSON value."""
    if name == "tags":
        return F.to_json(name)
    item = F.to_json(F.array(name))
    return F.when(F.col(name).isNotNull(), F.substring(item, F.lit(2), F.length(item) - 2))


def change_log(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` of ``note_changes``: each batch under its number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def notes_of_changes(spark: SparkSession, path: str) -> DataFrame:
    """The notes as the last batch that changed each left it."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("note_id").agg(F.max(F.struct("batch", *(c for c in rows.columns if c not in ("note_id", "batch")))).alias("last"))
    return last.filter("last.live").select("note_id", *(F.col(f"last.{c}").alias(c) for c in (*NOTE_FIELDS, "created_at", "updated_at")))

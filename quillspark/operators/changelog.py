"""Folding logs of events into state. Where only the latest events matter, plain aggregates
do it, so one key with very many events is pre-aggregated in every task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import schema


def _latest(when: Column, *fields: Column | str) -> Column:
    """The fields of the latest event (by ts, seq) for which ``when`` holds, as a struct that starts with ts and seq."""
    return F.max(F.when(when, F.struct("ts", "seq", *fields)))


def _after(event: str, head: str) -> Column:
    e, h = F.col(event), F.col(head)
    return F.coalesce((e["ts"] > h["ts"]) | ((e["ts"] == h["ts"]) & (e["seq"] > h["seq"])), F.lit(False))


#: What a note event may set; other names in a mask are ignored.
NOTE_FIELDS = ["title", "markdown_content", "folder_id", "tags", "owner_id"]


def _default(name: str) -> Column:
    """What a new note has in a field that its create doesn't set."""
    texts = {"title": schema.DEFAULT_TITLE, "markdown_content": schema.DEFAULT_BODY, "owner_id": schema.DEFAULT_OWNER}
    return F.array().cast("array<string>") if name == "tags" else F.lit(texts.get(name)).cast("string")


def note_clocks(events: DataFrame) -> DataFrame:
    """``events`` (note_id, ts, seq, op, set_mask, and the fields that masks name) to one row for each note with the latest event that
    counts for each part of it: ``head`` (its last create or delete, with what a create set), ``patched`` and ``of_<field>``.

    These are maxima by (ts, seq), so rows of two logs merge by taking maxima again, in any order and as often as one
    likes (``merged_clocks``). A deleted note stays as a tombstone: its head is the delete, and events from before
    it that come later can't revive it.
    """
    op, mask = F.col("op"), F.coalesce("set_mask", F.array().cast("array<string>"))

    def field(c: str) -> Column:
        return F.col(c) if c in events.columns else F.lit(None).cast("array<string>" if c == "tags" else "string")

    return events.groupBy("note_id").agg(
        _latest(op.isin("create", "delete"), "op", *(F.when(F.array_contains(mask, c), field(c)).alias(c) for c in NOTE_FIELDS)).alias("head"),
        _latest(op == "patch").alias("patched"),
        *(_latest((op == "patch") & F.array_contains(mask, c), field(c).alias("value")).alias(f"of_{c}") for c in NOTE_FIELDS),
    )


def merged_clocks(clocks: DataFrame) -> DataFrame:
    """Rows of ``note_clocks`` from several logs to one row for each note."""
    return clocks.groupBy("note_id").agg(*(F.max(c).alias(c) for c in ("head", "patched", *(f"of_{c}" for c in NOTE_FIELDS))))


def notes_of_clocks(clocks: DataFrame) -> DataFrame:
    """The notes that are there, from one row of ``note_clocks`` each."""

    def field(name: str) -> Column:
        return F.when(_after(f"of_{name}", "head"), F.col(f"of_{name}")["value"]).otherwise(F.coalesce(F.col("head")[name], _default(name)))

    updated = F.when(_after("patched", "head"), F.col("patched.ts")).otherwise(F.col("head.ts"))
    return clocks.filter(F.col("head.op") == "create").select("note_id", *(field(c).alias(c) for c in NOTE_FIELDS), F.col("head.ts").alias("created_at"), updated.alias("updated_at"))


def fold_notes(events: DataFrame) -> DataFrame:
    """``events``, as ``note_clocks`` takes them, to the notes that are there in the end.

    A create starts a note afresh, with the fields it sets (null ones take their defaults); a
    delete ends it; a patch of a note that is there sets the fields it names, to null perhaps.
    So a field is that of the latest event after the last create that names it, and a note is
    there if the last create or delete was a create.
    """
    return notes_of_clocks(note_clocks(events))


#: Events of a key are walked in pieces of this length.
PIECE = "1 hour"


def _running(events: DataFrame, key: str, value: Column, summary: Column, fold: Callable[[Column], Column], name: str, upto: int = 0) -> DataFrame:
    """``events`` (key, ts, seq, ..) with ``name``: ``fold`` of the values of the key's events up to this one
    (``upto`` 0) or the one before (-1), by ts, seq and value.

    A key's events are cut into pieces of time, which different tasks walk; each begins with the fold
    over the ``summary`` of all pieces before it. So a key with very many events isn't one task.
    """
    start = F.lit("0001-01-01 00:00:00").cast(events.schema["ts"].dataType)  # where events without a time are put: first
    pieces = events.withColumn("_piece", F.window(F.coalesce("ts", start), PIECE)["start"]).withColumn("_value", value)
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = pieces.groupBy(key, "_piece").agg(summary.alias("_all")).select(key, "_piece", fold(F.col("_all")).over(earlier).alias("_value"), F.lit(True).alias("_head"))
    every = pieces.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    order = Window.partitionBy(key, "_piece").orderBy(F.desc("_head"), "ts", "seq", "_value").rowsBetween(Window.unboundedPreceding, upto)
    return every.withColumn(name, fold(F.col("_value")).over(order)).filter(~F.col("_head")).drop("_piece", "_value", "_head")


def changed_edits(edits: DataFrame) -> DataFrame:
    """The edits (note_id, ts, seq, value) whose value differs from the one before in the same note."""
    summary = F.max(F.struct("ts", "seq", "_value"))["_value"]
    told = _running(edits, "note_id", F.col("value"), summary, F.last, "_before", upto=-1)
    return told.filter(~F.col("value").eqNullSafe(F.col("_before"))).drop("_before")


def save_sessions(edits: DataFrame, gap: str) -> DataFrame:
    """Runs of edits of a note at most ``gap`` apart: (note_id, started, saved, edits); saved is the last edit plus the gap.

    Works on a stream with a watermark too, by session windows. In batch, where a note's edits would meet in
    one task, starts are found and counted in pieces of time, and sessions are plain aggregates.
    """
    if edits.isStreaming:
        w = F.session_window("ts", gap).alias("w")
        return edits.groupBy("note_id", w).agg(F.count("*").alias("edits")).select("note_id", F.col("w.start").alias("started"), F.col("w.end").alias("saved"), "edits")
    length = F.expr(f"INTERVAL {gap}")
    timed = _running(edits.filter("ts IS NOT NULL").select("note_id", "ts", "seq"), "note_id", F.col("ts"), F.max("_value"), F.max, "_before", upto=-1)
    starts = F.coalesce(F.col("ts") > F.col("_before") + length, F.lit(True)).cast("bigint")
    numbered = _running(timed, "note_id", starts, F.sum("_value"), F.sum, "_session")
    return numbered.groupBy("note_id", "_session").agg(F.min("ts").alias("started"), (F.max("ts") + length).alias("saved"), F.count("*").alias("edits")).drop("_session")


def save_statuses(events: DataFrame, gap: str = "800 milliseconds") -> DataFrame:
    """``events`` (session, ts, seq, note_id, edit) to (session, note_id, status, at, seq): what each session's editor shows of its saving.

    An edit shows ``saving`` unless a save of its note is pending, and sets the pending save to ``gap`` after it; then
    it shows ``saved``, with the seq of that edit. An event of another note opens that note and drops the pending save. Opening the open
    note does nothing; an event at the very moment of a save comes before it. Events without note are ignored.
    """
    keys = ["ts", "seq", "note_id", "edit"]
    last = F.max(F.struct("ts", "seq", "_value"))["_value"]
    opened = _running(events.filter("note_id IS NOT NULL").select("session", *keys), "session", F.col("note_id"), last, F.last, "_open", upto=-1)
    real = opened.filter(F.col("edit") | ~F.col("note_id").eqNullSafe(F.col("_open"))).drop("_open")
    told = _running(real, "session", F.struct(*keys), last, F.last, "_before", upto=-1)
    before, length = F.col("_before"), F.expr(f"INTERVAL {gap}")
    was = F.coalesce(before["edit"], F.lit(False))
    over = before["ts"] + length < F.col("ts")
    going = was & (before["note_id"] == F.col("note_id")) & ~over

    def row(status: str, note_id: Column, at: Column, seq: Column) -> Column:
        return F.struct(note_id.alias("note_id"), F.lit(status).alias("status"), at.alias("at"), seq.alias("seq"))

    shown = F.array(
        F.when(was & over, row("saved", before["note_id"], before["ts"] + length, before["seq"])), F.when(F.col("edit") & ~F.coalesce(going, F.lit(False)), row("saving", F.col("note_id"), F.col("ts"), F.col("seq")))
    )
    rows = told.select("session", F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("r")).select("session", "r.*")
    ends = real.groupBy("session").agg(F.max(F.struct(*keys)).alias("end")).filter("end.edit")
    return rows.unionByName(ends.select("session", row("saved", F.col("end.note_id"), F.col("end.ts") + length, F.col("end.seq")).alias("r")).select("session", "r.*"))


#: Ids count adds up to this number and then start again (fixed value).
ID_WRAP = 2**53 - 1


def numbered_adds(events: DataFrame) -> DataFrame:
    """``events`` (list_id, ts, seq, type, ..) with ``adds``: how many messages the list had been given by then. An add's own number is its id."""
    return _running(events, "list_id", (F.col("type") == "ADD").cast("bigint"), F.sum("_value"), F.sum, "adds")


def toast_id(number: Column) -> Column:
    """The id that the ``number``-th add of a list gets."""
    return (number % ID_WRAP).cast("string")


def _after_control(state: Column, event: Column, delay_us: int) -> Column:
    """What an add, dismiss or remove of a message makes of its state: ``present``, ``timer`` (the moment at which it is removed),
    ``shut`` and ``starts``, the dismisses that started a delay. A removal that is due by then comes first."""
    due = F.coalesce(state["timer"] <= event["at"], F.lit(False))
    present, timer = state["present"] & ~due, F.when(~due, state["timer"])
    kind = event["type"]
    starts = (kind == "DISMISS") & timer.isNull() & (event["named"] | present)
    return F.struct(
        F.when(kind == "ADD", F.lit(True)).when(kind == "REMOVE", F.lit(False)).otherwise(present).alias("present"),
        F.when(starts, event["at"] + delay_us).otherwise(timer).alias("timer"),
        F.when(kind == "ADD", F.lit(False)).when(kind == "DISMISS", state["shut"] | present).otherwise(state["shut"]).alias("shut"),
        F.when(starts, F.concat(state["starts"], F.array(F.struct(event["seq"].alias("seq"), (event["at"] + delay_us).alias("at"))))).otherwise(state["starts"]).alias("starts"),
    )


def _messages(events: DataFrame, delay_ms: int) -> DataFrame:
    """One row for each (list_id, toast_id) that events name or mean: its last add, what updates gave it, and the ``state`` its adds, dismisses and removes leave.

    An event without id means the message added last. Adds, dismisses and removes of one message, a few numbers each, are
    folded in the order of their moments; a dismiss starts a delay only while none is running, so a removal that the log itself
    makes takes its place among the events.
    """
    added = F.when(F.col("type") == "ADD", F.col("toast_id"))
    summary = F.max(F.when(F.col("_value").isNotNull(), F.struct("ts", "seq", "_value")))["_value"]
    held = _running(events, "list_id", added, summary, lambda c: F.last(c, ignorenulls=True), "_held")
    kind, named = F.col("type"), F.col("toast_id").isNotNull()
    control = F.when(kind.isin("ADD", "DISMISS", "REMOVE"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", "type", named.alias("named")))
    by_id = (
        held.withColumn("control", control)
        .groupBy("list_id", F.coalesce("toast_id", "_held").alias("toast_id"))
        .agg(
            _latest(kind == "ADD", "title", "description").alias("added"),
            _latest((kind == "UPDATE") & F.col("title").isNotNull(), "title").alias("retitled"),
            _latest((kind == "UPDATE") & F.col("description").isNotNull(), "description").alias("described"),
            F.max("ts").alias("seen"),
            F.sort_array(F.collect_list("control")).alias("log"),
        )
    )
    start = F.struct(F.lit(False).alias("present"), F.lit(None).cast("bigint").alias("timer"), F.lit(False).alias("shut"), F.array().cast("array<struct<seq: bigint, at: bigint>>").alias("starts"))
    return by_id.withColumn("state", F.aggregate("log", start, lambda state, event: _after_control(state, event, delay_ms * 1000))).drop("log")


#: How long a dismissed message stays (fixed value).
REMOVE_DELAY_MS = 1_000_000


def fold_toasts(events: DataFrame, until: Column | None = None, delay_ms: int = REMOVE_DELAY_MS) -> DataFrame:
    """``events`` (list_id, ts, seq, type, toast_id, title, description) to the message each list shows at the moment ``until``, if any:
    (list_id, toast_id, title, description, open). Without ``until`` a list's clock stops at its last event.

    A list holds one message, the one added last. An update changes what it gives (not null)
    of the message with its id; a dismiss closes and a remove takes away the message with its
    id, or any if it names none. A dismissed message is removed after ``delay_ms``, before events of the same moment; a further dismiss
    within that time changes nothing, one after it starts another delay.
    """
    known = events if until is None else events.filter(F.col("ts") <= until)
    messages = _messages(known, delay_ms)
    head = F.struct(F.col("added.ts").alias("ts"), F.col("added.seq").alias("seq"), "toast_id", "added", "retitled", "described", "state")
    by_list = messages.groupBy("list_id").agg(F.max(F.when(F.col("added").isNotNull(), head)).alias("head"), F.max("seen").alias("seen"))
    clock = F.unix_micros((F.col("seen") if until is None else until).cast("timestamp"))
    flat = by_list.filter(F.col("head").isNotNull()).select("list_id", "head", "head.*", clock.alias("clock"))
    there = F.col("state.present") & ~F.coalesce(F.col("state.timer") <= F.col("clock"), F.lit(False))
    title = F.when(_after("retitled", "head"), F.col("retitled.title")).otherwise(F.col("added.title"))
    description = F.when(_after("described", "head"), F.col("described.description")).otherwise(F.col("added.description"))
    return flat.filter(there).select("list_id", "toast_id", title.alias("title"), description.alias("description"), (~F.col("state.shut")).alias("open"))


def toast_expiries(events: DataFrame, delay_ms: int = REMOVE_DELAY_MS) -> DataFrame:
    """(list_id, toast_id, seq, expires): each delay that a dismiss (of this seq) starts, and when it ends.

    A dismiss with an id starts one unless one is running for the id, whether the list holds that message or not; a dismiss without
    id is one of the message that the list holds then, if it holds any.
    """
    started = _messages(events, delay_ms).select("list_id", "toast_id", F.explode("state.starts").alias("s"))
    return started.select("list_id", "toast_id", "s.seq", F.timestamp_micros("s.at").alias("expires"))


def latest_toast(events: DataFrame) -> DataFrame:
    """(list_id, toast_id, title) of each list's last add; its id is the count of the list's adds."""
    adds = events.filter(F.col("type") == "ADD").groupBy("list_id").agg(F.count("*").alias("n"), _latest(F.lit(True), "title").alias("last"))
    return adds.select("list_id", toast_id(F.col("n")).alias("toast_id"), "last.title")

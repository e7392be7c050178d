import json
import os
import random
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import schema
from quillspark.functions import reltime, text
from quillspark.operators import changelog, lookup, search, slots, store, views
from quillspark.sources import codec, files, json_array
from quillspark.sources.note_files import NoteFiles
from quillspark.sources.search_index import SearchIndex, code, codes, grams
from quillspark.streaming import changed, folds, in_order, note_state, status
from quillspark.streaming.feed import Feed


def moment():
    return F.to_timestamp(F.lit("2024-02-10 12:00:00"))

PREVIEWS = [
    ("# Title\nbody", "Title"), ("#Title", "#Title"), (" # Title", "# Title"), ("**bold** and *it*", "bold and it"), ("`code`", "code"),
    ("[text](http://x)", "text"), ("![alt](u)", "!alt"), ("[](u)", "[](u)"), ("\n\t\n  second", "second"), ("", ""), (None, ""),
    ("a" * 60, "a" * 60), ("a" * 61, "a" * 60 + "..."), ("# \nnext", "next"), (" ﻿x", "x"), ("x\r# y", "x\ry"),
]


def test_preview(spark):
    rows = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(PREVIEWS)], "k int, m string").select("k", text.preview(F.col("m")).alias("p"))
    assert {r.k: r.p for r in rows.collect()} == {k: p for k, (_, p) in enumerate(PREVIEWS)}


def test_relative_dates(spark):
    cases = {
        "2024-02-10 12:00:00.000": "Today", "2024-02-09 12:00:00.001": "Today", "2024-02-09 12:00:00.000": "Yesterday", "2024-02-08 12:00:00.000": "2 days ago",
        "2024-02-03 12:00:00.001": "6 days ago", "2024-02-03 12:00:00.000": "Feb 3", "2023-12-25 00:00:00.000": "Dec 25", "2024-02-10 12:00:00.001": "-1 days ago",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", reltime.label(F.to_timestamp("t"), moment()).alias("l")).collect()
    assert {r.t: r.l for r in rows} == cases


def _notes(spark, rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t, b, None, tags, at, at, "o", p) for p, (i, t, b, tags) in enumerate(rows)], schema.NOTE)


def _ids(df):
    return [r.id for r in df.orderBy("position").collect()]


@pytest.mark.parametrize(("query", "three", "two"), [("", "AB", "AB"), ("PLAN", "A", "A"), ("%", "A", "A"), ("_", "B", "B"), ("work", "A", ""), (" ", "A", "A")])
def test_search(spark, query, three, two):
    notes = _notes(spark, [("A", "Plan 100%", "x", ["Work"]), ("B", "b", "a_b", [])])
    assert _ids(search.by_all(notes, query)) == list(three)
    assert _ids(search.by_title_or_body(notes, query)) == list(two)


def test_codec(spark):
    cases = {
        "missing": None, "empty": "", "bad": "not json", "cut": '[{"id":"a"}', "null": "null",
        "one": '[{"id":"a","createdAt":"2024-01-05T10:20:30.123Z"}]', "no date": '[{"id":"b","createdAt":null}]',
    }
    stored = spark.createDataFrame(list(cases.items()), "key string, value string")
    rows = {r.id: r for r in codec.decode_notes(stored).collect()}
    assert set(rows) == {"a", "b"} and rows["b"].created_at is None
    assert rows["a"].created_at.microsecond == 123000
    set_aside = stored.filter(codec.broken(F.col("value"), schema.STORED_NOTE))
    assert {r.key for r in set_aside.collect()} == {"bad", "cut"}


def test_changes(spark):
    notes = _notes(spark, [("A", "a", "x", []), ("B", "b", "y", ["t"])])
    made = store.create_note(notes, "C", moment(), {"title": ""})
    assert _ids(made) == ["C", "A", "B"]
    c = made.filter("id = 'C'").first()
    assert c.title == "" and c.markdown_content == schema.DEFAULT_BODY and c.created_at == c.updated_at
    patches = spark.createDataFrame([("B", ["title"], "t", "z"), ("Z", ["title"], "t", None)], "id string, set_mask array<string>, title string, markdown_content string")
    changed = store.update_notes(notes, patches, moment())
    assert _ids(changed) == ["A", "B"]
    b = changed.filter("id = 'B'").first()
    assert (b.title, b.markdown_content, b.updated_at) == ("t", "y", datetime(2024, 2, 10, 12))
    gone = spark.createDataFrame([("A",)], "id string")
    left = store.delete_notes(notes, gone)
    assert _ids(left) == ["B"] and store.deleted_any(notes, gone).first().removed
    assert store.reselect(left, "A", "A", "new", moment()).first().id == "B"
    assert store.reselect(store.delete_notes(left, left), "B", "B", "new", moment()).first().id == "new"
    stale = spark.createDataFrame([("Z",)], "id string")
    assert views.current_or_first(notes, stale).first().id == "A"
    assert _ids(store.delete_notes(made, made.filter("id = 'C'"))) == ["A", "B"]


def test_empty_collection(spark):
    none = _notes(spark, [])
    assert store.create_note(none, "C", moment()).first().position == -1
    assert views.empty_state(none, "").first().message == "No notes yet"
    assert views.index_of(none, "A").first().position == -1


def test_staged_write(spark, tmp_path):
    path = str(tmp_path / "notes")
    files.write_collection(_notes(spark, [("A", "a", "x", [])]), path)
    files.write_collection(store.create_note(files.read_collection(spark, path), "C", moment()), path)
    assert _ids(files.read_collection(spark, path)) == ["C", "A"]
    assert [p.name for p in tmp_path.iterdir()] == ["notes"]


def test_repeated_patches(spark):
    notes = _notes(spark, [("A", "a", "x", []), ("B", "b", "y", ["t"])])
    patches = spark.createDataFrame([("B", 1, ["title", "id"], "t1", "C"), ("B", 2, ["title"], None, None)], "id string, seq int, set_mask array<string>, title string, new_id string")
    changed = store.update_notes(notes, patches, moment())
    assert [(r.id, r.title) for r in changed.orderBy("position").collect()] == [("A", "a"), ("C", None)]


def test_slots(spark, tmp_path):
    path = str(tmp_path / "slot")
    for value, held in (("A", ["A"]), ("", []), ("B", ["B"]), (None, [])):
        files.write_slot(spark, path, value)
        assert [r.id for r in files.read_slot(spark, path).collect()] == held
    notes = _notes(spark, [("A", "a", "x", []), ("B", "b", "y", [])])
    none = spark.createDataFrame([], "session int, id string")
    asked = spark.createDataFrame([(1, 1, "B"), (1, 2, "Z"), (2, 1, "Z")], "session int, seq int, id string")
    picked = slots.selected(none, asked, notes)
    assert [tuple(r) for r in picked.collect()] == [(1, "B")]
    stale = slots.written(picked, spark.createDataFrame([(3, 1, "Z"), (1, 1, None)], "session int, seq int, id string"))
    assert sorted(map(tuple, stale.collect())) == [(3, "Z")]
    sessions = spark.createDataFrame([(1,), (3,)], "session int")
    assert sorted(map(tuple, slots.loaded(stale, sessions, notes).collect())) == [(1, "A", "A"), (3, "A", "Z")]


def test_set_aside(spark, tmp_path):
    stored = spark.createDataFrame([("a", "[]"), ("b", "not json")], "key string, value string")
    assert [r.key for r in files.set_aside(stored, schema.STORED_NOTE, str(tmp_path / "aside")).collect()] == ["a"]
    assert [r.key for r in spark.read.parquet(str(tmp_path / "aside")).collect()] == ["b"]


def _at(ms):
    return datetime.fromtimestamp(ms / 1000)


EDITS = [("n", _at(ms), seq, "x") for seq, ms in enumerate((0, 500, 1299, 3000))]
#: As the reducer's source has it: an update of a message that was replaced does nothing, and a second dismiss of an id starts no new delay.
TOASTS = [
    ("l", _at(k), k, kind, toast_id, title, text)
    for k, (kind, toast_id, title, text) in enumerate([
        ("ADD", "1", "one", None), ("ADD", "2", "two", "text"), ("UPDATE", "1", "lost", None), ("UPDATE", "2", "new", None), ("DISMISS", "1", None, None), ("DISMISS", "2", None, None),
        ("DISMISS", None, None, None), ("REMOVE", "1", None, None),
    ])
]
TOAST_DDL = "list_id string, ts timestamp, seq long, type string, toast_id string, title string, description string"


def test_sessions(spark):
    found = changelog.save_sessions(spark.createDataFrame(EDITS, "note_id string, ts timestamp, seq long, value string"), "800 milliseconds")
    assert sorted((r.saved.timestamp() * 1000, r.edits) for r in found.collect()) == [(2099, 3), (3800, 1)]


def test_sessions_over_pieces(spark):
    """Sessions that span many pieces of time, ties, an event exactly one gap later, null keys and times."""
    r = random.Random(13)
    rows, at = [], datetime(2024, 4, 6, 12)
    for seq in range(500):
        at += timedelta(minutes=r.choice([0, 1, 20, 29, 30, 31, 90]))
        rows.append((r.choice(["hot", "hot", "hot", None]), None if r.random() < 0.02 else at, seq, "x"))
    edits = spark.createDataFrame(rows, "note_id string, ts timestamp, seq long, value string")
    expected = []
    for key in ("hot", None):
        times = sorted(t for k, t, *_ in rows if k == key and t)
        runs = [[times[0]]]
        for before, t in zip(times, times[1:], strict=False):
            runs.append([t]) if t > before + timedelta(minutes=30) else runs[-1].append(t)
        expected += [(key, x[0], x[-1] + timedelta(minutes=30), len(x)) for x in runs]
    assert sorted(map(tuple, changelog.save_sessions(edits, "30 minutes").collect()), key=repr) == sorted(expected, key=repr)


def test_toasts(spark):
    events = spark.createDataFrame(TOASTS, TOAST_DDL)
    assert [tuple(r) for r in changelog.fold_toasts(events).collect()] == [("l", "2", "new", "text", False)]
    expiry = changelog.toast_expiries(events).collect()
    assert sorted((r.toast_id, r.seq, round(r.expires.timestamp() * 1000)) for r in expiry) == [("1", 4, 1_000_004), ("2", 5, 1_000_005)]
    gone = events.unionByName(spark.createDataFrame([("l", _at(9), 9, "REMOVE", None, None, None), ("l", _at(10), 10, "DISMISS", None, None, None)], TOAST_DDL))
    assert changelog.fold_toasts(gone).count() == 0
    assert sorted(r.seq for r in changelog.toast_expiries(gone).collect()) == [4, 5]
    assert [tuple(r) for r in changelog.latest_toast(events).collect()] == [("l", "2", "two")]
    assert [r.adds for r in changelog.numbered_adds(events).orderBy("seq").collect()] == [1] + [2] * 7


class PlainToasts:
    """The message list of the user interface, with a clock of its own: timers fire before events of their moment."""

    def __init__(self, delay):
        self.delay, self.held, self.timers, self.starts = delay, None, {}, []

    def pass_time(self, now):
        for which in [i for i, at in self.timers.items() if at <= now]:
            del self.timers[which]
            if self.held and self.held[0] == which:
                self.held = None

    def dispatch(self, now, seq, kind, which, title, text):
        self.pass_time(now)
        hit = self.held is not None and which in (None, self.held[0])
        if kind == "ADD":
            self.held = [which, title, text, True]
        elif kind == "UPDATE" and hit:
            self.held[1:3] = title or self.held[1], text or self.held[2]
        elif kind == "DISMISS":
            meant = which or (self.held[0] if self.held else None)
            if meant and meant not in self.timers:
                self.timers[meant] = now + self.delay
                self.starts.append((meant, seq, now + self.delay))
            if hit:
                self.held[3] = False
        elif kind == "REMOVE" and hit:
            self.held = None


def _toast_log(r, lists, steps, delay):
    """Random logs that span several delays, some of whose events fall on the moment of a removal."""
    rows = []
    for name in lists:
        now, n = 0, 0
        for k in range(steps):
            now += r.choice([0, 1, delay // 3, delay // 2, delay, 2 * delay])
            kind = r.choice(["ADD", "UPDATE", "UPDATE", "DISMISS", "DISMISS", "DISMISS", "REMOVE"]) if k % 5 else "DISMISS"
            n += kind == "ADD"
            which = str(n) if kind == "ADD" else r.choice([str(max(1, n)), str(max(1, n - 1)), None if kind != "UPDATE" else str(n)])
            rows.append((name, _at(now), k, kind, which, r.choice(["t", None]) and f"t{k}", r.choice(["d", None]) and f"d{k}"))
    return rows


def _plain(rows, delay, until):
    lists, starts, held = {}, {}, {}
    for name, at, *event in sorted(rows, key=lambda e: (e[0], e[1], e[2])):
        state = lists.setdefault(name, PlainToasts(delay))
        starts[name] = state.starts
        if (now := round(at.timestamp() * 1000)) <= until:
            state.dispatch(now, *event)
            held[name] = state
    for state in held.values():
        state.pass_time(until)
    return {n: tuple(x.held) for n, x in held.items() if x.held}, sorted((n, *x) for n, state in lists.items() for x in state.starts)


@pytest.mark.parametrize("delay", [1000, 1_000_000])
def test_toasts_by_a_plain_reducer_with_a_clock(spark, delay):
    rows = _toast_log(random.Random(4), "abcdefghijkl", 60, delay)
    events = spark.createDataFrame(rows, TOAST_DDL)
    last = max(round(e[1].timestamp() * 1000) for e in rows)
    _, starts = _plain(rows, delay, 2 * last)
    assert sorted((x.list_id, x.toast_id, x.seq, round(x.expires.timestamp() * 1000)) for x in changelog.toast_expiries(events, delay).collect()) == starts
    assert len({x[:2] for x in starts}) < len(starts)
    for until in (last // 3, last // 2, last, last + delay):
        held, _ = _plain(rows, delay, until)
        got = changelog.fold_toasts(events, F.timestamp_millis(F.lit(until)), delay)
        assert {x[0]: tuple(x[1:]) for x in got.collect()} == held
    # without a moment each list's clock stops at its last event
    ends = {}
    for name in "abcdefghijkl":
        own = [e for e in rows if e[0] == name]
        ends |= _plain(own, delay, max(round(e[1].timestamp() * 1000) for e in own))[0]
    assert {x[0]: tuple(x[1:]) for x in changelog.fold_toasts(events, delay_ms=delay).collect()} == ends


def test_a_dismiss_after_the_removal_starts_another_delay(spark):
    log = [("l", _at(ms), k, kind, "1", title, None) for k, (ms, kind, title) in enumerate([(0, "ADD", "a"), (1000, "DISMISS", None), (3_000_000, "UPDATE", "late"), (3_001_000, "DISMISS", None)])]
    events = spark.createDataFrame(log, TOAST_DDL)
    assert changelog.fold_toasts(events).count() == 0
    assert sorted(x.seq for x in changelog.toast_expiries(events).collect()) == [1, 3]


def _stream(spark, path, batches, ddl):
    """A stream with one file, and so one batch, for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(path / f"in/{k}"))
        part = next((path / f"in/{k}").glob("*.parquet"))
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(path / "in/*"))


def _finish(writer, path):
    writer.option("checkpointLocation", str(path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(240)


def test_toast_stream_is_the_plain_reducer(spark, tmp_path):
    delay = 1_000_000
    rows = sorted(_toast_log(random.Random(9), "abcd", 25, delay), key=lambda e: (e[1], e[2]))
    end = max(round(e[1].timestamp() * 1000) for e in rows)
    rows.append(("z", _at(end + 60_000), 999, "ADD", "1", "end", None))
    cuts = [rows[:30], rows[30:70], rows[70:]]
    seen = []
    out = folds.toasts(_stream(spark, tmp_path, cuts, TOAST_DDL), delay_ms=delay)
    _finish(out.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((n, tuple(r)) for r in df.collect())), tmp_path)
    # the watermark ends ten seconds before the last event, after every removal that is due by then
    held, _ = _plain(rows, delay, end + 50_000)
    last = {r[0]: r[1:] for _, r in seen}
    assert {n: r for n, r in last.items() if r[0] is not None and n != "z"} == {n: r for n, r in held.items() if n != "z"}


# ---- logs of notes in any order --------------------------------------------------------------

LOG_DDL = "note_id string, ts timestamp, seq long, op string, set_mask array<string>, title string, markdown_content string, folder_id string, tags array<string>"


def _note_logs(r, notes, steps):
    """Random logs of many notes; events of one moment differ by seq."""
    rows = []
    for k in range(notes):
        for seq in range(r.randrange(1, steps)):
            op = r.choice(["create", "patch", "patch", "patch", "delete", "select"])
            mask = r.sample(["title", "markdown_content", "folder_id", "tags"], r.randrange(0, 4)) if op in ("create", "patch") else None
            value = r.choice([None, f"v{seq}", 'a "quoted" \\ line\n'])
            rows.append((f"n{k}", _at(r.randrange(6)), seq, op, mask, value, f"b{seq}", value, r.choice([None, [], ["x", f"t{seq}"]])))
    return rows


def _plain_notes(rows):
    """The notes after the events in the order of their moments."""
    notes = {}
    for note_id, at, _, op, mask, title, body, folder, tags in sorted(rows, key=lambda e: (e[0], e[1], e[2])):
        given = {k: v for k, v in (("title", title), ("markdown_content", body), ("folder_id", folder), ("tags", tags)) if k in (mask or [])}
        if op == "create":
            fields = {"title": schema.DEFAULT_TITLE, "markdown_content": schema.DEFAULT_BODY, "folder_id": None, "tags": [], "owner_id": schema.DEFAULT_OWNER}
            notes[note_id] = fields | {k: v for k, v in given.items() if v is not None} | {"created_at": at, "updated_at": at}
        elif op == "patch" and note_id in notes:
            notes[note_id] |= given | {"updated_at": at}
        elif op == "delete":
            notes.pop(note_id, None)
    return {k: tuple(v.values()) for k, v in notes.items()}


def _as_dict(df):
    return {r.note_id: tuple(r[1:]) for r in df.collect()}


def test_log_table_and_stream_agree_in_any_order(spark, tmp_path):
    """A thousand notes' logs, dealt to batches in any order, some of them twice."""
    r = random.Random(11)
    rows = _note_logs(r, 1000, 9)
    expected = _plain_notes(rows)
    assert _as_dict(changelog.fold_notes(spark.createDataFrame(rows, LOG_DDL))) == expected
    r.shuffle(rows)
    batches = [rows[k::5] for k in range(5)]
    batches.append(r.sample(rows, 300))
    table = folds.NoteTable(spark, str(tmp_path / "table"), compact_every=2)
    for k, batch in enumerate(batches):
        table(spark.createDataFrame(batch, LOG_DDL), k)
        if k == 3:
            table(spark.createDataFrame(batches[2], LOG_DDL), 2)  # repeated after it went into a base
    assert _as_dict(table.current()) == expected
    assert table._numbers("base") == [3, 5] and table._numbers("clocks") == [4, 5]
    changes = note_state.note_changes(_stream(spark, tmp_path, batches, LOG_DDL))
    _finish(changes.writeStream.outputMode("update").foreachBatch(note_state.change_log(str(tmp_path / "changes"))), tmp_path)
    assert _as_dict(note_state.notes_of_changes(spark, str(tmp_path / "changes"))) == expected


def test_late_events(spark, tmp_path):
    """What was found wrong: an earlier event in a later batch is ignored, and a late one revives a deleted note."""
    table = folds.NoteTable(spark, str(tmp_path))
    ddl = "note_id string, ts timestamp, seq long, op string, set_mask array<string>, title string"
    table(spark.createDataFrame([("n", _at(1), 1, "create", None, None), ("n", _at(5), 5, "patch", ["folder_id"], None), ("d", _at(1), 2, "create", None, None), ("d", _at(9), 9, "delete", None, None)], ddl), 0)
    seen = []
    table.subscribe(lambda notes: seen.append(notes.count()))
    table.listeners.append(lambda notes: 1 / 0)
    table(spark.createDataFrame([("n", _at(3), 3, "patch", ["title"], "late"), ("d", _at(4), 4, "create", ["title"], "back")], ddl), 1)
    assert [(x.note_id, x.title) for x in table.current().collect()] == [("n", "late")] and seen == [1, 1]


# ---- what an editor shows --------------------------------------------------------------------


def _plain_statuses(events, gap):
    """One session's editor as it takes the events in order, with a clock."""
    opened, pending, out = None, None, []
    for ms, seq, note, edit in sorted(events):
        if pending and pending[0] < ms:
            out.append((opened, "saved", *pending))
            pending = None
        if note != opened:
            opened, pending = note, None
        if edit:
            if not pending:
                out.append((note, "saving", ms, seq))
            pending = (ms + gap, seq)
    return out + ([(opened, "saved", *pending)] if pending else [])


STATUS_DDL = "session string, ts timestamp, seq long, note_id string, edit boolean"


def test_statuses(spark, tmp_path):
    r = random.Random(3)
    rows, now = [], dict.fromkeys("abcdef", 0)
    for seq in range(400):
        name = r.choice("aaabcdef")
        now[name] += r.choice([0, 100, 799, 800, 801, 3000])
        rows.append((name, _at(now[name]), seq, r.choice(["n1", "n1", "n1", "n2"]), r.random() < 0.7))
    expected = sorted((name, *x) for name in now for x in _plain_statuses([(round(t.timestamp() * 1000), s, n, e) for who, t, s, n, e in rows if who == name], 800))
    plain = [*rows, ("a", _at(5), 9999, None, True)]
    got = changelog.save_statuses(spark.createDataFrame(plain, STATUS_DDL))
    assert sorted((x.session, x.note_id, x.status, round(x["at"].timestamp() * 1000), x.seq) for x in got.collect()) == expected
    # as a stream in three batches, each in any order and with events that come before those of the batch before
    order = sorted(rows, key=lambda e: (e[1], e[2]))
    order = [e for k in range(0, len(order), 8) for e in r.sample(order[k : k + 8], len(order[k : k + 8]))]
    end = _at(max(now.values()) + 3_600_000)
    out = status.statuses(_stream(spark, tmp_path, [order[:150], order[150:290], order[290:], [("z", end, 0, "n", False)]], STATUS_DDL), lateness="200 seconds")
    _finish(out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "rows")), tmp_path)
    shown = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert sorted((x.session, x.note_id, x.status, round(x["at"].timestamp() * 1000), x.seq) for x in shown) == expected


def test_opening_another_note_drops_the_save(spark):
    rows = [("s", _at(ms), ms, note, edit) for ms, note, edit in ((0, "a", True), (500, "a", False), (600, "b", False), (2000, "b", True), (2100, "b", False))]
    got = changelog.save_statuses(spark.createDataFrame(rows, STATUS_DDL)).orderBy("at").collect()
    assert [(x.note_id, x.status, round(x["at"].timestamp() * 1000)) for x in got] == [("a", "saving", 0), ("b", "saving", 2000), ("b", "saved", 2800)]


def test_changed_edits_of_a_stream(spark, tmp_path):
    """In any order within the watermark, over batches, with null values; and forgotten after a time."""
    r = random.Random(5)
    rows = [(r.choice("aaab"), _at(10_000 + 100 * k), k, r.choice(["x", "x", "y", None])) for k in range(240)]
    ddl = "note_id string, ts timestamp, seq long, value string"
    expected = sorted(x.seq for x in changelog.changed_edits(spark.createDataFrame(rows, ddl)).collect())
    order = [e for k in range(0, len(rows), 10) for e in r.sample(rows[k : k + 10], 10)]
    batches = [order[:75], order[75:160], order[160:], [("z", _at(3_600_000), 0, "end")]]
    out = changed.changed_edits(_stream(spark, tmp_path / "all", batches, ddl), "5 seconds")
    _finish(out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "rows")), tmp_path / "all")
    assert sorted(x.seq for x in spark.read.parquet(str(tmp_path / "rows")).collect() if x.note_id != "z") == expected
    few = [[("n", _at(1000), 0, "x"), ("n", _at(1050), 1, "x"), ("n", _at(1151), 2, "x"), ("n", _at(1251), 3, "x")], [("z", _at(3_600_000), 0, "end")], [("n", _at(3_700_000), 4, "x"), ("z", _at(9_900_000), 1, "end")]]
    out = changed.changed_edits(_stream(spark, tmp_path / "few", few, ddl), "5 seconds", keep_ms=100)
    _finish(out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "kept")), tmp_path / "few")
    # after 101 ms the value is forgotten, after 100 ms at the moment of an edit it isn't yet
    assert sorted(x.seq for x in spark.read.parquet(str(tmp_path / "kept")).collect() if x.note_id == "n") == [0, 2, 4]


def test_a_feed_goes_on_after_a_restart(spark, tmp_path):
    """Subscribers that stop, with and without a commit, while a stream goes on in three runs from its checkpoint."""
    r = random.Random(21)
    logs = _note_logs(r, 60, 9)
    r.shuffle(logs)
    runs, path = [logs[:100], logs[100:200], logs[200:]], tmp_path / "feed"
    seen = {"early": {}, "late": {}, "lost": {}}

    def read(name, commit=True):
        feed = Feed(spark, str(path), "note_id")  # a new one each time, as after a restart
        news = feed.pull(name)
        if news is None:
            return None
        if news.state:
            seen[name] = {}
        for row in sorted(news.rows.collect(), key=lambda x: x.batch):
            seen[name][row.note_id] = (row.live, row.title, row.folder_id)
        if commit:
            feed.commit(name, news)
        return news

    def run(k):
        part = tmp_path / f"in/{k}"
        spark.createDataFrame(runs[k], LOG_DDL).coalesce(1).write.parquet(str(part))
        os.utime(next(part.glob("*.parquet")), (1_700_000_000 + k, 1_700_000_000 + k))
        stream = spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        changes = note_state.note_changes(stream)
        _finish(changes.writeStream.outputMode("update").foreachBatch(Feed(spark, str(path), "note_id")), tmp_path)

    assert read("early") is None
    run(0)
    assert read("early").state and read("early") is None
    read("lost", commit=False)
    run(1)
    assert not read("early").state
    news = read("late")
    assert news.state and read("lost", commit=False).state  # it never committed, so it begins anew
    assert read("lost").state
    assert Feed(spark, str(path), "note_id").compact() == 1
    run(2)
    assert not read("early").state and not read("late").state and not read("lost").state
    expected = {k: (True, v[0], v[2]) for k, v in _plain_notes(logs).items()}
    for name in seen:
        assert {k: v for k, v in seen[name].items() if v[0]} == expected
    assert Feed(spark, str(path), "note_id").position("early") == 2
    new = Feed(spark, str(path), "note_id").pull("new")
    assert {x.note_id: (x.live, x.title, x.folder_id) for x in new.rows.collect() if x.live} == expected


# ---- notes in files --------------------------------------------------------------------------


def _many(spark, n):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(f"id{k}", f"Title {k}", f"body of note {k} {'quince' if k % 97 == 5 else 'pear'}", None, [f"tag{k % 9}"], at, at, "o", k) for k in range(n)], schema.NOTE)


def test_a_change_copies_only_the_files_it_touches(spark, tmp_path):
    notes = _many(spark, 600).cache()
    files = NoteFiles(spark, str(tmp_path), buckets=32)
    first = files.write(notes)
    assert len(first.written) == 32 and files.read().count() == 600
    patches = spark.createDataFrame([(f"id{k}", ["title"], "new", None) for k in (3, 50, 411)] + [("unknown", ["title"], "x", None), (None, ["title"], "x", None)], "id string, set_mask array<string>, title string, new_id string")
    holders = {b.bucket for b in notes.filter("id IN ('id3', 'id50', 'id411')").select(files.bucket(F.col("id")).alias("bucket")).collect()}
    change = files.patch(patches, moment())
    assert len(change.dropped) == len(holders) == len(change.written)
    # the other files are the very same
    assert {r.file for r in files.live().collect()} - set(change.written) == set(first.written) - set(change.dropped)
    expected = sorted(map(tuple, store.update_notes(notes, patches, moment()).collect()), key=repr)
    assert sorted(map(tuple, files.read().collect()), key=repr) == expected
    assert sorted(map(tuple, files.read(0).collect()), key=repr) == sorted(map(tuple, notes.collect()), key=repr)
    # unknown ids touch nothing, a new id moves a note to its own bucket
    assert files.delete(spark.createDataFrame([("nobody",)], "id string")).dropped == []
    files.patch(spark.createDataFrame([("id7", ["id"], "seven")], "id string, set_mask array<string>, new_id string"), moment())
    seven = spark.createDataFrame([("seven",)], "id string")
    assert files.find(seven).filter("id = 'seven'").count() == 1 and files.read().filter("id = 'id7'").count() == 0
    files.append(_many(spark, 2).withColumn("id", F.concat(F.lit("new"), "id")))
    assert files.read().count() == 602
    gone = files.delete(seven)
    assert len(gone.dropped) == 1 and files.read().count() == 601
    before = files.live().count()
    assert len(files.compact(1).dropped) > 0 and files.live().count() < before and files.read().count() == 601
    known = files.versions()
    assert files.vacuum(2) > 0 and files.versions() == known[-2:] and files.read().count() == 601


def test_kept_previews(spark, tmp_path):
    notes = store.with_previews(_notes(spark, [("A", "a", "# one\nx", []), ("B", "b", "**two**", [])]))
    patches = spark.createDataFrame([("B", ["title"], "t", "lost"), ("A", ["markdown_content"], None, "`three`")], "id string, set_mask array<string>, title string, markdown_content string")
    changed = store.update_notes(notes, patches, moment())
    assert {r.id: r.preview for r in changed.collect()} == {"A": "three", "B": "two"}
    made = store.create_note(changed, "C", moment())
    assert {r.id: r.preview for r in made.collect()}["C"] == "New note"
    assert store.reselect(store.delete_notes(made, made), "A", "A", "new", moment()).first().preview == "New note"
    files = NoteFiles(spark, str(tmp_path), buckets=2)
    files.write(made)
    listed = views.list_view(files.read(), moment(), "A")
    assert [(r.id, r.preview, r.active) for r in listed.orderBy("position").collect()] == [("C", "New note", False), ("A", "three", True), ("B", "two", False)]
    scan = listed._jdf.queryExecution().executedPlan().toString()
    assert "preview" in scan and "markdown_content" not in scan


ITEM = "id string, n int, inner struct<a: string, b: array<struct<c: string>>>"


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_json_arrays_by_ranges_of_bytes(spark, tmp_path, split):
    r = random.Random(split)
    nasty = ['}', '{', '"', "\\", '\\"', "}},{", "[", "]", "é😀", "\n", "\\\\", "a" * 90, ",", ""]
    items = [{"id": f"i{k}", "n": r.choice([k, None, "wrong"]), "inner": {"a": "".join(r.choice(nasty) for _ in range(r.randrange(6))), "b": [{"c": r.choice(nasty)} for _ in range(r.randrange(3))]}} for k in range(120)]
    for name, text in (("a", json.dumps(items)), ("b", json.dumps(items[:40], indent=1, ensure_ascii=False)), ("c", "[]"), ("d", ""), ("e", json.dumps(items[3])), ("f", ",".join(map(json.dumps, items[:5])) + ",\n")):
        (tmp_path / f"{name}.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = json_array.read_array(spark, str(tmp_path), T.StructType.fromDDL(ITEM))
        if split == 64:
            assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 50
        got = {}
        for x in found.good.orderBy("position").collect():
            got.setdefault(x.file[-6], []).append(x["item"].asDict(True))
        assert found.broken.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    stored = spark.createDataFrame([("a", json.dumps(items)), ("b", json.dumps(items[:40])), ("e", json.dumps(items[3])), ("f", json.dumps(items[:5]))], "key string, value string")
    decoded = {x.key: [i.asDict(True) for i in x["items"]] for x in stored.select("key", codec.decode(F.col("value"), T.StructType.fromDDL(ITEM)).alias("items")).collect()}
    assert got == decoded


def test_broken_items_of_an_array(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": "a"}, {"id": }, 5, {"id": "b"}, {"id": "cut')
    (tmp_path / "y.json").write_text("not json")
    found = json_array.read_array(spark, str(tmp_path), T.StructType.fromDDL(ITEM))
    assert sorted(x["item"].id for x in found.good.collect()) == ["a"]
    assert sorted(x.text for x in found.broken.collect()) == sorted(['{"id": }', '5, {"id": "b"}', '{"id": "cut', "not json"])


def test_a_rewrite_sets_broken_items_aside(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/x.json").write_text('[{"id": "a", "n": 1}, {"id": }, {"id": "b"}]')
    path, aside, item = str(tmp_path / "notes"), str(tmp_path / "aside"), T.StructType.fromDDL("id string, n int")
    json_array.rewrite(spark, path, item, lambda items: items.filter("item.id <> 'b'").select(F.struct("item.id", (F.col("item.n") + 1).alias("n")).alias("item")), aside)
    assert [tuple(x["item"]) for x in json_array.read_array(spark, path, item).good.collect()] == [("a", 2)]
    assert [x.text for x in spark.read.parquet(aside).collect()] == ['{"id": }']
    with pytest.raises(Exception, match="zero"):
        json_array.rewrite(spark, path, item, lambda items: items.select(F.struct("item.id", F.expr("1 div (item.n - 2)").alias("n")).alias("item")), aside)
    assert [tuple(x["item"]) for x in json_array.read_array(spark, path, item).good.collect()] == [("a", 2)]
    assert sorted(p.name.split(".")[0] for p in tmp_path.iterdir() if "staged" not in p.name) == ["aside", "notes"]


def test_nested_dates(spark):
    stored = [
        ("a", '[{"id": 1, "createdAt": "2024-01-05T10:20:30.123Z", "x": {"y": [{"z": [[{"updatedAt": "2024-01-06T00:00:00Z"}]]}]}}]'),
        ("b", '{"createdAt": {"updatedAt": "2024-01-06T00:00:00Z"}, "updatedAt": "no date", "createdat": "2024-01-06T00:00:00Z"}'),
        ("c", "not json"), ("d", None), ("e", "[]"), ("f", '"2024-01-06T00:00:00Z"'), ("g", '{"k": {"createdAt": null}}'),
    ]
    got = codec.nested_dates(spark.createDataFrame(stored, "key string, value string")).collect()
    assert sorted((r.key, r.path, r["at"] and str(r["at"])) for r in got) == [
        ("a", "$[0].createdAt", "2024-01-05 10:20:30.123000"), ("a", "$[0].x.y[0].z[0][0].updatedAt", "2024-01-06 00:00:00"),
        ("b", "$.createdAt", None), ("b", "$.updatedAt", None), ("g", "$.k.createdAt", None),
    ]
    assert codec.nested_dates(spark.createDataFrame([], "key string, value string")).count() == 0


def test_versions_are_published_once(spark, tmp_path):
    files = NoteFiles(spark, str(tmp_path), buckets=2)
    with pytest.raises(FileNotFoundError):
        files.read()
    files.write(_many(spark, 0))
    assert files.read().count() == 0 and files.read().columns == schema.NOTE.names
    files.append(_many(spark, 3))
    behind = NoteFiles(spark, str(tmp_path), buckets=2)
    behind.versions = lambda: [0]  # another writer that has not seen the last version
    with pytest.raises(OSError, match="another writer"):
        behind._publish(files.live())
    assert files.read().count() == 3


@pytest.mark.parametrize("query", ["quince", "QUINCE", "note 41", "Title 7", "tag3", "no such text", "ea", "", " pear", "%", "body of note 599 pear", "İ"])
def test_indexed_search(spark, indexed, query):
    files, index = indexed
    for look in (search.by_all, search.by_title_or_body, search.by_tag):
        assert sorted(r.id for r in index.search(query, look).collect()) == sorted(r.id for r in look(files.read(), query).collect())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    files = NoteFiles(spark, str(tmp_path_factory.mktemp("files")), buckets=40)
    files.write(_many(spark, 600))
    index = SearchIndex(files, str(tmp_path_factory.mktemp("index")))
    index.build()
    return files, index


def test_the_index_reads_few_files(spark, indexed):
    files, index = indexed
    live = files.live().count()
    for query, most in (("quince", 7), ("note 599", 1), ("no such text", 0)):
        read = {r.f for r in index.search(query, search.by_all).select(F.input_file_name().alias("f")).distinct().collect()}
        assert len(files.holding(index.candidates(query))) <= most < live
        assert len(read) <= most
    # only common trigrams, or too few characters
    assert index.candidates("pear") is None and index.candidates("no") is None


def test_the_index_follows_changes(spark, tmp_path):
    files = NoteFiles(spark, str(tmp_path / "files"), buckets=8)
    files.write(_many(spark, 100))
    index = SearchIndex(files, str(tmp_path / "index"))
    index.build()
    assert index.search("zebra", search.by_all).count() == 0
    ids = spark.createDataFrame([("id5",)], "id string")
    files.patch(ids.select("id", F.array(F.lit("markdown_content")).alias("set_mask"), F.lit("a Zebra").alias("markdown_content")), moment())
    index.add(files.find(ids).join(ids, "id", "left_semi"))
    assert [r.id for r in index.search("zebra", search.by_all).collect()] == ["id5"]
    assert index.search("quince", search.by_all).filter("id = 'id5'").count() == 0  # its old text is still in the postings


def test_grams(spark):
    texts = ["", "ab", "abc", "abcabc", "😀é中x", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", grams(F.col("t")).alias("g")).collect()
    assert {r.k: r.g and sorted(r.g) for r in got} == {0: [], 1: [], 2: ["abc"], 3: ["abc", "bca", "cab"], 4: sorted(["😀é中", "é中x"]), 5: None}


def test_trigrams_are_numbers(spark, indexed):
    """The same trigrams as ``grams`` has, by numpy; counts and postings are as a plain count has them, and grams are found by number."""
    files, index = indexed
    for text in ("", "ab", "abc", "abcabc", "\U0001f600\u00e9\u4e2dx", "\U0010ffff" * 4):
        assert codes(text).tolist() == sorted({code(text[k : k + 3]) for k in range(len(text) - 2)})
    held = {}
    for note in files.read().collect():
        whole = "\n".join(x for x in (note.title, note.markdown_content, *(note.tags or [])) if x is not None).lower()
        for k in range(len(whole) - 2):
            held.setdefault(code(whole[k : k + 3]), set()).add(note.id)
    n = files.read().count()
    counts = {r.gram: (r.n, r.common) for r in spark.read.parquet(f"{index.path}/counts").collect()}
    assert counts == {g: (len(ids), len(ids) > 0.05 * n) for g, ids in held.items()}
    postings = sorted((r.gram, r.id) for r in spark.read.parquet(f"{index.path}/postings").collect())
    assert postings == sorted((g, i) for g, ids in held.items() if len(ids) <= 0.05 * n for i in ids)


def test_streams(spark, tmp_path):
    def stream(df, ddl, name):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(ddl).parquet(str(tmp_path / name))

    def finish(writer, name):
        writer.option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination(120)

    ddl = "note_id string, ts timestamp, seq long, value string"
    later = [*EDITS, ("late", _at(10_000_000), 9, "x")]
    sessions = folds.save_sessions(stream(spark.createDataFrame(later, ddl), ddl, "edits"))
    finish(sessions.writeStream.format("memory").queryName("sessions").outputMode("append"), "sessions")
    assert sorted(r.edits for r in spark.table("sessions").filter("note_id = 'n'").collect()) == [1, 3]

    toasts = folds.toasts(stream(spark.createDataFrame(TOASTS, TOAST_DDL), TOAST_DDL, "toasts"))
    finish(toasts.writeStream.format("memory").queryName("toasts").outputMode("update"), "toasts")
    assert ("l", "2", "new", "text", False) in [tuple(r) for r in spark.table("toasts").collect()]

    ddl = "note_id string, ts timestamp, seq long, op string, set_mask array<string>, title string, folder_id string"
    log = [
        ("n", _at(1), 1, "create", ["folder_id"], None, "f"), ("n", _at(2), 2, "patch", ["title"], "t", None), ("m", _at(1), 3, "patch", ["title"], "lost", None),
        ("d", _at(1), 4, "create", None, None, None), ("d", _at(2), 5, "delete", None, None, None), ("p", _at(1), 6, "create", ["title"], None, None), ("p", _at(3), 7, "patch", ["folder_id"], None, None),
    ]
    events = spark.createDataFrame(log, ddl)
    finish(stream(events, ddl, "events").writeStream.foreachBatch(folds.event_log(str(tmp_path / "log"))), "log")
    folded = sorted(map(tuple, changelog.fold_notes(events).collect()))
    assert sorted(map(tuple, folds.notes_of_log(spark, str(tmp_path / "log")).collect())) == folded
    assert [r[:2] + r[3:4] for r in folded] == [("n", "t", "f"), ("p", schema.DEFAULT_TITLE, None)]

    # the same log in three batches, one of them twice, into a table that listeners follow
    table, seen = folds.NoteTable(spark, str(tmp_path / "table")), []
    batches = [events.filter("seq < 3"), events.filter("seq BETWEEN 3 AND 5").unionByName(spark.createDataFrame([(None, _at(9), 9, "create", None, None, None), ("x", _at(9), 10, "?", None, None, None)], ddl)), events.filter("seq > 5")]
    table(batches[0], 0)
    stop = table.subscribe(lambda state: seen.append(state.count()))
    for number in (1, 1, 2):
        table(batches[number], number)
    stop()
    table(batches[2], 3)
    assert sorted(map(tuple, table.current().collect())) == folded and seen == [1, 1, 1, 2]
    assert spark.read.parquet(str(tmp_path / "table" / "quarantine")).count() == 2


def test_lookups(spark):
    config = spark.createDataFrame([(0, "a", None, {"light": "l1"}), (1, "b", "c2", None), (2, "x", "", None)], "ord int, key string, color string, theme map<string,string>")
    css = {r.theme: r.css for r in lookup.theme_css(config, ":r:").collect()}
    assert css["light"] == "\n [data-chart=r] {\n  --color-a: l1;\n  --color-b: c2;\n}\n"
    assert css["dark"] == "\n.dark [data-chart=r] {\n\n  --color-b: c2;\n}\n"
    items = spark.createDataFrame([(1, "k", {"k": "p"}, {}), (2, "k", {}, {"k": "none"}), (3, "z", None, None)], "item_id int, key string, payload map<string,string>, inner map<string,string>")
    labels = spark.createDataFrame([("p", "P"), ("k", "K")], "key string, label string")
    assert {r.item_id: r.label for r in lookup.item_config(items, labels).collect()} == {1: "P", 2: "K", 3: None}


@pytest.mark.parametrize("zone", ["UTC", "Australia/Adelaide"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_running_values_over_pieces(spark, zone, kind):
    """Values that depend on the events before, over a key with very many hours, gaps, ties, null keys, times and values."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        r = random.Random(7)
        start = datetime(2024, 4, 6, 12)
        rows = []
        for seq in range(600):
            key = r.choice(["hot"] * 8 + ["b", None])
            at = None if r.random() < 0.02 else start + timedelta(minutes=r.randrange(0, 6000, 7))
            rows.append((key, at, seq, r.choice(["x", "x", "y", None]), r.choice(["ADD", "UPDATE"]), 5))
        events = spark.createDataFrame([(k, str(t) if t else None, *rest) for k, t, *rest in rows], "note_id string, ts string, seq long, value string, type string, piece int")
        events = events.withColumn("ts", F.col("ts").cast(kind))
        ordered = sorted(rows, key=lambda e: (e[1] is not None, e[1] or start, e[2]))
        last, adds, changed, numbered = {}, {}, [], []
        for key, _, seq, value, type_, _ in ordered:
            if last.get(key) != value:
                changed.append(seq)
            last[key] = value
            adds[key] = adds.get(key, 0) + (type_ == "ADD")
            numbered.append((seq, adds[key]))
        got = changelog.changed_edits(events)
        assert got.columns == events.columns
        assert sorted(x.seq for x in got.collect()) == sorted(changed)
        lists = changelog.numbered_adds(events.withColumnRenamed("note_id", "list_id"))
        assert sorted((x.seq, x.adds) for x in lists.collect()) == sorted(numbered)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


class _Held:
    """A state variable in memory that counts how often it is asked."""

    def __init__(self, calls, many=False):
        self.calls, self.value = calls, [] if many else None

    def __getattr__(self, name):
        def called(*args):
            self.calls.append(name)
            if name in ("update", "put"):
                self.value = args[0]
            elif name in ("appendList",):
                self.value = [*self.value, *args[0]]
            elif name == "clear":
                self.value = None
            elif name == "iterator":
                return iter(())
            return list(self.value) if isinstance(self.value, list) else self.value

        return called


class _Handle:
    def __init__(self):
        self.calls, self.states = [], {}

    def getListState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, _Held(self.calls, True))

    def getValueState(self, name, *schemas):  # noqa: N802
        return self.states.setdefault(name, _Held(self.calls))

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("registerTimer")

    deleteTimer = registerTimer  # noqa: N815


class _Time:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_a_batch_asks_the_state_of_a_list_once():
    """Each call goes to the JVM and back, so their number mustn't grow with the events of a batch."""
    asked = []
    for n in (10, 1000):
        processor, handle = folds.ToastProcessor(10**9), _Handle()
        processor.init(handle)
        events = [Row(list_id="l", ts_us=k, seq=k, type=("ADD", "UPDATE", "DISMISS")[k % 3], toast_id=None, title=f"t{k}", description=None) for k in range(n)]
        assert len(list(processor.handleInputRows(("l",), iter(events), _Time(0)))) == 1
        asked.append([c for c in handle.calls if c not in ("updateValue", "registerTimer")])
        assert handle.calls.count("updateValue") == handle.calls.count("registerTimer") == n // 3
    assert asked[0] == asked[1]


@pytest.mark.parametrize("kind", ["edits", "editor"])
def test_a_batch_waits_in_few_entries(kind):
    """A thousand events are one entry of a key's list, and a batch that has nothing due doesn't read it; then all come out in order."""
    processor, handle = changed.ChangedProcessor() if kind == "edits" else status.StatusProcessor(1), _Handle()
    processor.init(handle)

    def rows(moments):
        fields = [{"ts_us": t * 1000, "seq": t, "value": f"v{t}"} if kind == "edits" else {"ts_us": t * 1000, "seq": t, "note_id": "n", "edit": True} for t in moments]
        return iter([Row(key="k", ts=datetime.fromtimestamp(t / 1000, UTC), event=json.dumps(e)) for t, e in zip(moments, fields, strict=True)])

    for part in (range(2000, 1000, -1), range(1000, 0, -1)):
        assert not list(processor.handleInputRows(("k",), rows(part), _Time(0)))
    assert len(handle.states["waiting"].value) == 2 and handle.calls.count("appendList") == 2
    assert len(handle.calls) <= 10 and handle.states["timer"].value == (1,)
    found = list(processor.handleExpiredTimer(("k",), _Time(1500), None))
    assert [r.seq for r in found if kind == "edits" or r.status == "saving"] == list(range(1, 1501))
    assert len(handle.states["waiting"].value) == 1 and handle.states["timer"].value == (1501,)
    late = list(processor.handleInputRows(("k",), rows([2001]), _Time(2001)))
    assert [r.seq for r in late if kind == "edits" or r.status == "saving"] == list(range(1501, 2002))
    assert handle.states["waiting"].value is None


def test_events_of_a_key_come_in_few_rows(monkeypatch):
    """A row takes Python longer than the events in it. Those of a key lie in one row whatever the order, but at most a thousand of them."""
    keys = [None if k % 10 == 3 else "hot" if k % 2 else f"k{k % 10}" for k in range(6000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(range(a, b)), pa.array([f'{{"seq":{k}}}' for k in range(a, b)])], ["session", "ts_us", "event"]) for a, b in ((0, 2500), (2500, 2500), (2500, 6000))]
    for limit, most in ((10**9, 9), (1, 18)):
        monkeypatch.setattr(in_order, "BUFFER", limit)
        rows = [row for batch in in_order._parts(iter(batches)) for row in batch.to_pylist()]
        assert len(rows) <= most
        seen = {}
        for row in rows:
            events = [e["seq"] for e in json.loads("[" + row["event"] + "]")]
            assert len(events) <= 1000 and (row["first_us"], row["last_us"]) == (min(events), max(events))
            seen.setdefault(row["session"], []).extend(events)
        assert seen == {key: [k for k, name in enumerate(keys) if name == key] for key in set(keys)}
    assert not list(in_order._parts(iter(batches[1:2])))


def _joined_rows(*parts):
    """Rows as they reach the processor of editors: each with several events."""
    events = [[json.dumps({"ts_us": t * 1000, "seq": t, "note_id": "n", "edit": True}) for t in part] for part in parts]
    return iter([Row(session="k", ts=datetime.fromtimestamp(max(p) / 1000, UTC), first_us=min(p) * 1000, event=",".join(e)) for p, e in zip(parts, events, strict=True)])


def test_an_expired_timer_asks_little_of_the_state():
    """Each call goes to the JVM and back. What comes out is one row; Spark itself deletes the timer."""
    processor, handle = in_order._InLists(status.StatusProcessor(10_000), "session"), _Handle()
    processor.init(handle)
    assert not list(processor.handleInputRows(("k",), _joined_rows(range(20, 1000, 20), range(1000, 2000, 20)), _Time(0)))
    assert len(handle.states["waiting"].value) == 1 and handle.states["timer"].value == (20,)
    handle.calls.clear()
    (row,) = processor.handleExpiredTimer(("k",), _Time(3000), None)
    assert row.session == "k" and row.status == ["saving", "saved"] * 99 and row.seq == [t for t in range(20, 2000, 20) for _ in (1, 2)]
    assert sorted(handle.calls) == ["clear", "clear", "get", "get", "update"]


def test_an_event_that_comes_with_later_ones_after_its_moment_was_passed(spark, tmp_path):
    """It is dropped, as it would be by itself; one whose key has nothing passed yet, or only earlier moments, is taken."""
    rows = [[("a", _at(1000), 0, "n", True), ("z", _at(60_000), 1, "n", False)], [("y", _at(60_000), 2, "n", False)],
        [("a", _at(5000), 3, "m", True), ("a", _at(70_000), 4, "n", True), ("b", _at(5000), 5, "n", True), ("b", _at(70_000), 6, "n", True)], [("z", _at(3_600_000), 7, "n", False)]]
    for zone in ("UTC", "America/New_York"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            at = tmp_path / zone.replace("/", "-")
            out = status.statuses(_stream(spark, at, rows, STATUS_DDL))
            _finish(out.writeStream.outputMode("append").format("parquet").option("path", str(at / "rows")), at)
            shown = spark.read.parquet(str(at / "rows")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert sorted((x.session, x.note_id, x.status, round(x["at"].timestamp() * 1000), x.seq) for x in shown) == [
            ("a", "n", "saved", 1800, 0), ("a", "n", "saved", 70_800, 4), ("a", "n", "saving", 1000, 0), ("a", "n", "saving", 70_000, 4),
            ("b", "n", "saved", 5800, 5), ("b", "n", "saved", 70_800, 6), ("b", "n", "saving", 5000, 5), ("b", "n", "saving", 70_000, 6),
        ]

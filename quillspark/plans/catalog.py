"""Registered queries over the given tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from quillspark import schema
from quillspark.functions import reltime, text
from quillspark.operators import changelog, lookup, search, slots, store, views
from quillspark.plans import notes as bind
from quillspark.sources import codec, json_array
from quillspark.sources.note_files import NoteFiles
from quillspark.sources.scratch import scratch_folder
from quillspark.sources.search_index import SearchIndex
from quillspark.streaming import changed, folds, note_state, status
from quillspark.streaming.feed import Feed

CURRENT = "17"
STALE = "no-such-note"

#: SQL of the notes collection, and of what a row is reported as.
_NOTES = r"""
    n AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'Doc ' || doc_id || ' ' || lang AS title,
        chr(10) || ' ' || chr(10) || '## **' || lang || '** *n* `c` [<' || source || '>](http://x/' || source || ') ' || text AS markdown_content,
        source AS folder_id, [lang, source] AS tags, epoch_ms(TIMESTAMP '2024-01-01 00:00:00') + doc_id * 3600000 AS ms,
        'local-user' AS owner_id, doc_id AS position FROM documents)"""
_ROW = "id, title, sha256(markdown_content) AS body_sha256, folder_id, array_to_string(tags, ',') AS tags, {created} AS created_ms, {updated} AS updated_ms, owner_id, position"
_REPORT = _ROW.format(created="ms", updated="ms")
_NOW_MS = f"epoch_ms(TIMESTAMP '{bind.NOW}')"


def _report(notes: DataFrame) -> DataFrame:
    """Notes with bodies as digests, tags joined and moments in milliseconds."""
    return notes.select(
        "id", "title", F.sha2("markdown_content", 256).alias("body_sha256"), "folder_id", F.array_join("tags", ",").alias("tags"),
        F.unix_millis("created_at").alias("created_ms"), F.unix_millis("updated_at").alias("updated_ms"), "owner_id", "position",
    )


_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---- scans and codec -----------------------------------------------------------------------


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n")
def scan_notes(spark, sf_dir):
    return _report(bind.notes(spark, sf_dir))


@_query("SELECT source AS id, source AS name, min(doc_id) AS position FROM documents GROUP BY source")
def scan_folders(spark, sf_dir):
    return bind.folders(spark, sf_dir).select("id", "name", "position")


@_query("SELECT lang AS id, lang AS name, '#3b82f6' AS color, min(doc_id) AS position FROM documents GROUP BY lang")
def scan_tags(spark, sf_dir):
    return bind.tags(spark, sf_dir).select("id", "name", "color", "position")


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_type(props) = 'OBJECT'")
def json_decode(spark, sf_dir):
    """Each event's properties as a stored collection of one (an object counts as one item)."""
    items = codec.decode(F.col("props"), T.StructType([T.StructField("k", T.LongType())]))
    return bind.table(spark, sf_dir, "events").select("event_id", F.explode(items).alias("item")).select("event_id", F.col("item.k").alias("k"))


@_query(f"WITH {_NOTES} SELECT {_REPORT.replace('position', '0 AS position')} FROM n")
def json_round_trip(spark, sf_dir):
    """Every note encoded as stored JSON and decoded again."""
    return _report(codec.decode_notes(codec.encode_each(bind.notes(spark, sf_dir))))


@_query("""
    WITH d AS (SELECT doc_id, epoch_ms(TIMESTAMP '2024-01-01 00:00:00') + doc_id * 3600000 AS ms FROM documents)
    SELECT doc_id, '$.meta.createdAt' AS path, ms AS at_ms FROM d UNION ALL SELECT doc_id, '$.meta.all[0].updatedAt', ms + 1000 FROM d WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, '$.meta.all[1].in[0].createdAt', NULL FROM d WHERE doc_id % 2 = 0""")
def json_nested_dates(spark, sf_dir):
    """Dates at three depths, one of them none; every second document has no inner ones."""
    docs = bind.table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00"))) + F.col("doc_id") * 3600)
    inner = F.concat(F.lit('[{"updatedAt": "'), F.date_format(at + F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"}, {"in": [{"createdAt": "never"}]}]'))
    value = F.concat(F.lit('{"meta": {"createdAt": "'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('", "all": '), F.when(F.col("doc_id") % 2 == 0, inner).otherwise("[1, null]"), F.lit("}}"))
    return codec.nested_dates(docs.select(F.col("doc_id").alias("key"), value.alias("value"))).select(F.col("key").alias("doc_id"), "path", F.unix_millis("at").alias("at_ms"))


@_query(f"WITH {_NOTES} SELECT {_REPORT.replace('position', '0 AS position')} FROM n")
def json_array_round_trip(spark, sf_dir):
    """Every note written to JSON arrays and read again by ranges of their bytes."""
    path = scratch_folder(spark)
    json_array.write_items(bind.notes(spark, sf_dir).select(codec.stored_note().alias("n")), path)
    return _report(codec.as_notes(json_array.read_array(spark, path, schema.STORED_NOTE).good.select(F.col("item").alias("n"), F.lit(0).alias("position"))))


# ---- filters, lookups, lists ---------------------------------------------------------------


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE id = '{CURRENT}' ORDER BY position LIMIT 1")
def note_by_id(spark, sf_dir):
    return _report(views.by_id(bind.notes(spark, sf_dir), CURRENT))


@_query(f"WITH {_NOTES} SELECT coalesce(min(position), -1) AS position FROM n WHERE id = '{CURRENT}'")
def note_index(spark, sf_dir):
    return views.index_of(bind.notes(spark, sf_dir), CURRENT)


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE contains(lower(title), 'the') OR contains(lower(markdown_content), 'the') OR len(list_filter(tags, lambda x: contains(lower(x), 'the'))) > 0")
def search_notes(spark, sf_dir):
    return _report(search.by_all(bind.notes(spark, sf_dir), "The"))


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE contains(lower(title), 'thea') OR contains(lower(markdown_content), 'thea')")
def search_sidebar(spark, sf_dir):
    found = search.by_title_or_body(bind.notes(spark, sf_dir), "THEA")
    return _report(found)


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE len(list_filter(tags, lambda x: contains(lower(x), 'en'))) > 0")
def search_by_tag(spark, sf_dir):
    return _report(search.by_tag(bind.notes(spark, sf_dir), "EN"))


_LINES = r"list_filter(string_split(trim(regexp_replace(replace(replace(replace(regexp_replace(markdown_content, '(?m)^#+ ', '', 'g'), '**', ''), '*', ''), '`', ''), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), ' ' || chr(9) || chr(10) || chr(13)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')"
_PREVIEW = f"(SELECT CASE WHEN length(l) > 60 THEN substring(l, 1, 60) || '...' ELSE l END FROM (SELECT coalesce(({_LINES})[1], '') AS l))"
_DAYS = f"CAST(floor(({_NOW_MS} - ms) / 86400000.0) AS BIGINT)"
_LABEL = f"CASE WHEN {_DAYS} = 0 THEN 'Today' WHEN {_DAYS} = 1 THEN 'Yesterday' WHEN {_DAYS} < 7 THEN {_DAYS} || ' days ago' ELSE strftime(make_timestamp(ms * 1000), '%b %-d') END"


@_query(f"WITH {_NOTES} SELECT id, title, {_PREVIEW} AS preview, {_LABEL} AS label, id = '{CURRENT}' AS active, position FROM n")
def list_view(spark, sf_dir):
    return views.list_view(bind.notes(spark, sf_dir), bind.now(), CURRENT)


@_query(f"WITH {_NOTES} SELECT id, {_PREVIEW} AS preview FROM n")
def note_preview(spark, sf_dir):
    return bind.notes(spark, sf_dir).select("id", text.preview(F.col("markdown_content")).alias("preview"))


@_query(f"WITH {_NOTES} SELECT id, {_DAYS} AS days, {_LABEL} AS label FROM n")
def relative_date(spark, sf_dir):
    at = F.col("updated_at")
    return bind.notes(spark, sf_dir).select("id", reltime.days_between(at, bind.now()).alias("days"), reltime.label(at, bind.now()).alias("label"))


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n ORDER BY position LIMIT 10")
def recent_10(spark, sf_dir):
    return _report(views.recent(bind.notes(spark, sf_dir)))


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n ORDER BY position LIMIT 1")
def init_or_first(spark, sf_dir):
    """The first note; a new one if there is none."""
    notes = bind.notes(spark, sf_dir)
    return _report(store.reselect(notes, "", "", "new", bind.now()))


def _pointer(spark: SparkSession, value: str) -> DataFrame:
    return spark.range(1).select(F.lit(value).alias("id"))


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE id = '{CURRENT}'")
def current_note(spark, sf_dir):
    return _report(views.current_or_first(bind.notes(spark, sf_dir), _pointer(spark, CURRENT)))


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n ORDER BY position LIMIT 1")
def current_note_stale(spark, sf_dir):
    return _report(views.current_or_first(bind.notes(spark, sf_dir), _pointer(spark, STALE)))


@_query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE source END, ''), 'Notes') AS title FROM documents")
def display_title(spark, sf_dir):
    """A fallback for empty and missing titles, which every third document is given in turn."""
    given = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.col("source"))
    return bind.table(spark, sf_dir, "documents").select("doc_id", text.or_default(given, schema.APP_TITLE).alias("title"))


@_query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Saving...' WHEN 'purchase' THEN 'Unsaved' WHEN 'view' THEN 'Saved' END AS status FROM events")
def save_status(spark, sf_dir):
    names = F.create_map(*map(F.lit, ("click", "saving", "purchase", "unsaved", "view", "saved")))
    return bind.table(spark, sf_dir, "events").select("event_id", views.status_text(F.coalesce(F.element_at(names, F.col("event_type")), F.lit(""))).alias("status"))


@_query("SELECT doc_id, 100 - coalesce(quality * 40, 0) AS left_over FROM documents LEFT JOIN labels USING (doc_id)")
def progress_offset(spark, sf_dir):
    labels = bind.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return bind.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", views.percent_left(F.col("quality") * 40).alias("left_over"))


@_query("SELECT count(*) AS n FROM documents")
def note_count(spark, sf_dir):
    return bind.notes(spark, sf_dir).agg(F.count("*").alias("n"))


@_query(f"WITH {_NOTES} SELECT count(*) = 0 AS empty, CASE WHEN count(*) = 0 THEN 'No notes found' END AS message FROM n WHERE contains(lower(title), 'no such title')")
def empty_state(spark, sf_dir):
    notes = bind.notes(spark, sf_dir)
    return views.empty_state(notes.filter(text.contains_ci(F.col("title"), "No such title")), "No such title")


# ---- changes -------------------------------------------------------------------------------

_NEW = f"SELECT '{{id}}' AS id, 'Untitled Note' AS title, sha256('# New note' || chr(10) || chr(10) || 'Write here.') AS body_sha256, NULL AS folder_id, '' AS tags, {_NOW_MS} AS created_ms, {_NOW_MS} AS updated_ms, 'local-user' AS owner_id, {{position}} AS position"


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n UNION ALL SELECT * FROM ({_NEW.format(id='new', position='(SELECT min(position) - 1 FROM n)')})")
def create_note(spark, sf_dir):
    return _report(store.create_note(bind.notes(spark, sf_dir), "new", bind.now()))


_MARKED = "(SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1)"


_PATCHED = f"WITH {_NOTES}, p AS {_MARKED} SELECT n.id, CASE WHEN p.id IS NULL THEN title ELSE 'Checked ' || n.id END AS title, sha256(markdown_content) AS body_sha256, CASE WHEN p.id IS NULL THEN folder_id END AS folder_id, array_to_string(tags, ',') AS tags, ms AS created_ms, CASE WHEN p.id IS NULL THEN ms ELSE {_NOW_MS} END AS updated_ms, owner_id, position FROM n LEFT JOIN p ON n.id = p.id"


@_query(_PATCHED)
def update_note(spark, sf_dir):
    """New titles for the documents labelled as good, and no folder."""
    return _report(store.update_notes(bind.notes(spark, sf_dir), _checked(spark, sf_dir), bind.now()))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.marked_ids(spark, sf_dir).select(
        "id", F.array(F.lit("title"), F.lit("folder_id")).alias("set_mask"), F.concat(F.lit("Checked "), "id").alias("title"), F.lit(None).cast("string").alias("folder_id")
    )


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE id NOT IN (SELECT id FROM {_MARKED})")
def delete_note(spark, sf_dir):
    return _report(store.delete_notes(bind.notes(spark, sf_dir), bind.marked_ids(spark, sf_dir)))


@_query(f"WITH {_NOTES} SELECT count(*) > 0 AS removed FROM n WHERE id IN (SELECT id FROM {_MARKED})")
def delete_reported(spark, sf_dir):
    return store.deleted_any(bind.notes(spark, sf_dir), bind.marked_ids(spark, sf_dir))


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE id <> '0' ORDER BY position LIMIT 1")
def reselect_after_delete(spark, sf_dir):
    notes = bind.notes(spark, sf_dir)
    left = store.delete_notes(notes, _pointer(spark, "0"))
    return _report(store.reselect(left, "0", "0", "new", bind.now()))


@_query("SELECT source AS id, source AS name, min(doc_id) AS position FROM documents GROUP BY source UNION ALL SELECT 'f', 'Inbox', max(position) + 1 FROM (SELECT min(doc_id) AS position FROM documents GROUP BY source)")
def create_folder(spark, sf_dir):
    return store.create_folder(bind.folders(spark, sf_dir), "f", "Inbox", bind.now()).select("id", "name", "position")


@_query("SELECT lang AS id, lang AS name, '#3b82f6' AS color, min(doc_id) AS position FROM documents GROUP BY lang UNION ALL SELECT 't', 'Later', '#3b82f6', max(position) + 1 FROM (SELECT min(doc_id) AS position FROM documents GROUP BY lang)")
def create_tag(spark, sf_dir):
    return store.create_tag(bind.tags(spark, sf_dir), "t", "Later").select("id", "name", "color", "position")


# ---- notes in files ------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> NoteFiles:
    files = NoteFiles(spark, scratch_folder(spark), 64)
    files.write(bind.notes(spark, sf_dir))
    return files


@_query(_PATCHED)
def update_note_files(spark, sf_dir):
    """The same in files, of which those that hold a patched note are copied."""
    files = _files(spark, sf_dir)
    files.patch(_checked(spark, sf_dir), bind.now())
    return _report(files.read())


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE id NOT IN (SELECT id FROM {_MARKED})")
def delete_note_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    files.delete(bind.marked_ids(spark, sf_dir))
    return _report(files.read())


@_query(f"""WITH {_NOTES}, p AS {_MARKED}, m AS (SELECT n.id, title, CASE WHEN p.id IS NULL THEN markdown_content ELSE '# Checked **' || n.id || '**' END AS markdown_content,
    CASE WHEN p.id IS NULL THEN ms ELSE {_NOW_MS} END AS ms, position FROM n LEFT JOIN p ON n.id = p.id)
    SELECT id, title, {_PREVIEW} AS preview, {_LABEL} AS label, id = '{CURRENT}' AS active, position FROM m""")
def list_view_kept(spark, sf_dir):
    """The list of notes whose previews are kept in their files: a patch makes those of patched bodies anew, and the list reads no body."""
    files = NoteFiles(spark, scratch_folder(spark), 64)
    files.write(store.with_previews(bind.notes(spark, sf_dir)))
    bodies = bind.marked_ids(spark, sf_dir).select("id", F.array(F.lit("markdown_content")).alias("set_mask"), F.concat(F.lit("# Checked **"), "id", F.lit("**")).alias("markdown_content"))
    files.patch(bodies, bind.now())
    return views.list_view(files.read(), bind.now(), CURRENT)


@_query(f"WITH {_NOTES} SELECT {_REPORT} FROM n WHERE contains(lower(title), 'doc 12') OR contains(lower(markdown_content), 'doc 12') OR len(list_filter(tags, lambda x: contains(lower(x), 'doc 12'))) > 0")
def search_notes_indexed(spark, sf_dir):
    """Search over the files that hold candidates by their trigrams."""
    files = _files(spark, sf_dir)
    index = SearchIndex(files, scratch_folder(spark))
    index.build()
    return _report(index.search("Doc 12", search.by_all))


# ---- logs of events ------------------------------------------------------------------------

_EDITS = "SELECT CAST(user_id AS VARCHAR) AS note_id, ts, event_id AS seq, event_type AS value FROM events"


_CHANGED = f"SELECT note_id, seq, value FROM (SELECT *, lag(value) OVER (PARTITION BY note_id ORDER BY ts, seq) AS before FROM ({_EDITS})) WHERE value IS DISTINCT FROM before"


@_query(_CHANGED)
def changed_edits(spark, sf_dir):
    return changelog.changed_edits(bind.edits(spark, sf_dir)).select("note_id", "seq", "value")


@_query(f"WITH c AS ({_CHANGED.replace('SELECT note_id, seq, value', 'SELECT note_id, ts, seq, value')}) SELECT note_id, seq, value FROM c WHERE epoch_us(ts) <= 1000 * (SELECT epoch_ms(max(ts) - INTERVAL 1 HOUR) FROM events)")
def changed_edits_stream(spark, sf_dir):
    """The same by a stream: what the watermark has passed by the end of the log."""

    def start(session, path):
        found = changed.changed_edits(bind.edits_of(bind.event_stream(session, sf_dir)), "1 hour")
        return found.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")

    return spark.read.parquet(f"{_run_stream(spark, start)}/rows").select("note_id", "seq", "value")


_FOLDED = """
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS note_id, ts, event_id AS seq, event_type AS kind, 'v' || event_id AS value FROM events WHERE event_type <> 'view'),
    s AS (SELECT *, count(*) FILTER (WHERE kind IN ('signup', 'error')) OVER (PARTITION BY note_id ORDER BY ts, seq) AS segment FROM e),
    g AS (SELECT note_id, segment, arg_min(kind, (ts, seq)) AS head, min(ts) AS created, max(ts) AS updated,
        arg_max(value, (ts, seq)) FILTER (WHERE kind = 'click' OR (kind = 'signup' AND seq % 3 = 0)) AS title, arg_max(value, (ts, seq)) FILTER (WHERE kind = 'purchase') AS body,
        arg_max(seq, (ts, seq)) FILTER (WHERE kind = 'click' AND seq % 4 = 0) AS moved FROM s GROUP BY ALL),
    l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY segment DESC) = 1)
    SELECT note_id, coalesce(title, 'Untitled Note') AS title, coalesce(body, '# New note' || chr(10) || chr(10) || 'Write here.') AS markdown_content,
        CASE WHEN moved % 8 <> 0 THEN 'f' || moved END AS folder_id, 'local-user' AS owner_id, epoch_us(created) AS created_us, epoch_us(updated) AS updated_us FROM l WHERE head = 'signup'"""


@_query(_FOLDED)
def changelog_fold(spark, sf_dir):
    return _folded_report(changelog.fold_notes(bind.note_events(bind.table(spark, sf_dir, "events"))))


def _folded_report(folded: DataFrame) -> DataFrame:
    return folded.select("note_id", "title", "markdown_content", "folder_id", "owner_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


@_query(_FOLDED)
def note_stream(spark, sf_dir):
    """The same by a stream that keeps each note's state under its own key."""

    def start(session, path):
        changes = note_state.note_changes(bind.note_events(bind.event_stream(session, sf_dir)))
        return changes.writeStream.outputMode("update").foreachBatch(note_state.change_log(f"{path}/changes"))

    return _folded_report(note_state.notes_of_changes(spark, f"{_run_stream(spark, start)}/changes"))


@_query(f"""
    WITH b AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY note_id ORDER BY ts, seq) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM ({_EDITS})),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY note_id ORDER BY ts, seq) AS session FROM b)
    SELECT note_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS saved_us, count(*) AS edits FROM s GROUP BY note_id, session""")
def save_sessions(spark, sf_dir):
    found = changelog.save_sessions(bind.edits(spark, sf_dir), "30 minutes")
    return found.select("note_id", F.unix_micros("started").alias("started_us"), F.unix_micros("saved").alias("saved_us"), "edits")


#: Each user's editor: its note changes every second day, views open that note or the next.
_EDITOR = """
    e AS (SELECT CAST(user_id AS VARCHAR) AS session, ts, event_id AS seq, event_type <> 'view' AS edit, 'n' || (epoch_ms(ts) // 172800000 + CASE WHEN event_type = 'view' THEN event_id % 2 ELSE 0 END) AS note_id FROM events),
    o AS (SELECT *, lag(note_id) OVER (PARTITION BY session ORDER BY ts, seq) AS open FROM e),
    b AS (SELECT *, lag(ts) OVER w AS before, lag(edit) OVER w AND lag(note_id) OVER w = note_id AS same, lead(ts) OVER w AS next FROM o WHERE edit OR note_id IS DISTINCT FROM open WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
    s AS (SELECT session, note_id, 'saving' AS status, ts AS moment, seq FROM b WHERE edit AND NOT coalesce(same AND before + INTERVAL 12 HOUR >= ts, false)
        UNION ALL SELECT session, note_id, 'saved', ts + INTERVAL 12 HOUR, seq FROM b WHERE edit AND coalesce(next > ts + INTERVAL 12 HOUR, true))"""
_STATUS = "SELECT session, note_id, status, epoch_us(moment) AS at_us, seq FROM s"
_LATENESS = "1 hour"


def _status_report(found: DataFrame) -> DataFrame:
    return found.select("session", "note_id", "status", F.unix_micros("at").alias("at_us"), "seq")


@_query(f"WITH {_EDITOR} {_STATUS}")
def save_statuses(spark, sf_dir):
    """What each user's editor shows of its saving, twelve hours after the last edit at the latest."""
    return _status_report(changelog.save_statuses(bind.editor_events(bind.table(spark, sf_dir, "events")), "12 hours"))


def _run_stream(spark: SparkSession, start: Callable[[SparkSession, str], DataStreamWriter]) -> str:
    """Run a stream over all that is there, in a session of its own as it needs its own state store; what it wrote, in the shared folder."""
    session, path = spark.newSession(), scratch_folder(spark)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    start(session, path).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return path


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@_query(f"WITH {_EDITOR} {_STATUS} WHERE epoch_us(moment) <= 1000 * (SELECT epoch_ms(max(ts) - INTERVAL {_LATENESS}) FROM events)")
def save_status_stream(spark, sf_dir):
    """The same by a stream: what the watermark has reached by the end of the log."""

    def start(session, path):
        shown = status.statuses(bind.editor_events(bind.event_stream(session, sf_dir)), 43_200_000, _LATENESS)
        return shown.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")

    path = _run_stream(spark, start)
    return _status_report(spark.read.parquet(f"{path}/rows"))


#: Adds are numbered as they come; the others name the message added last or the one before, or any (null).
_TOASTS = """
    n AS (SELECT CAST(user_id AS VARCHAR) AS list_id, ts, event_id AS seq, event_type AS kind, 'v' || event_id AS value,
        count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS adds FROM events WHERE event_type IN ('signup', 'click', 'error', 'purchase')),
    t AS (SELECT list_id, ts, seq, kind, value, adds, CASE WHEN kind = 'signup' THEN adds WHEN kind <> 'click' AND seq % 5 = 0 THEN NULL ELSE greatest(adds - seq % 2, 1) END AS id FROM n)"""
#: What adds, dismisses and removes make of each message, a step for each: a removal that is due comes before the event.
_STEPS = """
    c AS (SELECT list_id, coalesce(id, adds) AS meant, epoch_us(ts) AS us, seq, kind, id IS NOT NULL AS named, row_number() OVER (PARTITION BY list_id, coalesce(id, adds) ORDER BY ts, seq) AS k
        FROM t WHERE kind <> 'click' AND (id IS NOT NULL OR adds > 0)),
    r AS (SELECT DISTINCT list_id, meant, CAST(0 AS BIGINT) AS k, false AS present, CAST(NULL AS BIGINT) AS timer, false AS shut, CAST(NULL AS BIGINT) AS started FROM c
        UNION ALL SELECT list_id, meant, k, CASE kind WHEN 'signup' THEN true WHEN 'purchase' THEN false ELSE there END, CASE WHEN begins THEN us + 1000000000 ELSE running END,
            CASE kind WHEN 'signup' THEN false WHEN 'error' THEN shut OR there ELSE shut END, CASE WHEN begins THEN seq END
        FROM (SELECT *, kind = 'error' AND running IS NULL AND (named OR there) AS begins FROM (SELECT c.*, shut, present AND NOT coalesce(timer <= us, false) AS there, CASE WHEN timer > us THEN timer END AS running
            FROM r JOIN c ON r.list_id = c.list_id AND r.meant = c.meant AND c.k = r.k + 1)))"""
#: The moment at which lists are looked at.
_UNTIL = "2024-01-20 12:00:00"


@_query(f"""
    WITH RECURSIVE {_TOASTS.replace("event_type IN", f"ts <= TIMESTAMP '{_UNTIL}' AND event_type IN")}, {_STEPS},
    l AS (SELECT *, max(adds) OVER (PARTITION BY list_id) AS last FROM t),
    g AS (SELECT list_id, last, arg_max(value, (ts, seq)) FILTER (WHERE kind = 'signup' OR (kind = 'click' AND id = adds AND seq % 3 <> 0)) AS title,
        arg_max(value, (ts, seq)) FILTER (WHERE kind = 'signup' OR (kind = 'click' AND id = adds AND seq % 2 <> 0)) AS description FROM l WHERE adds = last AND last > 0 GROUP BY ALL),
    e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY list_id, meant ORDER BY k DESC) = 1)
    SELECT g.list_id, CAST(last AS VARCHAR) AS toast_id, title, 'd' || description AS description, NOT shut AS open
    FROM g JOIN e ON g.list_id = e.list_id AND e.meant = last WHERE present AND NOT coalesce(timer <= epoch_us(TIMESTAMP '{_UNTIL}'), false)""")
def toast_fold(spark, sf_dir):
    """What each list shows at a moment within the log: dismissed messages have gone if their delay is over by then."""
    return changelog.fold_toasts(bind.toast_events(spark, sf_dir), F.to_timestamp(F.lit(_UNTIL)))


@_query(f"WITH RECURSIVE {_TOASTS}, {_STEPS} SELECT list_id, CAST(meant AS VARCHAR) AS toast_id, started AS seq, timer AS expires_us FROM r WHERE started IS NOT NULL")
def toast_expiry(spark, sf_dir):
    """Every delay that a dismiss starts; an id may have several, one after the other."""
    found = changelog.toast_expiries(bind.toast_events(spark, sf_dir))
    return found.select("list_id", "toast_id", "seq", F.unix_micros("expires").alias("expires_us"))


@_query(f"""
    WITH RECURSIVE {_TOASTS.replace("CASE WHEN kind = 'signup' THEN adds WHEN kind <> 'click' AND seq % 5 = 0 THEN NULL ELSE greatest(adds - seq % 2, 1) END AS id", "CASE kind WHEN 'signup' THEN adds WHEN 'click' THEN seq % 10 + 1 END AS id")}, {_STEPS},
    l AS (SELECT *, max(adds) OVER (PARTITION BY list_id) AS last, max(ts) OVER (PARTITION BY list_id) AS seen FROM t),
    g AS (SELECT list_id, last, seen, arg_max(value, (ts, seq)) FILTER (WHERE kind = 'signup' OR (kind = 'click' AND id = adds AND seq % 3 <> 0)) AS title,
        arg_max(value, (ts, seq)) FILTER (WHERE kind = 'signup' OR (kind = 'click' AND id = adds AND seq % 2 <> 0)) AS description FROM l WHERE adds = last AND last > 0 GROUP BY ALL),
    e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY list_id, meant ORDER BY k DESC) = 1)
    SELECT g.list_id, CAST(last AS VARCHAR) AS toast_id, title, 'd' || description AS description, NOT shut AS open
    FROM g JOIN e ON g.list_id = e.list_id AND e.meant = last WHERE present AND NOT coalesce(timer <= greatest(epoch_us(seen), 1000 * (SELECT epoch_ms(max(ts) - INTERVAL 10 SECOND) FROM t)), false)""")
def toast_feed(spark, sf_dir):
    """The messages that lists show by the end of the log, as a subscriber gets them from the feed of a stream."""

    def start(session, path):
        shown = folds.toasts(bind.toast_stream(bind.event_stream(session, sf_dir)))
        return shown.writeStream.outputMode("update").foreachBatch(Feed(session, f"{path}/feed", "list_id"))

    news = Feed(spark, f"{_run_stream(spark, start)}/feed", "list_id").pull("reader")
    return news.rows.filter("toast_id IS NOT NULL").select("list_id", "toast_id", "title", "description", "open")


@_query(f"WITH {_TOASTS} SELECT list_id, CAST(max(adds) AS VARCHAR) AS toast_id, arg_max(value, (ts, seq)) AS title FROM t WHERE kind = 'signup' GROUP BY list_id")
def toast_latest(spark, sf_dir):
    return changelog.latest_toast(bind.toast_events(spark, sf_dir))


# ---- the slot of the current note ----------------------------------------------------------

_WRITES = """
    w AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CAST(event_id % 50 AS VARCHAR) END WHEN event_id % 2 = 0 THEN '' END AS id
        FROM events WHERE event_type IN ('view', 'error')),
    i AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id FROM documents),
    l AS (SELECT session, arg_max(coalesce(id, ''), seq) AS id FROM w GROUP BY session),
    slots AS (SELECT session, id FROM l WHERE id <> '')"""


def _no_slots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "session bigint, id string")


@_query(f"WITH {_WRITES} SELECT session, id FROM slots")
def slot_write(spark, sf_dir):
    """Each user's slot after all writes and clears."""
    return slots.written(_no_slots(spark), bind.slot_writes(spark, sf_dir))


@_query(f"WITH {_WRITES} SELECT session, arg_max(id, seq) AS id FROM w WHERE id IN (SELECT id FROM i) GROUP BY session")
def select_note(spark, sf_dir):
    """As selections: those of unknown notes are no-ops, clears are none at all."""
    return slots.selected(_no_slots(spark), bind.slot_writes(spark, sf_dir), bind.notes(spark, sf_dir))


@_query(f"""WITH {_WRITES}, u AS (SELECT DISTINCT user_id AS session FROM events), f AS (SELECT id AS first FROM i ORDER BY doc_id LIMIT 1)
    SELECT u.session, coalesce(i.id, f.first) AS current, coalesce(slots.id, f.first) AS id FROM u CROSS JOIN f LEFT JOIN slots USING (session) LEFT JOIN i ON slots.id = i.id""")
def slot_on_load(spark, sf_dir):
    """What each user sees first: a missing slot is filled, a stale one stays."""
    held = slots.written(_no_slots(spark), bind.slot_writes(spark, sf_dir))
    users = bind.table(spark, sf_dir, "events").select(F.col("user_id").alias("session")).distinct()
    return slots.loaded(held, users, bind.notes(spark, sf_dir))


@_query(f"WITH {_NOTES} SELECT {_REPORT}, id = 'new' AS active FROM n UNION ALL SELECT *, true FROM ({_NEW.format(id='new', position='(SELECT min(position) - 1 FROM n)')})")
def new_note_selected(spark, sf_dir):
    """A new note, and the slot that names it."""
    made = store.create_note(bind.notes(spark, sf_dir), "new", bind.now())
    opened = slots.selected(_no_slots(spark), spark.range(1).select(F.col("id").alias("session"), F.lit(1).alias("seq"), F.lit("new").alias("id")), made)
    marked = made.join(opened.select(F.col("id").alias("current")), F.col("id") == F.col("current"), "left")
    report = _report(made).columns
    return _report(marked.withColumn("owner_id", F.struct("owner_id", "current"))).select(*[F.col("owner_id.owner_id").alias(c) if c == "owner_id" else c for c in report], F.col("owner_id.current").isNotNull().alias("active"))


@_query("SELECT count(*) AS n, count(*) AS distinct_ids, count(*) AS well_formed FROM documents")
def new_ids(spark, sf_dir):
    """An id for each document: all differ, all are version 4 UUIDs."""
    made = bind.table(spark, sf_dir, "documents").select(text.new_id().alias("id"))
    formed = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.sum(formed.cast("bigint")).alias("well_formed"))


@_query("SELECT doc_id, source, lang FROM documents")
def object_rest(spark, sf_dir):
    """Each document's fields without its text and length."""
    docs = bind.table(spark, sf_dir, "documents")
    return docs.select(text.without(F.struct(*docs.columns), "text", "n_chars").alias("rest")).select("rest.*")


@_query("SELECT doc_id, nullif(substring(source, CAST(doc_id % 6 + 1 AS INTEGER), 1), '') AS char FROM documents")
def slot_char(spark, sf_dir):
    """The character of the source's name that one of six slots shows."""
    return bind.table(spark, sf_dir, "documents").select("doc_id", text.slot_char(F.col("source"), F.col("doc_id") % 6).alias("char"))


@_query(f"""WITH {_NOTES}, p AS (SELECT CAST(doc_id AS VARCHAR) AS id, min(quality) AS q FROM labels GROUP BY doc_id)
    SELECT CASE WHEN p.id IS NOT NULL THEN 'm' || n.id ELSE n.id END AS id, CASE WHEN p.id IS NULL THEN title WHEN q = 0 THEN NULL ELSE 'second' END AS title, sha256(markdown_content) AS body_sha256, folder_id,
    array_to_string(tags, ',') AS tags, CASE WHEN p.id IS NULL THEN ms ELSE 0 END AS created_ms, CASE WHEN p.id IS NULL THEN ms ELSE {_NOW_MS} END AS updated_ms, owner_id, position FROM n LEFT JOIN p ON n.id = p.id""")
def patch_any_field(spark, sf_dir):
    """Several patches of one note in turn: a new id and creation time first, titles (or none) later."""
    marks = bind.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.min("quality").alias("q"))
    steps = F.array(*(F.struct(F.lit(k).alias("seq"), F.array(*map(F.lit, mask)).alias("set_mask"), title.alias("title")) for k, mask, title in (
        (1, ["id", "created_at", "title"], F.lit("first")), (2, ["title"], F.when(F.col("q") != 0, "second")))))
    patches = marks.select("id", "q", F.explode(steps).alias("s")).select("id", "s.seq", "s.set_mask", "s.title", F.concat(F.lit("m"), "id").alias("new_id"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    return _report(store.update_notes(bind.notes(spark, sf_dir), patches, bind.now()))


# ---- library lookups -----------------------------------------------------------------------


@_query("""
    WITH g AS (SELECT lang, list_sort(list(DISTINCT source)) AS names FROM documents GROUP BY lang)
    SELECT lang, array_to_string(list_transform(names[1:3], lambda x: upper(x[1])), ',') AS initials, CASE WHEN len(names) > 3 THEN len(names) - 3 END AS more FROM g""")
def collab_overflow(spark, sf_dir):
    """The sources of each language as its collaborators."""
    people = bind.table(spark, sf_dir, "documents").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("names"))
    initials, more = views.shown_people(F.col("names"))
    return people.select("lang", F.array_join(initials, ",").alias("initials"), more.alias("more"))


@_query("""
    WITH c AS (SELECT source AS key, 'S' || min(doc_id) AS label FROM documents GROUP BY source),
    i AS (SELECT doc_id AS item_id, lang AS key, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'none' ELSE lang END AS resolved FROM documents)
    SELECT item_id, resolved, CASE WHEN a.key IS NOT NULL THEN a.label ELSE b.label END AS label FROM i LEFT JOIN c a ON i.resolved = a.key LEFT JOIN c b ON i.key = b.key""")
def chart_label_lookup(spark, sf_dir):
    """A third of the items name their source directly, a third something unknown in a nested map, a third nothing."""
    docs = bind.table(spark, sf_dir, "documents")
    config = docs.groupBy("source").agg(F.concat(F.lit("S"), F.min("doc_id").cast("string")).alias("label")).select(F.col("source").alias("key"), "label")
    none = F.create_map().cast("map<string,string>")

    def third(k: int, value: Column) -> Column:
        return F.when(F.col("doc_id") % 3 == k, F.create_map("lang", value)).otherwise(none)

    items = docs.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("key"), third(0, F.col("source")).alias("payload"), third(1, F.lit("none")).alias("inner"))
    return lookup.item_config(items, config)


@_query("""
    WITH c AS (SELECT r_regionkey AS ord, lower(replace(r_name, ' ', '-')) AS key, CASE WHEN r_regionkey % 2 = 0 THEN '#' || r_regionkey END AS color, r_regionkey % 3 = 0 AS themed FROM region),
    e AS (SELECT * FROM c WHERE themed OR color IS NOT NULL),
    t AS (SELECT * FROM (VALUES ('light', ''), ('dark', '.dark')) v(theme, prefix)),
    l AS (SELECT theme, prefix, ord, coalesce('  --color-' || key || ': ' || coalesce(CASE WHEN themed AND theme = 'dark' THEN 'black' || ord END, color) || ';', '') AS line FROM e, t)
    SELECT theme, chr(10) || prefix || ' [data-chart=r1] {' || chr(10) || string_agg(line, chr(10) ORDER BY ord) || chr(10) || '}' || chr(10) AS css FROM l GROUP BY theme, prefix""")
def chart_css(spark, sf_dir):
    key = F.col("r_regionkey")
    dark = F.when(key % 3 == 0, F.create_map(F.lit("dark"), F.concat(F.lit("black"), key.cast("string"))))
    config = bind.table(spark, sf_dir, "region").select(
        key.alias("ord"), F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))).alias("key"), F.when(key % 2 == 0, F.concat(F.lit("#"), key.cast("string"))).alias("color"), dark.alias("theme")
    )
    return lookup.theme_css(config, ":r1:")


@_query("SELECT doc_id, CASE WHEN doc_id <> 0 THEN format('{:,}', doc_id * 1000) END AS shown FROM documents")
def chart_value_fmt(spark, sf_dir):
    return bind.table(spark, sf_dir, "documents").select("doc_id", text.grouped_number(F.col("doc_id") * 1000).alias("shown"))

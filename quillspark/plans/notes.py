"""Collections of notes and event logs made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.operators import changelog

#: The moment that relative dates refer to.
NOW = "2024-02-10 12:00:00"
EVENT_OPS = {"signup": "create", "click": "patch", "purchase": "patch", "error": "delete", "view": "select"}
TOAST_TYPES = {"signup": "ADD", "click": "UPDATE", "error": "DISMISS", "purchase": "REMOVE"}


def now():
    return F.to_timestamp(F.lit(NOW))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a note, its text behind a line of Markdown marks."""
    created = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00"))) + F.col("doc_id") * 3600)
    head = F.concat(F.lit("\n \n## **"), "lang", F.lit("** *n* `c` [<"), "source", F.lit(">](http://x/"), "source", F.lit(") "), "text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(" "), "lang").alias("title"),
        head.alias("markdown_content"), F.col("source").alias("folder_id"), F.array("lang", "source").alias("tags"),
        created.alias("created_at"), created.alias("updated_at"), F.lit(schema.DEFAULT_OWNER).alias("owner_id"), F.col("doc_id").alias("position"),
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each source, in order of its first document."""
    made = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("position"))
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return made.select(
        F.col("source").alias("id"), F.col("source").alias("name"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(schema.DEFAULT_OWNER).alias("owner_id"), at.alias("created_at"), at.alias("updated_at"), "position",
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag for each language."""
    made = table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("doc_id").alias("position"))
    return made.select(F.col("lang").alias("id"), F.col("lang").alias("name"), F.lit(schema.DEFAULT_TAG_COLOR).alias("color"), F.lit(schema.DEFAULT_OWNER).alias("owner_id"), "position")


def _mapped(names: dict[str, str]):
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("event_type"))


def note_events(events: DataFrame) -> DataFrame:
    """The event log (a table or a stream) as changes to one note for each user. Every third create brings a title;
    clicks set the title and every fourth the folder too, to null each second time; purchases set the body."""
    number, kind = F.col("event_id"), F.col("event_type")
    value = F.concat(F.lit("v"), number.cast("string"))
    mask = (
        F.when((kind == "signup") & (number % 3 == 0), F.array(F.lit("title")))
        .when((kind == "click") & (number % 4 == 0), F.array(F.lit("title"), F.lit("folder_id")))
        .when(kind == "click", F.array(F.lit("title")))
        .when(kind == "purchase", F.array(F.lit("markdown_content")))
    )
    return events.select(
        F.col("user_id").cast("string").alias("note_id"), F.col("ts").cast("timestamp").alias("ts"), number.alias("seq"),
        _mapped(EVENT_OPS).alias("op"), mask.alias("set_mask"), value.alias("title"), value.alias("markdown_content"),
        F.when(number % 8 != 0, F.concat(F.lit("f"), number.cast("string"))).alias("folder_id"),
    )


def slot_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, id): views write a note's id, which a third of the time is unknown; errors clear the slot, with null or an empty id."""
    number, kind = F.col("event_id"), F.col("event_type")
    wanted = F.when(number % 3 == 0, F.concat(F.lit("x"), number.cast("string"))).otherwise((number % 50).cast("string"))
    events = table(spark, sf_dir, "events").filter(kind.isin("view", "error"))
    return events.select(F.col("user_id").alias("session"), number.alias("seq"), F.when(kind == "view", wanted).when(number % 2 == 0, "").alias("id"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream of its files."""
    # as a pattern, since a stream takes a plain path for a folder, and the table may be one file
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


def editor_events(events: DataFrame) -> DataFrame:
    """Each user as a session whose note changes every second day. Views open that note or, every second time, the next; all else edits it."""
    at, edit = F.col("ts").cast("timestamp"), F.col("event_type") != "view"
    day = F.floor(F.unix_seconds(at) / 172_800)
    note = day + F.when(edit, 0).otherwise(F.col("event_id") % 2)
    return events.select(F.col("user_id").cast("string").alias("session"), at.alias("ts"), F.col("event_id").alias("seq"), F.concat(F.lit("n"), note.cast("string")).alias("note_id"), edit.alias("edit"))


def edits_of(events: DataFrame) -> DataFrame:
    """All events as edits, whose value is the event's type, so that neighbours may be equal."""
    return events.select(F.col("user_id").cast("string").alias("note_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits_of(table(spark, sf_dir, "events"))


def _toast_log(events: DataFrame) -> DataFrame:
    kind, value = _mapped(TOAST_TYPES), F.concat(F.lit("v"), F.col("event_id").cast("string"))
    known = events.filter(F.col("event_type").isin(*TOAST_TYPES))
    return known.select(F.col("user_id").cast("string").alias("list_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("type"), value.alias("value"))


def _toast_rows(events: DataFrame, toast_id) -> DataFrame:
    update, seq = F.col("type") == "UPDATE", F.col("seq")
    return events.select(
        "list_id", "ts", "seq", "type", toast_id.alias("toast_id"),
        F.when(~(update & (seq % 3 == 0)), F.col("value")).alias("title"), F.when(~(update & (seq % 2 == 0)), F.concat(F.lit("d"), "value")).alias("description"),
    )


def toast_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds get their ids by count. The others mean the message added last or the one before, or,
    but for updates, every fifth time any. Every third update gives no title and every second no description."""
    update, seq, adds = F.col("type") == "UPDATE", F.col("seq"), F.col("adds")
    meant = F.when(F.col("type") == "ADD", adds).when(~update & (seq % 5 == 0), F.lit(None)).otherwise(F.greatest(adds - seq % 2, F.lit(1)))
    return _toast_rows(changelog.numbered_adds(_toast_log(table(spark, sf_dir, "events"))), changelog.toast_id(meant))


def toast_stream(events: DataFrame) -> DataFrame:
    """The same from a stream, but adds get their ids from the list, and all others but updates mean any message; updates mean one of the first ten."""
    return _toast_rows(_toast_log(events), F.when(F.col("type") == "UPDATE", (F.col("seq") % 10 + 1).cast("string")))


def marked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): the documents labelled as good."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("id")).distinct()

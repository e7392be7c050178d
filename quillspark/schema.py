"""Types of the note collections."""

from pyspark.sql import types as T

NOTE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("markdown_content", T.StringType()),
    T.StructField("folder_id", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("owner_id", T.StringType()),
    T.StructField("position", T.LongType()),
])

#: A note as stored JSON has it (fixed names).
STORED_NOTE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("markdownContent", T.StringType()),
    T.StructField("folderId", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("createdAt", T.TimestampType()),
    T.StructField("updatedAt", T.TimestampType()),
    T.StructField("ownerId", T.StringType()),
])

#: Defaults of new rows (fixed values).
DEFAULT_TITLE = "Untitled Note"
DEFAULT_OWNER = "local-user"
DEFAULT_TAG_COLOR = "#3b82f6"
#: The text of a new note is our own.
DEFAULT_BODY = "# New note\n\nWrite here."
APP_TITLE = "Notes"

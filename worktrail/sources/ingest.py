"""Raw inputs: capture feed, model replies, log files, capture file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.functions.keys import source_key
from worktrail.functions.normalize import (
    ACTION_ITEMS, NODE_KEYWORDS, SNIPPETS, action_priority, action_source, cap, clamp, clean_app_hint, clean_entities,
    merge_hints,
)
from worktrail.functions.text import blank_to_null, project_key

# Formats.
LOG_LINE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+ [+-]\d{4})\] (\w+): \[(.+?)\] (.+)$"
LOG_TIME = "yyyy-MM-dd HH:mm:ss.SSS Z"
CAPTURE_FILE = r"^capture-.*\.(jpeg|png|webp)$"

FEED = "type string, source_id string, display_id string, name string, app_name string, window_title string, ts timestamp, phash long, file_path string"

REPLY_NODE = T.StructType(
    [
        T.StructField("screenshot_index", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "app_context",
            T.StructType([T.StructField(n, T.StringType()) for n in ("app_hint", "window_title", "source_key", "project_name", "project_key")]),
        ),
        T.StructField("knowledge", T.StringType()),
        T.StructField("state_snapshot", T.StringType()),
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("raw", T.StringType()),
                        T.StructField("confidence", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "action_items",
            T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("action", "priority", "source")])),
        ),
        T.StructField("ui_text_snippets", T.ArrayType(T.StringType())),
        T.StructField("importance", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
    ]
)
REPLY = T.StructType([T.StructField("nodes", T.ArrayType(REPLY_NODE))])


def ingest_captures(feed: DataFrame) -> DataFrame:
    """Capture rows of a raw feed, batch or stream: source key, storage state, hint and title."""
    return feed.select(
        source_key(F.col("type"), F.col("source_id"), F.col("display_id")).alias("source_key"),
        "ts", "phash",
        clean_app_hint("app_name").alias("app_hint"),
        F.coalesce(blank_to_null("window_title"), blank_to_null("name")).alias("window_title"),
        "file_path",
        F.lit("ephemeral").alias("storage_state"),
    )


def stream_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture feed from a folder of JSON files as a stream."""
    return ingest_captures(spark.readStream.schema(FEED).json(path))


def explode_model_nodes(replies: DataFrame, members: DataFrame) -> DataFrame:
    """Node rows of model replies, each with the capture its 1-based index names.

    ``replies(batch_id, reply)`` with JSON text; ``members(batch_id, pos, id, ...)`` with 0-based
    positions.  An index out of range has no member and drops out; a broken reply has no nodes.
    """
    parsed = replies.select("batch_id", F.from_json("reply", REPLY).alias("r"))
    rows = parsed.select("batch_id", F.posexplode("r.nodes").alias("node_index", "n"))
    rows = rows.withColumn("pos", F.col("n.screenshot_index") - 1)
    return rows.join(members.withColumnRenamed("id", "screenshot_id"), ["batch_id", "pos"])


def normalize_reply_node(n: Column, capture_hint: Column | None = None) -> list[Column]:
    """Clean columns of one reply node."""
    ctx = n["app_context"]
    hint = clean_app_hint(ctx["app_hint"])
    actions = F.transform(
        cap(n["action_items"], ACTION_ITEMS),
        lambda a: F.struct(a["action"].alias("action"), action_priority(a["priority"]).alias("priority"), action_source(a["source"]).alias("source")),
    )
    return [
        n["title"].alias("title"),
        n["summary"].alias("summary"),
        (hint if capture_hint is None else merge_hints(capture_hint, hint)).alias("app_hint"),
        blank_to_null(ctx["window_title"]).alias("window_title"),
        project_key(ctx["project_key"], ctx["project_name"]).alias("project_key"),
        clean_entities(n["entities"]).alias("entities"),
        actions.alias("action_items"),
        cap(n["ui_text_snippets"], SNIPPETS).alias("ui_text_snippets"),
        cap(n["keywords"], NODE_KEYWORDS).alias("keywords"),
        clamp(n["importance"], 0.0, 10.0).alias("importance"),
        clamp(n["confidence"], 0.0, 10.0).alias("confidence"),
    ]


def parse_logs(lines: DataFrame, col: str = "value") -> DataFrame:
    """Structured rows of log lines; lines of another form drop out."""
    part = lambda i: F.regexp_extract(col, LOG_LINE, i)
    return lines.filter(F.col(col).rlike(LOG_LINE)).select(
        F.try_to_timestamp(part(1), F.lit(LOG_TIME)).alias("line_ts"),
        part(2).alias("level"), part(3).alias("module"), part(4).alias("message"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))


def capture_files(listing: DataFrame) -> DataFrame:
    """Capture files of a listing, by the form of their ``name``."""
    return listing.filter(F.col("name").rlike(CAPTURE_FILE))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times of capture files, newest name first; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length",
        F.unix_millis("modificationTime").alias("mtime_ms"),
    )
    return capture_files(rows).orderBy(F.col("name").desc())

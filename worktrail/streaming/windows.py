"""Windows, sessions and incremental tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from worktrail.streaming.snapshots import read_version, write_version

WINDOW_MS = 20 * 60_000


def window_counts(stream: DataFrame, ts: str = "ts", width: str = "20 minutes", delay: str = "0 seconds") -> DataFrame:
    """Node count per tumbling window, each emitted once when the watermark has passed its end."""
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("node_count"))
    return counts.select(F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), "node_count")


def session_stream(stream: DataFrame, key: str, ts: str = "ts", gap: str = "10 minutes", delay: str = "0 seconds") -> DataFrame:
    """Sessions per key, emitted when closed.  Also what is idle: a thread without a node for the gap
    (4 hours) has become inactive, a source without a capture for the gap (60 s) gives up its buffer.
    """
    spans = stream.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w"))
    out = spans.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return out.select(key, F.unix_millis("first_ts").alias("start_ms"), F.unix_millis("last_ts").alias("last_ms"), "n")


def inactive_threads(stream: DataFrame, ts: str = "ts", idle: str = "4 hours", delay: str = "0 seconds") -> DataFrame:
    """Thread id and last activity whenever a thread has been idle for the given time."""
    return session_stream(stream, "thread_id", ts, idle, delay).select("thread_id", F.col("last_ms").alias("last_active_ms"))


def evict_idle(stream: DataFrame, ts: str = "ts", ttl: str = "60 seconds", delay: str = "0 seconds") -> DataFrame:
    """Sources whose buffer is dropped, with the time they were last seen."""
    return session_stream(stream, "source_key", ts, ttl, delay).select("source_key", F.col("last_ms").alias("last_seen_ms"))


COUNTS = T.StructType([T.StructField("window_start", T.LongType()), T.StructField("node_count", T.LongType())])


def window_table(stream: DataFrame, path: str, width_ms: int = WINDOW_MS, flush: bool = False) -> StreamingQuery:
    """A table of window counts that late rows still change: each micro-batch adds to the windows it touches.

    The snapshot after batch ``b`` is ``path/windows/v=b``; ``path/touched/v=b`` lists the windows that
    changed, among them closed ones that open again.
    """

    def on_batch(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        start = F.floor(F.col("ts_ms") / width_ms) * width_ms
        new = rows.groupBy(start.cast("long").alias("window_start")).agg(F.count("*").alias("node_count"))
        old = read_version(spark, path, "windows", batch - 1, COUNTS)
        both = old.unionByName(new).groupBy("window_start").agg(F.sum("node_count").alias("node_count"))
        write_version(both, path, "windows", batch)
        write_version(new, path, "touched", batch)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/offsets")
    return writer.trigger(availableNow=True).start() if flush else writer.start()

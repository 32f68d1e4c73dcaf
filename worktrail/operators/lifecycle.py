"""Status changes of queue rows, windows, threads and events from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.keys import marker_key
from worktrail.functions.normalize import long_event_kind
from worktrail.functions.text import marker_title
from worktrail.operators.aggregates import ordered_list, vector_dims
from worktrail.operators.blocks import HOUR_MS, time_block, top_n
from worktrail.operators.filters import capture_allowed, eligible, within
from worktrail.operators.ranking import gap_sessions
from worktrail.operators.sequential import changes_only

# Fixed values.
MAX_ATTEMPTS, RETRY_MS, STALE_MS = 2, 60_000, 5 * 60_000
IDLE_MS = 4 * HOUR_MS
WINDOW_MS = 20 * 60_000
SOURCE_TTL_MS = 60_000
REFRESH_NODES, REFRESH_MS = 50, 10 * 60_000
MARKER_NODES, MARKER_SCORE = 200, 6


def transition(rows: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """Queue rows after one round of work.

    ``rows(id, status, attempts, next_run_at, downstream_status)``; ``outcomes(id, ok)``.  A row
    that was due and has an outcome counts one attempt; success releases the next stage, a
    failure waits a minute, and the last allowed failure is final for both stages.
    """
    due = eligible(F.col("status"), F.col("attempts"), F.col("next_run_at"), F.lit(now_ms))
    joined = rows.join(outcomes.select("id", "ok"), "id", "left").withColumn("__ran", due & F.col("ok").isNotNull())
    ran, good = F.col("__ran"), F.col("ok")
    tries = F.col("attempts") + F.when(ran, 1).otherwise(0)
    final = ran & ~good & (tries >= MAX_ATTEMPTS)
    return joined.select(
        "id",
        F.when(ran & good, "succeeded").when(final, "failed_permanent").when(ran, "failed").otherwise(F.col("status")).alias("status"),
        tries.alias("attempts"),
        F.when(ran & ~good & ~final, now_ms + RETRY_MS).when(~ran, F.col("next_run_at")).alias("next_run_at"),
        F.when(ran & good, "pending").when(final, "failed_permanent").otherwise(F.col("downstream_status")).alias("downstream_status"),
    )


def recover_stale(rows: DataFrame, now_ms: int, stale_ms: int = STALE_MS) -> DataFrame:
    """Queue rows after recovery, with what was done to each in ``recovery``.

    Running for more than five minutes: back to pending, or final at the attempt limit.  A stage
    that waits for one that failed for good fails too.
    """
    stale = (F.col("status") == "running") & (F.col("updated_ms") < now_ms - stale_ms)
    final = stale & (F.col("attempts") >= MAX_ATTEMPTS)
    orphan = (F.col("status") == "failed_permanent") & (F.col("downstream_status") == "pending")
    return rows.select(
        "id",
        F.when(final, "failed_permanent").when(stale, "pending").otherwise(F.col("status")).alias("status"),
        "attempts",
        F.when(~stale, F.col("next_run_at")).alias("next_run_at"),
        F.when(final | orphan, "failed_permanent").otherwise(F.col("downstream_status")).alias("downstream_status"),
        F.when(final, "permanent").when(stale, "recovered").when(orphan, "orphaned").alias("recovery"),
    )


def mark_inactive(threads: DataFrame, now_ms: int, idle_ms: int = IDLE_MS) -> DataFrame:
    idle = (F.col("status") == "active") & (F.col("last_active_ms") < now_ms - idle_ms)
    return threads.withColumn("status", F.when(idle, "inactive").otherwise(F.col("status")))


def tumble(df: DataFrame, ts: str = "ts", width: str = "20 minutes") -> DataFrame:
    """Start and end of the epoch-aligned tumbling window of each row."""
    w = F.window(ts, width)
    return df.withColumn("__w", w).select(
        *df.columns, F.unix_millis("__w.start").alias("window_start"), F.unix_millis("__w.end").alias("window_end")
    )


def complete_windows(nodes: DataFrame, now_ms: int, width_ms: int = WINDOW_MS, limit: int | None = None) -> DataFrame:
    """Non-empty windows that have ended by ``now_ms``; the earliest ``limit`` if one is given.

    No window can end later than the one that holds the last node, so ``now_ms`` is the only bound.
    """
    start = time_block("ts_ms", width_ms) * width_ms
    last_end = now_ms // width_ms * width_ms
    held = nodes.filter(F.col("ts_ms") < last_end).groupBy(start.alias("window_start")).agg(F.count("*").alias("node_count"))
    out = held.withColumn("window_end", F.col("window_start") + width_ms)
    return out if limit is None else out.orderBy("window_start").limit(limit)


def reopen_windows(summaries: DataFrame, nodes: DataFrame, now_ms: int, width_ms: int = WINDOW_MS) -> DataFrame:
    """Summaries after late data: an empty window that now has a node is pending again."""
    start = time_block("ts_ms", width_ms) * width_ms
    held = nodes.select(start.alias("window_start")).distinct().withColumn("__held", F.lit(True))
    joined = summaries.join(held, "window_start", "left")
    again = (F.col("status") == "no_data") & F.col("__held").isNotNull()
    return (
        joined.withColumn("attempts", F.when(again, 0).otherwise(F.col("attempts")))
        .withColumn("next_run_at", F.when(again, F.lit(now_ms)).otherwise(F.col("next_run_at")))
        .withColumn("status", F.when(again, "pending").otherwise(F.col("status")))
        .drop("__held")
    )


def sessions(df: DataFrame, key: str, gap_ms: int = 10 * 60_000, ranges: int | None = None) -> DataFrame:
    """Activity sessions per key: start, last row and row count; a step of exactly the gap stays inside.

    Times are counted once each and numbered range by range; a session window would sort a whole key in one task.
    """
    times = df.groupBy(key, "ts_ms").agg(F.count("*").alias("same"))
    numbered = gap_sessions(times, key, gap_ms, ranges)
    spans = numbered.groupBy(key, "session").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.sum("same").alias("n")
    )
    return spans.drop("session")


def evict_idle(captures: DataFrame, now_ms: int, ttl_ms: int = SOURCE_TTL_MS, ranges: int | None = None) -> DataFrame:
    """When a source's buffer was dropped: each time it was not seen for longer than ``ttl_ms``."""
    spans = sessions(captures, "source_key", ttl_ms, ranges)
    gone = spans.filter(F.col("last_ms") < now_ms - ttl_ms)
    return gone.select("source_key", F.col("last_ms").alias("last_seen_ms"), F.col("n").alias("captures"))


def needs_refresh(threads: DataFrame, last_state: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Threads to describe anew: 50 nodes and ten active minutes more than last time, or forced.

    A thread that was never described is not refreshed.
    """
    last = last_state.select("thread_id", F.col("node_count").alias("__n"), F.col("last_active_ms").alias("__t"))
    joined = threads.join(last, "thread_id")
    grown = (F.col("node_count") - F.col("__n") >= REFRESH_NODES) & (F.col("last_active_ms") - F.col("__t") >= REFRESH_MS)
    if forced is not None:
        joined = joined.join(forced.select("thread_id").distinct().withColumn("__f", F.lit(True)), "thread_id", "left")
        grown = grown | F.coalesce("__f", F.lit(False))
        return joined.filter(grown).drop("__n", "__t", "__f")
    return joined.filter(grown).drop("__n", "__t")


def pull_since(df: DataFrame, mark: int, ts_ms: str = "ts_ms", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows after the high-water mark, and the new mark as a one-row frame.

    Files that hold only older rows are skipped where the table stores ``ts``.
    """
    fresh = within(df, mark + 1, ts_ms=ts_ms, ts=ts)
    return fresh, fresh.agg(F.coalesce(F.max(ts_ms), F.lit(mark)).alias("mark"))


def reset_on_dim_change(docs: DataFrame, dim: int) -> DataFrame:
    """All vectors go back to pending when any has another dimension than ``dim``."""
    wrong = vector_dims(docs.filter("embedding IS NOT NULL"), dim).agg(
        F.coalesce(F.bool_or("mismatch"), F.lit(False)).alias("reset")
    )
    reset = bool(wrong.first()["reset"])  # one value decides for the table
    if not reset:
        return docs
    return docs.withColumn("embedding", F.lit(None).cast(docs.schema["embedding"].dataType)).withColumn(
        "embedding_status", F.lit("pending")
    ).withColumn("index_status", F.lit("pending"))


def upsert_markers(events: DataFrame, long_threads: DataFrame, nodes: DataFrame, now_ms: int) -> DataFrame:
    """Markers of long-running threads after a window was summarised.

    ``events`` are existing markers ``(event_key, kind, end_ms, node_ids, details_text,
    details_status, details_attempts, details_next_run_at)``; ``long_threads(thread_id, title,
    current_phase, event_title, event_description, event_kind, start_ms, last_active_ms,
    duration_ms)``; ``nodes(thread_id, id, ts_ms)``.  Details are dropped when the end or the
    node list changed.  Only the markers of the given threads are returned.
    """
    newest = top_n(
        nodes.join(long_threads.select("thread_id"), "thread_id", "left_semi").select("thread_id", "id", "ts_ms"),
        ["thread_id"], [F.col("ts_ms").desc(), F.col("id").desc()], MARKER_NODES,
    )
    ids = newest.groupBy("thread_id").agg(ordered_list("rn", F.col("id")).alias("node_ids"))
    title = marker_title(F.col("event_title"), F.col("event_description"), F.col("event_kind"), F.col("title"))
    rows = long_threads.withColumn("event_key", marker_key(F.col("thread_id"))).withColumn("marker", title)
    rows = rows.join(ids, "thread_id", "left")
    old = events.select("event_key", F.struct(*[c for c in events.columns if c != "event_key"]).alias("o"))
    joined = rows.join(old, "event_key", "left")
    exists = F.col("o").isNotNull()
    same = F.col("o.end_ms").eqNullSafe(F.col("last_active_ms")) & F.col("o.node_ids").eqNullSafe(F.col("node_ids"))
    stale = exists & F.col("o.details_text").isNotNull() & ~same
    fresh_kind = F.coalesce("event_kind", long_event_kind("current_phase", "marker"))
    return joined.select(
        "event_key", "thread_id", F.col("marker").alias("title"),
        F.when(exists, F.col("o.kind")).otherwise(fresh_kind).alias("kind"),
        "start_ms", F.col("last_active_ms").alias("end_ms"), "duration_ms", "node_ids",
        F.when(exists & ~stale, F.col("o.details_text")).alias("details_text"),
        F.when(exists & ~stale, F.col("o.details_status")).otherwise("pending").alias("details_status"),
        F.when(exists & ~stale, F.col("o.details_attempts")).otherwise(0).alias("details_attempts"),
        F.when(stale, F.lit(now_ms)).when(exists, F.col("o.details_next_run_at")).alias("details_next_run_at"),
    )


def schedule_changes(ticks: DataFrame, key: str, windows: Column, override: Column | None = None, tz: str = "UTC") -> DataFrame:
    """Ticks at which capture starts or stops; the first tick of a key sets its state."""
    state = F.when(capture_allowed(F.col("ts"), windows, override, tz), "running").otherwise("paused")
    return changes_only(ticks.withColumn("state", state), key, "state")

"""Equi, as-of, band, interval and flag joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.operators.blocks import BLOCK, in_ranges, running, time_block, top_n
from worktrail.operators.filters import drop_system_windows, flag_self
from worktrail.session import shared

# Fixed values.
WINDOW_MS = 20 * 60_000
NEIGHBORS_BEFORE, NEIGHBORS_AFTER = 3, 3
BAND_MS = 2 * 60_000


def explode_members(batches: DataFrame, captures: DataFrame) -> DataFrame:
    """Batch members in the order of the id list; ids without a capture drop out."""
    members = batches.select("batch_id", F.posexplode("screenshot_ids").alias("pos", "id"))
    return members.join(captures, "id")


def captures_with_batch(captures: DataFrame, batches: DataFrame) -> DataFrame:
    return captures.join(batches, "batch_id")


def evidence(nodes: DataFrame, links: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures linked to the nodes, each once per query, with how many of its nodes it supports.

    ``nodes`` has ``query_id`` and ``id``; the pairs are counted before captures are read.
    """
    linked = (
        nodes.select("query_id", F.col("id").alias("node_id"))
        .distinct()
        .join(links.distinct(), "node_id")
        .groupBy("query_id", "screenshot_id")
        .agg(F.count("*").alias("node_count"))
    )
    return linked.join(captures.withColumnRenamed("id", "screenshot_id"), "screenshot_id")


def nodes_for_hits(hits: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes linked to a capture that the full-text search found, per query."""
    pairs = (
        hits.select("query_id", "screenshot_id")
        .distinct()
        .join(links.distinct(), "screenshot_id")
        .select("query_id", F.col("node_id").alias("id"))
        .distinct()
    )
    return pairs.join(nodes, "id")


def nodes_for_vectors(matches: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the matched vector documents with the best distance."""
    best = (
        matches.join(docs.select("vector_id", F.col("ref_id").alias("id")), "vector_id")
        .groupBy("query_id", "id")
        .agg(F.min("score").alias("score"))
    )
    return best.join(nodes, "id")


def overlapped_windows(windows: DataFrame, events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each window with a flag: does any event overlap it (``start < window_end`` and ``end > window_start``)?

    An event qualifies when it starts before the window ends, and the one that ends last of
    those decides.  So the flag is a running maximum of event ends over one timeline, and a
    long event is never copied into the windows it covers.  Of the events that start in one millisecond
    only the latest end is kept; events without a start and windows without an end are left out.
    """
    latest = events.filter("start_ms IS NOT NULL").groupBy("start_ms").agg(F.max("end_ms").alias("end_ms"))
    marks = latest.select(
        F.col("start_ms").alias("at"), F.lit(1).alias("side"), F.col("end_ms").alias("reach"),
        F.lit(None).cast("long").alias("window_start"),
    ).unionByName(
        windows.select("window_start", "window_end").filter("window_end IS NOT NULL").distinct().select(
            F.col("window_end").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("reach"),
            "window_start",
        )
    )
    order = ["at", "side", "window_start"]
    swept = running(in_ranges(marks, [], order, ranges), [], order, BLOCK, {"reached": ("max", F.col("reach"))})
    return swept.filter("side = 0").select(
        "window_start", F.col("at").alias("window_end"),
        F.coalesce(F.col("reached") > F.col("window_start"), F.lit(False)).alias("has_long_event"),
    )


def assign_window(df: DataFrame, ts_ms: str, width_ms: int = WINDOW_MS) -> DataFrame:
    """Start and end of the epoch-aligned window that holds each row."""
    start = time_block(ts_ms, width_ms) * width_ms
    return df.withColumn("window_start", start).withColumn("window_end", start + width_ms)


def _timeline(nodes: DataFrame, markers: DataFrame, keys: list[str], ranges: int | None) -> DataFrame:
    """Nodes (``side = 0``) and markers on one timeline per key, with ``n`` = nodes up to the row.

    ``markers`` has the keys, ``pivot_id``, ``ts_ms`` and ``side``: -1 stands before the nodes
    of the same time, 1 after them.
    """
    no_id = F.lit(None).cast("long")
    rows = nodes.select(*keys, "ts_ms", F.lit(0).alias("side"), "id", no_id.alias("pivot_id")).unionByName(
        markers.select(*keys, "ts_ms", "side", no_id.alias("id"), F.col("pivot_id").cast("long").alias("pivot_id"))
    )
    order = ["ts_ms", "side", "id", "pivot_id"]
    rows = in_ranges(rows.filter("ts_ms IS NOT NULL"), keys, order, ranges)
    one = F.when(F.col("side") == 0, 1).otherwise(0).cast("long")
    return running(rows, keys, order, BLOCK, {"n": ("sum", one)})


def nearest_k(
    pivots: DataFrame,
    nodes: DataFrame,
    k_before: int = NEIGHBORS_BEFORE,
    k_after: int = NEIGHBORS_AFTER,
    key: str = "thread_id",
    ranges: int | None = None,
) -> DataFrame:
    """The ``k`` nodes at or before and at or after each pivot of the same key.

    A pivot that is a node counts on both sides.  Nodes get their number in the key's
    timeline, a pivot gets the number it falls at, and ``k_before + k_after`` numbers are
    looked up; pivots are never paired with all nodes of their key, and keys without a pivot are left out.
    """
    own = pivots.filter(F.col(key).isNotNull()).select(key, "pivot_id", "ts_ms")
    markers = own.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    held = nodes.filter(F.col(key).isNotNull()).join(shared(own.select(key).distinct()), key, "left_semi")
    line = _timeline(held, markers, [key], ranges)
    n = F.col("n")
    numbers = F.when(F.col("side") > 0, F.sequence(n - (k_before - 1), n)).otherwise(F.sequence(n + 1, n + k_after))
    wanted = line.filter("side <> 0").select(
        key, "pivot_id", F.when(F.col("side") > 0, "before").otherwise("after").alias("side"), F.explode(numbers).alias("n")
    )
    numbered = line.filter("side = 0").select(key, "n", "id", "ts_ms")
    return wanted.filter("n > 0").join(numbered, [key, "n"]).select(key, "pivot_id", "side", "id", "ts_ms")


def band_join(
    pivots: DataFrame, nodes: DataFrame, radius_ms: int = BAND_MS, limit: int = NEIGHBORS_BEFORE + NEIGHBORS_AFTER,
    ranges: int | None = None,
) -> DataFrame:
    """The earliest ``limit`` nodes within ``radius_ms`` of each pivot, both ends counted.

    Only nodes in a cell of time (twice the radius wide) that some pivot's band touches are numbered.
    """
    width = 2 * radius_ms + 1
    cell = lambda c: F.floor(c / width)
    touched = pivots.select(F.explode(F.array(cell(F.col("ts_ms") - radius_ms), cell(F.col("ts_ms") + radius_ms))).alias("__cell")).distinct()
    nodes = nodes.withColumn("__cell", cell(F.col("ts_ms"))).join(shared(touched), "__cell", "left_semi").drop("__cell")
    markers = pivots.select("pivot_id", (F.col("ts_ms") - radius_ms).alias("ts_ms"), F.lit(-1).alias("side"))
    line = _timeline(nodes, markers, [], ranges)
    wanted = line.filter("side < 0").select(
        "pivot_id", (F.col("ts_ms") + 2 * radius_ms).alias("__hi"),
        F.explode(F.sequence(F.col("n") + 1, F.col("n") + limit)).alias("n"),
    )
    numbered = line.filter("side = 0").select("n", "id", "ts_ms")
    return wanted.join(numbered, "n").filter("ts_ms <= __hi").select("pivot_id", "id", "ts_ms")


def nonempty_windows(windows: DataFrame, nodes: DataFrame, width_ms: int = WINDOW_MS) -> DataFrame:
    """Windows that hold at least one node."""
    held = nodes.select((time_block("ts_ms", width_ms) * width_ms).alias("window_start")).distinct()
    return windows.join(held, "window_start", "left_semi")


def unseeded_windows(windows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Windows that have no summary row yet."""
    return windows.join(summaries.select("window_start", "window_end").distinct(), ["window_start", "window_end"], "left_anti")


def text_regions(captures: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text region for each capture through its first linked node, if it has one."""
    first = links.groupBy(F.col("screenshot_id").alias("id")).agg(F.min("node_id").alias("node_id"))
    regions = nodes.select(F.col("id").alias("node_id"), "text_region")
    return captures.join(first, "id", "left").join(regions, "node_id", "left")


def enrich_windows(
    sources: DataFrame, inspector: DataFrame, system: DataFrame, aliases: DataFrame, own_names: list[str]
) -> DataFrame:
    """Window sources with the inspector's app and title, by the number inside their id.

    Windows the inspector does not know, system windows and the recorder's own go; screens pass.
    """
    number = F.regexp_extract("source_id", r"(\d+)", 1).try_cast("long")
    screens = sources.filter(F.col("type") == "screen").select(
        "source_id", "type", "name", F.lit(None).cast("string").alias("app_name"),
        F.lit(None).cast("string").alias("window_title"),
    )
    windows = (
        sources.filter(F.col("type") == "window")
        .withColumn("window_number", number)
        .join(inspector.select("window_number", "app_name", "window_title"), "window_number")
        .select("source_id", "type", F.col("app_name").alias("name"), "app_name", "window_title")
    )
    kept = drop_system_windows(windows.filter(~flag_self("app_name", own_names)), system, aliases)
    return kept.unionByName(screens)


def source_visibility(requested: DataFrame, visible: DataFrame) -> DataFrame:
    """Requested source ids with whether they are visible now, and their name."""
    shown = visible.groupBy("source_id").agg(F.min("name").alias("__name"))
    joined = requested.join(shown, "source_id", "left")
    return joined.select(
        "source_id", F.coalesce("__name", F.lit("Unknown")).alias("name"), F.col("__name").isNotNull().alias("is_visible")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "__first").drop("__first")

"""Operators whose decision depends on the last kept row: built on the ordered fold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.functions.keys import batch_id
from worktrail.operators.blocks import BLOCK, HOUR_MS, in_ranges, lag_in_blocks, running, time_block
from worktrail.operators.folds import ordered_fold

# Fixed values.
DUPLICATE_DISTANCE = 8
BATCH_SIZE, BATCH_TIMEOUT_MS = 2, 60_000
PRESSURE_LEVELS = (3, 7, 11, math.inf)
PRESSURE_HOLD_MS = 30_000
THROTTLE_MS = 30_000
COALESCE_MS = 800
MASK = 0xFFFF_FFFF_FFFF_FFFF


def dedup_step(threshold: int):
    """Keep a fingerprint that is further than the threshold from the last one kept."""

    def step(cols, last):
        keep = []
        for fp in cols["fp"]:
            kept = last is None or ((fp ^ last) & MASK).bit_count() > threshold
            keep.append(kept)
            if kept:
                last = fp
        return {"kept": keep}, last

    return step


def dedup_flags(df: DataFrame, key: str, fp: str, threshold: int = DUPLICATE_DISTANCE, partitions: int | None = None) -> DataFrame:
    """All rows with ``kept``; rows need ``ts_ms`` and ``id``."""
    rows = df.withColumnRenamed(fp, "fp") if fp != "fp" else df
    out = ordered_fold(
        rows, [key], ["ts_ms", "id"], ["fp"], [T.StructField("kept", T.BooleanType())], dedup_step(threshold), partitions
    )
    return out.withColumnRenamed("fp", fp) if fp != "fp" else out


def dedup_sequential(df: DataFrame, key: str, fp: str, threshold: int = DUPLICATE_DISTANCE, partitions: int | None = None) -> DataFrame:
    """Rows whose fingerprint is not a near-duplicate of the last kept one of the same source."""
    return dedup_flags(df, key, fp, threshold, partitions).filter("kept").drop("kept")


def batch_step(size: int, timeout_ms: int):
    """Close a batch at ``size`` rows; a row ``timeout_ms`` or more after the first starts a new one."""

    def step(cols, state):
        opened, head, n = state or (0, None, 0)
        first = []
        for t, i in zip(cols["ts_ms"], cols["id"]):
            if n == 0 or t - opened >= timeout_ms:
                opened, head, n = t, i, 0
            n += 1
            first.append(head)
            if n == size:
                n = 0
        return {"first_id": first}, ((opened, head, n) if n else None)

    return step


def micro_batch(df: DataFrame, key: str, size: int = BATCH_SIZE, timeout_ms: int = BATCH_TIMEOUT_MS, partitions: int | None = None) -> DataFrame:
    """Rows with the id of the first row of their batch."""
    field = T.StructField("first_id", T.LongType())
    return ordered_fold(df, [key], ["ts_ms", "id"], ["ts_ms", "id"], [field], batch_step(size, timeout_ms), partitions)


def build_batches(batched: DataFrame, key: str = "source_key") -> DataFrame:
    """One row per batch: members in time order, start, end and a deterministic id."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "id"))), lambda s: s["id"])
    grouped = batched.groupBy(key, "first_id").agg(
        F.min("ts_ms").alias("ts_start"), F.max("ts_ms").alias("ts_end"), members.alias("screenshot_ids")
    )
    bid = batch_id(F.col(key), F.col("ts_start"), F.col("ts_end"), F.col("screenshot_ids"))
    return grouped.withColumn("batch_id", bid).drop("first_id")


def batch_conflicts(batches: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures that already belong to another batch than the one that now lists them."""
    members = batches.select("batch_id", F.explode("screenshot_ids").alias("id"))
    held = captures.select("id", F.col("batch_id").alias("held_by")).filter("held_by IS NOT NULL")
    return members.join(held, "id").filter("held_by <> batch_id")


def pressure_step(levels, hold_ms: int):
    """Level of a depth is the first bound it does not exceed; rises at once, falls after the hold."""

    def step(cols, state):
        level, changed = state or (0, None)
        out = []
        for t, depth in zip(cols["ts_ms"], cols["depth"]):
            want = next((i for i, top in enumerate(levels) if depth <= top), len(levels) - 1)
            if want > level or (want < level and (changed is None or t - changed >= hold_ms)):
                level, changed = want, t
            out.append(level)
        return {"level": out}, (level, changed)

    return step


def pressure_levels(df: DataFrame, key: str, depth: str = "depth", levels=PRESSURE_LEVELS, hold_ms: int = PRESSURE_HOLD_MS, partitions: int | None = None) -> DataFrame:
    """Backlog level after each sample, starting from level 0."""
    rows = df.withColumnRenamed(depth, "depth")
    field = T.StructField("level", T.IntegerType())
    return ordered_fold(rows, [key], ["ts_ms", "id"], ["ts_ms", "depth"], [field], pressure_step(levels, hold_ms), partitions)


def throttle_step(width_ms: int):
    """Show a repeat only ``width_ms`` after the last one shown; critical ones pass and do not count."""

    def step(cols, last):
        out = []
        for t, critical in zip(cols["ts_ms"], cols["critical"]):
            if critical:
                out.append(True)
                continue
            shown = last is None or t - last >= width_ms
            out.append(shown)
            if shown:
                last = t
        return {"shown": out}, last

    return step


def throttle(df: DataFrame, key: str, width_ms: int = THROTTLE_MS, partitions: int | None = None) -> DataFrame:
    """Rows (``ts_ms``, ``id``, ``critical``) with ``shown``."""
    field = T.StructField("shown", T.BooleanType())
    return ordered_fold(df, [key], ["ts_ms", "id"], ["ts_ms", "critical"], [field], throttle_step(width_ms), partitions)


def coalesce_step(width_ms: int):
    """Changes join the group whose first change came less than ``width_ms`` before."""

    def step(cols, start):
        out = []
        for t in cols["ts_ms"]:
            if start is None or t - start >= width_ms:
                start = t
            out.append(start)
        return {"opened": out}, start

    return step


def coalesce_changes(df: DataFrame, key: str, width_ms: int = COALESCE_MS, partitions: int | None = None) -> DataFrame:
    """One change per group: widest range and a revision number per key.

    Rows have ``ts_ms``, ``id``, ``from_ms`` and ``to_ms``; the timer starts with the first change
    of a group and is not extended.
    """
    field = T.StructField("opened", T.LongType())
    grouped = ordered_fold(df, [key], ["ts_ms", "id"], ["ts_ms"], [field], coalesce_step(width_ms), partitions)
    merged = grouped.groupBy(key, "opened").agg(
        F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"), F.count("*").alias("changes")
    )
    merged = merged.withColumn("__block", time_block("opened", HOUR_MS))
    one = F.lit(1).cast("long")
    return running(merged, [key], ["opened"], "__block", {"revision": ("sum", one)}).drop("__block")


def changes_only(df: DataFrame, key: str, sig: str, ranges: int | None = None) -> DataFrame:
    """Rows whose signature differs from the row before; the first row of a key always counts."""
    rows = in_ranges(df, [key], ["ts_ms", "id"], ranges)
    rows = lag_in_blocks(rows, [key], ["ts_ms", "id"], BLOCK, {"__sig": (sig, 1), "__t": ("ts_ms", 1)})
    changed = F.col("__t").isNull() | ~F.col(sig).eqNullSafe(F.col("__sig"))
    return rows.filter(changed).drop("__sig", "__t", BLOCK)

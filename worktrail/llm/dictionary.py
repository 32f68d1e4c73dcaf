"""A corpus as blocks of word codes, with a dictionary per block that is resolved against all words.

A block is an Arrow batch of documents: the distinct words of the block, and one code per word into that
list.  Counting and looking up words then takes a row per distinct word of a block, not one per
occurrence; the occurrences themselves stay in place as numbers.  No hash stands for a word anywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.store import written

# A key with more than one row in so many is joined by broadcast: there can be no more such keys than that.
HOT_SHARE = 16_384
# Longer words are not broadcast, so that the hot ones take some megabytes at most.
HOT_BYTES = 256


def vocabulary(blocks: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """A row per word (and ``keys``): sums of the ``counts`` lists of all blocks, and ``n_blocks``.

    ``blocks`` has ``words`` (array of string) and per count an array of the same length.  Partial sums are
    taken before the shuffle, so a word of every block is a row per task.
    """
    rows = blocks.select(*keys, F.explode(F.arrays_zip("words", *counts)).alias("x")).select(*keys, F.col("x.words").alias("word"), *[F.col(f"x.{c}").alias(c) for c in counts])
    return rows.groupBy(*keys, "word").agg(*[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("n_blocks"))


def matched(blocks: DataFrame, words: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``block``, ``at`` (the code of a word) and ``v``, its value, for words of ``words`` only.

    ``words`` is a written vocabulary (or part of it) with ``n_blocks``.  A word that more than one in
    ``HOT_SHARE`` (block, word) rows has goes to all tasks, and no more than ``HOT_SHARE`` words can; of the
    others each has a small share of the shuffle.
    """
    rows = blocks.select("block", *keys, F.posexplode("words").alias("at", "word"))
    total = words.agg(F.sum("n_blocks")).first()[0] or 0
    hot = (F.col("n_blocks") * HOT_SHARE > total) & (F.octet_length("word") <= HOT_BYTES)
    table = words.select(*keys, "word", "n_blocks", value.alias("v"))
    on = [*keys, "word"]
    often = F.broadcast(table.where(hot).drop("n_blocks"))
    frequent = rows.join(often, on).select("block", "at", "v")
    others = rows.join(F.broadcast(table.where(hot).select(*on)), on, "left_anti").join(table.where(~hot).drop("n_blocks").hint("merge"), on).select("block", "at", "v")
    return frequent.unionByName(others)


def resolved(blocks: DataFrame, words: DataFrame, keys: list[str], values: dict[str, Column], carry: list[str]) -> DataFrame:
    """``block``, the ``carry`` columns and ``found``: structs of ``at`` and ``values``; a block's list is as long as its dictionary at most."""
    rows = matched(blocks, words, keys, F.struct(*[c.alias(n) for n, c in values.items()]))
    lists = rows.groupBy("block").agg(F.collect_list(F.struct("at", "v.*")).alias("found"))
    return blocks.select("block", *carry).join(lists, "block", "left")


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, all lowest bytes first, then all of the next place: high places are mostly equal and compress away."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    """The numbers of ``planes`` again."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows, written, with ``id``: 0, 1, 2 and so on without gaps.  A row per task is summed up for the offsets."""
    done = written(df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    before, at = [], 0
    for r in done.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        before.append((r._part, at))
        at += r.n
    offsets = done.sparkSession.createDataFrame(before, "_part int, _before long")
    return done.join(F.broadcast(offsets), "_part").withColumn("id", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")

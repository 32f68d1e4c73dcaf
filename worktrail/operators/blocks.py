"""Ordered computations over one key that stay spread over many tasks.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task, which
fails when one key holds a third of the table.  ``in_ranges`` deals the rows out into
many even ranges of ``(key, order)``; the window runs inside a ``(key, range)`` group, and
what must cross a border passes through a summary with one row per ``(key, range)``.
Only that summary is ever ordered per key, so the largest ordered group is the number
of ranges, whatever the number of rows.  Everything is built-in expressions; results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrail.session import cut

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

BLOCK = "__block"
CARRY = "__carry"


def ms(ts: str | Column) -> Column:
    """Epoch milliseconds of a timestamp column."""
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def time_block(ts_ms: str | Column, width_ms: int) -> Column:
    """Number of the span that holds an epoch-millisecond value; numbers grow with time."""
    c = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return F.floor(c / F.lit(width_ms)).cast("long")


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``__block``, the number of the range of ``(keys, order)`` that holds the row.

    Spark measures the ranges on a sample of the sort columns, so neither a hot key nor a burst in one
    millisecond makes a large one, as long as ``order`` ends in an id; rows alike in all of these columns
    stay together.  Numbers grow with the order.  ``ranges`` defaults to the session's shuffle partitions,
    of which small neighbours are joined.  The rows are written once, so a lost executor cannot move a border.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return cut(dealt.withColumn(BLOCK, F.spark_partition_id().cast("long")))


def carry_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, payload: Sequence[str], n: int
) -> DataFrame:
    """For each non-empty block, the last ``n`` rows of the key that lie before it.

    Every non-empty block holds at least one row, so the ``n`` blocks before it are
    enough; each gives at most ``n`` rows.
    """
    row = F.struct(*order, *[c for c in payload if c not in order])
    if n == 1:
        tails = df.groupBy(*keys, block).agg(F.array(F.max(row)).alias("__tail"))
    else:
        last = Window.partitionBy(*keys, block).orderBy(*[F.col(c).desc() for c in order])
        tails = (
            df.select(*keys, block, row.alias("__row"), *[F.col(c) for c in order])
            .withColumn("__rn", F.row_number().over(last))
            .filter(F.col("__rn") <= n)
            .groupBy(*keys, block)
            .agg(F.collect_list("__row").alias("__tail"))
        )
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(-n, -1)
    merged = F.array_sort(F.flatten(F.collect_list("__tail").over(before)))
    return (
        tails.withColumn("__rows", merged)
        .withColumn("__rows", F.slice(F.col("__rows"), F.greatest(F.size("__rows") - n + 1, F.lit(1)), n))
        .select(*keys, block, F.explode("__rows").alias("__row"))
        .select(*keys, block, "__row.*")
    )


def with_carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, payload: Sequence[str], n: int
) -> DataFrame:
    """Rows of ``df`` plus, in each block, the ``n`` rows before it marked ``__carry``.

    A rows-frame of up to ``n`` preceding rows over ``(keys, block)`` is then exact for
    the unmarked rows; drop the marked ones afterwards.
    """
    carried = carry_rows(df, keys, order, block, payload, n).withColumn(CARRY, F.lit(True))
    return df.withColumn(CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)


def lag_in_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, lags: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """``lag`` columns ``{name: (column, offset)}`` over the whole key, one block at a time."""
    n = max(offset for _, offset in lags.values())
    payload = sorted({column for column, _ in lags.values()})
    w = Window.partitionBy(*keys, block).orderBy(*order)
    out = with_carry(df, keys, order, block, payload, n)
    out = out.withColumns({name: F.lag(column, offset).over(w) for name, (column, offset) in lags.items()})
    return out.filter(~F.col(CARRY)).drop(CARRY)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, aggs: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` over the whole key, up to and with the current row.

    ``aggs`` is ``{name: (kind, expression)}``.  The value inside the block comes from a
    window over ``(keys, block)``; the value before the block from the running total of
    the per-block summary.  The join reuses the window's partitioning.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    names = list(aggs)
    staged = df.withColumns({f"__in_{n}": expr for n, (_, expr) in aggs.items()})
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy(*keys, block).agg(*[fold[k](f"__in_{n}").alias(f"__tot_{n}") for n, (k, _) in aggs.items()])
    prefix = totals.select(
        *keys, block, *[fold[k](f"__tot_{n}").over(before).alias(f"__pre_{n}") for n, (k, _) in aggs.items()]
    )
    local = staged.withColumns({f"__loc_{n}": fold[k](f"__in_{n}").over(inside) for n, (k, _) in aggs.items()})

    def combine(name: str, kind: str) -> Column:
        here, pre = F.col(f"__loc_{name}"), F.col(f"__pre_{name}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(pre, F.lit(0))
        return F.greatest(here, pre) if kind == "max" else F.least(here, pre)

    joined = local.join(prefix, [*keys, block])
    out = joined.withColumns({n: combine(n, k) for n, (k, _) in aggs.items()})
    return out.drop(*[f"__{p}_{n}" for n in names for p in ("in", "loc", "pre")])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key with their rank.

    Spark prunes ``row_number() <= n`` before the shuffle only up to its group-limit
    threshold (1000), so a larger ``n`` ranks inside salted sub-groups first.
    """
    if n > 1000:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
        part = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", salt)
            .withColumn("__pre", F.row_number().over(part))
            .filter(F.col("__pre") <= n)
            .drop("__salt", "__pre")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)

"""Stream forms of the ordered folds.

Rows wait in a pending table until the watermark (latest event time seen, less the allowed
delay) has passed them, and are then folded in event-time order by the batch form, after one
seed row per key that carries the key's state.  So a stream gives what one batch run over the
same rows gives, a hot key is spread like in a batch, and rows that come after the watermark
passed them go to a side table.  All state is in folders numbered by micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from worktrail.operators.folds import Step, ordered_fold
from worktrail.operators.sequential import BATCH_SIZE, BATCH_TIMEOUT_MS, DUPLICATE_DISTANCE, batch_step, dedup_step
from worktrail.streaming.snapshots import empty, last_version, read_version, write_version

MARK = T.StructType([T.StructField("mark", T.LongType())])


@dataclass
class StreamFold:
    """The fold of a stream with ``key``, ``ts_ms``, ``id`` and the input columns.

    ``seeds(folded, old)`` gives the seed rows for the next micro-batch: rows in the schema of the
    stream plus ``seed`` that lead the step to the key's state.  Results are appended to
    ``path/out``; late rows and rows without a time go to ``path/late``.
    """

    stream: DataFrame
    path: str
    key: str
    inputs: Sequence[str]
    outputs: Sequence[T.StructField]
    step: Step
    seeds: Callable[[DataFrame, DataFrame], DataFrame]
    delay_ms: int

    def start(self, flush: bool = False) -> StreamingQuery:
        """Start the stream; with ``flush`` it ends after the available input (``drain`` then folds what still waits)."""
        writer = self.stream.writeStream.foreachBatch(self._advance).option("checkpointLocation", f"{self.path}/offsets")
        return writer.trigger(availableNow=True).start() if flush else writer.start()

    def drain(self) -> None:
        """Fold the rows that wait for a watermark when no more input will come.

        It is written as the batch after the last; a stream that goes on after all takes that number
        again, overwrites it, and folds the same rows in their turn.
        """
        spark = self.stream.sparkSession
        self._advance(empty(spark, self.stream.schema), last_version(spark, self.path, "mark") + 1, drain=True)

    def _advance(self, rows: DataFrame, batch: int, drain: bool = False) -> None:
        spark, schema, path = rows.sparkSession, self.stream.schema, self.path
        seeded = T.StructType([*schema.fields, T.StructField("seed", T.BooleanType())])
        old_mark = read_version(spark, path, "mark", batch - 1, MARK).agg(F.max("mark").alias("m")).first()["m"]
        late = F.col("ts_ms").isNull() | (F.lit(False) if old_mark is None else F.col("ts_ms") <= F.lit(old_mark))
        write_version(rows.filter(late), path, "late", batch)
        top = rows.agg(F.max("ts_ms").alias("m")).first()["m"]
        mark = max((m for m in (old_mark, None if top is None else top - self.delay_ms) if m is not None), default=None)
        pool = read_version(spark, path, "pending", batch - 1, schema).unionByName(rows.filter(~late))
        passed = F.lit(True) if drain else F.lit(False) if mark is None else F.col("ts_ms") <= F.lit(mark)
        old = read_version(spark, path, "seeds", batch - 1, seeded)
        folded = ordered_fold(
            old.unionByName(pool.filter(passed).withColumn("seed", F.lit(False))), [self.key], ["ts_ms", "id"], [*self.inputs, "seed"], self.outputs, self.step
        )
        write_version(folded, path, "folded", batch)
        folded = spark.read.parquet(f"{path}/folded/v={batch}")
        write_version(folded.filter(~F.col("seed")).drop("seed"), path, "out", batch)
        write_version(self.seeds(folded, old).select(*seeded.names), path, "seeds", batch)
        write_version(pool.filter(~passed), path, "pending", batch)
        write_version(spark.createDataFrame([(mark,)], MARK), path, "mark", batch)


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """Last row per key in fold order."""
    names = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("ts_ms", "id")).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in names])


def _passes(step: Step, columns: Sequence[str]) -> Step:
    """The step, for runs in which seed rows set the state through ``columns``."""

    def seeded(cols, state):
        return step({c: cols[c] for c in columns}, state)

    return seeded


def dedup_fold(stream: DataFrame, path: str, key: str, fp: str, threshold: int = DUPLICATE_DISTANCE, delay_ms: int = 0) -> StreamFold:
    """Near-duplicate removal per source as a stream: ``out`` has every row with ``kept``.

    The seed of a key is its last kept row: from an empty state the step keeps it, which is its state.
    """
    rows = stream.withColumnRenamed(fp, "fp")
    kept = T.StructField("kept", T.BooleanType())
    seeds = lambda folded, old: _latest(folded.filter("kept"), key).withColumn("seed", F.lit(True)).drop("kept")
    return StreamFold(rows, path, key, ["fp"], [kept], _passes(dedup_step(threshold), ["fp"]), seeds, delay_ms)


def dedup_stream(stream: DataFrame, path: str, key: str, fp: str, threshold: int = DUPLICATE_DISTANCE, delay_ms: int = 0, flush: bool = False) -> StreamingQuery:
    """``dedup_fold``, started."""
    return dedup_fold(stream, path, key, fp, threshold, delay_ms).start(flush)


def batch_fold(stream: DataFrame, path: str, key: str, size: int = BATCH_SIZE, timeout_ms: int = BATCH_TIMEOUT_MS, delay_ms: int = 0) -> StreamFold:
    """Count-or-timeout batching per source as a stream: ``out`` has every row with ``first_id``.

    The seeds of a key are the rows of its open batch: fewer than ``size``.
    """
    field = T.StructField("first_id", T.LongType())

    def seeds(folded: DataFrame, old: DataFrame) -> DataFrame:
        last = _latest(folded.select(key, "ts_ms", "id", "first_id"), key).select(key, "first_id")
        tail = folded.join(last, [key, "first_id"])
        n = F.count("*").over(Window.partitionBy(key))  # at most ``size`` rows per key
        return tail.withColumn("__n", n).filter(F.col("__n") < size).withColumn("seed", F.lit(True)).drop("__n", "first_id")

    step = _passes(batch_step(size, timeout_ms), ["ts_ms", "id"])
    return StreamFold(stream, path, key, ["ts_ms", "id"], [field], step, seeds, delay_ms)


def batch_stream(stream: DataFrame, path: str, key: str, size: int = BATCH_SIZE, timeout_ms: int = BATCH_TIMEOUT_MS, delay_ms: int = 0, flush: bool = False) -> StreamingQuery:
    """``batch_fold``, started."""
    return batch_fold(stream, path, key, size, timeout_ms, delay_ms).start(flush)

"""Tables and files that outlive a stage, in the folder all executors share, and settings of Python tasks."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from worktrail.session import ensure_checkpoint_dir

# Rows and bytes of one Arrow batch: what a Python task holds at a time, whatever the text lengths.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (a temporary one only in local mode without that setting)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back: lineage ends here.

    A lost executor costs the tasks that were running, not what has been committed.  The shuffle
    files of the write are given up when it ends, so that stages do not add up on disk.
    """
    path = shared_folder(df.sparkSession, name)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    done.written_path = path
    return done


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, when nothing that is still to run reads them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded rows and bytes; a worker that goes on to other tasks starts them small."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    user = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held()
        if held.get("user") != user:
            held.clear()
            held["user"] = user
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most so many bytes in a text column, or of one row: what working on a batch takes is bounded too."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right"))
            end = max(at + 1, end)
            yield batch.slice(at, end - at)
            at = end


def _held() -> dict[str, Any]:
    """What this Python worker keeps between tasks; functions are shipped by value, so it is no variable of this module."""
    return sys.modules.setdefault("_worktrail_llm_held", types.ModuleType("_worktrail_llm_held")).__dict__.setdefault("things", {})


def once(key: str, make: Callable[[], Any]) -> Any:
    """``make()``, kept in this Python worker for as long as its tasks are those of one ``in_arrow``."""
    held = _held()
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Hand memory that a task no longer uses back to the system: idle workers count towards an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)

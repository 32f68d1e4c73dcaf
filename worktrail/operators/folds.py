"""Ordered folds: the decision on a row depends on the last row that was *kept*.

No window function can express that, so rows are range-partitioned by ``(key, order)``
and folded in sorted order.  A key may span many partitions: Spark's range partitioner
splits a hot key by its order columns, so no task ever gets all of one key.

What must cross a partition border is the fold's state.  Each partition first folds
from an empty state and reports where it ends (one small row per partition, so the
driver holds as many rows as there are partitions).  Partitions that continue a key
are then folded again from the end states their predecessor can have, until the chain
from the first partition is known.  Folds forget their start quickly, so this settles
after one or two short passes, and it is exact whenever it stops.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from worktrail.session import ensure_checkpoint_dir

State = Any
# step(columns of one run of rows of a key, state) -> (output columns, new state)
Step = Callable[[dict[str, list], State], tuple[dict[str, list], State]]

_SUMMARY = "pid int, first_key binary, last_key binary, one_key boolean, seed binary, end_state binary"


def _runs(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """Consecutive spans of equal key in one sorted batch."""
    n = len(pdf)
    if n == 0:
        return
    change = np.zeros(n, dtype=bool)
    change[0] = True
    values = [pdf[k].to_numpy() for k in keys]
    for v in values:
        change[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    for a, b in zip(starts.tolist(), ends.tolist()):
        yield tuple(v[a].item() if hasattr(v[a], "item") else v[a] for v in values), a, b


def _summaries(keys: Sequence[str], inputs: Sequence[str], step: Step, seeds: dict[int, list[bytes]] | None):
    """Partition summaries, from an empty state or from the given states."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        starts = [pickle.dumps(None)] if seeds is None else seeds.get(pid, [])
        if not starts:
            return
        states = [pickle.loads(s) for s in starts]
        first = last = None
        one_key = True
        for pdf in batches:
            columns = {c: pdf[c].tolist() for c in inputs}
            for key, a, b in _runs(pdf, keys):
                if first is None:
                    first = last = key
                elif key != last:
                    last, one_key, states = key, False, [None] * len(states)
                run = {c: v[a:b] for c, v in columns.items()}
                states = [step(run, s)[1] for s in states]
        if first is None:
            return
        yield pd.DataFrame(
            {
                "pid": pid,
                "first_key": pickle.dumps(first),
                "last_key": pickle.dumps(last),
                "one_key": one_key,
                "seed": starts,
                "end_state": [pickle.dumps(s) for s in states],
            }
        )

    return fold


def _incoming_states(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], step: Step) -> dict[int, bytes]:
    """State each partition must start from: one entry per partition that continues a key."""
    first_pass = rows.mapInPandas(_summaries(keys, inputs, step, None), _SUMMARY).collect()
    parts = sorted(first_pass, key=lambda r: r["pid"])
    ends = {r["pid"]: {bytes(r["seed"]): bytes(r["end_state"])} for r in parts}
    empty = pickle.dumps(None)
    while True:
        incoming: dict[int, bytes] = {}
        wanted: dict[int, list[bytes]] = {}
        resolved = True
        for prev, cur in zip(parts, parts[1:]):
            if prev["last_key"] != cur["first_key"]:
                resolved = True
                continue
            if resolved:
                start = incoming.get(prev["pid"], empty) if prev["one_key"] else empty
                known = ends[prev["pid"]].get(start)
                resolved = known is not None
                if resolved:
                    incoming[cur["pid"]] = known
            if not cur["one_key"]:
                resolved = True
                continue
            missing = set(ends[prev["pid"]].values()) - set(ends[cur["pid"]])
            if missing:
                wanted[cur["pid"]] = sorted(missing)
        unresolved = any(
            prev["last_key"] == cur["first_key"] and cur["pid"] not in incoming for prev, cur in zip(parts, parts[1:])
        )
        if not unresolved:
            return incoming
        for r in rows.mapInPandas(_summaries(keys, inputs, step, wanted), _SUMMARY).collect():
            ends[r["pid"]][bytes(r["seed"])] = bytes(r["end_state"])


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    outputs: Sequence[T.StructField],
    step: Step,
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with the fold's output columns, rows in fold order within each partition.

    The order columns must be unique inside a key.  The sorted rows are checkpointed, so a
    lost executor cannot move a partition border between the passes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    by = [*keys, *order]
    spread = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    rows = spread.sortWithinPartitions(*by).checkpoint()
    incoming = _incoming_states(rows.select(*keys, *[c for c in inputs if c not in keys]), keys, inputs, step)
    names = [f.name for f in outputs]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blob = incoming.get(TaskContext.get().partitionId())
        state = pickle.loads(blob) if blob is not None else None
        last = None
        for pdf in batches:
            columns = {c: pdf[c].tolist() for c in inputs}
            parts: dict[str, list] = {n: [] for n in names}
            for key, a, b in _runs(pdf, keys):
                if last is not None and key != last:
                    state = None
                last = key
                out, state = step({c: v[a:b] for c, v in columns.items()}, state)
                for n in names:
                    parts[n].extend(out[n])
            yield pdf.assign(**parts)

    return rows.mapInPandas(apply, T.StructType([*df.schema.fields, *outputs]))

"""Exact substring dedup by seed and extend.

Seeds: of the hashes of ``seed`` consecutive words, winnowing selects the least in each window, so two equal
windows have the same seed at the same place (an anchor).  Documents meet on anchors that occur more than
once in the corpus.  Extend: from each such anchor on both sides, the windows that contain it are formed, and
each window's first document is found.  Windows that start earlier elsewhere cover words; stretches of covered
words are the maximal repeats, and go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.store import in_arrow, written
from worktrail.llm.words import Words, runs, words

WINDOW = 20
SEED = 8
_SIGNED = np.int64


def anchored(w: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, their hashes, the places of their anchors, and the anchors' hashes."""
    if len(w.hash) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    seeds, _ = runs(w, seed)
    whole, inside = runs(w, window)
    start = np.flatnonzero(inside)
    least = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)[start].argmin(axis=1)
    return start, whole[start].view(_SIGNED), start + least, seeds[start + least].view(_SIGNED)


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values (in the order of ``doc``) as a list per text."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _distinct(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, value) once, by text, and how often it occurs."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(first)
    return doc[at], values[at], np.diff(np.append(at, len(doc)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column (null as empty) as values and the row of each."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), n), column.flatten().to_numpy(zero_copy_only=False)


def _among(doc: np.ndarray, values: np.ndarray, in_doc: np.ndarray, in_values: np.ndarray) -> np.ndarray:
    """Whether (text, value) is one of the others."""
    both_doc, both = np.append(doc, in_doc), np.append(values, in_values)
    _, code = np.unique(both, return_inverse=True)
    key = both_doc * (int(code.max(initial=0)) + 1) + code
    return np.isin(key[: len(doc)], key[len(doc) :])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Texts without the words of windows that start earlier in the corpus.

    Returns ``id_col``, ``n_words``, ``n_removed``, ``kept`` (the other words, joined by one space) and ``repeats``
    (start and end word of each maximal repeat that was removed).  Words are ``[^\\x20\\x09-\\x0D]+``; a window is
    ``window`` consecutive words of one document; earlier means a smaller id, or an earlier start in the same
    document.  A null text has no words; a null id comes before all others; rows with one id do not remove
    words from one another; an empty table gives no rows; other columns are not carried.

    Every anchor is an (anchor, id) row, about one in five words; windows are formed only around anchors that
    occur twice; texts are joined twice, by id, to lists that are at most as long as the text.
    """
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("id"), F.col(text_col).alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column(1))
            _, _, place, anchor = anchored(w, window, seed)
            place, first = np.unique(place, return_index=True)
            doc, anchor, n = _distinct(w.doc()[place], anchor[first])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(anchor), pa.array(n.astype(np.int32))], ["id", "anchor", "n"])

    anchors = written(in_arrow(rows, seeds, "id bigint, anchor bigint, n int"), "anchors")
    twice = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    listed = anchors.select("id", "anchor").join(twice, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    listed = written(listed, "seeds")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column(1))
            start, whole, _, anchor = anchored(w, window, seed)
            doc = w.doc()[start] if len(start) else start
            chosen = _among(doc, anchor, *_flat(batch.column(2)))
            doc, whole, _ = _distinct(doc[chosen], whole[chosen])
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int64()), batch.column(0).take(pa.array(doc))], ["window", "id"])

    around = in_arrow(rows.join(listed, "id").select("id", "text", "anchors"), extend, "window bigint, id bigint")
    firsts = written(around.groupBy("window").agg(F.min("id").alias("id")), "firsts")
    own = firsts.groupBy("id").agg(F.collect_list("window").alias("firsts"))
    lists = listed.join(own, "id", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = words(batch.column(1)), len(batch)
            start, whole, _, anchor = anchored(w, window, seed)
            doc = w.doc()[start] if len(start) else start
            chosen = _among(doc, anchor, *_flat(batch.column(2)))
            start, whole, doc = start[chosen], whole[chosen], doc[chosen]
            first = _among(doc, whole, *_flat(batch.column(3)))  # the corpus has it in no earlier document
            order = np.lexsort((start, whole, doc))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (whole[order][1:] == whole[order][:-1])
            gone = start[~first | again]
            step = np.zeros(len(w.hash) + 1, np.int32)
            np.add.at(step, gone, 1)
            np.add.at(step, gone + window, -1)
            covered = np.cumsum(step[:-1]) > 0
            edge = np.zeros(len(covered) + 1, bool)
            edge[w.first] = True
            begin = np.flatnonzero(covered & (edge[:-1] | ~np.append(False, covered[:-1])))
            end = np.flatnonzero(covered & (edge[1:] | ~np.append(covered[1:], False))) + 1
            at = np.searchsorted(w.first, begin, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array((begin - w.first[at]).astype(np.int32)), pa.array((end - w.first[at]).astype(np.int32))], ["start", "end"])
            removed = np.bincount(w.doc()[covered], minlength=n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), _joined(w, ~covered), pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32)), spans)],
                ["id", "n_words", "n_removed", "kept", "repeats"],
            )

    joined = rows.join(lists, "id", "left").select("id", "text", "anchors", "firsts")
    done = in_arrow(joined, remove, "id bigint, n_words bigint, n_removed bigint, kept string, repeats array<struct<start:int,end:int>>")
    return done.select(F.when(F.col("id") != low, F.col("id")).alias(id_col), "n_words", "n_removed", "kept", "repeats")


def _joined(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, end = w.start[kept], w.end[kept]
    n = len(w.first) - 1
    count = np.bincount(w.doc()[kept], minlength=n) if n else np.zeros(0, np.int64)
    size = end - start + 1  # with a space after each word
    place = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    length = end - start
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(place, length) + inner] = w.data[np.repeat(start, length) + inner]
    data = out.tobytes()
    border = np.append(place, len(out))[np.concatenate([[0], np.cumsum(count)])].tolist()
    return pa.array([data[a : max(a, b - 1)].decode() for a, b in zip(border[:-1], border[1:], strict=True)], pa.string())


def op7_seed_extend(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without repeats of 20 words."""
    done = remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats"))

"""Benchmark decontamination with a positional inverted index of the training tokens.

The documents of an Arrow batch form a segment of the index, written as one row: the documents with
their places in the segment's token stream, and for each benchmark term its posting list, the ascending
places where it stands.  Corpus-wide term counts are added up from the lists.  Each benchmark window is
then looked up in each segment from its rarest term on: the lists of its terms, shifted by the terms'
places in the window, are intersected in the order of their counts; what is left are exact phrase matches.
Windows all of whose terms lie near a place of the rarest one are proximity matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.store import in_arrow, written
from worktrail.llm.words import ALNUM, runs, words

WINDOW = 10
SLOP = 5
# Benchmark words that are held in a task at a time; a larger benchmark is looked up in blocks of items.
BLOCK_WORDS = 500_000


def benchmark_windows(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Item of each distinct window, its length, and term hashes of each window."""
    w = words(texts, ALNUM, lower=True)
    item, terms = [], []
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        seen = set()
        for at in range(a, max(b - window, a) + 1):
            some = w.hash[at : min(at + window, b)]
            if len(some) and some.tobytes() not in seen:
                seen.add(some.tobytes())
                item.append(i)
                terms.append(some)
    return np.array(item, np.int64), np.array([len(t) for t in terms], np.int64), terms


def build_index(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str, key_col: Column) -> DataFrame:
    """A row per segment: ``ids``, ``keys`` (of the rows), ``first`` (place of each document's first token; one more at the end), and
    ``terms``, ``list_end`` and ``places`` (the posting lists in a row) for the terms in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column(1), ALNUM, lower=True)  # a segment
            at = np.minimum(np.searchsorted(vocabulary, w.hash), max(len(vocabulary) - 1, 0))
            place = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
            term = at[place]
            order = np.argsort(term, kind="stable")
            held, count = np.unique(term, return_counts=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (w.first.astype(np.int32), vocabulary[held].astype(np.int64), np.cumsum(count).astype(np.int32), place[order].astype(np.int32))]
            ids, keys = (pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(c)) for c in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, keys, *lists], ["ids", "keys", "first", "terms", "list_end", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key_col)
    return in_arrow(rows, run, f"ids array<{kind}>, keys array<bigint>, first array<int>, terms array<bigint>, list_end array<int>, places array<int>")


class Lookup:
    """The windows of a benchmark block, each with its terms from the rarest on, by rarest term."""

    def __init__(self, item: np.ndarray, terms: list[np.ndarray], rarity: dict[int, int], slop: int) -> None:
        self.item, self.slop = item, slop
        self.length = np.array([len(t) for t in terms], np.int64)
        self.by_rarest: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
        for k, t in enumerate(terms):
            shifted = sorted(((int(h), o) for o, h in enumerate(t)), key=lambda x: (rarity.get(x[0], 0), x))
            if rarity.get(shifted[0][0], 0):  # else no document has the term
                self.by_rarest.setdefault(shifted[0][0], []).append((k, shifted))

    def search(self, lists: dict[int, np.ndarray], first: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
        """Exact matches (window, start places) and proximity matches (window, places of the rarest term) in a segment."""
        exact, near = [], []
        for rarest in lists.keys() & self.by_rarest.keys():
            for k, shifted in self.by_rarest[rarest]:
                if any(h not in lists for h, _ in shifted):
                    continue
                anchor, n = lists[rarest], int(self.length[k])
                doc = np.searchsorted(first, anchor, side="right") - 1
                low, high = first[doc], first[doc + 1]
                start = anchor - shifted[0][1]
                start = start[(start >= low) & (start + n <= high)]
                for h, o in shifted[1:]:
                    if not len(start):
                        break
                    start = start[_member(start + o, lists[h])]
                if len(start):
                    exact.append((k, start))
                reach = n + self.slop
                inside = np.ones(len(anchor), bool)
                for h in {h for h, _ in shifted[1:]}:
                    at = np.searchsorted(lists[h], np.maximum(anchor - reach, low))
                    inside &= lists[h][np.minimum(at, len(lists[h]) - 1)] <= np.minimum(anchor + reach, high - 1)
                    inside &= at < len(lists[h])
                if inside.any():
                    near.append((k, anchor[inside]))
        return exact, near


def _member(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ascending, x)
    return ascending[np.minimum(at, len(ascending) - 1)] == x


def _block_count(benchmark: DataFrame, text_col: str, block_words: int) -> int:
    """Blocks of about ``block_words`` words each; a word is taken to have four bytes."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)) / 4).first()[0]
    return max(1, int(-(-total // block_words)))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[pa.Table]:
    """The items, dealt into ``n`` blocks."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).toArrow()
        if len(part):
            yield part.combine_chunks()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Benchmark matches of each whole document.

    Returns a row per document: ``id_col``, ``n_words``, ``spans`` (start and end word of stretches that
    windows cover, disjoint and in order), ``items`` (item ids as strings, sorted, with an exact match) and
    ``near_items`` (with a proximity match: all terms of a window within its length plus ``slop`` words of
    its rarest term).  A window is ``window`` consecutive item words, or all words of a shorter item.  Null and
    empty texts have no words and match nothing, items without words match nothing, items with a null id
    are matched under the id ``null``; repeated rows and items count each; an empty benchmark leaves all
    documents clean; other columns are not carried.
    """
    benchmark = benchmark.withColumn(item_col, F.coalesce(F.col(item_col).cast("string"), F.lit("null")))
    found, key = [], F.lit(0).cast("long")
    n_blocks = _block_count(benchmark, item_text_col, block_words)
    if n_blocks > 1:  # rows must be known again in the index of another block
        docs = written(docs.select(id_col, text_col, F.monotonically_increasing_id().alias("_key")), "keyed")
        key = F.col("_key")
    for block in _blocks(benchmark, item_col, item_text_col, n_blocks):
        item, _, terms = benchmark_windows(block.column("text").chunk(0) if block.num_rows else pa.array([], pa.string()), window)
        names = block.column("item").to_pylist()
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
        index = written(build_index(docs, vocabulary, id_col, text_col, key.alias("key")), "postings")
        sizes = F.transform(F.sequence(F.lit(1), F.size("terms")), lambda i: F.element_at("list_end", i) - F.when(i > 1, F.try_element_at("list_end", F.greatest(i - 1, F.lit(1)))).otherwise(0))
        counted = index.where(F.size("terms") > 0).select(F.explode(F.arrays_zip(F.col("terms").alias("t"), sizes.alias("n"))).alias("x"))
        # One row per term of the block: bounded by block_words.
        rarity = {r[0] & 0xFFFFFFFFFFFFFFFF: r[1] for r in counted.groupBy("x.t").agg(F.sum("x.n")).collect()}
        found.append(_search(index, Lookup(item, terms, rarity, slop), names, id_col, docs))
    if not found:
        empty = F.expr("cast(array() as array<string>)")
        rows = in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _count_words, f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint")
        return rows.select(F.col("id").alias(id_col), "n_words", F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"), empty.alias("items"), empty.alias("near_items"))
    if len(found) == 1:
        return found[0].drop("key")
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    merged = union.groupBy("key").agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")])
    joined = F.aggregate("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))
    return merged.select(id_col, "n_words", joined.alias("spans"), "items", "near_items")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words(batch.column(1), ALNUM, lower=True).first), pa.int64())], ["id", "n_words"])


def _search(index: DataFrame, lookup: Lookup, names: list[str], id_col: str, docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                ids, keys, first, terms, ends, places = (batch.column(c)[r].values for c in range(6))
                first, terms, ends, places = (x.to_numpy(zero_copy_only=False) for x in (first, terms, ends, places))
                lists = dict(zip(terms.astype(np.uint64).tolist(), np.split(places, ends[:-1]), strict=True)) if len(terms) else {}
                exact, near = lookup.search(lists, first)
                n = len(first) - 1
                step = np.zeros(int(first[-1]) + 1, np.int32)
                items: dict[int, set[str]] = {}
                close: dict[int, set[str]] = {}
                for pairs, into in ((exact, items), (near, close)):
                    for k, at in pairs:
                        for d in np.unique(np.searchsorted(first, at, side="right") - 1).tolist():
                            into.setdefault(d, set()).add(names[lookup.item[k]])
                for k, at in exact:
                    np.add.at(step, at, 1)
                    np.add.at(step, at + int(lookup.length[k]), -1)
                hit = np.cumsum(step[:-1]) > 0
                # Stretches of hit words, cut at the borders of documents.
                edge = np.zeros(len(hit) + 1, bool)
                edge[first] = True
                begin = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
                end = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1
                doc = np.searchsorted(first, begin, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array((begin - first[doc]).astype(np.int32)), pa.array((end - first[doc]).astype(np.int32))], ["start", "end"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), spans)
                names_of = lambda of: pa.array([sorted(of.get(d, ())) for d in range(n)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array(np.diff(first), pa.int64()), listed, names_of(items), names_of(close)], ["key", "id", "n_words", "spans", "items", "near_items"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_arrow(index, run, f"key bigint, id {kind}, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>, near_items array<string>").withColumnRenamed("id", id_col)


def op6_positional_index(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of all benchmark items in all documents."""
    done = contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return done.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )

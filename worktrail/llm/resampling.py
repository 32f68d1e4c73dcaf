"""Importance resampling towards a target distribution, on hashed word n-grams.

Words come from an untrained regex Split of the tokenizers library over the ASCII-lowered text, with their
byte offsets.  A feature is the window from the start of one word to the end of that word or of one of the
next two; its bucket is the CRC-32 of those bytes with one space between words.  Two histograms of buckets, of
the raw documents and of the target texts, give each bucket a gain; a document's weight is the sum of the gains
of its features; Gumbel noise from a seeded hash of its id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.store import in_arrow, once, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PER_CENT = 5
SEED = 42
# Bytes of a text that are split at a time; a stretch ends between two words.
STRETCH = 1 << 20
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


class Shift:
    """What CRC-32 values become when more bytes follow, as tables per power of two of the number of bytes.

    The checksum of two strings in a row is that of the first, moved past the length of the second, xor that of
    the second; moving is linear in the 32 bits, so it is four look-ups for each power of two in the length.
    """

    def __init__(self, powers: int = 32) -> None:
        columns = [1 << (b - 8) if b >= 8 else self._byte(1 << b) for b in range(32)]  # each bit moved past one byte
        self.tables = []
        for _ in range(powers):
            self.tables.append(self._table(columns))
            columns = self._apply(self.tables[-1], np.array(columns, np.uint32)).tolist()

    @staticmethod
    def _byte(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (POLYNOMIAL if c & 1 else 0)
        return c

    @staticmethod
    def _table(columns: list[int]) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        values = np.arange(256)
        for b, column in enumerate(columns):
            out[b // 8] ^= np.where(values >> (b % 8) & 1, np.uint32(column), np.uint32(0))
        return out

    @staticmethod
    def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]

    def past(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each value moved past so many bytes."""
        out = crc.copy()
        for k in range(int(length.max(initial=0)).bit_length()):
            some = np.flatnonzero(length >> k & 1)
            out[some] = self._apply(self.tables[k], out[some])
        return out


def _stretches(text: str) -> Iterator[str]:
    """The ASCII-lowered text in stretches of about ``STRETCH`` bytes that cut no word."""
    data = text.encode().lower()  # bytes: only A-Z change
    at = 0
    while at < len(data):
        found = _BETWEEN.search(data, at + STRETCH)
        to = found.start() if found else len(data)
        yield data[at:to].decode()
        at = to


class Splitter:
    """Words and byte lengths of whole texts."""

    def __init__(self) -> None:
        from tokenizers import PreTokenizedString, Regex, pre_tokenizers

        self.held = PreTokenizedString
        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)

    def words(self, text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
        """All words of a text with their byte offsets (in their stretch)."""
        found, offsets = [], []
        for stretch in _stretches(text or ""):
            held = self.held(stretch)
            self.split.pre_tokenize(held)
            for word, at, _ in held.get_splits(offset_referential="original", offset_type="byte"):
                found.append(word)
                offsets.append(at)
        return found, offsets


def features(texts: list[str | None], splitter: Splitter, shift: Shift, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, features per text, and the buckets of all features in the order of the texts."""
    found, offsets, n_words = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        some, at = splitter.words(text)
        found += some
        offsets += at
        n_words[i] = len(some)
    place = np.array(offsets, np.int64).reshape(-1, 2)
    length = place[:, 1] - place[:, 0]
    coded = pa.array(found, pa.large_string()).dictionary_encode()
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    alone, led = (np.array([zlib.crc32(p + w) for w in distinct], np.uint32)[code] if distinct else np.zeros(0, np.uint32) for p in (b"", b" "))
    border = np.concatenate([[0], np.cumsum(n_words)])
    doc = np.repeat(np.arange(len(texts)), n_words)
    left = np.repeat(border[1:], n_words) - np.arange(len(doc))  # words of the text from this one on
    docs, values, crc = [doc], [alone], alone
    for k in range(1, longest):
        if len(crc) < 2:
            break
        crc = shift.past(crc[:-1], length[k:] + 1) ^ led[k:]
        whole = left[: len(crc)] > k
        docs.append(doc[: len(crc)][whole])
        values.append(crc[whole])
    owner = np.concatenate(docs)
    order = np.argsort(owner, kind="stable")
    return n_words, np.bincount(owner, minlength=len(texts)).astype(np.int64), (np.concatenate(values)[order] % np.uint32(buckets)).astype(np.uint32)


def bucketed(docs: DataFrame, id_col: str, text_col: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``buckets`` (of all features, as bytes of 16 or 32 bits each) of each text."""
    wide = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, shift = once("splitter", Splitter), once("shift", Shift)
        for batch in batches:
            n_words, n, values = features(batch.column(1).to_pylist(), splitter, shift, longest, buckets)
            border = np.concatenate([[0], np.cumsum(n)]) * wide.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(border.astype(np.int64)), pa.py_buffer(values.astype(wide))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), packed.cast(pa.binary())], ["id", "n_words", "n_features", "buckets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_words bigint, n_features bigint, buckets binary")


def _values(column: pa.Array, wide: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a batch in a row, and how many each text has."""
    n = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // wide.itemsize
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), wide), n


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n`` over all features of all rows of ``bucketed``; a task sends a row per bucket at most."""
    wide = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0), wide)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return in_arrow(rows.select("buckets"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """``floor(1000 * ln((t + 1) (S + B) / ((s + 1) (T + B))))`` of each bucket, in doubles; one row per bucket reaches the driver."""
    spark = raw.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    n = lambda h, c: h.select("bucket", F.col("n").alias(c))
    both = every.join(n(raw, "s"), "bucket", "left").join(n(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    plus = lambda c: F.col(c).cast("double") + F.lit(1.0)
    gain = F.floor(1000 * F.log(plus("t") * F.lit(float(all_s + buckets)) / (plus("s") * F.lit(float(all_t + buckets)))))
    out = np.zeros(buckets, np.int64)
    for row in both.select("bucket", gain.alias("gain")).collect():  # sums: one row
        out[row.bucket] = row.gain
    return out


def weights(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight``, the sum of the gains of all features."""
    wide = np.dtype("<u2" if len(gains) <= 1 << 16 else "<u4")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _values(batch.column(3), wide)
            total = np.concatenate([[0], np.cumsum(gains[values])])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total[ends] - total[ends - n])], ["id", "n_words", "n_features", "weight"])

    return in_arrow(rows.select("id", "n_words", "n_features", "buckets"), run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def _ranked(scored: DataFrame, per_cent: int) -> DataFrame:
    """With ``rank`` for the drawn rows: ranges of the score are numbered in parallel and moved past the ranges before.

    Rows not eligible come last.  A row per range (task) is summed up for the offsets.
    """
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("id").asc_nulls_first()]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = written(ranged, "ranked")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("eligible").cast("long")).alias("fit")).orderBy("part").collect()
    before, at = {}, 0
    for r in sizes:
        before[r.part], at = at, at + r.n
    drawn = sum(r.fit for r in sizes) * per_cent // 100
    offsets = ranged.sparkSession.createDataFrame([(p, n) for p, n in before.items()], "part int, before long")
    rank = F.col("row") + F.col("before") + 1
    return ranged.join(F.broadcast(offsets), "part", "left").withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "row", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Draw ``per_cent`` of the documents of ``least_words`` words or more, by importance towards the target texts.

    Returns ``id_col``, ``n_words``, ``n_features``, ``weight``, ``score`` (weight plus floored Gumbel noise times
    1000) and ``rank`` (from 1 by falling score, then rising id; null for documents that are not drawn).
    A null or empty text has no words and no features, weight 0, and is never drawn; a null id is hashed as an
    empty string and comes before others on ties; rows with one id share their noise and each are ranked;
    empty tables give no rows (an empty target: all its counts are zero); other columns are not carried.
    A text of any length is split in stretches; a task holds a batch.  Texts are read once: their buckets (two
    bytes per feature) are written and then summed up twice.
    """
    rows = written(bucketed(docs, id_col, text_col, longest, buckets), "buckets")
    wanted = written(bucketed(target.select(F.lit(0).alias("of"), F.col(target_text_col).alias("text")), "of", "text", longest, buckets), "target")
    gains = bucket_gains(histogram(rows, buckets), histogram(wanted, buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights(rows, gains).withColumns({"score": F.col("weight") + noise, "eligible": F.col("n_words") >= least_words})
    return _ranked(scored, per_cent).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def op13_importance_draw(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their weight towards the benchmark texts, and the rank of those that are drawn."""
    done = resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")

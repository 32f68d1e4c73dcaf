"""Collocations of two to four words, counted in counting quotient filters.

Words that are frequent enough get numbers.  An n-gram is its numbers in a row, ``n * width`` bits; a Feistel
network permutes these bits, so that they are spread evenly and can be turned back.  The permuted value is cut
into a quotient and the full remainder: a sorted filter holds, per quotient in use, the run of its remainders with
their counts, and loses nothing.  Each block of documents makes a filter; pieces of filters with the same
high quotient bits meet in one task, which merges them and adds up the counts.

Longer n-grams grow only from frequent shorter ones: a merging task answers each block with one bit per
n-gram that the block sent, and the block goes on with the places where both shorter n-grams were frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktrail.llm.dictionary import numbered, resolved, vocabulary
from worktrail.llm.store import in_arrow, written
from worktrail.llm.words import encoded, mix, text_bytes

LONGEST = 4
LEAST_COUNT = 30
COVERED = 80  # per cent
TOP = 2000
# n-grams (before counting) for each range of quotients: what a merging task holds at a time.
PIECE_GRAMS = 1 << 20
_ROUNDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]
_ZERO, _WORD = np.uint64(0), 64


class Packing:
    """n-grams of numbers below ``2 ** width`` as permuted values of ``n * width`` bits, in two 64-bit words (high, low)."""

    def __init__(self, n: int, width: int) -> None:
        if width > 31:
            raise ValueError("more than 2 ** 31 frequent words: raise the least count")
        self.n, self.width, self.bits = n, width, n * width
        self.left_words = (n + 1) // 2
        self.left_bits, self.right_bits = self.left_words * width, (n - self.left_words) * width

    @staticmethod
    def _mask(bits: int) -> np.uint64:
        return np.uint64((1 << bits) - 1)

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.uint64)
        for j in range(numbers.shape[1]):
            out = out << np.uint64(self.width) | numbers[:, j].astype(np.uint64)
        return out

    def pack(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of numbers, permuted: each half in turn is xored with a scrambling of the other."""
        left, right = self._joined(grams[:, : self.left_words]), self._joined(grams[:, self.left_words :])
        for i, salt in enumerate(_ROUNDS):
            if i % 2:
                right ^= mix(left + salt) & self._mask(self.right_bits)
            else:
                left ^= mix(right + salt) & self._mask(self.left_bits)
        over = self.bits - _WORD
        low = left << np.uint64(self.right_bits) | right
        return (left >> np.uint64(_WORD - self.right_bits) if over > 0 else np.zeros(len(left), np.uint64)), low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The rows of numbers again."""
        right = low & self._mask(self.right_bits)
        left = low >> np.uint64(self.right_bits)
        if self.bits > _WORD:
            left |= high << np.uint64(_WORD - self.right_bits)
        for i, salt in reversed(list(enumerate(_ROUNDS))):
            if i % 2:
                right ^= mix(left + salt) & self._mask(self.right_bits)
            else:
                left ^= mix(right + salt) & self._mask(self.left_bits)
        cut = lambda half, words: [half >> np.uint64(self.width * (words - 1 - j)) & self._mask(self.width) for j in range(words)]
        return np.column_stack(cut(left, self.left_words) + cut(right, self.n - self.left_words)).astype(np.int64)


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values: the place of one of each, the number of each value given, and how often each is given."""
    order = np.argsort(low, kind="stable") if not high.any() else np.lexsort((low, high))
    h, x = high[order], low[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(first) - 1
    return order[at], number, np.diff(np.append(at, len(x)))


def _top(high: np.ndarray, low: np.ndarray, dropped: int) -> np.ndarray:
    """Values without their ``dropped`` low bits (what is left fits 64 bits)."""
    if dropped >= _WORD:
        return high >> np.uint64(dropped - _WORD)
    return low >> np.uint64(dropped) | (high << np.uint64(_WORD - dropped) if dropped else _ZERO)


class Filter:
    """A counting quotient filter over one range of quotients: ascending distinct values with their counts."""

    def __init__(self, high: np.ndarray, low: np.ndarray, count: np.ndarray) -> None:
        self.high, self.low, self.count = high, low, count

    def to_bytes(self, bits: int, range_bits: int, part: int) -> bytes:
        """Quotients in use and ends of their runs as bits, remainders in whole bytes, counts in one byte (or eight, if above 254)."""
        n = len(self.low)
        quotient_bits = max(range_bits, min(n.bit_length(), bits))
        size = max(0, -(-(bits - quotient_bits) // 8))
        if bits - 8 * size < range_bits:
            size = (bits - range_bits) // 8
        span = bits - 8 * size - range_bits
        quotient = (_top(self.high, self.low, 8 * size) - np.uint64(part << span)).astype(np.int64)
        used = np.zeros(1 << span, np.uint8)
        used[quotient] = 1
        end = np.append(quotient[1:] != quotient[:-1], True)
        value = np.column_stack([self.low, self.high]).astype("<u8").view(np.uint8)[:, :size]
        large = self.count > 254
        head = np.array([n, span, size, int(large.sum())], "<i8").tobytes()
        return head + np.packbits(used).tobytes() + np.packbits(end).tobytes() + value.tobytes() + np.where(large, 255, self.count).astype(np.uint8).tobytes() + self.count[large].astype("<i8").tobytes()

    @staticmethod
    def from_bytes(data: bytes, part: int) -> Filter:
        n, span, size, n_large = np.frombuffer(data, "<i8", 4).tolist()
        at = 32

        def take(length: int) -> np.ndarray:
            nonlocal at
            at += length
            return np.frombuffer(data, np.uint8, length, at - length)

        used = np.flatnonzero(np.unpackbits(take(-(-(1 << span) // 8)), count=1 << span))
        end = np.flatnonzero(np.unpackbits(take(-(-n // 8)), count=n))
        value = np.zeros((n, 16), np.uint8)
        value[:, :size] = take(n * size).reshape(n, size)
        count = take(n).astype(np.int64)
        count[count == 255] = np.frombuffer(data, "<i8", n_large, at)
        low, high = value.view("<u8").T.copy()
        quotient = np.repeat(used, np.diff(np.append(-1, end))).astype(np.uint64) + np.uint64(part << span)
        if size >= 8:
            high |= quotient << np.uint64(8 * size - _WORD)
        else:
            low |= quotient << np.uint64(8 * size)
            if size:
                high |= quotient >> np.uint64(_WORD - 8 * size)
        return Filter(high, low, count)


def merged(filters: list[Filter]) -> tuple[Filter, np.ndarray]:
    """One filter with the counts of all added up, and for each value of each (in a row) its place in it."""
    high, low = (np.concatenate([getattr(f, c) for f in filters]) for c in ("high", "low"))
    at, number, _ = distinct(high, low)
    count = np.zeros(len(at), np.int64)
    np.add.at(count, number, np.concatenate([f.count for f in filters]))
    return Filter(high[at], low[at], count), number


_BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
_BLANKS = [0x20, 0x09]


def pieces(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Codes of all words of some texts (A-Z lower-cased), -1 where a piece or text ends, and the distinct words."""
    data, border = text_bytes(texts)
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    breaks = np.isin(data, np.array(_BREAKS, np.uint8))
    m = ~breaks & ~np.isin(data, np.array(_BLANKS, np.uint8))
    edge = np.zeros(len(data) + 1, bool)
    edge[border] = True
    begin = np.flatnonzero(m & (edge[:-1] | ~np.append(False, m[:-1])))
    end = np.flatnonzero(m & (edge[1:] | ~np.append(m[1:], False))) + 1
    code, words = encoded(data, begin, end, m, codes)
    # Words of one piece have as many breaks and text borders before them.
    before = np.cumsum(breaks)[begin] + np.searchsorted(border, begin, side="right") if len(begin) else begin
    last = np.flatnonzero(np.append(before[1:] != before[:-1], True)) if len(begin) else begin
    return np.insert(code.astype(np.int32), last + 1, -1), words


def _blocks(docs: DataFrame) -> DataFrame:
    """``block``, ``lang``, ``codes`` (32-bit numbers into ``words``, -1 between pieces), ``words`` and ``n`` (how often each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                code, words = pieces(batch.column(1).take(pa.array(np.flatnonzero(of == i))))
                n = np.bincount(code[code >= 0], minlength=len(words))
                listed = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([code.tobytes()], pa.binary()), listed([w.decode() for w in words], pa.string()), listed(n, pa.int64())], ["lang", "codes", "words", "n"])

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    return in_arrow(rows, run, "lang string, codes binary, words array<string>, n array<bigint>").withColumn("block", F.monotonically_increasing_id())


def _numbers(blocks: DataFrame) -> DataFrame:
    """``block``, ``lang`` and ``numbers``: the words' numbers (32 bits each), -1 for words that have none and between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, found in zip(batch.column(2), batch.column(3), strict=True):
                code = np.frombuffer(codes.as_buffer(), np.int32)
                of = np.full(int(code.max(initial=-1)) + 2, -1, np.int32)
                if found.is_valid:
                    of[found.values.field("at").to_numpy()] = found.values.field("number").to_numpy()
                out.append(of[code].tobytes())  # the last place stands for -1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "lang", "numbers"])

    return in_arrow(blocks, run, "block bigint, lang string, numbers binary")


def _grams(numbers: np.ndarray, n: int, width: int, replies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a block, distinct and ascending (high, low, count), grown from those that replies call frequent."""
    good = np.append(numbers >= 0, False)
    for k in range(2, n + 1):
        at = np.flatnonzero(good[:-1] & good[1:])
        packing = Packing(k, width)
        high, low = packing.pack(numbers[at[:, None] + np.arange(k)])
        one, number, count = distinct(high, low)
        if k < n:
            good = np.zeros(len(numbers) + 1, bool)
            good[at] = replies[k - 2][number]
    return high[one], low[one], count


def _flags(parts) -> np.ndarray:
    """The bits of all parts of a reply in a row."""
    if not parts.is_valid:
        return np.zeros(0, bool)
    return np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(p["bits"].as_buffer(), np.uint8), count=p["n"].as_py()) for p in parts]]).astype(bool)


def _filters(blocks: DataFrame, n: int, width: int, range_bits: int) -> DataFrame:
    """Pieces of each block's filter: ``lang``, ``part`` (the high quotient bits), ``block``, ``filter``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = n * width
        for batch in batches:
            for i in range(len(batch)):
                numbers = np.frombuffer(batch.column(2)[i].as_buffer(), np.int32)
                high, low, count = _grams(numbers, n, width, [_flags(batch.column(3 + j)[i]) for j in range(n - 2)])
                if not len(low):
                    continue
                part = _top(high, low, bits - range_bits).astype(np.int64)
                begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                ends = np.append(begin[1:], len(part))
                made = [Filter(high[a:b], low[a:b], count[a:b]).to_bytes(bits, range_bits, int(part[a])) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                k = len(made)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array([i] * k, pa.int64())), pa.array(part[begin]), batch.column(0).take(pa.array([i] * k, pa.int64())), pa.array(made, pa.binary())], ["lang", "part", "block", "filter"])

    return in_arrow(blocks, run, "lang string, part bigint, block bigint, filter binary")


def _merge(filters: DataFrame, least: int) -> DataFrame:
    """Pieces of one language and range added up: a row of frequent values (``high``, ``low``, ``count``), and a reply per block.

    A task holds the pieces of one range at a time: ``PIECE_GRAMS`` n-grams on average, as the permutation
    spreads them evenly and a block sends each n-gram once.
    """

    def group(lang: str, part: int, blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
        filters = [Filter.from_bytes(d, part) for d in data]
        whole, number = merged(filters)
        often = whole.count >= least
        each = np.array([len(f.low) for f in filters])
        ends = np.cumsum(each)
        bits = [np.packbits(often[number[b - n : b]]).tobytes() for b, n in zip(ends.tolist(), each.tolist(), strict=True)]
        k = len(blocks)
        found = [x[often].view(np.int64) for x in (whole.high, whole.low, whole.count)]
        lists = [pa.array([x] + [None] * k, pa.list_(pa.int64())) for x in found]
        return pa.RecordBatch.from_arrays([pa.array([lang] * (k + 1)), pa.array([None, *blocks], pa.int64()), pa.array([part] * (k + 1), pa.int64()), pa.array([None, *each.tolist()], pa.int32()), pa.array([None, *bits], pa.binary()), *lists], ["lang", "block", "part", "n", "bits", "high", "low", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, data = None, [], []
        for batch in batches:
            for lang, part, block, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (lang, part) != now:
                    if now is not None:
                        yield group(*now, blocks, data)
                    now, blocks, data = (lang, part), [], []
                blocks.append(block)
                data.append(piece)
        if now is not None:
            yield group(*now, blocks, data)

    dealt = filters.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return in_arrow(dealt, run, "lang string, block bigint, part bigint, n int, bits binary, high array<bigint>, low array<bigint>, count array<bigint>")


def _turned_back(found: DataFrame, n: int, width: int) -> DataFrame:
    """``ids`` (numbers of the words) and ``f`` of the frequent n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = Packing(n, width)
        for batch in batches:
            high, low, count = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            grams = packing.unpack(high.view(np.uint64), low.view(np.uint64))
            border = pa.array(np.arange(len(grams) + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(border, pa.array(grams.ravel())), pa.array(count)], ["ids", "f"])

    return in_arrow(found.where(F.col("block").isNull() & (F.size("high") > 0)).select("high", "low", "count"), run, "ids array<bigint>, f bigint")


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST_COUNT, piece_grams: int = PIECE_GRAMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts: numbered frequent words (``lang``, ``word``, ``n``, ``id``), frequent phrases (``ids``, ``f``), words per language (``lang``, ``n``)."""
    blocks = written(_blocks(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))), "blocks")
    words = written(vocabulary(blocks, ["lang"], ["n"]), "vocabulary")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = written(numbered(words.where(F.col("n") >= least), "frequent"), "numbers")
    size, occurrences = frequent.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = max(1, (size - 1).bit_length())
    range_bits = min((occurrences // piece_grams).bit_length(), 2 * width)
    lists = resolved(blocks, frequent, ["lang"], {"number": F.col("id").cast("int")}, ["lang", "codes"])
    numbers = written(_numbers(lists.select("block", "lang", "codes", "found")), "numbers")
    phrases, given = [], numbers
    for n in range(2, longest + 1):
        found = written(_merge(_filters(given, n, width, range_bits), least), f"grams{n}")
        phrases.append(_turned_back(found, n, width))
        if n < longest:
            reply = found.where(F.col("block").isNotNull()).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "n", "bits"))).alias(f"reply{n}"))
            given = given.join(reply, "block", "left")
    every = phrases[0]
    for more in phrases[1:]:
        every = every.unionByName(more)
    return frequent, written(every, "phrases"), totals


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST_COUNT, covered: int = COVERED, top: int = TOP, piece_grams: int = PIECE_GRAMS) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts (A-Z lower-cased) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``.
    A candidate has 2 to ``longest`` words and ``a >= least`` occurrences within pieces.  Its score is the least of
    floor(2000000 a / (l + r)) over its cuts, ``l`` and ``r`` the counts of both parts (ties: first cut).  Candidates inside a
    longer candidate with ``covered`` per cent of their count are left out.  Order: score, ``a`` (both falling), phrase in bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; a language without
    candidates has no rows, nor has an empty table; other columns are not carried.  A very long text is one block.
    """
    words, phrases, totals = phrase_counts(docs, lang_col, text_col, longest, least, piece_grams)
    longer = phrases.where(F.size("ids") > 2)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("ids") - k + 1), lambda i: F.slice("ids", i, k))))
    cover = longer.select(F.explode(inner).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    whole = phrases.join(cover, "ids", "left").where(F.col("longer").isNull() | (100 * _exact(F.col("longer")) < covered * _exact(F.col("f"))))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(k.alias("k"), F.slice("ids", 1, k).alias("first"), F.slice("ids", k + 1, F.size("ids") - k).alias("rest"))))
    parts = words.select(F.array("id").alias("ids"), F.col("n").alias("f")).unionByName(phrases)
    side = lambda key, count: parts.select(F.col("ids").alias(key), F.col("f").alias(count))
    cuts = whole.select("ids", F.col("f").alias("a"), cut.alias("c")).select("ids", "a", "c.*").join(side("first", "l"), "first").join(side("rest", "r"), "rest")
    score = F.expr("(cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", score).groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("ids", "x.*")
    spelt = lowest.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word", "lang"), "id").groupBy("ids").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = lowest.join(spelt.select("ids", "lang", F.array_join("w.word", " ").alias("phrase")), "ids")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    chosen = named.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return chosen.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_quotient_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The 2,000 strongest phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf}/documents.parquet"))

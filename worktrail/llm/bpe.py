"""Byte-level BPE by a pair occurrence index, and its inverse.

The distinct words of a slice of a batch are laid out as one linked list of symbols.  An index maps each
mergeable pair to all its places; ranks that have places are taken in ascending order, all
places of a rank are merged from left to right, and the lists of the pairs that arise next to
them are brought up to date; few places are merged one by one, many as arrays.  A word is never
scanned again for its next merge.  Merging by rank over all words equals merging word by word as each
merge makes a symbol of its own, so that a pair with it has a higher rank.

Words (all of one slice of an Arrow batch that the worker has not met) are the unit of the index, so its
memory is bounded by the slice; ids of pieces are kept up to a bound.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.pieces import PieceIds, not_simple, taken, with_others
from worktrail.llm.store import give_back, in_arrow, once, sliced
from worktrail.llm.words import led_words, text_bytes

# The pattern that splits a text before merging, and the printable stand-ins of bytes
# (these three ranges stand for themselves, all other bytes for code points from 256 on, in order).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
# Pieces that the pattern leaves whole, of characters that all versions of Unicode class alike.
ONE_WORD = r"^ ?([A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ一-龥]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)$"
# Bytes of text that a task encodes at a time (one longer text is whole), and places that are put into a new index at a time.
SLICE_BYTES = 1 << 20
INDEXED = 1 << 17
# Places of a rank from which on they are merged as arrays, and ids that are decoded at a time.
MANY = 48
DECODED = 1 << 18
# Pieces of a generation that a task remembers, and their bytes: a worker stands beside its executor's heap for long.
KEPT_PIECES = 100_000
KEPT_BYTES = 8 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    printable = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairIndexBPE:
    """A byte-level BPE vocabulary file, encoding by the pair occurrence index and decoding."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        self.byte_ids = [vocab[s] for s in symbols]
        self.width = 1 << max(vocab.values()).bit_length()
        self.left = [vocab[a] for a, _ in merges]
        self.right = [vocab[b] for _, b in merges]
        self.joined = [vocab[a + b] for a, b in merges]
        # All pairs by their key, in order, for looking up many at a time; of a repeated pair the first rank counts.
        keys = np.array(self.left, np.int64) * self.width + np.array(self.right, np.int64)
        self.keys, self.ranks = np.unique(keys, return_index=True)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        self.ranks = self.ranks.astype(np.int32)
        self.narrow = np.min_scalar_type(len(merges))  # ranks of few bytes are sorted faster
        # The same for pairs of bytes, with which all words begin.
        single = np.array(self.byte_ids)
        self.byte_ranks = self._rank(np.repeat(single, 256), np.tile(single, 256))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.word_pattern = regex.compile(WORD_PATTERN)
        self.safe_cut = regex.compile(r" (?=\S)")
        of_symbol = {s: b for b, s in enumerate(symbols)}
        size = max([*vocab.values(), *self.added.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(of_symbol[c] for c in token)
        for token, i in self.added.items():
            tokens[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 where there is none (also where a symbol is negative)."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, merged together by rank, and how many each word has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, border = text_bytes(pa.array(words, pa.string()))
        n = len(data)
        symbol = np.full(n + 1, -1, np.int32)  # the last stands for "none"
        symbol[:n] = np.array(self.byte_ids, np.int32)[data]
        after = np.append(np.arange(1, n + 1), n)
        before = np.append(np.arange(-1, n - 1), n)
        full = np.diff(border) > 0
        after[border[1:][full] - 1] = before[border[:-1][full]] = n
        many: dict[int, list[np.ndarray]] = {}  # places by rank: as arrays
        few: dict[int, list[int]] = {}  # and others one by one
        active: list[int] = []

        def index(at: np.ndarray, rank: np.ndarray) -> None:
            """Put the pairs that begin at these places, of these ranks, into the index."""
            found = np.flatnonzero(rank >= 0)
            if not len(found):
                return
            rank = rank[found]
            order = np.argsort(rank.astype(self.narrow), kind="stable")
            at, rank = at[found[order]], rank[order]
            cut = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
            for r, a, b in zip(rank[[0, *cut]].tolist(), [0, *cut], [*cut, len(at)], strict=True):
                if r not in many and r not in few:
                    heapq.heappush(active, r)
                if b - a < MANY:
                    few.setdefault(r, []).extend(at[a:b].tolist())
                else:
                    many.setdefault(r, []).append(at[a:b])

        for a in range(0, n, INDEXED):
            at = a + np.flatnonzero(after[a : min(a + INDEXED, n)] < n)
            index(at, self.byte_ranks[data[at].astype(np.int32) * 256 + data[at + 1]])
        of, next_of, last_of, rank_of, width = memoryview(symbol), memoryview(after), memoryview(before), self.rank_of.get, self.width

        def note(r: int, i: int) -> None:
            if (some := few.get(r)) is not None:
                some.append(i)
            else:
                few[r] = [i]
                if r not in many:
                    heapq.heappush(active, r)

        def one_by_one(places: list[int], left: int, right: int, joined: int) -> None:
            """Merge these places of a pair; some may be gone since they were put into the index."""
            for i in sorted(places):
                j = next_of[i]
                if of[i] == left and of[j] == right:
                    follow, preceding = next_of[j], last_of[i]
                    of[i], of[j], next_of[i] = joined, -1, follow
                    if follow < n:
                        last_of[follow] = i
                        if (r := rank_of(joined * width + of[follow])) is not None:
                            note(r, i)
                    if preceding < n and (r := rank_of(of[preceding] * width + joined)) is not None:
                        note(r, preceding)

        while active:
            r = heapq.heappop(active)
            left, right = self.left[r], self.right[r]
            arrays, others = many.pop(r, []), few.pop(r, [])
            if not arrays and len(others) < MANY:
                one_by_one(others, left, right, self.joined[r])
                continue
            at = np.concatenate([*arrays, np.array(others, np.int64)])
            at.sort()
            at = at[(symbol[at] == left) & (symbol[after[at]] == right) & np.append(True, at[1:] != at[:-1])]
            if left == right:
                at = self._apart(at, after)
            if not len(at):
                continue  # earlier merges took all of them
            taken = after[at]
            follow = after[taken]
            symbol[at], symbol[taken], after[at] = self.joined[r], -1, follow
            before[follow] = at
            before[n] = n
            preceding = before[at]
            other = preceding < n
            other[1:] &= preceding[1:] != at[:-1]  # a place that has just been merged is in the list already
            begin = np.concatenate([at, preceding[other]])
            index(begin, self._rank(symbol[begin], symbol[after[begin]]))
        kept = symbol[:n] >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[border]
        return symbol[:n][kept].astype(np.uint32), np.diff(ends)

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of places of a doubled symbol, from left to right, those that share no symbol with the one before."""
        kept, taken = [], -1
        for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
            if i != taken:
                kept.append(i)
                taken = j
        return np.array(kept, np.int64)

    def split(self, text: str) -> list[str]:
        """Pieces of a text with special strings or unusual white space that encode one by one."""
        out: list[str] = []
        at = 0
        for m in self.added_pattern.finditer(text) if self.added_pattern else ():
            out += self._cut(text[at : m.start()]) + [m.group()]
            at = m.end()
        return out + self._cut(text[at:])

    def _cut(self, text: str) -> list[str]:
        cuts = [m.start() for m in self.safe_cut.finditer(text)]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if b > a]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row and the size of each: special strings as they are, other pieces by their words.

        Words are numbered while the pieces are cut, so that no piece is an object of its own at the end.
        """
        place: dict[str, int] = {}
        code, n_words = array("q"), array("q")
        whole = pc.match_substring_regex(pa.array(pieces, pa.string()), ONE_WORD).to_pylist()
        for p, one in zip(pieces, whole, strict=True):
            if p in self.added:
                code.append(-1 - self.added[p])  # this id and no word
                n_words.append(1)
            elif one:
                code.append(place.setdefault(p, len(place)))
                n_words.append(1)
            else:
                words = self.word_pattern.findall(p)
                code.extend([place.setdefault(w, len(place)) for w in words])
                n_words.append(len(words))
        flat, size = self.merge_words(list(place))
        of = np.array(code, np.int64)
        special = of < 0
        flat = np.concatenate([flat, (-1 - of[special]).astype(np.uint32)])
        of[special] = np.arange(len(size), len(size) + special.sum())
        size = np.concatenate([size, np.ones(special.sum(), np.int64)])
        each = size[of]
        border = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(np.array(n_words, np.int64))])]
        return taken(flat, (np.cumsum(size) - size)[of], each), np.diff(border)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text of any kind."""
        return self.encode_pieces(self.split(text))[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0].as_py()

    def decode_all(self, ids: np.ndarray, border: np.ndarray) -> pa.Array:
        """The texts of lists of ids, given in a row with their borders."""
        parts = [ids[a : a + DECODED] for a in range(0, len(ids), DECODED)]
        data = np.concatenate([self.token_bytes[:0], *[taken(self.token_bytes, self.token_at[p], self.token_size[p]) for p in parts]])
        ends = np.concatenate([[0], np.cumsum(self.token_size[ids])])[border]
        done = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(border) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        try:
            return done.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([x.decode("utf-8", errors="replace") for x in done.to_pylist()], pa.string())


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Token ids of each whole text, and the text that they decode to.

    Returns ``id_col``, ``ids`` (array of int) and ``decoded``.  A null text counts as empty: no ids,
    an empty text; repeated rows and ids stay as they are; other columns are not carried.
    ``vocab_path`` must be readable at the same place on each executor.  Map only: nothing is shuffled.
    Texts are encoded ``SLICE_BYTES`` at a time, so that a task holds little beside its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(f"bpe {vocab_path}", lambda: PairIndexBPE(vocab_path))
        memo = once(f"bpe ids {vocab_path}", lambda: PieceIds(bpe.encode_pieces, spaced=False, kept=KEPT_PIECES, kept_bytes=KEPT_BYTES))
        for batch in sliced(batches, 1, SLICE_BYTES):
            texts = batch.column(1).fill_null("")
            hard = not_simple(texts)
            ids, counts = with_others(*memo.of(led_words(pc.if_else(hard, "", texts))), {int(i): bpe.encode(texts[int(i)].as_py()) for i in np.flatnonzero(hard)})
            border = np.concatenate([[0], np.cumsum(counts)])
            listed = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(ids.astype(np.int32)))
            out = bpe.decode_all(ids, border) if decode else pa.nulls(len(texts), pa.string())
            done = pa.RecordBatch.from_arrays([batch.column(0), listed, out], ["id", "ids", "decoded"])
            del batch, texts, hard, ids, counts, border, listed, out
            give_back()
            yield done

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(rows, run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def op2_bpe_pair_index(spark: SparkSession, sf: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    import public_tokenizers

    done = encode_decode(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

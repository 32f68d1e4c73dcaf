"""Words of whole texts, for an Arrow batch at a time, their hashes, and hashes of runs of words.

Within a batch words are told apart by their bytes; what leaves a task is a 64-bit hash of them.
Words are found on UTF-8 bytes, which is exact for the two patterns in use: both have all
code points beyond ASCII inside words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACE = "space"  # words [^\x20\x09-\x0D]+
BLANK = "blank"  # words [^\x20]+
ALNUM = "alnum"  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
_STEP = np.uint64(0xD1342543DE82EF95)


@dataclass
class Words:
    """Words of ``n`` texts: text ``i`` has words ``first[i]`` to ``first[i + 1]``; ``start`` and ``end`` are bytes in ``data``.

    ``code`` is the place of each word in ``distinct``, the batch's distinct words as (lower-cased) bytes.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray
    distinct: list[bytes]

    @cached_property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hashed(self.distinct)[self.code]

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(kind: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint8)
    if lower:
        codes[65:91] += 32
    if kind == SPACE:
        inside = ~np.isin(codes, [0x20, *range(0x09, 0x0E)])
    elif kind == BLANK:
        inside = codes != 0x20
    else:
        inside = (codes >= 0x80) | ((codes >= 0x30) & (codes <= 0x39)) | ((codes >= 0x61) & (codes <= 0x7A))
    return codes, inside


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the place where each begins (one more at the end); null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def encoded(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct words as bytes, and the number of each word in that list: equal numbers mean equal bytes."""
    joined = codes[data[inside]]
    border = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(border), pa.py_buffer(joined)])
    return numbered(array)


def numbered(things: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The number of each value in the list of the distinct ones, and that list."""
    coded = things.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def hashed(things: list[bytes]) -> np.ndarray:
    """64 bits of a cryptographic digest of each: no input can be made up so that different things agree."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in things]), np.uint64)


def _classes() -> np.ndarray:
    """ASCII letters, digits and punctuation but the apostrophe, told apart; all other bytes are of no class (0)."""
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = 2
    for kind, ranges in ((1, ((0x41, 0x5B), (0x61, 0x7B))), (3, ((0x30, 0x3A),)), (0, ((0x27, 0x28),))):
        for a, b in ranges:
            out[a:b] = kind
    return out


def words(texts: pa.Array, kind: str = SPACE, lower: bool = False, classes: bool = False) -> Words:
    """All words of each text (A-Z lower-cased if asked), cut between ASCII characters of different classes if asked."""
    data, border = text_bytes(texts)
    codes, inside = _tables(kind, lower)
    m = inside[data]
    begins, ends = m.copy(), m.copy()
    begins[1:] &= ~m[:-1]
    ends[:-1] &= ~m[1:]
    inner = border[(border > 0) & (border < len(data))]
    begins[inner] = m[inner]
    ends[inner - 1] = m[inner - 1]
    if classes and len(data):
        of = _classes()[data]
        change = (of[1:] != of[:-1]) & (of[1:] > 0) & (of[:-1] > 0)
        begins[1:] |= change
        ends[:-1] |= change
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    code, distinct = encoded(data, start, end, m, codes)
    return Words(data, start, end, np.searchsorted(start, border), code, distinct)


def led_words(texts: pa.Array) -> Words:
    """Texts cut before each space and between ASCII characters of different classes, nothing left out: a word has the space before it.

    A line break that stands alone between such characters is a word by itself.
    """
    data, border = text_bytes(texts)
    of = _classes()[data]
    known = of > 0
    begins = data == 0x20
    begins[1:] |= (of[1:] != of[:-1]) & known[1:] & known[:-1]
    line = np.flatnonzero((data[1:-1] == 0x0A) & known[:-2] & known[2:]) + 1
    begins[line] = begins[line + 1] = True
    begins[border[border < len(data)]] = True
    start = np.flatnonzero(begins)
    places = np.append(start, len(data))
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data)])
    code, distinct = numbered(array)
    return Words(data, start, places[1:], np.searchsorted(start, border), code, distinct)


def runs(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words from each word on, and whether they lie within one text.

    Runs of doubled length are made from two neighbours, and ``k`` words from runs of powers of two.  Each step
    scrambles, so that the hash is no polynomial in those of the words.
    """
    n = len(w.hash)
    out = np.zeros(n, np.uint64)
    if n >= k:
        joined = lambda left, right: mix(left * _STEP + right)
        run, size, whole, length = w.hash, 1, None, 0
        while True:
            if k & size:  # the lowest places first: shorter runs stand at the front
                whole = run if whole is None else joined(whole[: n - length - size + 1], run[length : n - size + 1])
                length += size
            if 2 * size > k:
                break
            run, size = joined(run[: n - 2 * size + 1], run[size:]), 2 * size
        out[: n - k + 1] = whole
    doc_end = np.repeat(w.first[1:], np.diff(w.first))
    return out, np.arange(n) + k <= doc_end

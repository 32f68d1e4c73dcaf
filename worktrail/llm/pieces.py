"""Token ids of whole texts from the ids of their pieces.

A piece is a stretch that the tokenizer treats alone, whatever stands around it.  Pieces of a batch
are found and compared as bytes; each distinct one is encoded once and its ids are kept in the worker,
up to a bound.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from worktrail.llm.words import BLANK, SPACE, Words, words

# Distinct pieces of a generation, and their bytes (about 150 more each); beyond it a worker begins the next, and keeps two.
KEPT_PIECES = 300_000
KEPT_BYTES = 32 << 20
# White space beyond ASCII, with the controls that some libraries count as such.
_WIDE = "\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
# A space before more white space or at the end, or what may be a special string.
_NOT_SIMPLE = f" [ \\t-\\r\\x1c-\\x1f{_WIDE}]| $|^ |<\\|"
# Tokenizers that cut lower-cased words into runs of letters, single digits and runs of other characters (with some
# English endings after an apostrophe), and mark the end of each.
_CLASS_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_CLASS_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_END = "</w>"
# Lower-case letters that these tokenizers neither change nor cut.
_PLAIN = "^[a-zß-öø-ÿа-я一-龥]+$"


def not_simple(texts: pa.Array) -> np.ndarray:
    """Texts that ``space_pieces`` must not cut: runs of white space with a space inside, or special strings."""
    return pc.match_substring_regex(texts, _NOT_SIMPLE).to_numpy(zero_copy_only=False)


def space_pieces(texts: pa.Array) -> Words:
    """Simple texts cut before each space.

    A pattern that takes one leading space into a word never joins across such a space, so the
    pieces can be encoded one by one, each with its space.
    """
    return words(texts, BLANK)


def white_pieces(texts: pa.Array, classes: bool = False) -> Words:
    """Texts cut at white space, A-Z as a-z: for tokenizers that drop the one and lower-case the other.

    With ``classes`` (see ``cuts_at_classes``) also between ASCII letters, digits and punctuation, so that a word is
    one piece whatever stands before or after it.
    """
    return words(texts, SPACE, lower=True, classes=classes)


def cuts_at_classes(tokenizer) -> bool:
    """Whether a tokenizer cuts by ``_CLASS_RULE``: between two ASCII characters of different classes, neither an
    apostrophe, it then always cuts, and neither side bears on the other."""
    state = lambda part: json.loads(part.__getstate__()) if part is not None else {}
    before, normal = state(tokenizer.pre_tokenizer).get("pretokenizers", []), state(tokenizer.normalizer).get("normalizers")
    split = {"type": "Split", "pattern": {"Regex": _CLASS_RULE}, "behavior": "Removed", "invert": True}
    rule = len(before) == 2 and before[0] == split and before[1]["type"] == "ByteLevel" and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
    return rule and normal == _CLASS_NORMAL and getattr(tokenizer.model, "end_of_word_suffix", None) == _WORD_END


def _led(w: Words) -> np.ndarray:
    """Pieces that had a space before them: all but those that begin a text."""
    led = np.ones(len(w.start), bool)
    begins = w.first[:-1]
    led[begins[begins < w.first[1:]]] = False
    return led


class PieceIds:
    """Ids of pieces, remembered by the piece itself; ``encode`` gives the ids of a list of new pieces."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], spaced: bool, kept: int = KEPT_PIECES, kept_bytes: int = KEPT_BYTES) -> None:
        self.encode, self.spaced, self.kept, self.kept_bytes = encode, spaced, kept, kept_bytes
        self._clear()

    def _clear(self) -> None:
        """Begin a new generation; pieces of the last one come over when they are met again."""
        self.before = getattr(self, "place", {}), *(getattr(self, x, None) for x in ("at", "size", "flat"))
        self.place: dict[bytes, int] = {}
        self.at = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    @staticmethod
    def _put(into: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        """With new values from a place on, in an array that doubles as needed."""
        while at + len(new) > len(into):
            into = np.concatenate([into, np.zeros_like(into)])
        into[at : at + len(new)] = new
        return into

    def _learn(self, pieces: list[bytes]) -> None:
        place, at, size, flat = self.before
        new = [p for p in pieces if p not in place]
        met = [p for p in pieces if p in place]
        ids, each = _as_flat(self.encode([p.decode() for p in new])) if new else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if met:
            k = np.fromiter(map(place.__getitem__, met), np.int64, len(met))
            ids, each = np.concatenate([ids, taken(flat, at[k], size[k])]), np.concatenate([each, size[k]])
        n = len(self.place)
        self.place.update(zip(new + met, range(n, n + len(pieces)), strict=True))
        self.at = self._put(self.at, n, self.used + np.cumsum(each) - each)
        self.size = self._put(self.size, n, each)
        self.flat = self._put(self.flat, self.used, ids)
        self.used += int(each.sum())
        self.held += sum(map(len, pieces))

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.place) > self.kept or self.held > self.kept_bytes:
            self._clear()
        code, pieces = w.code, w.distinct
        if self.spaced:  # a piece with and without the space before it are two
            both, code = np.unique(code * 2 + _led(w), return_inverse=True)
            pieces = [b" " + pieces[c >> 1] if c & 1 else pieces[c >> 1] for c in both.tolist()]
        if new := [p for p in pieces if p not in self.place]:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))[code]
        each = self.size[place]
        border = np.concatenate([[0], np.cumsum(each)])
        return taken(self.flat, self.at[place], each), border[w.first[1:]] - border[w.first[:-1]]


def taken(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array in a row, each given by its place and size."""
    border = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(at - border[:-1], size) + np.arange(border[-1])]


def _as_flat(ids: list[np.ndarray] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, one array each, as all ids in a row and the size of each; such a pair stays as it is."""
    return ids if isinstance(ids, tuple) else (np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))


def library_ids(tokenizer, separator: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of many short pieces by the tokenizers library; a special string between them tells them apart.

    Pieces that have the special string themselves must not come here.
    """
    mark = tokenizer.token_to_id(separator)

    def encode(pieces: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(pieces), 4096):
            part = tokenizer.encode_batch_fast([separator.join(pieces[i : i + 4096])], add_special_tokens=False)[0].ids
            ids = np.asarray(part, np.uint32)
            at = np.flatnonzero(ids == mark)
            out += _between(ids, at)
        return out

    return encode


def class_ids(tokenizer, separator: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """The same for a tokenizer that ``cuts_at_classes``, all ids in a row and the size of each.

    Pieces of plain letters go to the library's model without the steps that leave them as they are; each is one
    word to it, and the id that ends a word ends the piece.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    whole = library_ids(tokenizer, separator)
    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for token, i in vocab.items() if token.endswith(_WORD_END)]] = True

    def of_plain(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        size = np.diff(np.flatnonzero(ends[ids]), prepend=-1)
        return (ids, size) if len(size) == len(pieces) and size.sum() == len(ids) else _as_flat(whole(pieces))

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        easy = pc.match_substring_regex(pa.array(pieces, pa.string()), _PLAIN).to_numpy(zero_copy_only=False)
        letters, others = ([pieces[i] for i in np.flatnonzero(m)] for m in (easy, ~easy))
        parts = [of_plain(letters[i : i + 4096]) for i in range(0, len(letters), 4096)] + ([_as_flat(whole(others))] if others else [])
        flat, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)]))
        at = np.cumsum(size) - size
        return taken(flat, at[order], size[order]), size[order]

    return encode


def _between(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [ids[a:b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)]


def with_others(ids: np.ndarray, counts: np.ndarray, others: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch, with those of some texts (which had none so far) put in their places."""
    if not others:
        return ids, counts
    border = np.concatenate([[0], np.cumsum(counts)])
    parts, at = [], 0
    for i, own in sorted(others.items()):
        parts += [ids[at : border[i]], own]
        counts[i], at = len(own), border[i]
    return np.concatenate([*parts, ids[at:]]), counts

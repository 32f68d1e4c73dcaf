"""Words that collide under polynomial hashes (Thue-Morse strings and their swaps), through all operators that compare words."""

import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from worktrail.llm import bpe, counts, decontaminate, minhash, store, substrings, tokenfiles
from worktrail.llm.pieces import PieceIds, space_pieces
from worktrail.llm.words import led_words, runs, words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def twins(n: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


PAIRS = [twins(n) for n in (1024, 2048, 4096)]
LEFT = [" ".join(f"{p[0]}{i}" for i in range(24)) for p in PAIRS]
RIGHT = [" ".join(f"{p[1]}{i}" for i in range(24)) for p in PAIRS]
ROWS = [(i, t) for i, t in enumerate([x for p in PAIRS for x in p] + LEFT + RIGHT, 1)]


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame(rows, f"{name} long, text string")


def test_distinct_words_have_distinct_hashes():
    w = words(pa.array([x for p in PAIRS for x in p]))
    assert len(set(w.hash.tolist())) == len(PAIRS) * 2 and len(w.distinct) == len(PAIRS) * 2
    first, second = (" ".join(x) for x in twins(1024))
    w = words(pa.array([first, second]))
    a, inside = runs(w, 1024)
    assert len(set(a[inside].tolist())) == 2
    empty = words(pa.array(["", None, " \n"]))
    assert not len(empty.hash) and empty.first.tolist() == [0, 0, 0, 0]


def test_token_operators(spark):
    library, other = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in ROWS}
    df = frame(spark, ROWS)
    assert {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(df, BYTE).collect()} == {i: (ids[i], t) for i, t in ROWS}
    assert {r.doc_id: r.n_tokens for r in counts.token_counts(df, BYTE, chunk=1 << 20).collect()} == {i: len(x) for i, x in ids.items()}
    read = tokenfiles.read_token_files(*tokenfiles.write_token_files(df, WORD, 1)).collect()
    assert {r.doc_id: np.frombuffer(r.ids_le, "<u4").tolist() for r in read} == {i: other.encode(t, add_special_tokens=False).ids + [1] for i, t in ROWS}


def test_document_operators(spark):
    texts, df = dict(ROWS), frame(spark, ROWS)
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert near == brute.near(texts, 4)
    kept = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in substrings.remove_repeats(df).collect()}
    assert kept == brute.substring(texts)
    items = dict(ROWS[6:9])
    found = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"])) for r in decontaminate.contamination(df, frame(spark, list(items.items()), "item_id")).collect()}
    assert found == {d: x[:3] for d, x in brute.decontaminate(texts, items).items()}


def test_ids_above_16_bits_are_kept():
    memo = PieceIds(lambda pieces: [np.array([70_000 + len(p)], np.uint32) for p in pieces], spaced=True, kept=2)
    for _ in range(3):  # also when the memo begins anew
        ids, n = memo.of(space_pieces(pa.array(["a bb ccc", "", "bb"])))
        assert ids.tolist() == [70_001, 70_003, 70_004, 70_002] and n.tolist() == [3, 0, 1]


def test_ids_of_words_cut_at_character_classes_are_the_library_s():
    from worktrail.llm.pieces import class_ids, cuts_at_classes, white_pieces

    library = Tokenizer.from_file(WORD)
    assert cuts_at_classes(library) and not cuts_at_classes(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    asked: list[str] = []
    encode = class_ids(library, "<|startoftext|>")
    memo = PieceIds(lambda pieces: asked.extend(pieces) or encode(pieces), spaced=False)
    memo.of(white_pieces(pa.array(["Word, word. (word) word", "don't 3d"]), True))
    assert sorted(asked) == ["(", ")", ",", ".", "3", "d", "don't", "word"]  # each once, whatever stands around it
    chars = [*"abestlvmSTKZ019.,;!'\"`_()~^#&-/=>|  \t\n\x0b\x01\x00\x1c\x7féÉßñйΣς一龥̸́̇İKſ;  ​٣²", "'s", "'ll", "'RE"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 40))) for _ in range(2000)]
    memo = PieceIds(encode, spaced=False, kept=500)
    for a in range(0, len(texts), 200):
        ids, n = memo.of(white_pieces(pa.array(texts[a : a + 200]), True))
        border = np.cumsum(n)
        for x, end, size in zip(texts[a : a + 200], border, n, strict=True):
            assert ids[end - size : end].tolist() == library.encode(x, add_special_tokens=False).ids


def test_a_word_is_encoded_once_whatever_stands_behind_it(spark, monkeypatch):
    """Full stops, commas, digits and single line breaks make no new word of the one before them."""
    mine, given = bpe.PairIndexBPE(BYTE), []
    memo = PieceIds(lambda pieces: given.extend(pieces) or mine.encode_pieces(pieces), spaced=False)
    texts = ["one two, two. two! two7 two\ntwo two", "", None, "two, 'two' don't, x_y\n\ny é, é"]
    ids, n = memo.of(led_words(pa.array(texts)))
    library = Tokenizer.from_file(BYTE)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    assert given.count(" two") == 1 and sum(p.strip(" ").startswith("two") for p in given) == 2  # with its space and without
    assert {p for p in given if not p.isascii()} == {" é,", " é"} and " don't" in given
    seen, encode = [], bpe.PairIndexBPE.encode_pieces
    monkeypatch.setattr(bpe.PairIndexBPE, "encode_pieces", lambda self, pieces: seen.extend(pieces) or encode(self, pieces))
    run = []
    with monkeypatch.context() as m:
        m.setattr(bpe, "in_arrow", lambda df, fn, schema: run.append(fn) or df)
        bpe.encode_decode(frame(spark, []), BYTE)
    store._held().clear()
    out = list(run[0](iter([pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["id", "text"])])))
    store._held().clear()
    assert out[0].column(1).to_pylist() == want and out[0].column(2).to_pylist() == [t or "" for t in texts]
    assert sorted(seen) == sorted(given)


def test_led_words_leave_nothing_out():
    rnd = random.Random(4)
    parts = ["a", "Bc", "7", ",", "'", "'s", "\n", "\n\n", "\t", " ", "é", "漢", "\x1c", "\x85", "_"]
    texts = [None, "", *("".join(rnd.choices(parts, k=rnd.randrange(30))) for _ in range(300))]
    w = led_words(pa.array(texts).slice(1))
    got = [b"".join(w.distinct[c] for c in w.code[a:b]).decode() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == texts[1:] and len(set(w.distinct)) == len(w.distinct) and b"" not in w.distinct


def test_few_and_many_places_of_a_pair_merge_alike(monkeypatch):
    library, mine, rnd = Tokenizer.from_file(BYTE), bpe.PairIndexBPE(BYTE), random.Random(5)
    texts = ["a" * n for n in range(1, 40)] + ["".join(rnd.choices("aeinrst", k=rnd.randint(1, 60))) for _ in range(400)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for many in (1, 5, 1 << 30):
        monkeypatch.setattr(bpe, "MANY", many)
        ids, n = mine.merge_words(texts)
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    bad = np.array([mine.byte_ids[0xE6], mine.byte_ids[0x41]])
    assert mine.decode_all(np.concatenate([bad, ids[:3]]), np.array([0, 2, 2, 5])).to_pylist() == ["\ufffdA", "", library.decode(ids[:3].tolist())]

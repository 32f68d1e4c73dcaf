"""What a Python task of the pipeline's last stage holds, and that smaller slices give the same rows."""

import random
import tracemalloc

import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from worktrail.llm import bpe, store

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def task(spark, monkeypatch):
    """The function that encodes batches, and batches with their ids, as Spark would hand them over."""
    given = []
    with monkeypatch.context() as m:
        m.setattr(bpe, "in_arrow", lambda df, fn, schema: given.append(fn) or df)
        bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), BYTE)
    return given[0]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])


def test_memory_of_a_task_does_not_follow_the_batch(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9)))
    whole = batch([" ".join(word() for _ in range(600)) for _ in range(1000)])
    run = task(spark, monkeypatch)
    store._held().clear()
    for _ in run(iter([batch(["the vocabulary is loaded"])])):
        pass
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in run(iter([whole])))
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
        store._held().clear()
    assert n == 1000 and whole.nbytes > 4e6
    assert most < 120, most


def test_slices_have_all_rows_in_order():
    texts = ["a" * 30, None, "", "b" * 500, None, "c" * 40, "d" * 40, "e" * 41, ""]
    for given in (batch(texts), batch(["x" * 999, *texts, "y"]).slice(1, len(texts))):
        parts = list(store.sliced(iter([given, given.slice(0, 0)]), 1, 100))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
        assert [x for p in parts for x in p.column(0).to_pylist()] == given.column(0).to_pylist()
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 100 for p in parts)
        assert len(parts) < len(texts)


def test_ids_are_the_library_s_across_slices_and_generations(spark, monkeypatch):
    library = Tokenizer.from_file(BYTE)
    rnd = random.Random(11)
    parts = ["Hello", " world", " ", "  ", "\n", "'s", "1", " 22", "<|endoftext|>", "<|", "é", " 漢字", "!", "\U0001f600", " aaaa", " the"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(60))) if rnd.random() < 0.9 else None for _ in range(400)]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 700)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    store._held().clear()
    got = [(i, ids, t) for out in task(spark, monkeypatch)(iter([batch(texts)])) for i, ids, t in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    store._held().clear()
    assert got == [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in enumerate(texts)]

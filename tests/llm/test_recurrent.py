"""The recurrent language model: exact counts, gradients, probabilities that add up to one, carried state, held-out gain."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrail.llm import recurrent as R

SF = "/root/testdata/sf0.001"


def plain(docs: dict, held) -> dict:
    words = {d: [*brute.SPACE_WORD.findall(brute.lower(t or "")), None] for d, t in docs.items()}
    c = Counter(w for d, ws in words.items() if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    return {d: (held(d), len(ws), sum(c[w] > 0 for w in ws), n, pytest.approx(base(ws), rel=1e-9)) for d, ws in words.items()}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in R.op12_recurrent_scores(spark, SF).collect()}
    want = plain(docs, lambda d: zlib.crc32(str(d).encode()) % 10 == 0)
    assert {d: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for d, r in got.items()} == want
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held) and all(r.score < 0 for r in got.values())


def small():
    sizes, rng = R.Sizes(6, 3, [0, 1, 3, 6]), np.random.default_rng(0)
    net = R.Network.fresh(sizes, np.arange(6, 0, -1.0), np.array([3.0, 2, 1]))
    net.flat[:] += rng.normal(0, 0.2, net.flat.shape)
    return net, rng


def test_gradient(monkeypatch):
    monkeypatch.setattr(R, "_F", np.float64)
    net, rng = small()
    net = R.Network(net.sizes, net.flat.astype(np.float64))
    given, target, reset = rng.integers(0, 9, (5, 3)), rng.integers(0, 9, (5, 3)), rng.random((5, 3)) < 0.3
    target[4, 2] = -1
    state = rng.normal(0, 0.5, (3, R.STATE))
    g, _, loss = net.gradient(given, reset, state, target)
    h, _, _ = net.forward(given, reset, state)
    assert loss == pytest.approx(-net.log_probability(h[target >= 0], target[target >= 0]).sum())
    for i in rng.choice(len(net.flat), 200, replace=False):
        old, ends = net.flat[i], []
        for e in (1e-5, -1e-5):
            net.flat[i] = old + e
            ends.append(net.gradient(given, reset, state, target)[2])
        net.flat[i] = old
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[i], abs=1e-7)


def test_probabilities_add_up_and_state_is_carried():
    net, rng = small()
    h = rng.normal(0, 1, (4, R.STATE)).astype(np.float32)
    total = sum(np.exp(net.log_probability(h, np.full(4, s))) for s in range(9))
    assert total == pytest.approx(np.ones(4), abs=1e-5)
    lengths = rng.integers(1, 200, 40)
    symbols = rng.integers(0, 9, int(lengths.sum()))

    def alone(text: np.ndarray) -> float:
        state, given, out = np.zeros((1, R.STATE), np.float32), R.END, 0.0
        for s in text:
            _, state, _ = net.forward(np.array([[given]]), np.zeros((1, 1), bool), state)
            out += float(net.log_probability(state, np.array([s]))[0])
            given = s
        return out

    want = [alone(t) for t in np.split(symbols, np.cumsum(lengths)[:-1])]
    for window in (1, 7, 32, 1000):
        assert R.scored(net, symbols, lengths, window) == pytest.approx(np.array(want), abs=1e-2)


def test_lanes_and_segments():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 50, 30)
    for seed in (None, 3):
        place = R.lanes(lengths, 4, seed)
        assert sorted(place[place >= 0].tolist()) == list(range(int(lengths.sum())))
        assert (np.diff((place >= 0).sum(axis=0)) <= 0).all()
    cut = R.segments(np.array([5, 4, 9, 1]), 4)
    assert cut.tolist() == [4, 1, 4, 4, 4, 1, 1]


def test_hard_cases(spark):
    texts = [None, "", " \n", "One one ONE two", "漢字 é " * 50, "x" * 5000, "the cat sat " * 700, "new words only"] + ["the dog sat on the mat"] * 30
    docs = {i: t for i, t in enumerate(texts)}
    rows = [(i if i else None, t) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "ids", "train", "round", "block", "n", "c", "word", "score")}).repartition(3)
    held = lambda d: d in (4, 7)
    got = {r.doc_id or 0: r for r in R.language_scores(df, ~F.coalesce(F.col("doc_id").isin(4, 7), F.lit(False))).collect()}
    assert {d: (not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for d, r in got.items()} == plain(docs, held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert R.language_scores(spark.createDataFrame([], schema)).collect() == []
    got = R.language_scores(spark.createDataFrame([(1, "a b"), (2, None)], schema), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)] and all(math.isfinite(r.score) for r in got)

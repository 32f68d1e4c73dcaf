"""Importance resampling against a plain version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
from pyspark.sql import functions as F

from worktrail.llm import resampling
from worktrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(docs: list, target: list, least: int = 20, per_cent: int = 5) -> list:
    def grams(text):
        w = brute.ALNUM_WORD.findall(brute.lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    of = [(d, *grams(t)) for d, t in docs]
    s, t = Counter(b for _, _, g in of for b in g), Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for d, n, g in of:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append((d, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    rank = {id(r): i for i, r in enumerate(fit[: per_cent * len(fit) // 100], 1)}
    return sorted(((*r[:1], *r[2:], rank.get(id(r))) for r in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = result(QUERIES["op13_importance_draw"](spark, SF))
    assert got == plain(docs, target) and sum(r[4] is not None for r in got) > 3


def test_hard_cases(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["Alpha", "beta", "ÄÖ", "漢字", "x1", "\U0001f600", "don't", "a" * 300, "É"]
    docs = [(i, "".join(rnd.choice(words) + rnd.choice([" ", "\n", ", ", "\x00", "  "]) for _ in range(rnd.randrange(60)))) for i in range(1, 120)]
    docs += [(None, docs[5][1] * 3), (7, docs[6][1]), (500, None), (501, ""), (502, " ,. "), (503, "one"), (504, "w " * 5000)]
    target = ["alpha beta x1", None, "", "漢字 alpha"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "score", "rank", "part", "row", "weight", "buckets", "eligible")}).repartition(5)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, of int")
    assert result(resampling.resample(df, bench)) == plain(docs, target)
    monkeypatch.setattr(resampling, "STRETCH", 7)  # many stretches: no word is cut
    splitter, shift = resampling.Splitter(), resampling.Shift()
    for _, t in docs:
        w = brute.ALNUM_WORD.findall(brute.lower(t or ""))
        assert splitter.words(t)[0] == w
        n, k, values = resampling.features([t], splitter, shift)
        assert n[0] == len(w) and sorted(values.tolist()) == sorted(zlib.crc32(" ".join(w[i : i + g]).encode()) % 10_000 for g in (1, 2, 3) for i in range(len(w) - g + 1)) and k[0] == len(values)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none.select("text")).collect() == []
    some = spark.createDataFrame([(i, "word " * 30) for i in range(40)], "doc_id long, text string")
    got = result(resampling.resample(some, none.select("text")))
    assert got == plain([(i, "word " * 30) for i in range(40)], []) and sum(r[4] is not None for r in got) == 2

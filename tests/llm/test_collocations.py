"""Phrases and their counting quotient filters against plain versions."""

import random
import re
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from worktrail.llm import collocations as C

SF = "/root/testdata/sf0.001"


def plain(docs: list, least: int = 30, top: int = 2000, longest: int = 4) -> list:
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = {(g, p[i : i + k]) for (g, p), a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * cand[g, p[i : i + k]]}
    out = []
    for lang in n:
        rows = []
        for (g, p), a in cand.items():
            if g == lang and (g, p) not in covered:
                score, _, l, r = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_permutation_and_filter_lose_nothing():
    rng = np.random.default_rng(1)
    for n in (2, 3, 4):
        for width in (1, 5, 16, 18, 21, 31):
            packing = C.Packing(n, width)
            grams = rng.integers(0, 1 << width, (500, n))
            high, low = packing.pack(grams)
            assert (packing.unpack(high, low) == grams).all()
            at, number, count = C.distinct(high, low)
            values = [int(h) << 64 | int(x) for h, x in zip(high, low)]
            assert [values[i] for i in at] == sorted(set(values)) and [values[at[k]] for k in number] == values and count.sum() == 500
            count = count * rng.integers(1, 400, len(count))
            for range_bits in (0, 1, min(4, packing.bits)):
                part = C._top(high[at], low[at], packing.bits - range_bits).astype(int) if range_bits else np.zeros(len(at), int)
                for p in np.unique(part):
                    some = part == p
                    given = C.Filter(high[at][some], low[at][some], count[some])
                    got = C.Filter.from_bytes(given.to_bytes(packing.bits, range_bits, int(p)), int(p))
                    assert all((getattr(got, c) == getattr(given, c)).all() for c in ("high", "low", "count"))


def test_merge_adds_counts():
    make = lambda pairs: C.Filter(*(np.array(x, t) for x, t in zip(zip(*pairs), (np.uint64, np.uint64, np.int64))))
    whole, number = C.merged([make([(0, 5, 1), (1, 2, 3)]), make([(0, 5, 300), (0, 9, 1), (1, 1, 2)])])
    assert list(zip(whole.high.tolist(), whole.low.tolist(), whole.count.tolist())) == [(0, 5, 301), (0, 9, 1), (1, 1, 2), (1, 2, 3)]
    assert number.tolist() == [0, 3, 0, 1, 2]


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r.lang, r.text) for r in docs.collect()])
    assert sorted(map(tuple, C.op11_quotient_phrases(spark, SF).collect())) == want and len(want) == 50


def test_hard_cases(spark):
    rnd = random.Random(2)
    vocab = ["New", "york", "CITY", "the", "ÄÖ", "漢", "\x01", "a" * 300, "x"]
    docs = [(rnd.choice(["en", "de", None]), "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "\t", "  ", ", ", "\n", "."]) for _ in range(rnd.randrange(80)))) for _ in range(300)]
    docs += [("en", None), (None, ""), ("fr", " ,. \n"), ("en", "x x x x x " * 400), ("one", "word")] + [("de", "new york city the " * 9)] * 20
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit(1) for c in ("block", "n", "word", "words", "codes", "id", "part", "score", "doc_id")})
    for least, top, piece in ((30, 2000, 1 << 20), (5, 7, 64)):
        got = sorted(map(tuple, C.collocations(df.repartition(4), least=least, top=top, piece_grams=piece).collect()))
        assert got == plain(docs, least, top)


def test_no_phrases(spark):
    schema = "lang string, text string"
    assert C.collocations(spark.createDataFrame([], schema)).collect() == []
    assert C.collocations(spark.createDataFrame([("en", "a b c"), (None, None)], schema)).collect() == []

"""Operators on small frames: exact cases, brute-force checks, and keys that hold much of the table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrail.functions import keys, normalize, register, text
from worktrail.operators import aggregates, blocks, filters, folds, joins, lifecycle, match, ranking, search, sequential, sets, vectors
from worktrail.sources import ingest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def hot_events(n=6000, seed=5):
    """One source holds more than half of the rows; times repeat."""
    rnd = random.Random(seed)
    out, t = [], 1_704_067_200_000
    for i in range(n):
        t += rnd.choice([0, 500, 3_000, 20_000, 45_000, 90_000])
        key = "hot" if rnd.random() < 0.6 else f"s{rnd.randrange(6)}"
        out.append((i, key, t, rnd.randrange(64), rnd.randrange(16), rnd.random() < 0.1))
    return out


SCHEMA = "id long, key string, ts_ms long, fp long, depth long, critical boolean"


@pytest.fixture(scope="module")
def events():
    return hot_events()


@pytest.fixture(scope="module")
def hot(spark, events):
    return spark.createDataFrame(events, SCHEMA).repartition(8).cache()


def by_key(events):
    out = {}
    for r in sorted(events, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


# --- gap durations -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "times,gap,want",
    [
        ([0, 1000, 10000], 2000, 1000),
        ([100], 1000, 0),
        ([0, 100, 200, 300], 500, 300),
        ([0, 5000, 10000], 1000, 0),
        ([0, 500, 5000, 5500], 1000, 1000),
        ([0, 0, 7, 7], 10, 7),
    ],
)
@pytest.mark.parametrize("block", [100, 3_600_000])
def test_gap_duration(spark, times, gap, want, block):
    df = spark.createDataFrame([("a", t) for t in times], "thread_id string, ts_ms long")
    got = aggregates.gap_duration(df, "thread_id", gap_ms=gap, block_ms=block).first()
    assert (got["duration_ms"], got["start_ms"], got["last_active_ms"], got["node_count"]) == (want, times[0], times[-1], len(times))


def test_gap_duration_of_nothing(spark):
    df = spark.createDataFrame([], "thread_id string, ts_ms long")
    assert aggregates.gap_duration(df, "thread_id").count() == 0


# --- blocks ------------------------------------------------------------------------------


def test_running_and_lag_over_blocks(hot, events):
    df = hot.withColumn("b", blocks.time_block("ts_ms", 60_000))
    run = blocks.running(df, ["key"], ["ts_ms", "id"], "b", {"s": ("sum", F.col("fp")), "m": ("max", F.col("fp")), "lo": ("min", F.col("fp"))})
    lag = blocks.lag_in_blocks(df, ["key"], ["ts_ms", "id"], "b", {"p1": ("fp", 1), "p3": ("fp", 3)})
    want_run, want_lag = {}, {}
    for group in by_key(events).values():
        total, top, low = 0, -1, 99
        for n, r in enumerate(group):
            total, top, low = total + r[3], max(top, r[3]), min(low, r[3])
            want_run[r[0]] = (total, top, low)
            want_lag[r[0]] = (group[n - 1][3] if n >= 1 else None, group[n - 3][3] if n >= 3 else None)
    assert {r["id"]: (r["s"], r["m"], r["lo"]) for r in run.collect()} == want_run
    assert {r["id"]: (r["p1"], r["p3"]) for r in lag.collect()} == want_lag


def test_ranges_are_even_and_in_order(hot, events):
    df = blocks.in_ranges(hot, [], ["ts_ms", "id"], 24)
    assert df.groupBy(blocks.BLOCK).count().agg(F.max("count")).first()[0] < len(events) / 8
    run = blocks.running(df, [], ["ts_ms", "id"], blocks.BLOCK, {"n": ("sum", F.lit(1).cast("long"))})
    order = sorted(events, key=lambda r: (r[2], r[0]))
    assert {r["id"]: r["n"] for r in run.collect()} == {r[0]: i + 1 for i, r in enumerate(order)}


@pytest.fixture(scope="module")
def burst(spark):
    """20,000 rows of one key, two in three of them in one millisecond; every tenth row without a time."""
    t = F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 3 == 0, F.col("id")).otherwise(7_000)
    return spark.range(20_000).select("id", F.lit("a").alias("key"), t.cast("long").alias("ts_ms"), (F.col("id") % 5).alias("fp"))


def test_a_burst_in_one_millisecond_is_spread(burst):
    df = blocks.in_ranges(burst, ["key"], ["ts_ms", "id"], 24)
    assert df.groupBy(blocks.BLOCK).count().agg(F.max("count")).first()[0] < 20_000 / 8


def by_time(burst):
    return sorted(burst.collect(), key=lambda r: (r["ts_ms"] is not None, r["ts_ms"] or 0, r["id"]))


def test_lane_of_one_millisecond(burst):
    now = 10**9
    got = ranking.lane_order(burst.withColumn("attempts", F.lit(1)), now, ranges=24).orderBy("slot").collect()
    assert [r["id"] for r in got] == [r["id"] for r in by_time(burst)] and {r["lane"] for r in got} == {"recovery"}


def test_changes_and_rates_in_one_millisecond(burst):
    want, before = [], None
    for r in by_time(burst):
        if before is None or before["ts_ms"] is None or r["fp"] != before["fp"]:
            want.append(r["id"])
        before = r
    assert sorted(r["id"] for r in sequential.changes_only(burst, "key", "fp", 24).collect()) == sorted(want)
    rates = {r["id"]: r["rate"] for r in ranking.counter_rate(burst, "key", "fp", 24).collect()}
    before = None
    for r in by_time(burst):
        known = before is not None and before["ts_ms"] is not None and r["ts_ms"] is not None and r["ts_ms"] > before["ts_ms"]
        rate = (r["fp"] - before["fp"]) / (r["ts_ms"] - before["ts_ms"]) * 100 if known else 0.0
        assert abs(rates[r["id"]] - max(0.0, min(100.0, rate))) < 1e-9
        before = r


def test_sessions_and_durations_of_one_millisecond(burst):
    timed = [r["ts_ms"] for r in by_time(burst) if r["ts_ms"] is not None]
    want, first = [], 0
    for i in range(1, len(timed) + 1):
        if i == len(timed) or timed[i] - timed[i - 1] > 5:
            want.append((timed[first], timed[i - 1], i - first))
            first = i
    assert rows(lifecycle.sessions(burst, "key", 5, 24), "start_ms", "last_ms", "n") == want
    steps = [b - a for a, b in zip(timed, timed[1:])]
    got = aggregates.gap_duration(burst.filter("ts_ms IS NOT NULL"), "key", gap_ms=5, block_ms=1_000).first()
    assert (got["duration_ms"], got["node_count"]) == (sum(d for d in steps if 0 < d <= 5), len(timed))


def test_top_n_beyond_the_group_limit(hot, events):
    got = blocks.top_n(hot, ["key"], [F.col("ts_ms").desc(), F.col("id").desc()], 1500)
    want = []
    for key, group in by_key(events).items():
        want += [(key, r[0], n + 1) for n, r in enumerate(reversed(group)) if n < 1500]
    assert rows(got, "key", "id", "rn") == sorted(want)


# --- folds -------------------------------------------------------------------------------


def fold_all(events, step, columns, out):
    index = {"id": 0, "ts_ms": 2, "fp": 3, "depth": 4, "critical": 5}
    got = {}
    for group in by_key(events).values():
        res, _ = step({c: [r[index[c]] for r in group] for c in columns}, None)
        got.update(zip((r[0] for r in group), res[out]))
    return got


CASES = {
    "dedup": (lambda df: sequential.dedup_flags(df, "key", "fp", 2, 24), sequential.dedup_step(2), ["fp"], "kept"),
    "dedup_all_alike": (lambda df: sequential.dedup_flags(df, "key", "fp", 64, 24), sequential.dedup_step(64), ["fp"], "kept"),
    "batch": (lambda df: sequential.micro_batch(df, "key", 2, 60_000, 24), sequential.batch_step(2, 60_000), ["ts_ms", "id"], "first_id"),
    "batch_parity": (lambda df: sequential.micro_batch(df, "key", 2, 10**12, 24), sequential.batch_step(2, 10**12), ["ts_ms", "id"], "first_id"),
    "pressure": (lambda df: sequential.pressure_levels(df, "key", hold_ms=60_000, partitions=24), sequential.pressure_step((3, 7, 11, 10**9), 60_000), ["ts_ms", "depth"], "level"),
    "throttle": (lambda df: sequential.throttle(df, "key", 90_000, 24), sequential.throttle_step(90_000), ["ts_ms", "critical"], "shown"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_fold_over_many_partitions(hot, events, name):
    run, step, columns, out = CASES[name]
    got = {r["id"]: r[out] for r in run(hot).collect()}
    assert got == fold_all(events, step, columns, out)


def test_a_hot_key_is_spread(hot):
    marked = sequential.dedup_flags(hot, "key", "fp", 2, 24).filter("key = 'hot'").groupBy(F.spark_partition_id()).count()
    assert marked.count() > 8


def test_dedup_output_has_no_close_neighbours(hot):
    kept = by_key([(r["id"], r["key"], r["ts_ms"], r["fp"]) for r in sequential.dedup_sequential(hot, "key", "fp", 2).collect()])
    for group in kept.values():
        assert all((a[3] ^ b[3]).bit_count() > 2 for a, b in zip(group, group[1:]))


def test_batches_partition_the_input(hot, events):
    out = sequential.build_batches(sequential.micro_batch(hot, "key", 2, 60_000), "key").collect()
    members = [i for r in out for i in r["screenshot_ids"]]
    assert sorted(members) == [r[0] for r in events] and {len(r["screenshot_ids"]) for r in out} <= {1, 2}
    assert len({r["batch_id"] for r in out}) == len(out) and all(r["batch_id"].startswith("batch_") and len(r["batch_id"]) == 30 for r in out)


def test_pressure_rises_at_once_and_falls_after_the_hold(spark):
    samples = [(0, 2), (1000, 9), (20_000, 2), (30_999, 2), (31_000, 2)]
    df = spark.createDataFrame([(i, "a", t, d) for i, (t, d) in enumerate(samples)], "id long, key string, ts_ms long, depth long")
    assert [r["level"] for r in sequential.pressure_levels(df, "key").orderBy("id").collect()] == [0, 2, 2, 2, 0]


def test_coalesce_timer_is_not_extended(spark):
    df = spark.createDataFrame([(i, "a", t, t - 5, t + 5) for i, t in enumerate([0, 500, 799, 800, 1500, 5000])], "id long, key string, ts_ms long, from_ms long, to_ms long")
    got = rows(sequential.coalesce_changes(df, "key"), "revision", "from_ms", "to_ms", "changes")
    assert got == [(1, -5, 804, 3), (2, 795, 1505, 2), (3, 4995, 5005, 1)]


# --- fingerprints ------------------------------------------------------------------------


def test_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("0000000000000001", "0000000000000000"), ("8a", "8a")], "a string, b string")
    got = df.select(keys.hamming(keys.fingerprint("a"), keys.fingerprint("b")).alias("d"), keys.hamming(keys.fingerprint("b"), keys.fingerprint("a")).alias("e"))
    assert [(r[0], r[1]) for r in got.collect()] == [(64, 64), (1, 1), (0, 0)]
    near = spark.createDataFrame([(255, 0), (511, 0), (5, None)], "a long, b long").select(keys.is_near_dup("a", "b"))
    assert [r[0] for r in near.collect()] == [True, False, False]


def test_phash_against_the_plain_sum(spark):
    rng = np.random.default_rng(3)
    grids = rng.integers(0, 256, (3, 32, 32))
    df = spark.createDataFrame([(i, g.ravel().tolist()) for i, g in enumerate(grids)], "id int, px array<int>")
    got = {r[0]: r[1] & (2**64 - 1) for r in df.select("id", vectors.phash(F.col("px"))).collect()}
    for i, g in enumerate(grids):
        coef = []
        for u in range(8):
            for w in range(8):
                cu, cw = (2**-0.5 if u == 0 else 1), (2**-0.5 if w == 0 else 1)
                wave = np.cos((2 * np.arange(32) + 1)[:, None] * u * np.pi / 64) * np.cos((2 * np.arange(32) + 1)[None, :] * w * np.pi / 64)
                coef.append(float((g * wave).sum() * cu * cw / 16))
        mid = sorted(coef[1:])[31]
        want = sum(1 << (63 - n) for n, c in enumerate(coef) if c > mid)
        assert (got[i] ^ want).bit_count() <= 1  # the median itself may fall either way in single precision


# --- neighbours, bands, intervals --------------------------------------------------------


def test_nearest_k_with_ties(spark, events):
    small = [(r[0], r[1], r[2]) for r in events[:500]]
    n = spark.createDataFrame(small, "id long, thread_id string, ts_ms long")
    piv = n.filter("id % 7 = 0").withColumnRenamed("id", "pivot_id")
    want = []
    for i, key, t in small:
        if i % 7:
            continue
        mates = sorted((b, a) for a, k, b in small if k == key)
        want += [(i, "before", a) for b, a in [m for m in mates if m[0] <= t][-3:]] + [(i, "after", a) for b, a in [m for m in mates if m[0] >= t][:3]]
    assert rows(joins.nearest_k(piv, n, ranges=12), "pivot_id", "side", "id") == sorted(want)


def test_band_join_with_ties(spark, events):
    small = [(r[0], r[2]) for r in events[:400]]
    n = spark.createDataFrame(small, "id long, ts_ms long")
    want = []
    for i, t in small[::9]:
        inside = sorted((b, a) for a, b in small if t - 120_000 <= b <= t + 120_000)[:6]
        want += [(i, a) for _, a in inside]
    piv = n.join(spark.createDataFrame([(i,) for i, _ in small[::9]], "id long"), "id").withColumnRenamed("id", "pivot_id")
    assert rows(joins.band_join(piv, n, ranges=12), "pivot_id", "id") == sorted(want)


def test_overlap_is_open(spark):
    w = spark.createDataFrame([(0, 10), (10, 20), (20, 30), (30, 40)], "window_start long, window_end long")
    e = spark.createDataFrame([(10, 20), (35, 36)], "start_ms long, end_ms long")
    got = rows(joins.overlapped_windows(w, e, 7), "window_start", "has_long_event")
    assert got == [(0, False), (10, True), (20, False), (30, True)]


# --- text matching -----------------------------------------------------------------------


def like(body, term):
    import re

    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term)
    return re.search(pattern, body, re.S) is not None


@pytest.mark.parametrize("bound", [1 << 20, 0])
@pytest.mark.parametrize("wild", [True, False])
def test_substring_join(spark, wild, bound):
    rnd = random.Random(1)
    letters = "ab%_é微\\ \n"
    texts = [(i, "".join(rnd.choice("abé微\\ \n") for _ in range(rnd.randrange(0, 40)))) for i in range(60)]
    terms = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 6))) for _ in range(50)} | {"%", "a", "_", "微é"}
    terms = [(n, t) for n, t in enumerate(sorted(terms))]
    t1 = spark.createDataFrame(texts, "tid long, body string")
    t2 = spark.createDataFrame(terms, "qid long, term string")
    got = rows(match.substring_join(t1, "tid", "body", t2, "qid", "term", wildcards=wild, max_broadcast=bound), "tid", "qid")
    hit = like if wild else (lambda b, t: t in b)
    assert got == sorted((i, q) for i, b in texts for q, t in terms if hit(b, t))


def test_parse_window_name(spark):
    al = spark.createDataFrame(
        [("Google Chrome", "Chrome"), ("Visual Studio Code", "Code"), ("WeChat", "微信"), ("Zoom", "zoom.us")], "canonical string, alias string"
    )
    cases = {
        "Inbox - Google Chrome": ("Google Chrome", "Inbox"),
        "main.py — Code": ("Visual Studio Code", "main.py"),
        "Chrome: News": ("Google Chrome", "News"),
        "chrome": ("Google Chrome", None),
        "Chromecast notes": (None, None),
        "微信": ("WeChat", None),
        "zoom.us | Weekly": ("Zoom", "Weekly"),
        "About Visual Studio Code today": ("Visual Studio Code", None),
        "plain": (None, None),
    }
    df = spark.createDataFrame([(n,) for n in cases], "name string")
    got = {r["name"]: (r["app"], r["title"]) for r in match.parse_window_name(df, "name", al).collect()}
    assert got == cases


def test_entity_match(spark):
    n = spark.createDataFrame([(1, ["Jane Doe"]), (2, ["repo/foo-bar"]), (3, [])], "id long, entities array<string>")
    q = spark.createDataFrame([(1, [" jane "]), (2, ["BAR", "zzz"]), (3, [" "])], "query_id long, entities array<string>")
    assert rows(filters.entity_match(n, q), "id", "query_id") == [(1, 1), (2, 2)]


def test_entity_match_shuffles_no_pairs(spark):
    """Repeated and null ids and names; pairs come from the last step, above all shuffles."""
    n = spark.createDataFrame([(1, ["Ann", None]), (1, ["Bob"]), (None, ["ann b"]), (2, ["Ann", None]), (3, None), (4, ["Bob"])], "id long, entities array<string>")
    q = spark.createDataFrame([(1, ["ANN", "b"]), (1, ["bob"]), (2, ["bo", None]), (None, ["nn"])], "query_id long, entities array<string>")
    out = filters.entity_match(n, q)
    got = sorted((r.id or 0, r.query_id or 0) for r in out.collect())
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (4, 1), (4, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < min(plan.index("Join"), plan.index("Aggregate"))


def test_index_counts_words_inside_the_row(spark):
    """Rows of one id, null ids, null and empty texts; the only aggregate is the one that brings texts together."""
    docs = spark.createDataFrame([(1, "a b, A"), (1, "b c"), (2, None), (3, " .. "), (None, "x"), (None, "X y"), (4, "\u00c9t\u00e9 \u00e9T\u00c9")], "doc_id long, text string")
    postings, lengths = search.build_index(docs)
    got = sorted((r.doc_id or 0, r.term, r.tf) for r in postings.collect())
    assert got == [(0, "x", 2), (0, "y", 1), (1, "a", 2), (1, "b", 2), (1, "c", 1), (4, "\u00e9t\u00e9", 2)]
    assert sorted((r.doc_id or 0, r.length) for r in lengths.collect() if r.doc_id in (1, 3)) == [(1, 2), (1, 3), (3, 0)]
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Generate") < plan.index("Aggregate")


# --- vectors -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    """Two thirds random, a third copies of one vector."""
    rng = np.random.default_rng(0)
    data = [(i, (rng.standard_normal(16) / 4).tolist() if i % 3 else [0.1] * 16) for i in range(600)]
    return data, spark.createDataFrame(data, "vector_id long, embedding array<float>")


def brute_knn(data, k):
    m = np.array([np.float32(v) for _, v in data], dtype=np.float64)
    out = []
    for i, v in enumerate(m):
        d = ((m - v) ** 2).sum(1)
        out += [(i, int(j)) for j in np.lexsort((np.arange(len(m)), d))[:k]]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_knn_exact(cloud, broadcast):
    data, df = cloud
    q = df.withColumnRenamed("vector_id", "query_id")
    got = vectors.knn_exact(q, df, 7, max_broadcast=broadcast, cell_queries=90, cell_vectors=70)
    assert rows(got, "query_id", "vector_id") == brute_knn(data, 7)


def test_knn_grid_copies_little(cloud):
    """Blocks grow with the input as far as their bytes allow, so copies of a row do not."""
    from worktrail.operators.vectors import CELL_BYTES, _layout

    for n in (10_000, 100_000, 500_000):
        g, h = _layout(n // 50, n, 64, 250, 250, 24)
        assert g == 1 and h <= 24
    g, h = _layout(10**6, 10**7, 64, 250, 250, 24)
    assert 10**6 / g * 64 * 8 <= CELL_BYTES and 10**7 / h * 64 * 8 <= CELL_BYTES


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_hyperplanes_compare_what_shares_a_bucket(spark, cloud, broadcast):
    """Against all pairs one by one: codes equal or one plane apart in some table; ids that repeat count once; no row per table."""
    data, df = cloud
    tables, planes, k = 3, 4, 5
    m = np.array([np.float32(v) for _, v in data], dtype=np.float64)
    a = np.random.default_rng(7).standard_normal((m.shape[1], tables * planes))
    side = (m @ a > 0).reshape(len(m), tables, planes)
    want = []
    for i in range(len(m)):
        met = np.flatnonzero(((side != side[i]).sum(2) <= 1).any(1))
        d = ((m[met] - m[i]) ** 2).sum(1)
        want += [(i, int(met[j])) for j in np.lexsort((met, d))[:k]]
    found = vectors.knn_hyperplanes(df.withColumnRenamed("vector_id", "query_id"), df.unionByName(df), k, tables=tables, planes=planes, cell_queries=90, cell_vectors=70, max_broadcast=broadcast)
    assert rows(found, "query_id", "vector_id") == sorted(want)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString() or broadcast == 0


def test_knn_lsh_recall_with_a_hot_bucket(cloud):
    _, df = cloud
    q = df.withColumnRenamed("vector_id", "query_id")
    found = vectors.knn_lsh(q, df, 7, tables=16, hashes=2, width=1.5, cell_queries=64, cell_vectors=64)
    mean = vectors.recall(found, vectors.knn_exact(q, df, 7)).agg(F.avg("recall")).first()[0]
    assert mean >= 0.9


def test_registered_index_finds_the_given_neighbours(spark):
    from worktrail.plans.queries_search import j1, j2

    found, exact = (q(spark, "/root/testdata/sf0.01") for q in (j2, j1))
    assert vectors.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_every_vector_asks_all_vectors(spark, cloud, tmp_path):
    """The registered searches against all pairs one by one; few ids are divisible by anything."""
    from worktrail.plans.queries_search import d12, j1, j2

    data = [(3 * i + 1, v) for i, v in cloud[0][:150]]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted((3 * q + 1, 3 * v + 1) for q, v in brute_knn(cloud[0][:150], vectors.TOP_K))
    for query in (j1, d12):
        assert rows(query(spark, str(tmp_path)), "query_id", "vector_id") == want
    asked = j2(spark, str(tmp_path)).select("query_id").distinct()
    assert sorted(r.query_id for r in asked.collect()) == [i for i, _ in data]


def test_full_text_queries_ask_for_whole_texts(spark):
    """All words of a text are asked for, and a document that lacks one does not match."""
    import re

    from worktrail.plans.queries_filters import fts_queries

    sf = "/root/testdata/sf0.001"
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    asked = {r.query_id: r.text for r in fts_queries(spark, sf).collect()}
    assert asked == {i: " ".join(x for x in re.split(r"[\W_]+", t.lower()) if x) for i, t in texts.items()}
    docs = spark.createDataFrame([(i, f"so {t} on") for i, t in asked.items()] + [(-i - 1, " ".join(t.split()[:-1])) for i, t in asked.items()], "doc_id long, text string")
    whole = {i: set(t.split()) for i, t in asked.items()}
    have = {r.doc_id: set(r.text.split()) for r in docs.collect()}
    postings, lengths = search.build_index(docs)
    q = fts_queries(spark, sf)
    want = sorted((i, d) for i, w in whole.items() for d, h in have.items() if w <= h)
    assert rows(search.fts_match(postings, q), "query_id", "doc_id") == want
    assert rows(search.bm25(postings, lengths, q), "query_id", "doc_id") == want



def test_phrases_against_brute_force(spark):
    """Words and phrases of cleaned queries, by place: repeated words, overlaps, reversed order, empty and null texts."""
    import math
    import re

    random.seed(7)
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    texts = ["a b a b a", "b a", "a x b", "a-b", "", None, "A, b! c", "c c c c", "b a c a b"]
    texts += [" ".join(random.choice("abcde") for _ in range(random.randint(1, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asks = ["a-b", "a b", "a-b-a", "c-c", "c.c.c d", '"b/a!" (e)', "zz a", "-", "", None, "e-d-c-b-a", "a a-a a", "B-c;d"]
    queries = spark.createDataFrame(list(enumerate(asks)), "query_id long, text string")

    def cleaned(t):
        parts = re.sub(r"[\"'`?!:;(){}\[\]]", " ", t or "").split()
        return sorted({tuple(split(p)) for p in parts} - {()})

    words = [split(t) for t in texts]
    count = lambda ws, ph: sum(tuple(ws[i : i + len(ph)]) == ph for i in range(len(ws) - len(ph) + 1))
    n, mean = len(words), sum(map(len, words)) / len(words)
    want = {}
    for q, ask in enumerate(asks):
        tf = {ph: [count(ws, ph) for ws in words] for ph in cleaned(ask)}
        for d, ws in enumerate(words):
            if tf and all(c[d] for c in tf.values()):
                idf = lambda c: max(math.log((n - sum(map(bool, c)) + 0.5) / (sum(map(bool, c)) + 0.5)), search.IDF_FLOOR)
                norm = search.K1 * (1 - search.B + search.B * len(ws) / mean)
                want[q, d] = sum(idf(c) * c[d] * (search.K1 + 1) / (c[d] + norm) for c in tf.values())
    positions = search.build_positions(docs)
    assert {(r.query_id, r.doc_id) for r in search.phrase_match(positions, queries).collect()} == set(want)
    lengths = docs.select("doc_id", F.greatest(F.size(text.tokens("text")), F.lit(0)).cast("long").alias("length"))
    got = {(r.query_id, r.doc_id): r.score for r in search.phrase_bm25(positions, lengths, queries).collect()}
    assert got == pytest.approx(want) and len(want) > 300
    assert search.phrase_match(positions, queries.limit(0)).count() == 0
    assert search.phrase_match(search.build_positions(docs.limit(0)), queries).count() == 0


# --- ranking -----------------------------------------------------------------------------


def test_lane_order_is_a_permutation(hot, events):
    now = events[-1][2]
    out = ranking.lane_order(hot.withColumn("attempts", F.col("depth") % 2), now, age_ms=10**12, ranges=12)
    got = out.orderBy("slot").collect()
    assert sorted(r["id"] for r in got) == [r[0] for r in events] and len({r["slot"] for r in got}) == len(events)
    lanes = [r["lane"] for r in got][:40]
    assert lanes == (["realtime"] * 3 + ["recovery"]) * 10


def test_answer_pool_loses_nothing(spark):
    """Choosing from the bounded pool equals choosing from all rows."""
    import pandas as pd

    rnd = random.Random(4)
    data = []
    for q in range(6):
        for rn in range(1, 901):
            data.append((q, q * 1000 + rn, rn, rnd.choice(["event", "knowledge", "state_snapshot"]), ["knowledge", None, "event"][q % 3],
                         int(rnd.random() < 0.4), rnd.randrange(1, 5000), rnd.choice(["t1", "t2", "t3", None, f"u{rn % 50}"]),
                         rnd.choice(["A", "B", "", None, f"app{rn % 90}"]), 0 if q % 2 else None, 5000 if q % 2 else None))
    schema = "query_id long, id long, rn int, kind string, kind_hint string, entity_boost int, ts_ms long, thread_id string, app_hint string, from_ms long, to_ms long"
    df = spark.createDataFrame(data, schema)
    for budget, caps in ((50, (20, 15, 10, 5)), (30, (20, 10, 0, 0)), (38, (20, 15, 3, 0))):
        assert ranking.answer_caps(budget) == caps
        got = rows(ranking.select_for_answer(df, budget), "query_id", "position", "id")
        assert got == sorted((q, n + 1, i) for q in {d[0] for d in data} for n, i in enumerate(_answer([d for d in data if d[0] == q], budget, caps)))


def _answer(rows, budget, caps):
    """One query's choice, each stage as a filter of what the stages before left."""
    pinned, hinted, threads, varied = caps
    rows = sorted(rows, key=lambda r: r[2])
    out = sorted((r for r in rows if r[3] == "event" and r[5] > 0), key=lambda r: (-r[6], r[2]))[:pinned]
    left = lambda: [r for r in rows if r not in out]
    out += [r for r in left() if r[4] and r[3] == r[4]][:hinted]
    order = list(dict.fromkeys(r[7] for r in out if r[7]))
    order.sort(key=lambda t: -max(r[6] for r in out if r[7] == t))
    out += [r for t in order for r in [x for x in left() if x[7] == t][:3]][:threads]
    if varied:
        if rows[0][9] is not None:
            width = max(1, (rows[0][10] - rows[0][9]) // varied)
            slots = [[r for r in left() if r[9] <= r[6] <= r[10] and min(varied - 1, (r[6] - r[9]) // width) == k][:1] for k in range(varied)]
            out += sorted(sum(slots, []), key=lambda r: r[2])
        seen = {r[8] for r in out}
        fresh = {}
        for r in left():
            if r[8] and r[8] not in seen:
                fresh.setdefault(r[8], r)
        out += list(fresh.values())[:varied]
    return [r[1] for r in (out + left())[:budget]]


@pytest.mark.parametrize("ranges", [1, 40, None])
def test_trailing_failure_rate(hot, events, ranges):
    df = hot.withColumn("status", F.when(F.col("fp") % 3 == 0, "failed").otherwise("succeeded"))
    out = ranking.trailing_failure_rate(df, "key", 20, ranges).collect()
    got = {r["id"]: (r["window_rows"], round(r["failure_rate"], 9), r["failure_run"], r["success_run"]) for r in out}
    want = {}
    for group in by_key(events).values():
        bad = [int(r[3] % 3 == 0) for r in group]
        run = 0
        for n, r in enumerate(group):
            run = run + 1 if n and bad[n] == bad[n - 1] else 1
            frame = bad[max(0, n - 19) : n + 1]
            want[r[0]] = (len(frame), round(sum(frame) / len(frame), 9), run if bad[n] else 0, 0 if bad[n] else run)
    assert got == want


def test_failure_bursts(spark):
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate([0, 5000, 10_000, 12_000, 40_000, 41_000, 50_000, 51_001])], "id long, k string, ts_ms long")
    got = rows(ranking.failure_bursts(df, "k"), "ts_ms", "failures", "tripped")
    assert [g[1] for g in got] == [1, 2, 3, 3, 1, 2, 3, 2]
    assert [g[0] for g in got if g[2]] == [10_000, 50_000]


def test_char_budget_counts_brackets_and_commas(spark):
    df = spark.createDataFrame([("a", i, "x" * 4) for i in range(6)], "k string, i long, js string")
    assert ranking.char_budget(df, "k", [F.col("i")], "js", 50, 2 + 4 * 3 + 2).count() == 3
    assert ranking.char_budget(df, "k", [F.col("i")], "js", 2, 1000).count() == 2


# --- normalisers -------------------------------------------------------------------------


def test_normalizers(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    assert [val(normalize.language_bucket(F.lit(s))) for s in ("english", "zh-CN", "french", "x")] == ["en", "zh", "en", "other"]
    assert [val(normalize.issue_type(F.lit(s))) for s in ("failure_reason", "123", None, "BUG")] == ["error", "warning", None, "bug"]
    assert [val(normalize.clamp(F.lit(x), 0.0, 10.0)) for x in (11.0, -1.0, None)] == [10.0, 0.0, None]
    assert len(val(normalize.cap(F.array(*[F.lit(str(i)) for i in range(7)]), 5))) == 5
    assert [val(keys.health_level(F.lit(x), 50, 200)) for x in (49, 50, 200)] == ["healthy", "warning", "critical"]
    assert val(text.ellipsis(F.lit("x" * 11), 10)) == "x" * 7 + "..." and val(text.ellipsis(F.lit("x" * 10), 10)) == "x" * 10
    region = val(normalize.text_region(F.lit("the header")))
    assert region["description"] == "the header" and list(region["box"]) == [0.0] * 4
    ents = F.array(*[F.struct(F.lit(f" n{i} ").alias("name"), F.lit("x").alias("type"), F.lit(None).cast("string").alias("raw"), F.lit(2.0).alias("confidence")) for i in range(12)])
    cleaned = val(normalize.clean_entities(ents))
    assert len(cleaned) == 10 and cleaned[0]["name"] == "n0" and cleaned[0]["type"] == "other" and cleaned[0]["confidence"] == 1.0
    assert val(normalize.json_or(F.lit('{"a": 1'), "a int", F.lit(None).cast("struct<a:int>"))) is None
    assert val(keys.minute_of_day(F.lit("23:59"))) == 1439 and val(keys.minute_of_day(F.lit("24:00"))) is None


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT wt_hamming(7L, 0L) AS h, wt_ellipsis('abcdefgh', 6) AS e, wt_window_start(1200001, 1200000) AS w, wt_clamp(12D, 0D, 10D) AS c").first()
    assert (got["h"], got["e"], got["w"], got["c"]) == (3, "abc...", 1_200_000, 10.0)


# --- assignments -------------------------------------------------------------------------


def test_assignment_violations(spark):
    a = spark.createDataFrame(
        [(1, 0, "t"), (1, 1, "NEW"), (2, 0, "t"), (2, 0, "t"), (3, 0, "t"), (3, 5, "t"), (4, 0, "NEW"), (5, 0, "t")], "batch_id long, node_index long, thread_id string"
    )
    n = spark.createDataFrame([(1, 0, 1), (5, 0, 0)], "batch_id long, thread_no long, node_index long")
    b = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 1), (5, 1), (6, 1)], "batch_id long, node_count long")
    got = {r["batch_id"]: r for r in sets.assignment_violations(a, n, b).collect()}
    assert set(got) == {2, 3, 4, 5, 6}
    assert got[2]["duplicated"] == 1 and got[2]["missing"] == 1 and got[3]["out_of_range"] == 1
    assert got[4]["new_unlisted"] == 1 and got[5]["listed_not_new"] == 1 and got[6]["missing"] == 1


def test_apply_assignments(spark):
    nodes = spark.createDataFrame(
        [(1, 1, 0, 0, None, "Mail", "p", ["x"]), (2, 1, 1, 60_000, None, "Mail", "p", ["y"]), (3, 1, 2, 5_000_000, None, "Code", None, ["y"]), (4, 9, 0, 7, "t1", "Code", "q", ["z"])],
        "id long, batch_id long, node_index long, ts_ms long, thread_id string, app_hint string, project_key string, names array<string>",
    )
    threads = spark.createDataFrame(
        [("t1", None, "old", "s", None, None, "inactive", [])],
        "thread_id string, origin_key string, title string, summary string, current_phase string, current_focus string, status string, milestones array<struct<time:bigint,description:string>>",
    )
    assign = spark.createDataFrame([(1, 0, "NEW"), (1, 1, "NEW"), (1, 2, "t1")], "batch_id long, node_index long, thread_id string")
    new = spark.createDataFrame([(1, 0, "fresh", "s", [1, 0], ["begun"])], "batch_id long, thread_no int, title string, summary string, node_indices array<bigint>, milestones array<string>")
    upd = spark.createDataFrame([(1, "t1", "new title", None, "phase", None, "done")], "batch_id long, thread_id string, title string, summary string, current_phase string, current_focus string, milestone string")
    out = sets.apply_assignments(nodes, threads, assign, upd, new, 99)
    assert out["violations"].count() == 0
    got = {r["title"]: r for r in out["threads"].collect()}
    assert set(got) == {"fresh", "new title"}
    fresh, old = got["fresh"], got["new title"]
    assert fresh["origin_key"] == "batch:1|nodes:0,1" and fresh["duration_ms"] == 60_000 and fresh["node_count"] == 2 and fresh["apps"] == ["Mail"]
    assert fresh["status"] == "active" and [m["description"] for m in fresh["milestones"]] == ["begun"]
    assert old["status"] == "active" and old["node_count"] == 2 and old["current_phase"] == "phase" and old["milestones"][0]["description"] == "done"
    again = sets.apply_assignments(out["nodes"].drop("mismatch"), out["threads"].select(*threads.columns), assign, upd.limit(0), new, 100)
    assert again["threads"].count() == 2 and again["nodes"].filter("mismatch").count() == 0


# --- search ------------------------------------------------------------------------------


def test_keyword_hits_outrank_semantic_hits(spark):
    c = spark.createDataFrame(
        [(1, 1, False, 0, 0.0, 0.0, 5, 10), (1, 2, False, 0, 0.0, 0.1, 9, 99), (1, 3, False, 0, 0.0, None, 9, 500), (1, 4, True, 0, 0.0, None, 1, 1)],
        "query_id long, id long, issue boolean, entity_boost int, app_boost double, score double, importance int, ts_ms long",
    )
    assert [r["id"] for r in ranking.rank_results(c).orderBy("rn").collect()] == [4, 1, 2, 3]


def test_fuse_ignores_order(spark):
    t = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, id long")
    k = spark.createDataFrame([(1, 2), (1, 3)], "query_id long, id long")
    s = spark.createDataFrame([(1, 3, 0.5), (1, 4, 0.2)], "query_id long, id long, score double")
    got = {r["id"]: r["score"] for r in search.fuse(t, k, s).collect()}
    assert got == {1: None, 2: 0.0, 3: 0.0, 4: 0.2}


# --- inputs ------------------------------------------------------------------------------


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("[2026-02-01 15:39:27.392 +0800] INFO: [core] hello [x]\nstack line\n[2026-02-01 15:39:28.000 +0800] ERROR: [db] boom\n")
    got = ingest.read_logs(spark, str(tmp_path)).orderBy("line_ts").collect()
    assert [(r["level"], r["module"], r["message"]) for r in got] == [("INFO", "core", "hello [x]"), ("ERROR", "db", "boom")]
    assert got[0]["line_ts"].isoformat().startswith("2026-02-01T07:39:27.392")


def test_manifest(spark, tmp_path):
    for n in ("capture-1.png", "capture-3.jpeg", "other.png", "capture-2.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["name"] for r in ingest.scan_manifest(spark, str(tmp_path)).collect()] == ["capture-3.jpeg", "capture-1.png"]


def test_capture_stream(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type":"screen","source_id":"5","display_id":"d1","app_name":" null ","window_title":" A ","ts":"2026-01-01T00:00:00Z","phash":1}\n')
    s = ingest.stream_captures(spark, str(tmp_path))
    s.writeStream.format("memory").queryName("caps").trigger(availableNow=True).start().awaitTermination(60)
    r = spark.table("caps").first()
    assert (r["source_key"], r["app_hint"], r["window_title"], r["storage_state"]) == ("screen:d1", None, "A", "ephemeral")


def test_retention_counts_each_path_once(spark):
    df = spark.createDataFrame([("a.png", "/x/a.png", 5), ("a.png", "/y/a.png", 5), ("b.png", "/x/b.png", 9)], "name string, path string, mtime_ms long")
    got = rows(ranking.retention_plan(df, 10, max_count=2, max_age_ms=100), "path", "delete")
    assert got == [("/x/a.png", True), ("/x/b.png", False), ("/y/a.png", False)]


def test_time_recall_takes_newest_cells(spark):
    """Ranges against all rows, with a burst in one millisecond, ties, ranges beyond the data and empty ones."""
    import random

    from worktrail.operators.search import time_recall

    rnd, hour = random.Random(11), 3_600_000
    rows = [(i, rnd.choice([rnd.randrange(40 * hour), 7 * hour + 5]), rnd.choice(["a", "b", None])) for i in range(600)]
    nodes = spark.createDataFrame(rows, "id long, ts_ms long, thread_id string")
    asked = [(q, rnd.randrange(-5, 40) * hour, rnd.randrange(0, 60) * hour, rnd.choice(["a", "x", None])) for q in range(40)]
    asked += [(90, -(10**15), 10**15, None), (91, 7 * hour + 5, 7 * hour + 5, "a"), (92, None, 5, None)]
    queries = spark.createDataFrame(asked, "query_id long, from_ms long, to_ms long, thread_id string")
    for limit in (1, 25, 1000):
        want = set()
        for q, lo, hi, th in asked:
            if lo is not None:
                fit = sorted(((t, i) for i, t, x in rows if lo <= t <= hi and th in (None, x)), reverse=True)
                want |= {(q, i) for _, i in fit[:limit]}
        got = [(r.query_id, r.id) for r in time_recall(nodes, queries, limit).collect()]
        assert set(got) == want and len(got) == len(want)
    assert time_recall(nodes.limit(0), queries).collect() == []


def test_time_recall_never_orders_its_pairs(spark):
    """Found pairs are read off packs: nothing above them sorts or shuffles; a pack asked for often is copied, a stretch spans packs."""
    from worktrail.operators.search import PACK_SPANS, time_recall

    nodes = spark.range(300).select("id", (F.col("id") * 10).alias("ts_ms"), F.lit("a").alias("thread_id"))
    n = 2 * PACK_SPANS + 1
    queries = spark.range(n).select(F.col("id").alias("query_id"), F.lit(55).cast("long").alias("from_ms"), F.lit(2500).cast("long").alias("to_ms"), F.lit(None).cast("string").alias("thread_id"))
    out = time_recall(nodes, queries, 70, pack_rows=64)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Generate") < plan.index("Join")
    got = out.groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert got.select("n", "lo", "hi").distinct().collect() == [(70, 181, 250)] and got.count() == n


def test_time_recall_of_a_repeated_query_id(spark):
    """Ranges of one query id, equal ones too, are one list with one limit."""
    from worktrail.operators.search import time_recall

    nodes = spark.createDataFrame([(i, i, None) for i in range(10)], "id long, ts_ms long, thread_id string")
    asked = [(1, 0, 9, None), (1, 0, 9, None), (2, 0, 3, None), (2, 8, 9, None), (None, 1, 1, None)]
    queries = spark.createDataFrame(asked, "query_id long, from_ms long, to_ms long, thread_id string")
    got = sorted(((r.query_id or 0, r.id) for r in time_recall(nodes, queries, 3).collect()))
    assert got == [(0, 1), (1, 8), (1, 9), (1, 9), (2, 3), (2, 8), (2, 9)]


def test_newest_direct_hits_are_those_of_all_hits(spark):
    """Against all hits, filtered and ordered: repeated and null ids, null times, open ranges, threads; no pair of node and query before the limit."""
    import random

    from worktrail.functions.text import keyword_terms
    from worktrail.operators.filters import keyword_hits
    from worktrail.operators.search import _newest_direct, keyword_top

    rnd = random.Random(5)
    data = [(rnd.choice([i, i, None, 7]), rnd.choice([rnd.randrange(50), None]), rnd.choice(["a", "b", None]), rnd.choice(["Mail 1", "mail 2", None]), rnd.choice(["ent x", "y"])) for i in range(300)]
    nodes = spark.createDataFrame(data, "id long, ts_ms long, thread_id string, title string, names string")
    asked = [(1, "MAIL", None, None, None, []), (2, "mail_1", 5, 40, None, ["x"]), (3, "ail", 0, 49, "a", ["y"]), (4, "none", None, None, None, []), (5, "2", None, None, "b", None), (6, "y", 3, None, None, []), (7, "mail", None, None, None, []), (7, "mail", None, None, None, []), (7, "y", 4, 30, "a", [])]
    queries = spark.createDataFrame(asked, "query_id long, text string, from_ms long, to_ms long, thread_id string, entities array<string>")
    terms = queries.select("query_id", F.explode(keyword_terms("text", F.col("entities"))).alias("term")).distinct()
    hits = keyword_hits(nodes, "id", ["title", "names"], terms).join(nodes.select("id", "ts_ms", F.col("thread_id").alias("at")), "id").join(queries, "query_id")
    hits = hits.filter("(from_ms IS NULL OR ts_ms BETWEEN from_ms AND to_ms) AND (thread_id IS NULL OR at = thread_id)")
    for limit in (1, 4, 1000):
        want = keyword_top(hits.select("query_id", "id", "ts_ms"), limit)
        got = _newest_direct(queries, nodes, ["title", "names"], limit)
        assert rows(got, "query_id", "id") == rows(want, "query_id", "id")


def test_only_rows_near_the_end_of_a_span_are_numbered(spark, monkeypatch):
    """Against all rows of each span: a burst, rows and keys without time or span, ends before, between and after all rows."""
    import random

    from worktrail.operators import search

    rnd = random.Random(3)
    at = lambda: rnd.choice([rnd.randrange(10**9), rnd.randrange(10**9), rnd.randrange(10**9), 5 * 10**8, None])
    data = [(rnd.choice("abc"), at(), i) for i in range(6000)]
    nodes = spark.createDataFrame(data, "key string, ts_ms long, id long").repartition(4)
    asked = [("a", None, 2**62), ("a", 10**8, 2 * 10**8), ("b", None, -5), ("b", 0, 5 * 10**8), ("b", None, 5 * 10**8 - 1), ("d", 0, 10**9), ("a", 7, 7)]
    spans = spark.createDataFrame(asked, "key string, from_ms long, to_ms long")
    numbered, ranges = [], search.in_ranges

    def counted(df, *rest):
        numbered.append(df.count())
        return ranges(df, *rest)

    monkeypatch.setattr(search, "in_ranges", counted)
    early = lambda r: -(2**62) if r[1] is None else r[1]
    for limit in (1, 30, 5000):
        want = []
        for key, lo, hi in asked:
            held = sorted((early(r), r[2]) for r in data if r[0] == key and early(r) <= hi and (lo is None or early(r) >= lo))
            want += [(key, lo, hi, i) for _, i in held[-limit:]]
        got = search.newest_in_spans(spans, nodes, ["key"], ["ts_ms", "id"], limit)
        order = lambda r: (r[0], r[1] or 0, r[2], r[3])
        assert sorted(((r.key, r.from_ms, r.to_ms, r.id) for r in got.collect()), key=order) == sorted(want, key=order)
    # the burst of b is one cell, which an end needs, rows without a time another; beside them there are limit rows and a cell for each end
    burst = sum(r[0] == "b" and r[1] == 5 * 10**8 for r in data)
    no_time = sum(r[0] in "ab" and r[1] is None for r in data)
    assert numbered[0] < burst + no_time + 50 and numbered[1] < burst + no_time + 300


def test_search_writes_no_whole_table(spark, monkeypatch, tmp_path):
    """Nodes, links and postings are met by few keys; results are those of the SQL."""
    import random

    import oracle

    from worktrail.operators import search
    from worktrail.plans import queries_search as q

    rnd, words = random.Random(4), ["error", "click", "kw3", "proj", "alpha", "beta", "gamma", "delta"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(8))
    say = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    apps = ["error", "click", "view", "signup", "purchase"]
    events = [(i, q.START + rnd.randrange(30 * 86_400_000), rnd.randrange(60), rnd.choice(apps), f'{{"k": {rnd.randrange(100)}}}', 1.0) for i in range(3000)]
    say(events, "event_id long, ms long, user_id long, event_type string, props string, value double", "raw")
    made = spark.read.parquet(f"{tmp_path}/raw.parquet").select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    say([(i, text()) for i in range(12)], "item_id long, text string", "benchmark")
    say([(i, f"{text()} {text()} w{i}") for i in range(60)], "doc_id long, text string", "documents")
    say([(i, [rnd.random() for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<float>", "embeddings")
    say([(rnd.randrange(3000), rnd.randrange(60)) for _ in range(9000)], "l_orderkey long, l_partkey long", "lineitem")
    wrote, cut = [], search.cut

    def watched(df):
        out = cut(df)
        wrote.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(search, "cut", watched)
    monkeypatch.setattr(q, "cut", watched)
    found = q.j6(spark, str(tmp_path))
    con = oracle.duckdb.connect()
    for name in ("events", "benchmark", "documents", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    from worktrail.plans.registry import SQL

    assert sorted(map(tuple, found.collect())) == sorted(con.execute(SQL["j6_search"]).fetchall())
    assert not [c for c, n in wrote if "title" in c and "query_id" not in c]
    assert not [c for c, n in wrote if "term" in c and n > 12]


def test_keyword_hits_of_repeated_values_are_the_same(spark):
    from worktrail.operators.filters import keyword_hits

    nodes = spark.createDataFrame([(1, "Mail 5", None), (2, "mail 5", "Ent a"), (3, "other", "ent_a"), (4, "", "x")], "id long, title string, names string")
    terms = spark.createDataFrame([(1, "MAIL"), (2, "nt_a"), (3, "zz"), (4, ""), (5, "5")], "query_id long, term string")
    both = [sorted(map(tuple, keyword_hits(nodes, "id", ["title", "names"], terms, repeated=r).collect())) for r in (False, True)]
    assert both[0] == both[1] == [(1, 1), (1, 5), (2, 1), (2, 2), (2, 5), (3, 2)]


# --- time ranges on the stored column ----------------------------------------------------


def scan_of(df):
    """The lines of the formatted plan that say what the scan skips and reads."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return "\n".join(line for line in plan.splitlines() if line.startswith(("PushedFilters", "PartitionFilters", "ReadSchema")))


def test_time_ranges_reach_the_scan(spark):
    from worktrail.plans import views as v
    from worktrail.operators import aggregates, lifecycle, ranking

    sf, lo, hi = "/root/testdata/sf0.001", 1_704_153_600_000, 1_705_363_200_000
    u = v.usage(spark, sf)
    ranged = [
        filters.within(v.nodes(spark, sf), lo, hi), aggregates.usage_summary(u, lo, hi, "c1"), aggregates.usage_by_model(u, lo, hi),
        aggregates.usage_daily(u, lo, hi), aggregates.error_rate(u, hi, {"day": 86_400_000}), aggregates.top_errors(u, hi),
        ranking.recent_errors(u, hi), lifecycle.pull_since(u, lo)[0],
    ]
    for df in ranged:
        assert "GreaterThanOrEqual(ts," in scan_of(df), scan_of(df)
    old = filters.retention_candidates(v.captures(spark, sf), spark.createDataFrame([(1, "succeeded")], "batch_id long, vlm_status string"), hi)
    assert "LessThan(ts," in scan_of(old)


def test_within_equals_comparison_of_milliseconds(spark):
    at = [None, 999, 1000, 1001, 1500, 1999, 2000, 2001, -1]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(at)], "id long, ts_ms long")
    # half a millisecond on top: the milliseconds are the floor of the stored time
    rows = rows.withColumn("ts", F.timestamp_micros(F.col("ts_ms") * 1000 + 500))
    for lo, hi in ((1000, 2000), (None, 1500), (1001, None), (-1, -1), (2000, 1000), (None, None)):
        for closed in (True, False):
            inside = lambda m: (lo is None or m >= lo) and (hi is None or (m <= hi if closed else m < hi))
            bound = lo is not None or hi is not None
            want = {i for i, m in enumerate(at) if (inside(m) if m is not None else not bound)}
            assert {r.id for r in filters.within(rows, lo, hi, closed=closed).collect()} == want
            assert {r.id for r in filters.within(rows.drop("ts"), lo, hi, closed=closed).collect()} == want


def test_scan_reads_wall_clock_times_without_a_cast(spark, tmp_path):
    from worktrail.sources.tables import scan

    path = str(tmp_path / "t.parquet")
    spark.sql("SELECT id, timestamp_ntz'2024-01-02 03:04:05.678' + make_dt_interval(id) AS ts FROM range(3)").write.parquet(path)
    df = scan(spark, path)
    assert dict(df.dtypes)["ts"] == "timestamp"
    assert [r.ms for r in df.orderBy("id").select(F.unix_millis("ts").alias("ms")).collect()] == [1704164645678 + i * 86_400_000 for i in range(3)]
    assert df.filter(F.col("ts") >= F.timestamp_millis(F.lit(1704164645679))).count() == 2


def test_percentiles_by_ranges_against_sorting(spark):
    """Values below one, heavy tails, ties, one value, one row, negatives and nulls, with a sketch that is really coarse."""
    import math

    rnd = random.Random(11)
    values = {0: [rnd.random() for _ in range(3000)], 1: [rnd.paretovariate(0.4) for _ in range(3000)], 2: [7.0] * 500, 3: [-1.5],
              4: [rnd.choice([0.0, 0.25, 0.5]) for _ in range(900)], 5: [-rnd.expovariate(1) for _ in range(1001)], 6: [0.5] * 2900 + [1e9] * 100}
    data = [(w * 1000 + rnd.randrange(1000), x) for w, xs in values.items() for x in xs] + [(8500, None), (10, None)]
    df = spark.createDataFrame(data, "ts_ms long, value double").repartition(8)
    rank = lambda xs, p: sorted(xs)[max(math.ceil(len(xs) * p), 1) - 1]
    ps = (0.01, 0.5, 0.51, 0.95, 1.0)
    want = sorted((w * 1000, len(xs), *[rank(xs, p) for p in ps]) for w, xs in values.items())
    for accuracy in (10_000, 50):
        out = aggregates.latency_percentiles(df, "ts_ms", "value", 1000, ps, accuracy)
        assert rows(out, "window_start", "n", "p1", "p50", "p51", "p95", "p100") == want
    assert aggregates.latency_percentiles(df.limit(0), "ts_ms", "value", 1000).count() == 0


def test_sql_functions_equal_their_column_forms(spark):
    register(spark)
    said = [None, "", "  ", "null", " NULL\t", "Unknown", "other", "  Ab  c　", "french", "zh-CN", "中文", "error", "It FAILED", "question", "urgent!",
            "High", "explicit", "jira_id", "09:41", "24:00", "9:41", "screen:1:2", "window:7", "no_data", "failed", "failed_permanent", "succeeded",
            "it's \"a-b\" (c)！d", "ff00ff00ff00ff00"]
    data = [(s, i * 37 - 400, (i * i) % 11 - 2, i / 9 - 0.5 if i % 4 else None, [None, True, False][i % 3], [s, " x ", ""] if i % 5 else [], i % 7 if i % 6 else None) for i, s in enumerate(said)]
    df = spark.createDataFrame(data, "c string, a long, b long, d double, flag boolean, arr array<string>, n int")
    df = df.withColumn("ints", F.array(F.col("b").cast("int"), F.lit(3), F.lit(1)))
    c, d = F.col("c"), F.col("d")
    pairs = {
        "wt_hamming(a, b)": keys.hamming("a", "b"), "wt_is_near_dup(a, b)": keys.is_near_dup("a", "b"),
        "wt_is_source_key(c)": keys.is_source_key("c"), "wt_source_kind(c)": keys.source_kind("c"),
        "wt_source_key(IF(flag, 'screen', 'window'), c, arr[1])": keys.source_key(F.when(F.col("flag"), "screen").otherwise("window"), c, F.get("arr", 1)),
        "wt_clamp(d, 0D, 1D)": normalize.clamp("d", 0.0, 1.0), "wt_ellipsis(c, 6)": text.ellipsis("c", 6), "wt_strip(c)": text.strip("c"),
        "wt_squeeze(c)": text.squeeze("c"), "wt_blank_to_null(c)": text.blank_to_null("c"), "wt_tokens(c)": text.tokens("c"),
        "wt_fts_terms(c)": text.fts_terms("c"), "wt_minute_of_day(c)": keys.minute_of_day("c"), "wt_health(d, 0.2D, 0.8D)": keys.health_level(d, 0.2, 0.8),
        "wt_summary_status(c)": keys.summary_status("c"), "wt_details_status(c)": keys.details_status("c"), "wt_text_hash(c)": text.text_hash("c"),
        "wt_marker_key(c)": keys.marker_key(c), "wt_origin_key(c, ints)": keys.origin_key(c, F.col("ints")), "wt_clean_app_hint(c)": normalize.clean_app_hint("c"),
        "wt_real_app_hint(c)": normalize.real_app_hint("c"), "wt_language_bucket(c)": normalize.language_bucket("c"), "wt_entity_type(c)": normalize.entity_type("c"),
        "wt_issue_type(c)": normalize.issue_type("c"), "wt_action_priority(c)": normalize.action_priority("c"), "wt_action_source(c)": normalize.action_source("c"),
        "wt_clean_names(arr)": normalize.clean_names("arr"), "wt_merge_hints(c, arr[1])": normalize.merge_hints(c, F.get("arr", 1)),
        "wt_boosted_importance(n, flag)": normalize.boosted_importance(F.col("n"), F.col("flag")), "wt_cap_uncited(d, arr)": normalize.cap_uncited(d, F.col("arr")),
    }
    pairs = {sql.replace("arr[1]", "get(arr, 1)"): col for sql, col in pairs.items()}
    for sql, col in pairs.items():
        got = df.select(F.expr(sql).alias("sql"), col.alias("col"), "c").collect()
        assert [r["sql"] for r in got] == [r["col"] for r in got], (sql, [(r["sql"], r["col"]) for r in got if r["sql"] != r["col"]][:3])
    hexes = spark.createDataFrame([("ff00ff00ff00ff00",), ("00",), (None,)], "c string")
    assert all(r.a == r.b for r in hexes.select(F.expr("wt_fingerprint(c)").alias("a"), keys.fingerprint("c").alias("b")).collect())
    from worktrail.functions import SQL_FUNCTIONS

    tested = {sql.split("(")[0] for sql in pairs} | {"wt_fingerprint", "wt_window_start"}
    assert tested == {s.split("(")[0] for s in SQL_FUNCTIONS}


def test_assigned_nodes_are_joined_once(spark):
    nodes = spark.createDataFrame(
        [(1, 1, 0, 0, None, "a", "p", ["x"]), (2, 1, 1, 9, "t0", "a", "p", ["y"]), (3, 1, 2, 9, None, "a", None, None), (4, 2, 0, 5, "t1", "a", "p", ["z"])],
        "id long, batch_id long, node_index long, ts_ms long, thread_id string, app_hint string, project_key string, names array<string>",
    )
    threads = spark.createDataFrame(
        [(t, None, t, "s", None, None, "inactive", []) for t in ("t0", "t1", "t2")],
        "thread_id string, origin_key string, title string, summary string, current_phase string, current_focus string, status string, milestones array<struct<time:bigint,description:string>>",
    )
    assign = spark.createDataFrame([(1, 0, "t2"), (1, 1, "t0"), (1, 2, "t2")], "batch_id long, node_index long, thread_id string")
    new = spark.createDataFrame([], "batch_id long, thread_no int, title string, summary string, node_indices array<bigint>, milestones array<string>")
    upd = spark.createDataFrame([], "batch_id long, thread_id string, title string, summary string, current_phase string, current_focus string, milestone string")
    out = sets.apply_assignments(nodes, threads, assign, upd, new, 99)
    assert "Join" not in out["nodes"]._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["thread_id"] for r in out["nodes"].collect()} == {1: "t2", 2: "t0", 3: "t2", 4: "t1"}
    assert {r["thread_id"]: r["node_count"] for r in out["threads"].collect()} == {"t0": 1, "t1": None, "t2": 2}


def test_keyword_hits_are_made_distinct_once_in_bounded_parts(spark, tmp_path):
    import re

    from worktrail.operators.filters import keyword_hits
    from worktrail.session import dealt

    rows = [(1, "alpha beta", "beta"), (1, "alpha beta", None), (2, "gamma", "ALPHA"), (None, "beta", ""), (3, None, None)]
    nodes = spark.createDataFrame(rows, "id long, a string, b string")
    terms = spark.createDataFrame([(7, "alpha"), (7, "beta"), (8, "bet_"), (9, "gamma delta")], "query_id long, term string")
    hits = keyword_hits(nodes, "id", ["a", "b"], terms)
    assert not re.search(r"Aggregate \[id#\d+L?, tid#\d+\]", hits._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(map(tuple, hits.collect()), key=str) == sorted([(1, 7), (1, 8), (2, 7), (None, 7), (None, 8)], key=str)
    nodes.repartition(3).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    split = dealt(read, 50)
    assert split.rdd.getNumPartitions() == 50 * read.rdd.getNumPartitions() and split.count() == 5

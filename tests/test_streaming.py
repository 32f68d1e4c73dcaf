"""Stream forms give what the batch forms give on the same rows."""

import pytest
from pyspark.sql import functions as F

from worktrail.operators import lifecycle, sequential
from worktrail.streaming import folds, snapshots, windows

SCHEMA = "id long, source_key string, ts timestamp, ts_ms long, phash long"


def captures(spark, n=600):
    r = spark.range(n)
    i = F.col("id")
    ts_ms = F.lit(1_704_067_200_000) + i * 7_000 + F.pmod(F.xxhash64("id"), F.lit(5_000))
    return r.select(
        i, F.when(i % 3 < 2, "window:1").otherwise(F.concat(F.lit("screen:"), (i % 5).cast("string"))).alias("source_key"),
        F.timestamp_millis(ts_ms).alias("ts"), ts_ms.alias("ts_ms"), F.pmod(F.xxhash64(F.floor(i / 3)), F.lit(64)).alias("phash"),
    )


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Rows split over six files, each a bit out of order, read one file per micro-batch."""
    path = str(tmp_path_factory.mktemp("feed"))
    rows = captures(spark)
    for part in range(6):
        rows.filter(f"id >= {part * 100} and id < {part * 100 + 100}").orderBy(F.xxhash64("id")).coalesce(1).write.mode("append").json(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


def finish(q):
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None


def test_dedup_stream(spark, feed, tmp_path):
    fold = folds.dedup_fold(stream(spark, feed), str(tmp_path), "source_key", "phash", 2, delay_ms=10_000)
    finish(fold.start(flush=True))
    waiting = spark.read.parquet(str(tmp_path / "pending" / "v=5")).count()
    batch = sequential.dedup_flags(captures(spark), "source_key", "phash", 2).select("id", "kept")
    want = {r["id"]: r["kept"] for r in batch.collect()}
    got = {r["id"]: r["kept"] for r in snapshots.read_all(spark, str(tmp_path), "out").collect()}
    assert len(got) + waiting == 600 and 0 < waiting < 10
    assert all(want[i] == k for i, k in got.items())
    for _ in range(2):  # a second drain has nothing to do
        fold.drain()
        assert {r["id"]: r["kept"] for r in snapshots.read_all(spark, str(tmp_path), "out").collect()} == want


def test_batch_stream(spark, feed, tmp_path):
    fold = folds.batch_fold(stream(spark, feed), str(tmp_path), "source_key", 3, 30_000, delay_ms=10_000)
    finish(fold.start(flush=True))
    fold.drain()
    want = {r["id"]: r["first_id"] for r in sequential.micro_batch(captures(spark), "source_key", 3, 30_000).collect()}
    assert {r["id"]: r["first_id"] for r in snapshots.read_all(spark, str(tmp_path), "out").collect()} == want


def test_rows_without_a_time_are_late_and_lost_state_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None, None, 5), (2, "a", None, 10, 5), (3, "a", None, 20, 5)], SCHEMA)
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    path = str(tmp_path / "state")
    fold = folds.dedup_fold(stream(spark, str(tmp_path / "in")), path, "source_key", "phash", 2)
    finish(fold.start(flush=True))
    fold.drain()
    assert [r.id for r in snapshots.read_all(spark, path, "late").collect()] == [1]
    assert sorted(r.id for r in snapshots.read_all(spark, path, "out").collect()) == [2, 3]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        snapshots.read_version(spark, path, "seeds", 99, spark.read.parquet(f"{path}/seeds").schema).count()


def test_window_counts_and_table(spark, feed, tmp_path):
    batch = lifecycle.complete_windows(captures(spark), 1_704_067_200_000 + 600 * 7_000)
    want = {r["window_start"]: r["node_count"] for r in batch.collect()}
    q = windows.window_counts(stream(spark, feed), delay="10 seconds").writeStream.format("memory").queryName("wc")
    q = q.outputMode("append").trigger(availableNow=True).start()
    finish(q)
    got = {r["window_start"]: r["node_count"] for r in spark.table("wc").collect()}
    assert len(got) >= 3 and all(want[s] == n for s, n in got.items())

    finish(windows.window_table(stream(spark, feed), str(tmp_path), flush=True))
    table = {r["window_start"]: r["node_count"] for r in spark.read.parquet(str(tmp_path / "windows" / "v=5")).collect()}
    assert sum(table.values()) == 600 and all(table[s] == n for s, n in want.items())


def test_sessions_stream_keeps_the_exact_gap(spark, tmp_path):
    rows = [(1, 0), (2, 600_000), (3, 1_200_001), (4, 9_000_000), (5, 99_000_000)]
    df = spark.createDataFrame([(i, "a", t) for i, t in rows], "id long, thread_id string, ts_ms long")
    batch = lifecycle.sessions(df, "thread_id")
    want = {(r["start_ms"], r["last_ms"], r["n"]) for r in batch.collect()}
    assert want == {(0, 600_000, 2), (1_200_001, 1_200_001, 1), (9_000_000, 9_000_000, 1), (99_000_000, 99_000_000, 1)}

    df.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.json(str(tmp_path / "in"))
    s = spark.readStream.schema("id long, thread_id string, ts_ms long, ts timestamp").json(str(tmp_path / "in"))
    q = windows.session_stream(s, "thread_id", gap="10 minutes").writeStream.format("memory").queryName("ss").outputMode("append")
    finish(q.trigger(availableNow=True).start())
    got = {(r["start_ms"], r["last_ms"], r["n"]) for r in spark.table("ss").collect()}
    # the last session stays open; the rest close as in the batch form
    assert got <= want and (1_200_001, 1_200_001, 1) in got


def test_idle_threads(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("b", 20_000_000), ("a", 90_000_000)], "thread_id string, ts_ms long")
    df.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.json(str(tmp_path / "in"))
    s = spark.readStream.schema("thread_id string, ts_ms long, ts timestamp").json(str(tmp_path / "in"))
    finish(windows.inactive_threads(s).writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).start())
    assert {(r[0], r[1]) for r in spark.table("idle").collect()} == {("a", 0), ("b", 20_000_000)}

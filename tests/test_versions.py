"""Tables on disk that are changed by key."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from worktrail.operators import sets
from worktrail.sources import versions

SCHEMA = "id long, name string, amount long"


def upsert(old, new):
    return sets.upsert(old, new, ["id"], ["amount"])


def held(spark, path):
    return sorted(tuple(r) for r in versions.read(spark, path).collect())


def folders(path, version):
    return sorted(p.name for p in Path(path, "rows", f"__version={version}").glob("__bucket=*"))


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.range(1_000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(0).cast("long").alias("amount")), path, ["id"], 16)
    return path


def test_only_touched_buckets_are_written(spark, table):
    assert len(folders(table, 0)) == 16
    assert versions.change(spark, table, spark.createDataFrame([(7, "x", 5), (5_000, "y", 6)], SCHEMA), upsert) == 1
    assert 1 <= len(folders(table, 1)) <= 2
    want = {i: (i, f"n{i}", 0) for i in range(1_000)} | {7: (7, "n7", 5), 5_000: (5_000, "y", 6)}
    assert held(spark, table) == sorted(want.values())


def test_a_change_applied_twice_gives_the_same_table(spark, table):
    new = spark.createDataFrame([(i, "z", i) for i in range(0, 2_000, 3)], SCHEMA)
    versions.change(spark, table, new, upsert)
    once = held(spark, table)
    assert versions.change(spark, table, new, upsert) == 2 and held(spark, table) == once and len(once) == 1_000 + 333
    versions.change(spark, table, new, lambda old, more: sets.insert_missing(old, more, ["id"]))
    assert held(spark, table) == once


def test_a_broken_off_change_is_not_seen_and_is_written_over(spark, table):
    before = held(spark, table)
    stray = spark.range(50).select("id", F.lit("lost").alias("name"), F.lit(9).cast("long").alias("amount"), F.lit(3).alias("__bucket"))
    stray.write.partitionBy("__bucket").parquet(f"{table}/rows/__version=1")
    assert held(spark, table) == before
    versions.change(spark, table, spark.createDataFrame([(1, "x", 1)], SCHEMA), upsert)
    assert held(spark, table) == sorted([*(r for r in before if r[0] != 1), (1, "n1", 1)])


def test_a_failing_change_leaves_the_table(spark, table):
    before = held(spark, table)
    broken = lambda old, new: upsert(old, new).withColumn("name", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        versions.change(spark, table, spark.createDataFrame([(1, "x", 1)], SCHEMA), broken)
    assert held(spark, table) == before


def test_empty_tables_and_no_changes(spark, tmp_path):
    path, none = str(tmp_path / "e"), spark.createDataFrame([], SCHEMA)
    versions.create(none, path, ["id"], 4)
    assert held(spark, path) == []
    assert versions.change(spark, path, none, upsert) == 0
    assert versions.change(spark, path, spark.createDataFrame([(1, None, None), (None, "a", 2)], SCHEMA), upsert) == 1
    assert sorted(versions.read(spark, path).collect(), key=str) == sorted([(1, None, None), (None, "a", 2)], key=str)


def test_columns_named_like_the_pointer_s(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(i, i * 2, "k", f"v{i}") for i in range(20)], "bucket long, held long, keys string, columns string")
    versions.create(df, path, ["bucket", "keys"], 4)
    versions.change(spark, path, df.filter("bucket < 3").withColumn("held", F.lit(-1).cast("long")), lambda old, new: sets.upsert(old, new, ["bucket", "keys"], ["held"]))
    assert held(spark, path) == [(i, -1 if i < 3 else i * 2, "k", f"v{i}") for i in range(20)]


def test_folders_of_other_versions_are_pruned(spark, table):
    versions.change(spark, table, spark.createDataFrame([(7, "x", 5)], SCHEMA), upsert)
    plan = versions.read(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()

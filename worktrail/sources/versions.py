"""Tables on disk that are changed by key: a change rewrites the buckets it touches and no others.

Rows lie in ``rows/__version=V/__bucket=B``, by a hash of their key.  A change writes its buckets below the
next version and then, in one file, a pointer that says which version of each bucket counts.  Readers go by
the newest pointer, so they see a change as a whole or not at all, and what a broken-off change left behind is
written over by the next.  One writer at a time.  Older versions stay until the table is copied by ``create``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from worktrail.session import cut

BUCKET, VERSION = "__bucket", "__version"
BUCKETS = 64


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, pointer: DataFrame, path: str, version: int) -> None:
    """The rows first, then the pointer: one row per bucket, in one file, which appears at once."""
    rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/rows/{VERSION}={version}")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/{VERSION}={version}")


def _newest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number of the newest version, and its pointer ``(bucket, held, keys, columns)``."""
    pointers = spark.read.parquet(f"{path}/pointers")
    version = pointers.agg(F.max(VERSION).alias("v")).first()["v"]
    return version, pointers.filter(F.col(VERSION) == version).drop(VERSION)


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """A new table of ``df`` in the empty folder ``path``; ``buckets`` should make a bucket a few files at most.

    Keys are hashed, so buckets are even unless one key has many rows.  An empty ``df`` makes an empty table.
    """
    pointer = df.sparkSession.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).alias("held"),
        F.lit(json.dumps(list(keys))).alias("keys"), F.lit(df.schema.json()).alias("columns"),
    )
    _write(df.withColumn(BUCKET, _bucket(keys, buckets)), pointer, path, 0)


def _held(spark: SparkSession, path: str, pointer: DataFrame, columns: str) -> DataFrame:
    """Rows of the buckets in ``pointer``, each in the version that counts; other folders are pruned by the join."""
    schema = StructType.fromJson(json.loads(columns)).add(VERSION, IntegerType()).add(BUCKET, IntegerType())
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    counts = F.broadcast(pointer.select(F.col("held").alias(VERSION), F.col("bucket").alias(BUCKET)))  # a row per bucket
    return rows.join(counts, [VERSION, BUCKET], "left_semi").drop(VERSION, BUCKET)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its newest version."""
    _, pointer = _newest(spark, path)
    return _held(spark, path, pointer, pointer.first()["columns"])


def change(spark: SparkSession, path: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Apply ``merge(rows, changes)`` to the buckets that hold a key of ``changes``; returns the newest version.

    ``changes`` has the table's key columns.  ``merge`` gives the next rows of these buckets, in the table's
    columns and with the keys of its inputs, such as ``sets.upsert`` or ``sets.insert_missing``.  Without changes nothing is written.
    """
    version, pointer = _newest(spark, path)
    first = pointer.first()
    keys, buckets = json.loads(first["keys"]), pointer.count()
    changes = cut(changes.withColumn(BUCKET, _bucket(keys, buckets)))
    touched = [r[BUCKET] for r in changes.select(BUCKET).distinct().collect()]  # numbers of buckets
    if not touched:
        return version
    hit = F.col("bucket").isin(touched)
    names = [f["name"] for f in json.loads(first["columns"])["fields"]]
    merged = merge(_held(spark, path, pointer.filter(hit), first["columns"]), changes.drop(BUCKET)).select(*names)
    moved = pointer.withColumn("held", F.when(hit, version + 1).otherwise(F.col("held")))
    _write(merged.withColumn(BUCKET, _bucket(keys, buckets)), moved, path, version + 1)
    return version + 1

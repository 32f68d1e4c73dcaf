"""Tables that grow by micro-batch: one folder per batch number, so a repeated batch overwrites itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_version(df: DataFrame, path: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/v={batch}")


def read_version(spark: SparkSession, path: str, name: str, batch: int, schema: T.StructType) -> DataFrame:
    """The snapshot that batch ``batch`` left behind; empty before the first.

    A snapshot that should be there and is not is an error: state is never begun anew in silence.
    """
    return empty(spark, schema) if batch < 0 else spark.read.schema(schema).parquet(f"{path}/{name}/v={batch}")


def last_version(spark: SparkSession, path: str, name: str) -> int:
    """The number of the latest batch that wrote the table."""
    return spark.read.parquet(f"{path}/{name}").agg({"v": "max"}).first()[0]


def read_all(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of all batches of an append-only table."""
    return spark.read.parquet(f"{path}/{name}").drop("v")

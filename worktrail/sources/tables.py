"""Typed table scans and snapshot writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

from worktrail.schemas import ENUMS, TABLES

# Column that large tables are split by on disk, so that time filters skip whole folders.
DAY_OF = {"captures": "ts", "nodes": "event_time", "model_usage_events": "ts"}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan of an entity table with its declared schema; no inference, filters reach the files."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files whose wall-clock times are read as times of the session's zone.

    The column is stored as asked for, without a cast above the scan, so that filters on it reach the files.
    """
    found = spark.read.parquet(path)
    if not any(isinstance(f.dataType, TimestampNTZType) for f in found.schema):
        return found
    zoned = lambda f: StructField(f.name, TimestampType(), f.nullable) if isinstance(f.dataType, TimestampNTZType) else f
    return spark.read.schema(StructType([zoned(f) for f in found.schema])).parquet(path)


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """Write a table; tables with an event time are laid out by day and sorted inside files."""
    ts = DAY_OF.get(name)
    if ts is None:
        df.write.mode(mode).parquet(f"{path}/{name}")
        return
    dated = df.withColumn("event_date", F.to_date(ts)).repartitionByRange("event_date", ts).sortWithinPartitions(ts)
    dated.write.mode(mode).partitionBy("event_date").parquet(f"{path}/{name}")


def invalid_values(df: DataFrame, col: str, enum: str) -> DataFrame:
    """Values outside an enumeration with their counts."""
    bad = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(ENUMS[enum]))
    return bad.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))

"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bound on the keys or ids of one frame that are sent to every task.
SHARED_ROWS = 1 << 20
# Settings every job here relies on; anything about size is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("worktrail")
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: all millisecond arithmetic is in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a temporary one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="worktrail-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the checkpoint folder: later steps neither recompute nor re-plan them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared(df: DataFrame, most: int = SHARED_ROWS) -> DataFrame:
    """``df`` of a few short columns, marked to be sent to every task if it has at most ``most`` rows.

    Counting reads it once more, so it should be written or small.  A large table that keeps only the rows of
    such keys is then not shuffled for it.
    """
    return F.broadcast(df) if df.count() <= most else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet and read back: for wide rows smaller than a checkpoint, and readers take the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, parts: int = 8) -> DataFrame:
    """Each partition of a scan dealt out to so many, and to all cores at least: for work that makes many rows of each.

    The number of partitions grows with the table, so that what a task holds does not.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, parts * df.rdd.getNumPartitions()))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than cores, dealt out to all cores before heavy work per row.

    A table of many files is returned as it is: its scan is parallel already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df

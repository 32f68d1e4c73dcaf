"""Sharding by an external shuffle in two passes: scatter into buckets, then shuffle each bucket and write it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktrail.llm.store import shared_folder, written

BUCKET_BYTES = 64 << 20
# Buckets there are at least, so that a small table is spread as well.
LEAST_BUCKETS = 1024
_GROUP = 1024


def _offsets(counts: DataFrame) -> DataFrame:
    """Rows of all buckets before each bucket: sums within groups of buckets, then over groups."""
    group = F.floor(F.col("bucket") / _GROUP)
    within = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row per 1024 buckets
    grouped = counts.withColumn("group", group)
    totals = grouped.groupBy("group").agg(F.sum("n").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0)))
    inner = grouped.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inner.join(totals, "group").select("bucket", "n", (F.col("base") + F.col("inner")).alias("offset"))


def _dealt(place: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place in the shuffled order: stretches whose lengths differ by one at most."""
    small, larger = divmod(total, shards)
    edge = larger * (small + 1)
    first = place < edge
    shard = F.when(first, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - edge) / max(small, 1)))
    slot = F.when(first, place % (small + 1)).otherwise((place - edge) % max(small, 1))
    return shard.cast("int"), slot.cast("long")


def shuffled_shards(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """Write all rows, in random order, into shards of equal counts; returns the shards as read back.

    Pass one scatters the records by a seeded hash of id and text into buckets of about ``bucket_bytes``.
    Pass two shuffles each bucket: its rows are numbered in a fixed order, and the numbers pass through
    a Fisher-Yates shuffle (``shuffle`` on the array of numbers); the shuffled order of all buckets in a row
    is cut into ``shards`` stretches.  The permutation is written once and then only read, so a task that
    runs again puts each row in the same place.

    The files (``folder``/shard=0, ...) have the given columns with ``_size`` (UTF-8 bytes of the text plus 1)
    and ``_slot`` (gapless from 0 in each shard, ascending within a file); a column of such a name is renamed
    with one more underscore.  Null ids and texts are hashed as such and kept; equal rows share a bucket, each
    has a slot of its own; an empty table gives empty shards.
    """
    spark = docs.sparkSession
    mine = ("_size", "_slot", "_bucket", "_row", "shard")
    docs = docs.withColumnsRenamed({c: f"{c}_" for c in docs.columns if c in mine})
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    total, total_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-total_bytes // bucket_bytes))
    scattered = docs.withColumns({"_size": size, "_bucket": F.pmod(F.xxhash64(id_col, text_col, F.lit(seed)), F.lit(buckets))})
    counts = scattered.groupBy(F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    order = F.shuffle(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(seed))
    permuted = written(_offsets(counts).select(F.col("bucket").alias("_bucket"), "offset", order.alias("order")), "permutation")
    numbered = scattered.withColumn("_row", F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(id_col), F.xxhash64(text_col))))
    place = F.col("offset") + F.element_at("order", F.col("_row")) - 1
    shard, slot = _dealt(place, total, shards)
    placed = numbered.join(permuted.hint("merge"), "_bucket").withColumns({"shard": shard, "_slot": slot}).drop("_bucket", "_row", "offset", "order")
    path = folder or shared_folder(spark, "shards")
    placed.sortWithinPartitions("shard", "_slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def op9_two_pass_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in eight shards of equal counts, read back from their files."""
    done = shuffled_shards(spark.read.parquet(f"{sf}/documents.parquet"))
    return done.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component), for nodes ``a`` or ``b`` of an edge, roots left out.

    Alternates two steps until nothing changes: each node hands its larger neighbours to the least of
    them, then its smaller neighbours (large star, small star).  Only minima are gathered per node, map-side
    first, so a node with very many edges is no burden; the rounds grow with the logarithm of the nodes.
    A round is one written table: both steps share the shuffled edges of the first.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a > b").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now

"""Nearest neighbours by squared L2 distance, and image fingerprints.

Distances are computed inside tasks, a block of vectors against a block of queries, and
only the best ``k`` per query leave a task: pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.operators.blocks import top_n

# Fixed values.
TOP_K = 20
GRID, HASH = 32, 8
# Bounds: queries sent to every task; when there are more, the least size of a cell, and what a side of one may take.
BROADCAST_BYTES = 64 << 20
CELL_QUERIES, CELL_VECTORS = 2_000, 20_000
CELL_BYTES = 16 << 20
# Bound on the rough distances that a task holds at once.
ROUGH = 2_000_000

_FOUND = "query_id long, vector_id long, score double"


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def _nearest(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, codes: "_Codes | None" = None) -> pd.DataFrame:
    """Best ``k`` vectors per query.  A matrix product finds who may be among them; their distances
    are then taken directly, so equal vectors get equal distances and ties go by id.

    With ``codes`` only vectors near the query in some table count, and an id counts once, by its best row.
    """
    out_q, out_v, out_d = [], [], []
    if len(q_ids) and len(v_ids):
        qq, vv = (q * q).sum(1), (v * v).sum(1)
        slack = 1e-9 * (qq.max() + vv.max() + 1.0)
        step = max(1, ROUGH // max(1, len(v_ids)))
        q_codes, v_codes = (codes.of(q), codes.of(v)) if codes else (None, None)
        rows = k * (int(np.unique(v_ids, return_counts=True)[1].max()) if codes else 1)  # so many hold k ids
        for a in range(0, len(q_ids), step):
            rough = qq[a : a + step, None] + vv[None, :] - 2.0 * (q[a : a + step] @ v.T)
            if codes:
                rough[~codes.met(q_codes[:, a : a + step], v_codes)] = np.inf
            if len(v_ids) > rows:
                bound = np.partition(rough, rows - 1, axis=1)[:, rows - 1] + slack
            else:
                bound = np.full(len(rough), np.inf)
            for i, row in enumerate(rough):
                near = np.flatnonzero((row <= bound[i]) & (row < np.inf)) if codes else np.flatnonzero(row <= bound[i])
                dist = ((v[near] - q[a + i]) ** 2).sum(1)
                best = np.lexsort((v_ids[near], dist))
                if rows > k:
                    best = best[np.sort(np.unique(v_ids[near][best], return_index=True)[1])]
                best = best[:k]
                out_q.append(np.full(len(best), q_ids[a + i]))
                out_v.append(v_ids[near][best])
                out_d.append(dist[best])
    cat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.array([], dtype=t)
    return pd.DataFrame({"query_id": cat(out_q, "int64"), "vector_id": cat(out_v, "int64"), "score": cat(out_d, "float64")})


def _best(found: pd.DataFrame, k: int, once: bool) -> pd.DataFrame:
    ordered = found.sort_values(["query_id", "score", "vector_id"], ignore_index=True)
    if once:
        ordered = ordered.drop_duplicates(["query_id", "vector_id"])
    return ordered.groupby("query_id", sort=False).head(k)


def _rank(found: DataFrame, k: int) -> DataFrame:
    return top_n(found, ["query_id"], [F.col("score"), F.col("vector_id")], k)


def _knn_broadcast(queries: DataFrame, vectors: DataFrame, k: int, chunk: int, codes: "_Codes | None") -> DataFrame:
    """A task reads vectors up to ``CELL_BYTES`` at a time and meets ``chunk`` queries after another with them."""
    rows = queries.select("query_id", "embedding").toPandas()  # at most the bound of bytes, checked by the caller
    shared = queries.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _matrix(rows["embedding"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        best: dict[int, pd.DataFrame] = {}

        def meet(ids: list[np.ndarray], held: list[np.ndarray]) -> None:
            v_ids, v = np.concatenate(ids), np.concatenate(held)
            for a in range(0, len(q_ids), chunk):
                found = _nearest(q_ids[a : a + chunk], q[a : a + chunk], v_ids, v, k, codes)
                best[a] = _best(pd.concat([best[a], found]), k, codes is not None) if a in best else found

        ids, held, size = [], [], 0
        for pdf in batches:
            if len(pdf):
                ids.append(pdf["vector_id"].to_numpy())
                held.append(_matrix(pdf["embedding"]))
                size += held[-1].nbytes
            if size >= CELL_BYTES:
                meet(ids, held)
                ids, held, size = [], [], 0
        if held:
            meet(ids, held)
        yield from best.values()

    return vectors.select("vector_id", "embedding").mapInPandas(scan, _FOUND)


def _cells(queries: DataFrame, vectors: DataFrame, on: list[str], k: int, codes: "_Codes | None" = None) -> DataFrame:
    """Best ``k`` per query inside each cell, for frames that already carry the cell columns."""

    def cell(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return _nearest(q["query_id"].to_numpy(), _matrix(q["qe"]), v["vector_id"].to_numpy(), _matrix(v["ve"]), k, codes)

    left = queries.select(*on, "query_id", F.col("embedding").alias("qe")).groupBy(*on)
    right = vectors.select(*on, "vector_id", F.col("embedding").alias("ve")).groupBy(*on)
    return left.cogroup(right).applyInPandas(cell, _FOUND)


def _layout(n_q: int, n_v: int, dims: int, cell_q: int, cell_v: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and of vectors.  A row is copied once per block of the other side, so blocks are as large
    as ``CELL_BYTES`` lets them be, as long as there is a cell for each core, and never below the sizes asked for."""
    fit = max(1, CELL_BYTES // (8 * max(1, dims)))
    g = -(-n_q // max(min(cell_q, n_q), fit)) or 1
    h = max(-(-n_v // max(cell_v, fit)), min(-(-n_v // cell_v), -(-cores // g))) or 1
    return g, h


def _knn_grid(queries: DataFrame, vectors: DataFrame, k: int, g: int, h: int, codes: "_Codes | None") -> DataFrame:
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qc", F.pmod(F.xxhash64("query_id"), F.lit(g)).cast("int")).withColumn("vc", spread(h))
    v = vectors.withColumn("vc", F.pmod(F.xxhash64("vector_id"), F.lit(h)).cast("int")).withColumn("qc", spread(g))
    return _cells(q, v, ["qc", "vc"], k, codes)


def _knn(
    queries: DataFrame, vectors: DataFrame, k: int, max_broadcast: int, cell_queries: int, cell_vectors: int, dims: int, codes: "_Codes | None",
) -> DataFrame:
    n_q = queries.count()
    if n_q * max(1, dims) * 8 <= max_broadcast:
        return _knn_broadcast(queries, vectors, k, cell_queries, codes)
    cores = 2 * queries.sparkSession.sparkContext.defaultParallelism
    return _knn_grid(queries, vectors, k, *_layout(n_q, max(1, vectors.count()), dims, cell_queries, cell_vectors, cores), codes)


def knn_exact(
    queries: DataFrame, vectors: DataFrame, k: int = TOP_K, max_broadcast: int = BROADCAST_BYTES,
    cell_queries: int = CELL_QUERIES, cell_vectors: int = CELL_VECTORS,
) -> DataFrame:
    """The ``k`` nearest vectors of each query, with rank ``rn``; ties go by id.

    ``queries(query_id, embedding)``, ``vectors(vector_id, embedding)``.  Queries that fit the
    bound go to every task and vectors are only scanned.  More queries than that are laid out
    on a grid: each vector meets each block of queries in a cell of bounded size, at least
    ``cell_queries`` by ``cell_vectors`` if there are so many.
    """
    dims = queries.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()["d"]
    return _rank(_knn(queries, vectors, k, max_broadcast, cell_queries, cell_vectors, dims, None), k)


def _bucket_udf(dim: int, tables: int, hashes: int, width: float, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((dim, tables * hashes))
    b = rng.uniform(0.0, width, tables * hashes)
    mix = rng.integers(1, 2**61, hashes, dtype=np.int64) | 1

    @F.pandas_udf("array<long>")
    def buckets(col: pd.Series) -> pd.Series:
        if not len(col):
            return pd.Series([], dtype=object)
        slot = np.floor((_matrix(col) @ a + b) / width).astype(np.int64).reshape(len(col), tables, hashes)
        with np.errstate(over="ignore"):
            return pd.Series(list((slot * mix).sum(2)))

    return buckets


def knn_lsh(
    queries: DataFrame, vectors: DataFrame, k: int = TOP_K, dim: int | None = None, tables: int = 12, hashes: int = 2,
    width: float = 1.0, seed: int = 7, cell_queries: int = CELL_QUERIES, cell_vectors: int = CELL_VECTORS,
) -> DataFrame:
    """Approximate nearest neighbours: only vectors that share a random-projection bucket are compared.

    A bucket may hold any share of the vectors, so each is split by its size into cells of
    bounded size; all candidates of a bucket are compared.  Distances are exact.
    """
    if dim is None:
        dim = vectors.agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    buckets = _bucket_udf(dim, tables, hashes, width, seed)
    hashed = lambda df: df.withColumn("__b", buckets("embedding")).select("*", F.posexplode("__b").alias("t", "b")).drop("__b")
    # fresh column identities, so that a table may be searched for its own rows
    own_names = lambda df, i: df.select(F.col(i).alias(i), F.col("embedding").alias("embedding"))
    q, v = hashed(own_names(queries, "query_id")), hashed(own_names(vectors, "vector_id"))
    return _in_buckets(q, v, k, cell_queries, cell_vectors)


class _Codes:
    """Sides of random hyperplanes as one number per table; two vectors meet if some table's differ in one plane at most."""

    def __init__(self, dim: int, tables: int, planes: int, seed: int) -> None:
        self.dim, self.tables, self.planes, self.seed = dim, tables, planes, seed

    def of(self, m: np.ndarray) -> np.ndarray:
        """Numbers by table: ``tables`` rows."""
        a = np.random.default_rng(self.seed).standard_normal((self.dim, self.tables * self.planes))
        bits = np.int64(1) << np.arange(self.planes, dtype=np.int64)
        kind = np.uint8 if self.planes <= 8 else np.uint16 if self.planes <= 16 else np.int64
        own = ((m @ a > 0).reshape(len(m), self.tables, self.planes) * bits).sum(2)
        return np.ascontiguousarray(own.T.astype(kind))

    def met(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros((q.shape[1], v.shape[1]), bool)
        for qt, vt in zip(q, v, strict=True):
            differ = qt[:, None] ^ vt[None, :]
            out |= (differ & (differ - 1)) == 0  # no bit or one
        return out


def knn_hyperplanes(
    queries: DataFrame, vectors: DataFrame, k: int = TOP_K, dim: int | None = None, tables: int = 28, planes: int = 8,
    seed: int = 7, cell_queries: int = CELL_QUERIES, cell_vectors: int = CELL_VECTORS, max_broadcast: int = BROADCAST_BYTES,
) -> DataFrame:
    """Approximate nearest neighbours by angle, for vectors of about one length.

    A query is compared with the vectors that lie, in any table, on its side of all hyperplanes or of all
    but one.  Distances are exact; ``knn_exact`` is the way that misses nothing.  Each task indexes the vectors
    it holds and answers all queries (or a block of them) from that, so a vector is not copied per table.
    """
    if dim is None:
        dim = vectors.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 1
    own = lambda df, i: df.select(F.col(i).alias(i), F.col("embedding").alias("embedding"))
    found = _knn(own(queries, "query_id"), own(vectors, "vector_id"), k, max_broadcast, cell_queries, cell_vectors, dim, _Codes(dim, tables, planes, seed))
    # one id may have rows in several tasks
    return _rank(found.groupBy("query_id", "vector_id").agg(F.min("score").alias("score")), k)


def _in_buckets(q: DataFrame, v: DataFrame, k: int, cell_queries: int, cell_vectors: int) -> DataFrame:
    """Best ``k`` per query among the vectors of its buckets ``(t, b)``, each split into cells of bounded size."""
    parts = lambda df, size, name: df.groupBy("t", "b").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = parts(q, cell_queries, "g").join(parts(v, cell_vectors, "h"), ["t", "b"])
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(sizes, ["t", "b"]).withColumn("qc", own("query_id", "g")).withColumn("vc", spread("h"))
    v = v.join(sizes, ["t", "b"]).withColumn("vc", own("vector_id", "h")).withColumn("qc", spread("g"))
    found = _cells(q, v, ["t", "b", "qc", "vc"], k)
    once = found.groupBy("query_id", "vector_id").agg(F.min("score").alias("score"))
    return _rank(once, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, per query."""
    hit = exact.join(found.select("query_id", "vector_id", F.lit(1).alias("hit")), ["query_id", "vector_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def phash(pixels: Column) -> Column:
    """64-bit fingerprint of a 32 x 32 grey grid given as 1024 values, as signed long.

    Low-frequency 8 x 8 corner of the cosine transform; a bit is set where the coefficient is
    above the median of the 63 coefficients without the mean.
    """
    i, j = np.arange(HASH)[:, None], np.arange(GRID)[None, :]
    cosine = np.cos((2 * j + 1) * i * np.pi / (2 * GRID)).astype(np.float32).astype(np.float64)
    scale = np.where(np.arange(HASH) == 0, 1 / np.sqrt(2), 1.0)

    @F.pandas_udf("long")
    def fingerprint(col: pd.Series) -> pd.Series:
        if not len(col):
            return pd.Series([], dtype="int64")
        grids = _matrix(col).reshape(-1, GRID, GRID)
        corner = cosine @ grids @ cosine.T * np.outer(scale, scale) * 2 / GRID
        flat = corner.astype(np.float32).reshape(len(col), HASH * HASH)
        median = np.median(flat[:, 1:], axis=1)
        bits = (flat > median[:, None]).astype(np.uint64)
        weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
        return pd.Series((bits * weights).sum(1, dtype=np.uint64).view(np.int64))

    return fingerprint(pixels)

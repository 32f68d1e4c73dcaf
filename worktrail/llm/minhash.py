"""Near duplicates by circulant MinHash, banding and exact verification.

Shingles are sent into [0, D) and through one permutation; coordinate ``k`` of a signature is the least value
of a second permutation, circularly shifted by ``k``.  Two permutations so make all coordinates, and the values
of one shingle for all shifts lie next to each other in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.components import components
from worktrail.llm.store import in_arrow, once, written
from worktrail.llm.words import SPACE, mix, runs, words

SHINGLE = 5
THRESHOLD = 80  # per cent
# A pair at the threshold shares no band once in 1.6 million times: (1 - 0.8 ** 5) ** 36.
BANDS, ROWS = 36, 5
DOMAIN = 1 << 20
STAR_ROUNDS = 2
# Coordinates by which sets of one bucket but of different components are told apart before full sets are compared.
LONG_COORDINATES = 1024
# Standard deviations by which the coordinates of a pair at the threshold fall short once in 3 million times.
SHORTFALL = 5
# Bits of a parity sketch: those that differ are at most the shingles that two sets do not share.
PARITY_BITS = 4096
_PART = 1 << 12


class Circulant:
    """Signatures of sets of 64-bit shingle hashes."""

    def __init__(self, coordinates: int, domain: int = DOMAIN, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.k, self.domain = coordinates, np.uint64(domain)
        self.sigma = rng.permutation(domain).astype(np.uint32)
        pi = rng.permutation(domain).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.append(pi, pi[: coordinates - 1]), coordinates)

    def signatures(self, doc: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
        """A row of coordinates per set; ``doc`` ascends."""
        out = np.full((n, self.k), np.iinfo(np.uint32).max, np.uint32)
        at = self.sigma[(shingle % self.domain).astype(np.int64)]
        for a in range(0, len(at), _PART):
            d = doc[a : a + _PART]
            first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            least = np.minimum.reduceat(self.shifted[at[a : a + _PART]], first, axis=0)
            out[d[first]] = np.minimum(out[d[first]], least)
        return out


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as (text, hash) by text and hash; of a shorter text the whole sequence."""
    w = words(texts, SPACE, lower=True)
    hashes, inside = runs(w, k)
    doc = w.doc()
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    step = np.uint64(0xA24BAED4963EE407)
    own = []
    old = np.seterr(over="ignore")
    for i in short.tolist():
        h = np.uint64(n[i])
        for x in w.hash[w.first[i] : w.first[i + 1]]:
            h = np.multiply(h, step) ^ x
        own.append(h)
    np.seterr(**old)
    doc = np.append(doc[inside], short)
    hashes = np.append(hashes[inside], mix(np.array(own, np.uint64)))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[first], hashes[first]


def parities(doc: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """Per set, for each of ``PARITY_BITS`` classes of shingles, whether it has an odd number of them; as 64-bit words.

    A class can differ between two sets only by a shingle that one of them lacks, so the bits that differ
    bound the symmetric difference from below; with few differences among many classes they nearly equal it.
    """
    at = doc * PARITY_BITS + (shingle % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = np.bincount(at, minlength=n * PARITY_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, PARITY_BITS), axis=1).view(np.int64)


def _sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per row of documents: set size, a 128-bit fingerprint of the set, the key of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = once(f"circulant {bands} {rows}", lambda: Circulant(bands * rows))
        factor = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            n = len(batch)
            doc, hashes = shingle_sets(batch.column(2), shingle)
            size = np.bincount(doc, minlength=n)
            some = np.flatnonzero(size)
            prints = [np.zeros(n, np.uint64) for _ in range(2)]
            if len(some):
                begin = np.searchsorted(doc, some)
                for p, salt in zip(prints, (1, 2), strict=True):
                    p[some] = np.add.reduceat(mix(hashes ^ mix(np.array([salt], np.uint64))), begin)
            signature = circulant.signatures(doc, hashes, n)[some].astype(np.uint64)
            keys = mix((signature * factor).reshape(len(some), bands, rows).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), *[pa.array(p.view(np.int64)) for p in prints], listed], ["id", "digest", "n", "f1", "f2", "bands"])

    return in_arrow(docs, run, "id bigint, digest bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``sid``, the full set of each row (``sid``, ``text``), the low bytes of a longer signature, a parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = once(f"circulant {LONG_COORDINATES}", lambda: Circulant(LONG_COORDINATES))
        for batch in batches:
            doc, hashes = shingle_sets(batch.column(1), shingle)
            ends = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
            low = circulant.signatures(doc, hashes, len(batch)).astype(np.uint8).view(np.int8)
            parity = parities(doc, hashes, len(batch))
            rows = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64))), rows(low), rows(parity)], ["sid", "shingles", "low", "parity"])

    return in_arrow(docs, run, "sid bigint, shingles array<bigint>, low array<tinyint>, parity array<bigint>")


def _near(a: Column, b: Column, threshold: int) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate groups: per document ``id_col``, ``n_shingles``, ``component_id`` and ``kept`` (it is the first of its group).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Documents are linked if their sets of ``shingle``-word
    shingles have 100 * intersection >= ``threshold`` * union; components of links are groups, named by their
    smallest id.  A shorter text is one shingle; a null or empty text has none, is in no group and is kept.
    Documents with equal sets are one from the start (their first stands for them).  Sets that share a band are
    candidates.  Each is compared with the first set of its buckets; then, only in buckets whose sets are not all
    connected yet, with other leaders, and at last with every set of another component that two sketches
    (parities of shingle classes, a longer signature) do not rule out.  So a bucket of copies costs its size, and no component is left out.  Links are confirmed on full sets.
    A null id counts as one id smaller than all others; rows with one id are one node; other columns are not carried.
    """
    low = -(1 << 63)
    rowed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    sketched = written(_sketches(rowed, shingle, bands, rows), "sketches")
    some = sketched.where("n > 0")
    first = some.groupBy("f1", "f2").agg(F.min(F.struct("id", "digest", "n", "bands")).alias("x"))
    sets = written(first.select("f1", "f2", "x.*").withColumn("sid", F.monotonically_increasing_id()), "sets")
    postings = sets.select("sid", "n", F.explode("bands").alias("key"))
    buckets = postings.groupBy("key").agg(F.min("sid").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    shared = written(postings.join(buckets, "key"), "buckets")
    wanted = shared.select("sid").distinct().join(sets.select("sid", "id", "digest"), "sid")
    texts = rowed.join(wanted, ["id", "digest"]).select("sid", "text")
    full = written(_sets(texts, shingle).dropDuplicates(["sid"]), "shingles")
    size = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those whose full sets are near enough."""
        one, other = (full.select(F.col("sid").alias(c), F.col("shingles").alias(f"s_{c}")) for c in ("a", "b"))
        both = F.size(F.array_intersect("s_a", "s_b"))
        found = pairs.join(other, "b").join(one, "a").withColumn("both", both)
        return found.where(100 * F.col("both") >= threshold * (F.size("s_a") + F.size("s_b") - F.col("both"))).select("a", "b")

    level, k = threshold / 100, LONG_COORDINATES
    enough = int(k * level - SHORTFALL * (k * level * (1 - level)) ** 0.5)

    star = shared.where("sid <> leader").select(F.col("leader").alias("a"), F.col("sid").alias("b"), F.col("n").alias("n_b")).distinct()
    pairs = written(star.join(size, "a").where(_near(F.col("n_a"), F.col("n_b"), threshold)).select("a", "b"), "pairs")
    tested, links = [pairs], written(verified(pairs), "links")
    found = components(links)
    for round_ in range(STAR_ROUNDS + 1):
        labelled = shared.select("key", "sid", "n").join(found, F.col("sid") == F.col("node"), "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root"))
        pick = F.min_by(F.struct("sid", "n", "root"), F.xxhash64("sid", "key", F.lit(round_)))
        mixed = labelled.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), pick.alias("p")).where("r1 < r2").select("key", "p")
        mixed = written(mixed, "mixed")
        if mixed.isEmpty():
            break
        within = labelled.join(mixed, "key")
        if round_ < STAR_ROUNDS:
            new = within.where("root <> p.root").select(F.col("p.sid").alias("x"), F.col("sid").alias("y"), F.col("p.n").alias("n_x"), F.col("n").alias("n_y"))
        else:
            held = within.select("key", "sid", "n", "root").join(sets.select("sid", "bands"), "sid").join(full.select("sid", "low", "parity"), "sid")
            x, y = (held.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("sid", "n", "root", "bands", "low", "parity")]) for side in "xy")
            # In the first band that both share, and only if neither sketch rules the pair out: the parities
            # never do so wrongly, and are near exact for small sets; the coordinates tell larger sets apart.
            once_ = F.array_min(F.array_intersect("bands_x", "bands_y")) == F.col("key")
            agree = F.aggregate(F.zip_with("low_x", "low_y", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
            differ = F.aggregate(F.zip_with("parity_x", "parity_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
            close = differ * (100 + threshold) <= (F.col("n_x") + F.col("n_y")) * (100 - threshold)
            new = x.join(y, "key").where((F.col("root_x") < F.col("root_y")) & _near(F.col("n_x"), F.col("n_y"), threshold) & once_ & close & (agree >= enough)).withColumnsRenamed({"sid_x": "x", "sid_y": "y"})
        new = new.where(_near(F.col("n_x"), F.col("n_y"), threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        for old in tested:
            new = new.join(old, ["a", "b"], "left_anti")
        new = written(new, "pairs")
        if new.isEmpty():
            continue
        tested.append(new)
        more = written(verified(new), "links")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = sets.join(found, F.col("sid") == F.col("node"), "left").select("f1", "f2", "id", F.coalesce("root", "sid").alias("root"))
    # An id with several sets joins their groups.
    ids = some.select("id", "f1", "f2").distinct().join(rooted.select("f1", "f2", "root"), ["f1", "f2"]).select("id", "root").distinct()
    named = _named(written(ids, "groups"))
    out = sketched.select("id", "n").join(named, "id", "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
    real = lambda c: F.when(F.col(c) != low, F.col(c))
    return out.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _named(ids: DataFrame) -> DataFrame:
    """``id`` and the smallest id of its group, from (``id``, ``root``); groups that an id shares are one."""
    several = ids.groupBy("id").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("id")
    if not several.isEmpty():
        linked = ids.join(several, "id").join(ids.groupBy("id").agg(F.min("root").alias("least")), "id").select(F.col("root").alias("a"), F.col("least").alias("b"))
        merged = components(linked)
        ids = ids.join(merged, F.col("root") == F.col("node"), "left").select("id", F.coalesce(merged["root"], ids["root"]).alias("root")).distinct()
    smallest = ids.groupBy("root").agg(F.min("id").alias("component"))
    return ids.join(smallest, "root").select("id", "component")


def op5_circulant_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of all documents, by shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), shingle=4)

"""Secrets in texts, told from widely copied examples by corpus-wide ownership: built-in expressions only.

Fixed patterns give the base spans.  Wider patterns give candidates; their values are hashed, and for each
hash the distinct repositories and owners that hold it are counted over the whole corpus.  A candidate that
few owners hold looks live and its span is added; one that is copied widely is an example and is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.store import written

# Kinds in their order, with pattern, the group that is measured, and its least length.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
BASE = {
    "assign": (ASSIGN, 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),  # of AKIA[A-Z0-9]+ the matches of 20 characters or more
    "hex": ("[0-9a-f]{24,}", 0, 24),  # of [0-9a-f]+ the matches of 24 characters or more
}
# Candidates beyond the base: known key formats, and long runs that mix cases and digits.
WIDER = {
    "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+", 0, 20),
    "prefixed": ("(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abprs])[_-][A-Za-z0-9_-]{16,}", 0, 20),
    "mixed": ("(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}", 0, 20),
}
MAX_OWNERS = 2
SPAN = "struct<start:int,rank:int,kind:string,end:int,hash:bigint>"


def spans_of(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """All leftmost, non-overlapping matches whose group is long enough, with places in code points.

    The matches and the stretches between them alternate, so their lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        part = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        between = F.split(text, pattern, -1)
        rows = F.arrays_zip(found.alias("m"), part.alias("g"), F.slice(between, 1, F.size(found)).alias("b"))
        zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["b"])
            e = a + F.length(x["m"])
            span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), F.xxhash64(x["g"]).alias("hash"))
            return F.struct(e.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(f"array<{SPAN}>").alias("out"))

        return F.aggregate(rows, zero, step, lambda acc: acc["out"])

    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return F.element_at(F.transform(F.array(whole), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none)), 1)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The given columns with ``base`` and ``wider``: arrays of spans, by start and kind; wider ones overlap no base span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = {**BASE, **WIDER}
    found = {k: spans_of(text, k, i, *v) for i, (k, v) in enumerate(every.items())}
    base = F.array_sort(F.concat(*[found[k] for k in BASE]))
    wider = F.array_sort(F.concat(*[found[k] for k in WIDER]))
    apart = lambda w, others: ~F.exists(others, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    out = docs.withColumns({"base": base, "wider": wider})
    return out.withColumn("wider", F.when(F.size("wider") > 0, F.filter("wider", lambda w: apart(w, F.col("base")))).otherwise(F.col("wider")))


def ownership(found: DataFrame, repo_col: str, owner_col: str, max_owners: int = MAX_OWNERS) -> DataFrame:
    """A row per candidate value (``hash``): distinct repositories and owners that hold it, and ``live``.

    Values are first made distinct per repository and owner, map-side, so one value in a third of all
    documents is a few rows per task.
    """
    held = found.select(F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.explode(F.concat("base", "wider")).alias("s"))
    held = held.select("repo", "owner", F.col("s.hash").alias("hash")).distinct()
    repos = held.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = held.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash").withColumn("live", F.col("n_owners") <= max_owners)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Secrets of each whole text: ``base`` spans, and ``added`` spans of wider candidates that few owners hold.

    Returns ``id_col``, ``base``, ``added`` (arrays of start, rank, kind, end, hash), ``n_live`` (of all candidates)
    and ``n_copied``.  A null text has no spans; null repositories and owners count as one each; repeated rows
    stay (each with its spans); an empty table gives no rows; other columns are not carried.
    """
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"))
    found = candidates(mine).select("id", "repo", "owner", "base", "wider").withColumn("key", F.monotonically_increasing_id())
    found = written(found, "candidates")  # short rows; from here on the texts are not needed
    verdicts = ownership(found, "repo", "owner", max_owners).select("hash", "live")
    some = found.where(F.size(F.concat("base", "wider")) > 0)
    exploded = some.select("key", F.explode(F.concat(F.transform("base", lambda s: F.struct(F.lit(True).alias("is_base"), s.alias("s"))), F.transform("wider", lambda s: F.struct(F.lit(False).alias("is_base"), s.alias("s"))))).alias("x"))
    judged = exploded.select("key", "x.*", F.col("x.s.hash").alias("hash")).join(verdicts, "hash")
    per_doc = judged.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_base") & F.col("live"), F.col("s")))).alias("added"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.join(per_doc, "key", "left").select(F.col("id").alias(id_col), "base", F.coalesce("added", F.expr(f"cast(array() as array<{SPAN}>)")).alias("added"), zero("n_live"), zero("n_copied"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_ownership(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of all documents; the source is repository and owner."""
    done = scan_secrets(spark.read.parquet(f"{sf}/documents.parquet"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select(
        "doc_id",
        *[n(k) for k in BASE],
        F.sha2(F.encode(span_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_copied",
    )

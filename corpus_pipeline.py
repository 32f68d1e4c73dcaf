"""The training-data pipeline: toxicity, near duplicates, benchmark passages, secrets, token ids.

Each stage gets what the one before it kept, as Parquet, and works on all of it; all but the last return
the columns of ``documents``.  Each row is judged by its own text, also if its id is null or that of other
rows.  Rows with a null text pass the filters (they match nothing) and get an empty list of ids at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from worktrail.llm.bpe import encode_decode
from worktrail.llm.decontaminate import contamination
from worktrail.llm.minhash import near_duplicates
from worktrail.llm.secrets import scan_secrets
from worktrail.llm.store import written
from worktrail.llm.toxicity import THRESHOLD, held_out, learn, score_texts

REDACTED = "[secret]"


# Rows and spans of marks that are sent to all tasks at most; more are joined by a shuffle.
SENT_MARKS = 200_000


def _carried(docs: DataFrame, **more: Column) -> DataFrame:
    """The row as one struct beside what the stage adds to it, so that no column name can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in more.items()])


def _digest() -> Column:
    """By this what was found in a text comes back to all rows that have it, whatever their ids."""
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def _marks(marks: DataFrame, name: str, size: Column) -> DataFrame:
    """Few rows about texts, written; sent to all tasks if they are small, so that the texts need no shuffle."""
    marks = written(marks, name)
    n = marks.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(marks) if n <= SENT_MARKS else marks


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labels that are not held out.

    A null or empty text has no matches and stays; repeated rows are scored each; all columns are kept as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    return score_texts(_carried(docs, text=F.col("text")), model).where(F.col("score") < THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows with one id and one text are one document and stay together; rows with one id and different texts are
    different ones (on equal ids, that with the smaller digest stays), and so is each row with a null id (smaller
    than all others).  Rows get a written key for this, since neither ids nor texts tell them apart.
    """
    keyed = written(_carried(docs, key=F.monotonically_increasing_id(), digest=F.xxhash64("text")), "keyed")
    doc_id = F.col("row.doc_id")
    unit = F.struct(doc_id.alias("doc_id"), "digest", F.when(doc_id.isNull(), F.col("key")).alias("own"))
    units = keyed.select("key", unit.alias("unit"))
    groups = near_duplicates(keyed.select("key", F.col("row.text").alias("text")), id_col="key").select(F.col("key").alias("of"), "component_id")
    # A document without words is a group by itself.
    kept = units.join(groups, F.col("key") == F.col("of")).groupBy("component_id").agg(F.min("unit").alias("unit")).select("unit.*")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"), F.col("own").alias("kept_own"))
    same = doc_id.eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    own = F.when(doc_id.isNull(), F.col("key"))
    return keyed.join(kept, same & own.eqNullSafe(F.col("kept_own")), "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; each row by its own text."""
    carried = _carried(docs, digest=_digest())
    found = contamination(carried.select("digest", F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="digest")
    gone = _marks(found.where(F.size("spans") > 0).select("digest").distinct(), "gone", F.lit(1))
    return carried.join(gone, "digest", "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret of the row's own text (base and added spans, overlapping ones as one) replaced.

    ``n_chars``, if there is such a column, follows the text; ``source`` is repository and owner, if there is one.
    """
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    carried = _carried(docs, digest=_digest(), owner=source)
    found = scan_secrets(carried.select("digest", F.col("row.text").alias("text"), "owner"), id_col="digest", repo_col="owner", owner_col="owner")
    found = found.select("digest", F.array_sort(F.concat("base", "added")).alias("spans")).where(F.size("spans") > 0)
    found = _marks(found.dropDuplicates(["digest"]), "spans", F.size("spans") + 1)  # equal texts have equal spans
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc, s):
        between = F.substring("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = s["start"] >= acc["at"]
        text = F.when(new, F.concat(acc["text"], between, F.lit(REDACTED))).otherwise(acc["text"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("text"))

    rest = lambda acc: F.concat(acc["text"], F.substring("text", acc["at"] + 1, F.length("text")))
    clean = F.aggregate("spans", start, step, rest)
    done = carried.join(found, "digest", "left").withColumn("text", F.col("row.text")).withColumn("clean", F.when(F.col("spans").isNotNull(), clean))
    row = F.when(F.col("clean").isNull(), F.col("row")).otherwise(F.struct(*[_redacted(f.name, f.dataType).alias(f.name) for f in docs.schema.fields]))
    return done.select(row.alias("row")).select("row.*")


def _redacted(name: str, kind: DataType) -> Column:
    """The column of a row whose text has changed."""
    if name == "text":
        return F.col("clean")
    return F.length("clean").cast(kind) if name == "n_chars" else F.col("row")[name]


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens`` and the digest of the decoded text of each row that is left.

    A null text has no ids; null ids and repeated rows stay as they are; other columns end here.
    """
    import public_tokenizers

    done = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]
ORACLE_SQL = None  # toxicity scores, near-duplicate groups and token ids are not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

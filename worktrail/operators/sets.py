"""Unions, set differences, keyed upserts and write-once merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.keys import origin_key, thread_id_of
from worktrail.functions.text import counted, tokens
from worktrail.operators.aggregates import key_entities, main_project, recent_nodes, thread_apps, thread_rollup
from worktrail.session import cut, stored


def merge_first(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in which the first frame that has a key gives its row."""
    union = None
    for i, df in enumerate(frames):
        part = df.withColumn("__pri", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in keys and c != "__pri"]
    best = union.groupBy(*keys).agg(F.min_by(F.struct("__pri", *rest), F.col("__pri")).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest], F.col("__row.__pri").alias("stage"))


def merge_ids(a: Column, b: Column) -> Column:
    """Union of two id lists, first occurrence kept."""
    empty = F.array().cast("array<bigint>")
    return F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))


def merge_entities(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))


def two_way_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are in one frame only, and in which."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    joined = left.join(right, list(keys), "full_outer")
    side = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right")
    return joined.withColumn("only_in", side).filter("only_in IS NOT NULL").drop("__a", "__b")


def affected_threads(assignments: DataFrame, updates: DataFrame) -> DataFrame:
    """Distinct threads that assignments or updates touch."""
    both = assignments.select("thread_id").unionByName(updates.select("thread_id"))
    return both.filter("thread_id IS NOT NULL AND thread_id <> 'NEW'").distinct()


def assignment_violations(assignments: DataFrame, new_threads: DataFrame, batches: DataFrame) -> DataFrame:
    """What is wrong with the assignments of each batch, as counts; only batches with a fault.

    ``assignments(batch_id, node_index, thread_id)``, ``new_threads(batch_id, thread_no, node_index)``
    with one row per listed index, ``batches(batch_id, node_count)``.
    """
    a = assignments.groupBy("batch_id", "node_index").agg(
        F.count("*").alias("a_rows"), F.max(F.when(F.col("thread_id") == "NEW", 1).otherwise(0)).alias("is_new")
    )
    n = new_threads.groupBy("batch_id", "node_index").agg(F.count("*").alias("n_rows"))
    cells = a.join(n, ["batch_id", "node_index"], "full_outer").join(batches, "batch_id")
    inside = F.col("node_index").between(0, F.col("node_count") - 1)
    counts = cells.groupBy("batch_id").agg(
        F.sum(F.coalesce("a_rows", F.lit(0))).alias("assigned"),
        F.count_if(F.col("a_rows").isNotNull() & inside).alias("covered"),
        F.count_if(F.col("a_rows").isNotNull() & ~inside).alias("out_of_range"),
        F.count_if(F.col("a_rows") > 1).alias("duplicated"),
        F.count_if(F.col("n_rows").isNotNull() & ~inside).alias("new_out_of_range"),
        F.count_if(F.col("n_rows") > 1).alias("new_duplicated"),
        F.count_if((F.col("is_new") == 1) & F.col("n_rows").isNull()).alias("new_unlisted"),
        F.count_if(F.col("n_rows").isNotNull() & (F.coalesce("is_new", F.lit(0)) == 0)).alias("listed_not_new"),
    )
    # a batch without any row at all misses every index
    full = batches.join(counts, "batch_id", "left").fillna(0)
    full = full.withColumn("missing", F.col("node_count") - F.col("covered"))
    faults = ["missing", "out_of_range", "duplicated", "new_out_of_range", "new_duplicated", "new_unlisted", "listed_not_new"]
    wrong = F.col("assigned") != F.col("node_count")
    for f in faults:
        wrong = wrong | (F.col(f) > 0)
    return full.filter(wrong).select("batch_id", "node_count", "assigned", *faults)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update_cols: Sequence[str]) -> DataFrame:
    """New snapshot of ``target``: absent keys are inserted, present ones change in the listed columns only.

    Both frames have the same columns; ``source`` has each key once.
    """
    rest = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*rest).alias("__old"))
    new = source.select(*keys, F.struct(*rest).alias("__new"))
    joined = old.join(new, list(keys), "full_outer")

    def value(c: str) -> Column:
        was, now = F.col(f"__old.{c}"), F.col(f"__new.{c}")
        if c in update_cols:
            return F.when(F.col("__new").isNotNull(), now).otherwise(was)
        return F.when(F.col("__old").isNotNull(), was).otherwise(now)

    return joined.select(*keys, *[value(c).alias(c) for c in rest])


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` plus the rows of ``source`` whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti"))


def diff_by_hash(target: DataFrame, source: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Change per key: ``insert``, ``update`` (digest differs), ``same`` or ``absent`` from the source."""
    a = target.select(*keys, F.col(digest).alias("__a"), F.lit(True).alias("__in_a"))
    b = source.select(*keys, F.col(digest).alias("__b"), F.lit(True).alias("__in_b"))
    change = (
        F.when(F.col("__in_a").isNull(), "insert")
        .when(F.col("__in_b").isNull(), "absent")
        .when(F.col("__a").eqNullSafe(F.col("__b")), "same")
        .otherwise("update")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def upsert_vector_docs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Next snapshot of the vector documents for the given nodes.

    Same digest: only the metadata is renewed.  New digest: text replaced, vector cleared and both
    stages queued again.  Absent: inserted.  Documents of other nodes stay.
    ``docs(vector_id, ref_id, text_content, text_hash, meta, embedding, embedding_status, index_status)``,
    ``nodes(id, text_content, meta)``.
    """
    new = nodes.select(
        F.concat(F.lit("node:"), F.col("id").cast("string")).alias("vector_id"),
        F.struct(
            F.col("id").alias("ref_id"), "text_content", F.sha2("text_content", 256).alias("text_hash"), "meta"
        ).alias("n"),
    )
    old = docs.select("vector_id", F.struct(*[c for c in docs.columns if c != "vector_id"]).alias("o"))
    both = old.join(new, "vector_id", "full_outer")
    touched, fresh = F.col("n").isNotNull(), ~F.col("o.text_hash").eqNullSafe(F.col("n.text_hash"))
    rewrite = touched & fresh
    pick = lambda cond, c: F.when(cond, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(
        "vector_id",
        pick(touched, "ref_id"),
        pick(rewrite, "text_content"),
        pick(rewrite, "text_hash"),
        pick(touched, "meta"),
        F.when(~rewrite, F.col("o.embedding")).alias("embedding"),
        F.when(rewrite, "pending").otherwise(F.col("o.embedding_status")).alias("embedding_status"),
        F.when(rewrite, "pending").otherwise(F.col("o.index_status")).alias("index_status"),
    )


def assign_once(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Nodes with ``thread_id`` filled where it was null; ``mismatch`` marks a differing assignment.

    ``assignments`` has each ``id`` once, with ``new_thread_id``.
    """
    joined = nodes.join(assignments.select("id", "new_thread_id"), "id", "left")
    clash = F.col("thread_id").isNotNull() & F.col("new_thread_id").isNotNull() & (F.col("thread_id") != F.col("new_thread_id"))
    return joined.withColumn("mismatch", F.coalesce(clash, F.lit(False))).withColumn(
        "thread_id", F.coalesce("thread_id", "new_thread_id")
    ).drop("new_thread_id")


def apply_assignments(
    nodes: DataFrame, threads: DataFrame, assignments: DataFrame, updates: DataFrame, new_threads: DataFrame, now_ms: int
) -> dict[str, DataFrame]:
    """Apply validated thread assignments: the next ``nodes`` and ``threads`` snapshots.

    ``nodes(id, batch_id, node_index, ts_ms, thread_id, app_hint, project_key, names)``;
    ``threads(thread_id, origin_key, title, summary, current_phase, current_focus, status, milestones)``;
    ``assignments(batch_id, node_index, thread_id)`` where ``NEW`` refers to
    ``new_threads(batch_id, thread_no, title, summary, node_indices, milestones)``;
    ``updates(batch_id, thread_id, title, summary, current_phase, current_focus, milestone)``.
    Batches with a violation are left out as a whole and listed in ``violations``.
    """
    listed = new_threads.select("batch_id", "thread_no", F.explode("node_indices").alias("node_index"))
    sizes = nodes.join(assignments.select("batch_id").distinct(), "batch_id", "left_semi").groupBy("batch_id").agg(
        F.count("*").alias("node_count")
    )
    violations = cut(assignment_violations(assignments, listed, sizes))
    bad = violations.select("batch_id")
    ok = lambda df: df.join(bad, "batch_id", "left_anti")

    # New threads: the same origin gives the same thread, whether it exists already or not.
    keyed = ok(new_threads).withColumn("origin_key", origin_key(F.col("batch_id"), F.col("node_indices")))
    known = threads.filter("origin_key IS NOT NULL").select("origin_key", F.col("thread_id").alias("__known"))
    keyed = keyed.join(known, "origin_key", "left").withColumn(
        "thread_id", F.coalesce("__known", thread_id_of(F.col("origin_key")))
    )
    new_ids = keyed.select("batch_id", F.explode("node_indices").alias("node_index"), F.col("thread_id").alias("__new"))
    mapped = stored(
        ok(assignments)
        .join(new_ids, ["batch_id", "node_index"], "left")
        .select(
            "batch_id", "node_index",
            F.when(F.col("thread_id") == "NEW", F.col("__new")).otherwise(F.col("thread_id")).alias("new_thread_id"),
        ),
        "mapped",
    )
    by_id = mapped.join(nodes.select("id", "batch_id", "node_index"), ["batch_id", "node_index"]).select("id", "new_thread_id")
    # nodes are joined once: written, since threads and their newest nodes are both read off them
    next_nodes = stored(assign_once(nodes, by_id), "nodes")

    stamp = lambda c: F.struct(F.lit(now_ms).cast("long").alias("time"), c.alias("description"))
    text = F.lit(None).cast("string")
    created = keyed.filter("__known IS NULL").select(
        "thread_id", "origin_key", "title", "summary", text.alias("current_phase"), text.alias("current_focus"),
        F.lit("active").alias("status"), F.transform("milestones", stamp).alias("milestones"),
    )
    base = threads.select(*created.columns).unionByName(created)
    # A thread may be updated by several batches: the last batch that sets a field wins.
    patch = ok(updates).groupBy("thread_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch_id"))).alias(f"__{c}")
          for c in ("title", "summary", "current_phase", "current_focus")],
        F.array_sort(F.collect_list(F.when(F.col("milestone").isNotNull(), F.struct("batch_id", "milestone")))).alias("__added"),
    )
    patched = base.join(patch, "thread_id", "left")
    for c in ("title", "summary", "current_phase", "current_focus"):
        patched = patched.withColumn(c, F.coalesce(f"__{c}", c))
    added = F.transform("__added", lambda m: stamp(m["milestone"]))
    patched = patched.withColumn(
        "milestones", F.when(F.col("__added").isNull(), F.col("milestones")).otherwise(F.concat("milestones", added))
    )
    touched = affected_threads(mapped.withColumnRenamed("new_thread_id", "thread_id"), ok(updates))
    of_touched = next_nodes.join(cut(touched), "thread_id", "left_semi")
    # apps, project and entities look at the newest nodes only: at most fifty rows per thread
    newest = cut(recent_nodes(of_touched.select("thread_id", "id", "ts_ms", "app_hint", "project_key", "names")).drop("recency"))
    stats = (
        thread_rollup(of_touched)
        .join(thread_apps(newest), "thread_id", "left")
        .join(main_project(newest), "thread_id", "left")
        .join(key_entities(newest), "thread_id", "left")
        .withColumn("__touched", F.lit(True))
    )
    kept = patched.select(*created.columns)
    out = kept.join(stats, "thread_id", "left").withColumn(
        "status", F.when(F.col("__touched"), "active").otherwise(F.col("status"))
    )
    return {"nodes": next_nodes, "threads": out.drop("__touched"), "violations": violations}


def term_postings(docs: DataFrame) -> DataFrame:
    """Postings ``(term, doc_id, tf)`` of ``docs(doc_id, text)``; rows with one id are one document.

    Texts are brought together by id, and words counted inside the row: no word is ever shuffled.
    """
    texts = docs.groupBy("doc_id").agg(F.collect_list("text").alias("__texts"))
    words = texts.select("doc_id", F.array_sort(F.flatten(F.transform("__texts", tokens))).alias("__words"))
    return words.select("doc_id", F.inline(counted(F.col("__words")))).select("term", "doc_id", "tf")


def refresh_postings(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after documents changed: their old rows go, their new text is tokenised.

    ``changed(doc_id, text)`` with a null text for a deleted document.
    """
    kept = postings.join(changed.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.select("term", "doc_id", "tf").unionByName(term_postings(changed))

"""Queries for stateful, incremental and snapshot operators (group I) and keyed sinks (A6, A7, D14)."""

from pyspark.sql import functions as F

from worktrail.operators import lifecycle, sequential, sets
from worktrail.operators.blocks import DAY_MS
from worktrail.operators.search import build_index
from worktrail.plans import views as v
from worktrail.plans.queries_ranking import SUMMARIES_SQL, summaries
from worktrail.plans.registry import query
from worktrail.session import shared_folder, stored
from worktrail.sources import versions

HOUR = 3_600_000
NOW = 1_705_363_200_000
WORK_NOW = 883_612_800_000


def join_ids(c):
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), ",")


def recursive(view: str) -> str:
    return v.more(view).replace("WITH ", "WITH RECURSIVE ", 1)


# --- ordered folds -----------------------------------------------------------------------

SEQ = "s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn FROM ev),\n"


def seq(spark, sf):
    return v.events(spark, sf).select(F.col("event_id").alias("id"), "user_id", "ts_ms", "k", "event_type")


@query(
    "i1_dedup_sequential",
    recursive("ev") + SEQ + """r AS (SELECT user_id, rn, event_id, k AS last, true AS kept FROM s WHERE rn = 1 UNION ALL
 SELECT s.user_id, s.rn, s.event_id, CASE WHEN bit_count(xor(s.k, r.last)) > 2 THEN s.k ELSE r.last END, bit_count(xor(s.k, r.last)) > 2
 FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT event_id AS id, user_id FROM r WHERE kept""",
)
def i1(spark, sf):
    return sequential.dedup_sequential(seq(spark, sf), "user_id", "k", 2).select("id", "user_id")


BATCHES = recursive("ev") + SEQ + """r AS (SELECT user_id, rn, event_id, ts_ms, ts_ms AS t0, event_id AS first_id, 1 AS n FROM s WHERE rn = 1 UNION ALL
 SELECT s.user_id, s.rn, s.event_id, s.ts_ms, CASE WHEN r.n >= 2 OR s.ts_ms - r.t0 >= 21600000 THEN s.ts_ms ELSE r.t0 END,
 CASE WHEN r.n >= 2 OR s.ts_ms - r.t0 >= 21600000 THEN s.event_id ELSE r.first_id END, CASE WHEN r.n >= 2 OR s.ts_ms - r.t0 >= 21600000 THEN 1 ELSE r.n + 1 END
 FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)"""


@query("i2_micro_batch", BATCHES + "SELECT event_id AS id, first_id FROM r")
def i2(spark, sf):
    return sequential.micro_batch(seq(spark, sf), "user_id", timeout_ms=6 * HOUR).select("id", "first_id")


@query(
    "i3_build_batches",
    BATCHES + """, g AS (SELECT user_id, first_id, min(ts_ms) AS ts_start, max(ts_ms) AS ts_end, string_agg(event_id::VARCHAR, ',' ORDER BY ts_ms, event_id) AS ids FROM r GROUP BY 1, 2)
SELECT ts_start, ts_end, ids, 'batch_' || left(sha256('{"sourceKey":"' || 'window:' || user_id || '","tsStart":' || ts_start || ',"tsEnd":' || ts_end || ',"screenshotIds":[' || ids || ']}'), 24) AS batch_id FROM g""",
)
def i3(spark, sf):
    rows = seq(spark, sf).withColumn("source_key", F.concat(F.lit("window:"), F.col("user_id").cast("string")))
    out = sequential.build_batches(sequential.micro_batch(rows, "source_key", timeout_ms=6 * HOUR))
    return out.select("ts_start", "ts_end", join_ids("screenshot_ids").alias("ids"), "batch_id")


LEVEL = "CASE WHEN {0} <= 3 THEN 0 WHEN {0} <= 7 THEN 1 WHEN {0} <= 11 THEN 2 ELSE 3 END"


@query(
    "i11_pressure_levels",
    recursive("ev") + SEQ + f"""w AS (SELECT user_id, rn, event_id, ts_ms, {LEVEL.format('(k % 16)')} AS want FROM s),
r AS (SELECT user_id, rn, event_id, want AS level, CASE WHEN want > 0 THEN ts_ms END AS changed FROM w WHERE rn = 1 UNION ALL
 SELECT w.user_id, w.rn, w.event_id, CASE WHEN w.want > r.level OR (w.want < r.level AND (r.changed IS NULL OR w.ts_ms - r.changed >= 43200000)) THEN w.want ELSE r.level END,
 CASE WHEN w.want > r.level OR (w.want < r.level AND (r.changed IS NULL OR w.ts_ms - r.changed >= 43200000)) THEN w.ts_ms ELSE r.changed END
 FROM r JOIN w ON w.user_id = r.user_id AND w.rn = r.rn + 1)
SELECT event_id AS id, level FROM r""",
)
def i11(spark, sf):
    rows = seq(spark, sf).withColumn("depth", F.col("k") % 16)
    return sequential.pressure_levels(rows, "user_id", hold_ms=12 * HOUR).select("id", "level")


@query(
    "i12_throttle",
    recursive("ev") + SEQ + """r AS (SELECT user_id, rn, event_id, CASE WHEN event_type <> 'error' THEN ts_ms END AS last, true AS shown FROM s WHERE rn = 1 UNION ALL
 SELECT s.user_id, s.rn, s.event_id, CASE WHEN s.event_type <> 'error' AND (r.last IS NULL OR s.ts_ms - r.last >= 28800000) THEN s.ts_ms ELSE r.last END,
 s.event_type = 'error' OR r.last IS NULL OR s.ts_ms - r.last >= 28800000 FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT event_id AS id, shown FROM r""",
)
def i12(spark, sf):
    rows = seq(spark, sf).withColumn("critical", F.col("event_type") == "error")
    return sequential.throttle(rows, "user_id", 8 * HOUR).select("id", "shown")


@query(
    "i14_coalesce_changes",
    recursive("ev") + SEQ + """r AS (SELECT user_id, rn, ts_ms, k, ts_ms AS opened FROM s WHERE rn = 1 UNION ALL
 SELECT s.user_id, s.rn, s.ts_ms, s.k, CASE WHEN s.ts_ms - r.opened >= 36000000 THEN s.ts_ms ELSE r.opened END FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1),
g AS (SELECT user_id, opened, min(ts_ms - k * 60000) AS from_ms, max(ts_ms + k * 1000) AS to_ms, count(*) AS changes FROM r GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY opened) AS revision FROM g""",
)
def i14(spark, sf):
    k, t = F.col("k"), F.col("ts_ms")
    rows = seq(spark, sf).withColumn("from_ms", t - k * 60_000).withColumn("to_ms", t + k * 1000)
    return sequential.coalesce_changes(rows, "user_id", 10 * HOUR)


# --- windows, sessions, triggers ---------------------------------------------------------


@query(
    "i4_tumble",
    v.cte("nodes") + "SELECT ts_ms // 1200000 * 1200000 AS window_start, ts_ms // 1200000 * 1200000 + 1200000 AS window_end, count(*) AS n FROM nodes GROUP BY 1, 2",
)
def i4(spark, sf):
    return lifecycle.tumble(v.nodes(spark, sf)).groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@query(
    "i5_complete_windows",
    v.cte("nodes") + f"""SELECT ts_ms // 1200000 * 1200000 AS window_start, ts_ms // 1200000 * 1200000 + 1200000 AS window_end, count(*) AS node_count
FROM nodes WHERE ts_ms // 1200000 * 1200000 + 1200000 <= {NOW + 777_777} GROUP BY 1, 2""",
)
def i5(spark, sf):
    return lifecycle.complete_windows(v.nodes(spark, sf), NOW + 777_777)


@query(
    "i6_reopen_windows",
    v.more("nodes") + SUMMARIES_SQL + f""",
t AS (SELECT *, status = 'no_data' AND window_start IN (SELECT ts_ms // 1200000 * 1200000 FROM nodes WHERE k % 2 = 0) AS again FROM sm)
SELECT window_start, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE 1 END AS attempts,
CASE WHEN again THEN {NOW} ELSE updated_ms END AS next_run_at FROM t""",
)
def i6(spark, sf):
    s = summaries(spark, sf).withColumn("attempts", F.lit(1)).withColumn("next_run_at", F.col("updated_ms"))
    late = v.nodes(spark, sf).filter("k % 2 = 0")
    return lifecycle.reopen_windows(s, late, NOW).select("window_start", "status", "attempts", "next_run_at")


@query(
    "i7_mark_inactive",
    v.cte("threads") + "SELECT thread_id, CASE WHEN status = 'active' AND last_active_ms < 1706600000000 - 14400000 THEN 'inactive' ELSE status END AS status FROM threads",
)
def i7(spark, sf):
    return lifecycle.mark_inactive(v.threads(spark, sf), 1_706_600_000_000).select("thread_id", "status")


@query(
    "i8_sessions",
    v.more("nodes") + """d AS (SELECT thread_id, id, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY thread_id ORDER BY ts_ms, id) AS d FROM nodes WHERE thread_id IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY ts_ms, id) AS session FROM d)
SELECT thread_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n FROM s GROUP BY thread_id, session""",
)
def i8(spark, sf):
    return lifecycle.sessions(v.nodes(spark, sf), "thread_id", 6 * HOUR)


OUTCOME = "CASE WHEN id % 5 < 4 THEN id % 3 = 0 END"


@query(
    "i9_transition",
    v.more("work") + f"""o AS (SELECT *, {OUTCOME} AS ok FROM work),
d AS (SELECT *, ok IS NOT NULL AND status IN ('pending', 'failed') AND attempts < 2 AND (next_run_at IS NULL OR next_run_at <= {WORK_NOW}) AS ran FROM o),
f AS (SELECT *, ran AND NOT ok AND attempts + 1 >= 2 AS final FROM d)
SELECT id, CASE WHEN ran AND ok THEN 'succeeded' WHEN final THEN 'failed_permanent' WHEN ran THEN 'failed' ELSE status END AS status,
attempts + CASE WHEN ran THEN 1 ELSE 0 END AS attempts, CASE WHEN ran AND NOT ok AND NOT final THEN {WORK_NOW + 60_000} WHEN NOT ran THEN next_run_at END AS next_run_at,
CASE WHEN ran AND ok THEN 'pending' WHEN final THEN 'failed_permanent' ELSE upstream_status END AS downstream_status FROM f""",
)
def i9(spark, sf):
    w = v.work(spark, sf).withColumnRenamed("upstream_status", "downstream_status")
    outcomes = w.filter("id % 5 < 4").select("id", (F.col("id") % 3 == 0).alias("ok"))
    return lifecycle.transition(w, outcomes, WORK_NOW)


@query(
    "i10_recover_stale",
    v.more("work") + f"""s AS (SELECT *, status = 'running' AND ts_ms < {WORK_NOW} - 300000 AS stale, status = 'failed_permanent' AND upstream_status = 'pending' AS orphan FROM work),
f AS (SELECT *, stale AND attempts >= 2 AS final FROM s)
SELECT id, CASE WHEN final THEN 'failed_permanent' WHEN stale THEN 'pending' ELSE status END AS status, attempts, CASE WHEN NOT stale THEN next_run_at END AS next_run_at,
CASE WHEN final OR orphan THEN 'failed_permanent' ELSE upstream_status END AS downstream_status,
CASE WHEN final THEN 'permanent' WHEN stale THEN 'recovered' WHEN orphan THEN 'orphaned' END AS recovery FROM f""",
)
def i10(spark, sf):
    w = v.work(spark, sf).withColumnRenamed("upstream_status", "downstream_status").withColumn("updated_ms", F.col("ts_ms"))
    return lifecycle.recover_stale(w, WORK_NOW)


@query(
    "i13_needs_refresh",
    v.more("threads") + """l AS (SELECT thread_id, node_count - num % 100 AS n0, last_active_ms - num % 40 * 60000 AS t0 FROM threads WHERE num % 4 <> 0)
SELECT thread_id FROM threads JOIN l USING (thread_id) WHERE (node_count - n0 >= 50 AND last_active_ms - t0 >= 600000) OR thread_id LIKE '%7'""",
)
def i13(spark, sf):
    t = v.threads(spark, sf)
    num = F.substring("thread_id", 2, 20).cast("long")
    last = t.filter(num % 4 != 0).select(
        "thread_id", (F.col("node_count") - num % 100).alias("node_count"), (F.col("last_active_ms") - num % 40 * 60_000).alias("last_active_ms")
    )
    return lifecycle.needs_refresh(t, last, t.filter("thread_id LIKE '%7'")).select("thread_id")


@query(
    "i15_changes_only",
    v.more("ev") + "d AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS p FROM ev)\nSELECT event_id AS id FROM d WHERE p IS NULL OR p <> event_type",
)
def i15(spark, sf):
    return sequential.changes_only(seq(spark, sf), "user_id", "event_type").select("id")


@query("i19_pull_since", v.cte("usage") + f"SELECT id, max(ts_ms) OVER () AS mark FROM usage WHERE ts_ms > {NOW}")
def i19(spark, sf):
    fresh, mark = lifecycle.pull_since(v.usage(spark, sf), NOW)
    return fresh.select("id", mark.scalar().alias("mark"))


@query(
    "i24_schedule_changes",
    v.more("ev") + """s AS (SELECT user_id, event_id, ts_ms, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM ev),
t AS (SELECT *, CASE WHEN m BETWEEN 600 AND 720 OR m BETWEEN 840 AND 1080 THEN 'running' ELSE 'paused' END AS state FROM s),
d AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS p FROM t)
SELECT event_id AS id, state FROM d WHERE p IS NULL OR p <> state""",
)
def i24(spark, sf):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    ticks = v.events(spark, sf).withColumnRenamed("event_id", "id")
    windows = F.array(span("10:00", "12:00"), span("14:00", "18:00"))
    return lifecycle.schedule_changes(ticks, "user_id", windows).select("id", "state")


# --- snapshots ---------------------------------------------------------------------------


def customers(spark, sf):
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))


def part_rows(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("amount"))


PAIR_SQL = "a AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS amount FROM customer), b AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS amount FROM part WHERE p_partkey % 2 = 0)"


@query(
    "a6_upsert",
    f"WITH {PAIR_SQL}\nSELECT id, coalesce(a.name, b.name) AS name, CASE WHEN b.id IS NOT NULL THEN b.amount ELSE a.amount END AS amount FROM a FULL JOIN b USING (id)",
)
def a6(spark, sf):
    return sets.upsert(customers(spark, sf), part_rows(spark, sf).filter("id % 2 = 0"), ["id"], ["amount"])


@query("a7_insert_missing", f"WITH {PAIR_SQL}\nSELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def a7(spark, sf):
    return sets.insert_missing(customers(spark, sf), part_rows(spark, sf).filter("id % 2 = 0"), ["id"])


def kept(spark, rows, keys, changes, merge):
    """The rows as a table on disk, changed by key and read back."""
    path = shared_folder(spark, "table")
    versions.create(rows, path, keys)
    versions.change(spark, path, changes, merge)
    return versions.read(spark, path)


@query(
    "a6_upsert_table",
    f"WITH {PAIR_SQL}\nSELECT id, coalesce(a.name, b.name) AS name, CASE WHEN b.id IS NOT NULL THEN b.amount ELSE a.amount END AS amount FROM a FULL JOIN b USING (id)",
)
def a6_table(spark, sf):
    merge = lambda old, new: sets.upsert(old, new, ["id"], ["amount"])
    return kept(spark, customers(spark, sf), ["id"], part_rows(spark, sf).filter("id % 2 = 0"), merge)


@query("a7_insert_table", f"WITH {PAIR_SQL}\nSELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def a7_table(spark, sf):
    merge = lambda old, new: sets.insert_missing(old, new, ["id"])
    return kept(spark, customers(spark, sf), ["id"], part_rows(spark, sf).filter("id % 2 = 0"), merge)


@query(
    "d14_diff_by_hash",
    """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN a.h IS NULL THEN 'insert' WHEN b.h IS NULL THEN 'absent' WHEN a.h = b.h THEN 'same' ELSE 'update' END AS change FROM a FULL JOIN b USING (doc_id)""",
)
def d14(spark, sf):
    d, i = v.table(spark, sf, "documents"), F.col("doc_id")
    a = d.filter(i % 3 != 0).select("doc_id", F.sha2("text", 256).alias("h"))
    b = d.filter(i % 5 != 0).select("doc_id", F.sha2(F.when(i % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return sets.diff_by_hash(a, b, ["doc_id"], "h")


@query(
    "i16_upsert_vector_docs",
    """WITH o AS (SELECT 'node:' || doc_id AS vector_id, doc_id AS ref_id, sha256(text) AS text_hash, lang AS meta, n_chars AS embedding, 'succeeded' AS st FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT 'node:' || doc_id AS vector_id, doc_id AS ref_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS text_hash, source AS meta FROM documents WHERE doc_id % 5 <> 0),
j AS (SELECT vector_id, o.ref_id AS r0, n.ref_id AS r1, o.text_hash AS h0, n.text_hash AS h1, o.meta AS m0, n.meta AS m1, embedding, st, n.ref_id IS NOT NULL AS touched,
 n.ref_id IS NOT NULL AND o.text_hash IS DISTINCT FROM n.text_hash AS rewrite FROM o FULL JOIN n USING (vector_id))
SELECT vector_id, CASE WHEN touched THEN r1 ELSE r0 END AS ref_id, CASE WHEN rewrite THEN h1 ELSE h0 END AS text_hash, CASE WHEN touched THEN m1 ELSE m0 END AS meta,
CASE WHEN NOT rewrite THEN embedding END AS embedding, CASE WHEN rewrite THEN 'pending' ELSE st END AS embedding_status, CASE WHEN rewrite THEN 'pending' ELSE st END AS index_status FROM j""",
)
def i16(spark, sf):
    d, i = v.table(spark, sf, "documents"), F.col("doc_id")
    old = d.filter(i % 3 != 0).select(
        F.concat(F.lit("node:"), i.cast("string")).alias("vector_id"), i.alias("ref_id"), F.col("text").alias("text_content"),
        F.sha2("text", 256).alias("text_hash"), F.col("lang").alias("meta"), F.col("n_chars").alias("embedding"),
        F.lit("succeeded").alias("embedding_status"), F.lit("succeeded").alias("index_status"),
    )
    new = d.filter(i % 5 != 0).select(
        i.alias("id"), F.when(i % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text_content"), F.col("source").alias("meta")
    )
    return sets.upsert_vector_docs(old, new).drop("text_content")


@query(
    "i17_assign_once",
    v.cte("nodes") + """SELECT id, coalesce(thread_id, CASE WHEN id % 3 <> 0 THEN 't' || (k % 50) END) AS thread_id,
coalesce(id % 3 <> 0 AND thread_id <> 't' || (k % 50), false) AS mismatch FROM nodes""",
)
def i17(spark, sf):
    n = v.nodes(spark, sf)
    a = n.filter("id % 3 <> 0").select("id", F.concat(F.lit("t"), (F.col("k") % 50).cast("string")).alias("new_thread_id"))
    return sets.assign_once(n.select("id", "thread_id"), a)


@query(
    "i17_assign_table",
    v.cte("nodes") + "SELECT id, coalesce(thread_id, CASE WHEN id % 3 <> 0 THEN 't' || (k % 50) END) AS thread_id FROM nodes",
)
def i17_table(spark, sf):
    n = v.nodes(spark, sf)
    a = n.filter("id % 3 <> 0").select("id", F.concat(F.lit("t"), (F.col("k") % 50).cast("string")).alias("new_thread_id"))
    return kept(spark, n.select("id", "thread_id"), ["id"], a, lambda old, new: sets.assign_once(old, new).drop("mismatch"))


@query(
    "i18_apply_assignments",
    """WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(epoch_us(l_shipdate) // 1000) AS t FROM lineitem GROUP BY 1, 2),
n AS (SELECT l_orderkey AS batch_id, l_orderkey * 10 + l_linenumber AS id, p, s, t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS node_index FROM li),
a AS (SELECT *, CASE WHEN p % 3 = 0 THEN 'NEW' ELSE 's' || s END AS thread_id FROM n),
g AS (SELECT batch_id, 'batch:' || batch_id || '|nodes:' || string_agg(node_index::VARCHAR, ',' ORDER BY node_index) AS origin,
 bool_or(p % 50 = 0) AS bad FROM a WHERE thread_id = 'NEW' GROUP BY 1),
m AS (SELECT a.batch_id, id, t, coalesce(bad, false) AS bad, CASE WHEN a.thread_id = 'NEW' THEN sha256(origin) ELSE a.thread_id END AS thread_id FROM a LEFT JOIN g USING (batch_id)),
ok AS (SELECT * FROM m WHERE NOT bad),
th AS (SELECT thread_id, min(t) AS start_ms, max(t) AS last_active_ms, count(*) AS node_count FROM ok GROUP BY 1)
SELECT thread_id, start_ms, last_active_ms, node_count FROM th
UNION ALL SELECT 's' || s_suppkey, NULL, NULL, NULL FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT thread_id FROM th)""",
)
def i18(spark, sf):
    c = F.col
    li = (
        v.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min(F.unix_millis(c("l_shipdate").cast("timestamp"))).alias("ts_ms"))
    )
    # a node's index is its place among the lines of its order: at most seven lines
    order = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    text = F.lit(None).cast("string")
    nodes = stored(li.join(order, "l_orderkey").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_orderkey").alias("batch_id"),
        (F.array_position("lines", c("l_linenumber")) - 1).cast("long").alias("node_index"), "ts_ms", text.alias("thread_id"),
        F.lit("app").alias("app_hint"), F.lit("proj").alias("project_key"), F.array(F.lit("e")).alias("names"), "p", "s",
    ), "nodes")
    assignments = nodes.select(
        "batch_id", "node_index", F.when(c("p") % 3 == 0, "NEW").otherwise(F.concat(F.lit("s"), c("s").cast("string"))).alias("thread_id")
    )
    # a batch with a part number that ends a block of fifty leaves that node out: a violation
    fresh = nodes.filter((c("p") % 3 == 0) & (c("p") % 50 != 0)).groupBy("batch_id").agg(
        F.array_sort(F.collect_list("node_index")).alias("node_indices")
    )
    new_threads = fresh.select(
        "batch_id", F.lit(0).alias("thread_no"), F.lit("new").alias("title"), F.lit("").alias("summary"), "node_indices",
        F.array(F.lit("begun")).alias("milestones"),
    )
    threads = v.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("thread_id"), text.alias("origin_key"), c("s_name").alias("title"),
        F.lit("").alias("summary"), text.alias("current_phase"), text.alias("current_focus"), F.lit("inactive").alias("status"),
        F.array().cast("array<struct<time:bigint,description:string>>").alias("milestones"),
    )
    updates = assignments.filter("thread_id = ''").select(
        "batch_id", "thread_id", *[text.alias(n) for n in ("title", "summary", "current_phase", "current_focus", "milestone")]
    )
    out = sets.apply_assignments(nodes.drop("p", "s"), threads, assignments, updates, new_threads, NOW)
    return out["threads"].select("thread_id", "start_ms", "last_active_ms", "node_count")


@query(
    "i20_refresh_postings",
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN text || ' added words' ELSE text END AS text FROM documents),
t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM d WHERE text IS NOT NULL)
SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2""",
)
def i20(spark, sf):
    d, i = v.table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id")
    postings, _ = build_index(d)
    changed = d.filter((i % 7 == 0) | (i % 5 == 0)).select(
        "doc_id", F.when(i % 7 == 0, None).otherwise(F.concat("text", F.lit(" added words"))).alias("text")
    )
    return sets.refresh_postings(postings, changed)


@query(
    "i21_reset_on_dim_change",
    "SELECT vec_id, 0 AS dims, 'pending' AS embedding_status, 'pending' AS index_status FROM embeddings",
)
def i21(spark, sf):
    e, i = v.table(spark, sf, "embeddings"), F.col("vec_id")
    docs = e.select(
        "vec_id", F.when(i % 100 == 7, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"),
        F.lit("succeeded").alias("embedding_status"), F.lit("succeeded").alias("index_status"),
    )
    out = lifecycle.reset_on_dim_change(docs, 64)
    return out.select("vec_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"), "embedding_status", "index_status").withColumn(
        "dims", F.greatest("dims", F.lit(0))
    )


@query(
    "i22_upsert_markers",
    v.more("threads") + """t AS (SELECT *, 'thr_' || thread_id AS event_key, CASE WHEN num % 3 = 0 THEN 'Deep Work ' || num END AS et,
  CASE WHEN num % 2 = 0 THEN 'First line. Second' END AS ed, CASE WHEN num % 5 <> 0 THEN 'coding' END AS ek FROM threads),
n AS (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY ts_ms DESC, id DESC) AS rn FROM nodes WHERE thread_id IN (SELECT thread_id FROM t)),
ids AS (SELECT thread_id, string_agg(id::VARCHAR, ',' ORDER BY rn) AS node_ids FROM n WHERE rn <= 200 GROUP BY 1),
o AS (SELECT event_key, thread_id, last_active_ms - CASE WHEN num % 7 = 0 THEN 5 ELSE 0 END AS end_ms, CASE WHEN num % 4 <> 0 THEN 'text' END AS details_text FROM t WHERE num % 11 <> 0),
m AS (SELECT t.*, CASE WHEN et IS NOT NULL THEN et WHEN ed IS NOT NULL THEN 'First line' WHEN ek IS NOT NULL THEN ek || ': ' || 'T' || num ELSE 'T' || num END AS title,
  o.event_key IS NOT NULL AS has, o.details_text, o.end_ms FROM t LEFT JOIN o USING (event_key)),
s AS (SELECT *, has AND details_text IS NOT NULL AND end_ms <> last_active_ms AS stale FROM m)
SELECT event_key, title, CASE WHEN has THEN 'focus' ELSE coalesce(ek, 'work') END AS kind, last_active_ms AS end_ms, node_ids, CASE WHEN has AND NOT stale THEN details_text END AS details_text,
CASE WHEN has AND NOT stale THEN 'succeeded' ELSE 'pending' END AS details_status FROM s JOIN ids USING (thread_id)""",
)
def i22(spark, sf):
    n = v.nodes(spark, sf)
    num = F.substring("thread_id", 2, 20).cast("long")
    txt = num.cast("string")
    t = v.threads(spark, sf).select(
        "thread_id", F.concat(F.lit("T"), txt).alias("title"), F.lit(None).cast("string").alias("current_phase"),
        F.when(num % 3 == 0, F.concat(F.lit("Deep Work "), txt)).alias("event_title"), F.when(num % 2 == 0, "First line. Second").alias("event_description"),
        F.when(num % 5 != 0, "coding").alias("event_kind"), "start_ms", "last_active_ms", (F.col("last_active_ms") - F.col("start_ms")).alias("duration_ms"),
    )
    from worktrail.operators.aggregates import ordered_list
    from worktrail.operators.blocks import top_n

    known = n.join(t.select("thread_id"), "thread_id", "left_semi").select("thread_id", "id", "ts_ms")
    ids = top_n(known, ["thread_id"], [F.col("ts_ms").desc(), F.col("id").desc()], 200).groupBy("thread_id").agg(
        ordered_list("rn", F.col("id")).alias("node_ids")
    )
    old = t.filter(num % 11 != 0).join(ids, "thread_id").select(
        F.concat(F.lit("thr_"), "thread_id").alias("event_key"), F.lit("focus").alias("kind"),
        (F.col("last_active_ms") - F.when(num % 7 == 0, 5).otherwise(0)).alias("end_ms"), "node_ids",
        F.when(num % 4 != 0, "text").alias("details_text"), F.lit("succeeded").alias("details_status"), F.lit(1).alias("details_attempts"),
        F.lit(None).cast("long").alias("details_next_run_at"),
    )
    out = lifecycle.upsert_markers(old, t, n, NOW)
    return out.select("event_key", "title", "kind", "end_ms", join_ids("node_ids").alias("node_ids"), "details_text", "details_status")


@query(
    "i23_evict_idle",
    v.more("captures") + """d AS (SELECT source_key, id, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY source_key ORDER BY ts_ms, id) AS d FROM captures),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY ts_ms, id) AS session FROM d),
g AS (SELECT source_key, max(ts_ms) AS last_seen_ms, count(*) AS captures FROM s GROUP BY source_key, session)
SELECT * FROM g WHERE last_seen_ms < 1706600000000 - 21600000""",
)
def i23(spark, sf):
    return lifecycle.evict_idle(v.captures(spark, sf), 1_706_600_000_000, 6 * HOUR)

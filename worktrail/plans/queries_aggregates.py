"""Queries for counts, rollups and summaries (group E)."""

from pyspark.sql import functions as F

from worktrail.operators import aggregates as agg
from worktrail.operators import sets
from worktrail.plans import views as v
from worktrail.plans.registry import query

NOW = 1_704_672_000_000  # 2024-01-08 00:00 UTC, inside the events table
HOUR = 3_600_000
LO, HI = 1_704_153_600_000, 1_705_363_200_000  # 2024-01-02 to 2024-01-16


def joined(c):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)


def queues(spark, sf):
    work, caps = v.work(spark, sf), v.captures(spark, sf)
    return {
        "vlm": work.select("status"),
        "thread": work.filter("status = 'succeeded'").select(F.col("upstream_status").alias("status")),
        "ocr": caps.select(F.col("ocr_status").alias("status")),
        "usage": v.usage(spark, sf).select("status"),
    }


QUEUES_SQL = (
    v.more("work", "captures", "usage")
    + """q AS (SELECT 'vlm' AS queue, status FROM work UNION ALL
SELECT 'thread', upstream_status FROM work WHERE status = 'succeeded' UNION ALL
SELECT 'ocr', ocr_status FROM captures UNION ALL SELECT 'usage', status FROM usage),
qs AS (SELECT queue, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
       count(*) FILTER (status IN ('failed', 'failed_permanent')) AS failed FROM q WHERE status IS NOT NULL GROUP BY 1)
"""
)


@query("e1_queue_status", QUEUES_SQL + "SELECT * FROM qs")
def e1(spark, sf):
    return agg.queue_status(queues(spark, sf))


@query(
    "e14_total_backlog",
    QUEUES_SQL + """SELECT b AS backlog, CASE WHEN b >= 200 THEN 'critical' WHEN b >= 50 THEN 'warning' ELSE 'healthy' END AS level
FROM (SELECT sum(pending + running) AS b FROM qs)""",
)
def e14(spark, sf):
    return agg.total_backlog(agg.queue_status(queues(spark, sf)))


@query(
    "e2_usage_summary",
    v.cte("usage") + f"""SELECT coalesce(sum(total_tokens), 0) AS total_tokens, count(*) AS requests,
count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed
FROM usage WHERE ts_ms BETWEEN {LO} AND {HI} AND config_hash = 'c1'""",
)
def e2(spark, sf):
    return agg.usage_summary(v.usage(spark, sf), LO, HI, "c1")


@query(
    "e3_usage_by_model",
    v.cte("usage") + f"""SELECT model, capability, sum(total_tokens) AS total_tokens, count(*) AS requests
FROM usage WHERE ts_ms BETWEEN {LO} AND {HI} GROUP BY 1, 2""",
)
def e3(spark, sf):
    return agg.usage_by_model(v.usage(spark, sf), LO, HI)


@query(
    "e4_usage_daily",
    v.cte("usage") + f"""SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, sum(total_tokens) AS total_tokens, count(*) AS requests
FROM usage WHERE ts_ms BETWEEN {LO} AND {HI} GROUP BY 1""",
)
def e4(spark, sf):
    return agg.usage_daily(v.usage(spark, sf), LO, HI, "Asia/Tokyo")


@query(
    "e15_usage_rollup",
    v.cte("usage") + """SELECT strftime(ts, '%Y-%m-%d') AS day, model, capability,
count(*) FILTER (status = 'succeeded') AS request_count_succeeded, count(*) FILTER (status = 'failed') AS request_count_failed,
sum(total_tokens) AS total_tokens_sum FROM usage GROUP BY 1, 2, 3""",
)
def e15(spark, sf):
    return agg.usage_rollup(v.usage(spark, sf))


@query(
    "e5_error_rate",
    v.cte("usage") + "SELECT "
    + ", ".join(
        f"count(*) FILTER (ts_ms >= {NOW - w} AND capability = '{c}') AS {n}_{c}"
        for n, w in {"day": 24 * HOUR, "hour": HOUR}.items() for c in ("vlm", "text", "embedding")
    )
    + f" FROM usage WHERE status = 'failed' AND ts_ms <= {NOW} AND ts_ms >= {NOW - 24 * HOUR}",
)
def e5(spark, sf):
    return agg.error_rate(v.usage(spark, sf), NOW, {"day": 24 * HOUR, "hour": HOUR})


@query(
    "e6_top_errors",
    v.cte("usage") + f"""SELECT coalesce(error_code, 'unknown') AS error_code, count(*) AS n FROM usage
WHERE status = 'failed' AND ts_ms BETWEEN {NOW - 48 * HOUR} AND {NOW} GROUP BY 1 ORDER BY n DESC, error_code LIMIT 10""",
)
def e6(spark, sf):
    return agg.top_errors(v.usage(spark, sf), NOW, 10, 48 * HOUR)


@query(
    "e7_thread_rollup",
    v.more("nodes") + """d AS (SELECT thread_id, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY thread_id ORDER BY ts_ms) AS d
FROM nodes WHERE thread_id IS NOT NULL)
SELECT thread_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_active_ms, count(*) AS node_count,
CAST(coalesce(sum(d) FILTER (d > 0 AND d <= 21600000), 0) AS BIGINT) AS duration_ms FROM d GROUP BY 1""",
)
def e7(spark, sf):
    # the test events of one user lie hours apart, so the gap is six hours here
    return agg.thread_rollup(v.nodes(spark, sf), gap_ms=6 * HOUR)


RECENT = v.more("nodes") + """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts_ms DESC, id DESC) AS recency
FROM nodes WHERE thread_id IS NOT NULL) WHERE recency <= 50)
"""


@query(
    "e8_main_project",
    RECENT.rstrip() + """, c AS (SELECT thread_id, project_key, count(*) AS n FROM r WHERE project_key IS NOT NULL GROUP BY 1, 2)
SELECT thread_id, project_key AS main_project FROM c
QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY n DESC, project_key) = 1""",
)
def e8(spark, sf):
    return agg.main_project(v.nodes(spark, sf))


@query(
    "e9_key_entities",
    RECENT.rstrip() + """, c AS (SELECT thread_id, name, count(*) AS n FROM
(SELECT DISTINCT thread_id, id, unnest(keywords) AS name FROM r) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC, name) AS rn FROM c)
SELECT thread_id, string_agg(name, ',' ORDER BY rn) AS key_entities FROM k WHERE rn <= 20 GROUP BY 1""",
)
def e9(spark, sf):
    nodes = v.nodes(spark, sf).withColumn("names", F.col("keywords"))
    return agg.key_entities(nodes).select("thread_id", joined("key_entities"))


@query(
    "e10_thread_apps",
    RECENT.rstrip() + """, c AS (SELECT thread_id, app_hint, min(recency) AS first FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY first) AS rn FROM c)
SELECT thread_id, string_agg(app_hint, ',' ORDER BY rn) AS apps FROM k WHERE rn <= 20 GROUP BY 1""",
)
def e10(spark, sf):
    return agg.thread_apps(v.nodes(spark, sf)).select("thread_id", joined("apps"))


@query(
    "e11_window_stats",
    v.more("nodes")
    + """w AS (SELECT *, ts_ms // 1200000 * 1200000 AS window_start FROM nodes),
base AS (SELECT window_start, count(*) AS node_count, count(DISTINCT thread_id) AS thread_count FROM w GROUP BY 1),
apps AS (SELECT window_start, app_hint AS name, count(*) AS n, min((ts_ms, id)) AS first FROM w GROUP BY 1, 2),
ents AS (SELECT window_start, name, count(*) AS n, min((ts_ms, id)) AS first
         FROM (SELECT window_start, ts_ms, id, unnest(entities) AS name FROM w) GROUP BY 1, 2),
ta AS (SELECT window_start, string_agg(name, ',' ORDER BY rn) AS top_apps FROM
       (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, first, name) AS rn FROM apps) WHERE rn <= 5 GROUP BY 1),
te AS (SELECT window_start, string_agg(name, ',' ORDER BY rn) AS top_entities FROM
       (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, first, name) AS rn FROM ents) WHERE rn <= 5 GROUP BY 1)
SELECT window_start, node_count, thread_count, top_apps, top_entities
FROM base JOIN ta USING (window_start) JOIN te USING (window_start)""",
)
def e11(spark, sf):
    out = agg.window_stats(v.nodes(spark, sf))
    return out.select("window_start", "node_count", "thread_count", joined("top_apps"), joined("top_entities"))


@query(
    "e12_result_summary",
    v.more("nodes", "links")
    + """res AS (SELECT substr(thread_id, 2)::BIGINT AS query_id, id, ts_ms, kind, entities, app_hint,
  row_number() OVER (PARTITION BY thread_id ORDER BY importance DESC, id) AS rn FROM nodes WHERE thread_id IS NOT NULL),
ev2 AS (SELECT query_id, id AS screenshot_id, ts_ms, app_hint, row_number() OVER (PARTITION BY query_id ORDER BY ts_ms DESC, id) AS rn
  FROM res WHERE app_hint <> 'click'),
span AS (SELECT query_id, min(ts_ms) AS from_ms, max(ts_ms) AS to_ms FROM
  (SELECT query_id, ts_ms FROM res UNION ALL SELECT query_id, ts_ms FROM ev2) GROUP BY 1),
kinds AS (SELECT query_id, count(*) FILTER (kind = 'event') AS n_event, count(*) FILTER (kind = 'knowledge') AS n_knowledge,
  count(*) FILTER (kind = 'state_snapshot') AS n_state_snapshot FROM res GROUP BY 1),
ac AS (SELECT query_id, app_hint, count(*) AS n, min(rn) AS first FROM ev2 GROUP BY 1, 2),
ta AS (SELECT query_id, string_agg(app_hint || ':' || n, ',' ORDER BY rk) AS top_apps FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS rk FROM ac) WHERE rk <= 5 GROUP BY 1),
ex AS (SELECT query_id, rn, unnest(entities) AS name, generate_subscripts(entities, 1) AS pos FROM res),
ec AS (SELECT query_id, name, min((rn, pos)) AS first FROM ex GROUP BY 1, 2),
te AS (SELECT query_id, string_agg(name, ',' ORDER BY rk) AS top_entities FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rk FROM ec) WHERE rk <= 10 GROUP BY 1)
SELECT query_id, from_ms, to_ms, n_event, n_knowledge, n_state_snapshot, coalesce(top_apps, '') AS top_apps,
  coalesce(top_entities, '') AS top_entities
FROM span LEFT JOIN kinds USING (query_id) LEFT JOIN ta USING (query_id) LEFT JOIN te USING (query_id)""",
)
def e12(spark, sf):
    from worktrail.operators.blocks import top_n

    n = v.nodes(spark, sf).filter("thread_id IS NOT NULL").withColumn("query_id", F.substring("thread_id", 2, 20).cast("long"))
    from pyspark.sql import Window

    res = n.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("importance").desc(), "id")))
    ev = n.filter("app_hint <> 'click'").withColumn(
        "rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("ts_ms").desc(), "id"))
    )
    out = agg.result_summary(
        res.select("query_id", "id", "rn", "ts_ms", "kind", "entities"),
        ev.select("query_id", F.col("id").alias("screenshot_id"), "rn", "ts_ms", "app_hint"),
    )
    return out.withColumns({c: F.array_join(c, ",") for c in ("top_apps", "top_entities")})


@query(
    "e13_long_threads",
    v.more("nodes") + """w AS (SELECT ts_ms // 86400000 * 86400000 AS window_start, thread_id, ts_ms, id,
  CASE WHEN k % 3 <> 0 THEN k * 60000 END AS dur FROM nodes WHERE thread_id IS NOT NULL)
SELECT window_start, thread_id, arg_max(dur, (ts_ms, id)) FILTER (dur IS NOT NULL) AS duration_ms, max(ts_ms) AS last_active_ms,
  count(*) AS node_count FROM w GROUP BY 1, 2 HAVING arg_max(dur, (ts_ms, id)) FILTER (dur IS NOT NULL) >= 1500000""",
)
def e13(spark, sf):
    snap = F.when(F.col("k") % 3 != 0, F.struct((F.col("k") * 60_000).alias("duration_ms")))
    n = v.nodes(spark, sf).withColumn("snapshot", snap)
    n = n.withColumn("window_start", F.floor(F.col("ts_ms") / 86_400_000) * 86_400_000)
    return agg.long_threads(n).withColumn("duration_ms", F.col("snapshot.duration_ms")).drop("snapshot")


@query(
    "e17_vector_dims",
    """WITH c AS (SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1)
SELECT dim, n, dim <> (SELECT dim FROM c ORDER BY n DESC, dim LIMIT 1) AS mismatch FROM c""",
)
def e17(spark, sf):
    return agg.vector_dims(v.table(spark, sf, "embeddings"))


@query(
    "e18_latency_percentiles",
    v.more("ev") + """w AS (SELECT ts_ms // 86400000 * 86400000 AS window_start, value FROM ev)
SELECT window_start, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM w GROUP BY 1""",
)
def e18(spark, sf):
    return agg.latency_percentiles(v.events(spark, sf), "ts_ms", "value", 86_400_000)


@query(
    "e19_merge_events",
    v.more("nodes") + """e AS (SELECT 'evt_' || coalesce(thread_id, 'none') || '_' || (ts_ms // 86400000) AS event_key, id AS seq, ts_ms AS start_ms,
  ts_ms + k * 30000 AS end_ms, title, kind, thread_id, CASE WHEN k % 2 = 0 THEN k END AS summary_id, importance,
  CASE WHEN k % 3 = 0 THEN importance END AS confidence, [id % 5, k % 3, id] AS node_ids FROM nodes),
m AS (SELECT event_key, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_max(title, seq) AS title, arg_max(kind, seq) AS kind,
  arg_max(summary_id, seq) AS summary_id, arg_max(confidence, seq) AS confidence, arg_max(importance, seq) AS importance
  FROM e GROUP BY 1),
x AS (SELECT event_key, node_id, min((seq, pos)) AS first FROM
  (SELECT event_key, seq, unnest(node_ids) AS node_id, generate_subscripts(node_ids, 1) AS pos FROM e) GROUP BY 1, 2),
l AS (SELECT event_key, string_agg(node_id::VARCHAR, ',' ORDER BY first) AS node_ids FROM x GROUP BY 1)
SELECT m.*, end_ms - start_ms AS duration_ms, end_ms - start_ms >= 1500000 AS is_long, node_ids FROM m JOIN l USING (event_key)""",
)
def e19(spark, sf):
    k = F.col("k")
    n = v.nodes(spark, sf)
    day = F.floor(F.col("ts_ms") / 86_400_000).cast("string")
    e = n.select(
        F.concat(F.lit("evt_"), F.coalesce("thread_id", F.lit("none")), F.lit("_"), day).alias("event_key"),
        F.col("id").alias("seq"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + k * 30_000).alias("end_ms"),
        "title", "kind", "thread_id", F.when(k % 2 == 0, k).alias("summary_id"), "importance",
        F.when(k % 3 == 0, F.col("importance")).alias("confidence"),
        F.array(F.col("id") % 5, k % 3, F.col("id")).alias("node_ids"),
    )
    return agg.merge_events(e).drop("thread_id").withColumn("node_ids", joined("node_ids"))


@query(
    "e20_latest_activity",
    v.cte("nodes") + """SELECT (max(ts_ms) // 1200000 - 3) * 1200000 AS latest_ms, 'summary' AS source FROM nodes""",
)
def e20(spark, sf):
    n = v.nodes(spark, sf)
    s = n.select(((F.floor(F.col("ts_ms") / 1_200_000) - 3) * 1_200_000).alias("window_end"))
    return agg.latest_activity(s, n)


def assignment_inputs(spark, sf):
    """Assignments and new-thread indices out of order lines: order = batch, line = node."""
    li = v.table(spark, sf, "lineitem")
    a = li.select(
        F.col("l_orderkey").alias("batch_id"), (F.col("l_linenumber") - 1).cast("long").alias("node_index"),
        F.when(F.col("l_partkey") % 3 == 0, "NEW").otherwise(F.concat(F.lit("t"), F.col("l_suppkey").cast("string"))).alias("thread_id"),
    )
    new = li.filter((F.col("l_partkey") % 3 == 0) & (F.col("l_suppkey") % 10 != 0)).select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_suppkey").alias("thread_no"),
        (F.col("l_linenumber") - 1).cast("long").alias("node_index"),
    )
    batches = li.groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.count_distinct("l_linenumber").alias("node_count"))
    return a, new, batches


ASSIGN_SQL = """WITH a AS (SELECT l_orderkey AS batch_id, l_linenumber - 1 AS node_index,
  CASE WHEN l_partkey % 3 = 0 THEN 'NEW' ELSE 't' || l_suppkey END AS thread_id FROM lineitem),
n AS (SELECT l_orderkey AS batch_id, l_linenumber - 1 AS node_index FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 10 <> 0),
b AS (SELECT l_orderkey AS batch_id, count(DISTINCT l_linenumber) AS node_count FROM lineitem GROUP BY 1),
ai AS (SELECT batch_id, node_index, count(*) AS a_rows, max(CASE WHEN thread_id = 'NEW' THEN 1 ELSE 0 END) AS is_new FROM a GROUP BY 1, 2),
ni AS (SELECT batch_id, node_index, count(*) AS n_rows FROM n GROUP BY 1, 2),
cells AS (SELECT *, node_index BETWEEN 0 AND node_count - 1 AS inside FROM ai FULL JOIN ni USING (batch_id, node_index) JOIN b USING (batch_id)),
cnt AS (SELECT batch_id, any_value(node_count) AS node_count, CAST(sum(coalesce(a_rows, 0)) AS BIGINT) AS assigned,
  any_value(node_count) - count(*) FILTER (a_rows IS NOT NULL AND inside) AS missing,
  count(*) FILTER (a_rows IS NOT NULL AND NOT inside) AS out_of_range, count(*) FILTER (a_rows > 1) AS duplicated,
  count(*) FILTER (n_rows IS NOT NULL AND NOT inside) AS new_out_of_range, count(*) FILTER (n_rows > 1) AS new_duplicated,
  count(*) FILTER (is_new = 1 AND n_rows IS NULL) AS new_unlisted,
  count(*) FILTER (n_rows IS NOT NULL AND coalesce(is_new, 0) = 0) AS listed_not_new FROM cells GROUP BY 1)
"""


@query(
    "e21_assignment_violations",
    ASSIGN_SQL + """SELECT * FROM cnt WHERE assigned <> node_count OR missing > 0 OR out_of_range > 0 OR duplicated > 0
OR new_out_of_range > 0 OR new_duplicated > 0 OR new_unlisted > 0 OR listed_not_new > 0""",
)
def e21(spark, sf):
    return sets.assignment_violations(*assignment_inputs(spark, sf))


@query(
    "e22_call_stats",
    v.more("usage") + """t AS (SELECT capability, status, total_tokens * 3 AS duration_ms FROM usage)
SELECT capability, count(*) AS calls, CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS mean_ms,
count(*) FILTER (status = 'failed') AS errors FROM t GROUP BY 1""",
)
def e22(spark, sf):
    return agg.call_stats(v.usage(spark, sf).withColumn("duration_ms", F.col("total_tokens") * 3))


def log_lines(spark, sf):
    """Log lines written out of the events table."""
    e = v.events(spark, sf)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +0000] "), level, F.lit(": [mod-"),
        (F.col("user_id") % 12).cast("string"), F.lit("] call "), F.col("event_id").cast("string"),
    )
    return e.select(F.when(F.col("k") % 10 == 0, F.concat(F.lit("  at "), "event_type")).otherwise(line).alias("value"))


LOGS_SQL = v.more("ev") + """logs AS (SELECT ts_ms AS line_ms, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
'mod-' || (user_id % 12) AS module, 'call ' || event_id AS message FROM ev WHERE k % 10 <> 0)
"""


@query("a4_read_logs", LOGS_SQL + "SELECT line_ms, level, module, message FROM logs")
def a4(spark, sf):
    from worktrail.sources.ingest import parse_logs

    return parse_logs(log_lines(spark, sf)).select(F.unix_millis("line_ts").alias("line_ms"), "level", "module", "message")


@query("e16_log_levels", LOGS_SQL + "SELECT level, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM logs), 1) AS percent FROM logs GROUP BY 1")
def e16a(spark, sf):
    from worktrail.sources.ingest import parse_logs

    return agg.log_levels(parse_logs(log_lines(spark, sf)))


@query("e16_log_modules", LOGS_SQL + "SELECT module, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, module LIMIT 5")
def e16b(spark, sf):
    from worktrail.sources.ingest import parse_logs

    return agg.log_modules(parse_logs(log_lines(spark, sf)))


@query("e16_log_recent", LOGS_SQL + "SELECT level, module, message, line_ms FROM logs WHERE level = 'ERROR' ORDER BY line_ms DESC, message LIMIT 10")
def e16c(spark, sf):
    from worktrail.sources.ingest import parse_logs

    out = agg.log_recent(parse_logs(log_lines(spark, sf)), ["ERROR"])
    return out.select("level", "module", "message", F.unix_millis("line_ts").alias("line_ms"))

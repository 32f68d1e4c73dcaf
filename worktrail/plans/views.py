"""The driver's tables read as activity-memory entities.

Every view is written twice, as a DataFrame and as a SQL common table expression, with
the same columns; ``cte("nodes", "usage")`` gives the ``WITH`` clause a SQL text needs.
Times are epoch milliseconds (``ts_ms``) next to the timestamp itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.session import prepare, spread
from worktrail.sources.tables import scan

# Tables whose rows are long texts: the work per row outweighs dealing the rows out.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = scan(prepare(spark), f"{sf}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def events(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id",
        ts.alias("ts"),
        F.unix_millis(ts).alias("ts_ms"),
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    k, e = F.col("k"), F.col("event_type")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        "ts",
        "ts_ms",
        F.when(e != "signup", text("t", F.col("user_id"))).alias("thread_id"),
        e.alias("app_hint"),
        (k % 11).alias("importance"),
        F.when(k % 3 == 0, "state_snapshot").when(k % 3 == 1, "knowledge").otherwise("event").alias("kind"),
        (k % 12 == 0).alias("issue"),
        F.concat(e, F.lit(" "), k.cast("string")).alias("title"),
        F.when(k % 4 != 0, text("p", k % 6)).alias("project_key"),
        F.array(text("kw", k % 17), text("kw", k % 5), e).alias("keywords"),
        F.array(text("Ent ", k % 7), text("proj-", k % 4)).alias("entities"),
        "value",
        "k",
    )


def captures(spark: SparkSession, sf: str) -> DataFrame:
    k, e = F.col("k"), F.col("event_type")
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        "ts",
        "ts_ms",
        F.concat(F.when(e == "view", "screen:").otherwise("window:"), F.col("user_id").cast("string")).alias("source_key"),
        k.alias("phash"),
        e.alias("app_hint"),
        F.concat(e, F.lit(" - "), k.cast("string")).alias("window_title"),
        F.when(k % 7 == 0, "persisted").otherwise("ephemeral").alias("storage_state"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "pending").when(k % 5 == 2, "failed_permanent")
        .otherwise("succeeded").alias("ocr_status"),
        F.when(k % 6 != 0, F.concat(F.lit("/c/"), F.col("event_id").cast("string"))).alias("file_path"),
        (F.col("event_id") % 1000).alias("batch_id"),
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    k, u = F.col("k"), F.col("user_id")
    failed = F.col("event_type") == "error"
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        "ts",
        "ts_ms",
        F.when(u % 3 == 0, "vlm").when(u % 3 == 1, "text").otherwise("embedding").alias("capability"),
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.when(failed & (k % 4 != 0), F.concat(F.lit("E"), (k % 14).cast("string"))).alias("error_code"),
        F.concat(F.lit("m"), (u % 5).cast("string")).alias("model"),
        F.concat(F.lit("c"), (u % 2).cast("string")).alias("config_hash"),
        F.floor("value").cast("long").alias("total_tokens"),
    )


def work(spark: SparkSession, sf: str) -> DataFrame:
    """Processing-queue rows from ``orders``."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    ts = F.col("o_orderdate").cast("timestamp")
    ts_ms = F.unix_millis(ts)
    return table(spark, sf, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("owner_id"),
        F.when(status == "O", F.when(key % 5 == 0, "running").otherwise("pending"))
        .when(status == "F", "succeeded")
        .otherwise(F.when(key % 4 == 0, "failed_permanent").otherwise("failed"))
        .alias("status"),
        (key % 3).alias("attempts"),
        F.when(key % 2 == 0, ts_ms + (key % 7) * 86_400_000).alias("next_run_at"),
        F.when(key % 6 == 0, "pending").otherwise("succeeded").alias("upstream_status"),
        F.when(key % 9 != 0, F.col("o_orderpriority")).alias("payload"),
        ts.alias("ts"),
        ts_ms.alias("ts_ms"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Many-to-many links: an order (node) to a part (capture)."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("node_id"), F.col("l_partkey").alias("screenshot_id")
    )


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """One row per thread id with its roll-up of the node view."""
    n = nodes(spark, sf).filter(F.col("thread_id").isNotNull())
    num = F.substring("thread_id", 2, 20).cast("long")
    return (
        n.groupBy("thread_id")
        .agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_active_ms"), F.count("*").alias("node_count"))
        .withColumn("status", F.when(num % 5 == 0, "closed").when(num % 5 == 1, "inactive").otherwise("active"))
        .withColumn("owner", num % 10)
    )


_CTE = {
    "ev": r"""ev AS (
  SELECT event_id, ts, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value,
         CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k
  FROM events)""",
    "nodes": """nodes AS (
  SELECT event_id AS id, ts, ts_ms,
         CASE WHEN event_type <> 'signup' THEN 't' || user_id END AS thread_id,
         event_type AS app_hint, k % 11 AS importance,
         CASE WHEN k % 3 = 0 THEN 'state_snapshot' WHEN k % 3 = 1 THEN 'knowledge' ELSE 'event' END AS kind,
         k % 12 = 0 AS issue, event_type || ' ' || k AS title,
         CASE WHEN k % 4 <> 0 THEN 'p' || (k % 6) END AS project_key,
         ['kw' || (k % 17), 'kw' || (k % 5), event_type] AS keywords,
         ['Ent ' || (k % 7), 'proj-' || (k % 4)] AS entities, value, k
  FROM ev)""",
    "captures": """captures AS (
  SELECT event_id AS id, ts, ts_ms,
         CASE WHEN event_type = 'view' THEN 'screen:' ELSE 'window:' END || user_id AS source_key,
         k AS phash, event_type AS app_hint, event_type || ' - ' || k AS window_title,
         CASE WHEN k % 7 = 0 THEN 'persisted' ELSE 'ephemeral' END AS storage_state,
         CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'pending'
              WHEN k % 5 = 2 THEN 'failed_permanent' ELSE 'succeeded' END AS ocr_status,
         CASE WHEN k % 6 <> 0 THEN '/c/' || event_id END AS file_path, event_id % 1000 AS batch_id
  FROM ev)""",
    "usage": """usage AS (
  SELECT event_id AS id, ts, ts_ms,
         CASE user_id % 3 WHEN 0 THEN 'vlm' WHEN 1 THEN 'text' ELSE 'embedding' END AS capability,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
         CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN 'E' || (k % 14) END AS error_code,
         'm' || (user_id % 5) AS model, 'c' || (user_id % 2) AS config_hash,
         CAST(floor(value) AS BIGINT) AS total_tokens
  FROM ev)""",
    "work": """work AS (
  SELECT o_orderkey AS id, o_custkey AS owner_id,
         CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'running' ELSE 'pending' END
              WHEN o_orderstatus = 'F' THEN 'succeeded'
              ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'failed_permanent' ELSE 'failed' END END AS status,
         o_orderkey % 3 AS attempts,
         CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) // 1000 + (o_orderkey % 7) * 86400000 END AS next_run_at,
         CASE WHEN o_orderkey % 6 = 0 THEN 'pending' ELSE 'succeeded' END AS upstream_status,
         CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS payload,
         o_orderdate AS ts, epoch_us(o_orderdate) // 1000 AS ts_ms
  FROM orders)""",
    "links": "links AS (SELECT l_orderkey AS node_id, l_partkey AS screenshot_id FROM lineitem)",
    "threads": """threads AS (
  SELECT *, CASE num % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'inactive' ELSE 'active' END AS status, num % 10 AS owner
  FROM (SELECT thread_id, CAST(substr(thread_id, 2) AS BIGINT) AS num, min(ts_ms) AS start_ms,
               max(ts_ms) AS last_active_ms, count(*) AS node_count
        FROM nodes WHERE thread_id IS NOT NULL GROUP BY thread_id))""",
}
_NEEDS = {
    "nodes": ["ev"], "captures": ["ev"], "usage": ["ev"], "threads": ["ev", "nodes"], "ev": [], "work": [], "links": [],
}


def cte(*names: str) -> str:
    """``WITH`` clause with the named views and what they read."""
    chosen: list[str] = []
    for name in names:
        for need in [*_NEEDS[name], name]:
            if need not in chosen:
                chosen.append(need)
    return "WITH " + ",\n".join(_CTE[n] for n in chosen) + "\n"


def more(*names: str) -> str:
    """The same, open for further common table expressions."""
    return cte(*names).rstrip() + ",\n"

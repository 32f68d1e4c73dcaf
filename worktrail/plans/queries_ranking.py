"""Queries for ranking and selection (F), sorted lists (G) and set operations (H)."""

from pyspark.sql import functions as F

from worktrail.functions.text import cut
from worktrail.operators import ranking, sets
from worktrail.operators.blocks import DAY_MS
from worktrail.plans import views as v
from worktrail.plans.queries_aggregates import ASSIGN_SQL, assignment_inputs
from worktrail.plans.registry import query

HOUR = 3_600_000
NOW = 1_704_672_000_000
LO, HI = 1_704_153_600_000, 1_705_363_200_000
WORK_NOW = 883_612_800_000


@query(
    "f1_recent_n",
    v.more("nodes") + """r AS (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY ts_ms DESC, id DESC) AS rn FROM nodes WHERE thread_id IS NOT NULL)
SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY rn DESC) AS pos FROM r WHERE rn <= 50""",
)
def f1(spark, sf):
    return ranking.recent_n(v.nodes(spark, sf), "thread_id", 50).select("thread_id", "id", "pos")


@query(
    "f2_gap_duration",
    """WITH o AS (SELECT o_custkey, epoch_us(o_orderdate) // 1000 AS t FROM orders),
d AS (SELECT o_custkey, t, t - lag(t) OVER (PARTITION BY o_custkey ORDER BY t) AS d FROM o)
SELECT o_custkey, min(t) AS start_ms, max(t) AS last_active_ms, count(*) AS node_count,
CAST(coalesce(sum(d) FILTER (d > 0 AND d <= 8640000000), 0) AS BIGINT) AS duration_ms FROM d GROUP BY 1""",
)
def f2(spark, sf):
    from worktrail.operators.aggregates import gap_duration

    o = v.table(spark, sf, "orders").select("o_custkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"))
    return gap_duration(o, "o_custkey", gap_ms=100 * DAY_MS, block_ms=30 * DAY_MS)


@query(
    "f2_gap_sessions",
    v.more("nodes") + """d AS (SELECT thread_id, id, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY thread_id ORDER BY ts_ms, id) AS d FROM nodes WHERE thread_id IS NOT NULL)
SELECT thread_id, id, CAST(sum(CASE WHEN d IS NULL OR d > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY ts_ms, id) AS BIGINT) AS session FROM d""",
)
def f2s(spark, sf):
    return ranking.gap_sessions(v.nodes(spark, sf), "thread_id", 6 * HOUR).select("thread_id", "id", "session")


@query(
    "f3_two_ended",
    v.more("work") + """a AS (SELECT id, ts_ms FROM work WHERE status IN ('pending', 'failed') ORDER BY ts_ms DESC, id DESC LIMIT 50),
b AS (SELECT id, ts_ms FROM work WHERE status IN ('pending', 'failed') ORDER BY ts_ms, id LIMIT 50)
SELECT * FROM a UNION SELECT * FROM b""",
)
def f3(spark, sf):
    open_rows = v.work(spark, sf).filter("status IN ('pending', 'failed')").select("id", "ts_ms")
    return ranking.two_ended(open_rows, ["ts_ms", "id"], 100)


def pins(spark, sf):
    """One pinned thread per owner, out of the supplier table."""
    s = F.col("s_suppkey")
    rows = v.table(spark, sf, "supplier").filter(s % 3 == 0)
    return rows.groupBy((s % 10).alias("owner")).agg(F.concat(F.lit("t"), F.min("s_suppkey").cast("string")).alias("thread_id"))


PINS_SQL = "pins AS (SELECT s_suppkey % 10 AS owner, 't' || min(s_suppkey) AS thread_id FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1)"


@query(
    "f4_thread_candidates",
    v.more("threads") + PINS_SQL + """,
act AS (SELECT * FROM threads WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY last_active_ms DESC, thread_id) <= 3),
fb AS (SELECT * FROM threads WHERE status <> 'closed' AND owner NOT IN (SELECT owner FROM act) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY last_active_ms DESC, thread_id) = 1),
al AS (SELECT owner, thread_id, last_active_ms, 1 AS pri FROM act UNION ALL SELECT owner, thread_id, last_active_ms, 1 FROM fb
 UNION ALL SELECT owner, thread_id, last_active_ms, 0 FROM threads JOIN pins USING (owner, thread_id) WHERE status <> 'closed'),
one AS (SELECT owner, thread_id, any_value(last_active_ms) AS t, min(pri) AS pri FROM al GROUP BY 1, 2)
SELECT owner, thread_id, row_number() OVER (PARTITION BY owner ORDER BY pri, t DESC, thread_id) AS position FROM one QUALIFY position <= 3""",
)
def f4(spark, sf):
    return ranking.thread_candidates(v.threads(spark, sf), pins(spark, sf)).select("owner", "thread_id", "position")


@query(
    "f6_lens_state",
    v.more("threads") + PINS_SQL + """,
rec AS (SELECT *, false AS pinned FROM threads WHERE status <> 'closed' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY last_active_ms DESC, thread_id) <= 6),
al AS (SELECT * FROM rec UNION ALL SELECT threads.*, true FROM threads JOIN pins USING (owner, thread_id) WHERE status <> 'closed'),
one AS (SELECT owner, thread_id, any_value(last_active_ms) AS t, any_value(status) AS status, bool_or(pinned) AS pinned FROM al GROUP BY 1, 2),
top AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY owner ORDER BY pinned DESC, t DESC, thread_id) <= 6)
SELECT owner, thread_id, pinned, row_number() OVER (PARTITION BY owner ORDER BY t DESC, thread_id) AS position,
row_number() OVER (PARTITION BY owner ORDER BY pinned DESC, (status = 'active') DESC, t DESC, thread_id) = 1 AS resolved FROM top""",
)
def f6(spark, sf):
    return ranking.lens_state(v.threads(spark, sf), pins(spark, sf)).select("owner", "thread_id", "pinned", "position", "resolved")


RANK_SQL = v.more("nodes") + """cand AS (SELECT ts_ms // 86400000 AS query_id, id, ts_ms, kind, thread_id, app_hint, importance, issue,
 (k % 2)::INT AS entity_boost, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS app_boost, CASE WHEN k % 4 <> 0 THEN value END AS score,
 CASE WHEN (ts_ms // 86400000) % 2 = 0 THEN 'knowledge' END AS kind_hint, ts_ms // 86400000 * 86400000 AS from_ms, ts_ms // 86400000 * 86400000 + 86399999 AS to_ms FROM nodes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY issue DESC, entity_boost DESC, app_boost DESC, (score IS NOT NULL) DESC,
 score * (1.2::DOUBLE - importance / 10) ASC NULLS FIRST, ts_ms DESC, id) AS rn FROM cand)
"""


def ranked(spark, sf):
    k, day = F.col("k"), F.floor(F.col("ts_ms") / DAY_MS)
    cand = v.nodes(spark, sf).select(
        day.alias("query_id"), "id", "ts_ms", "kind", "thread_id", "app_hint", "importance", "issue", (k % 2).cast("int").alias("entity_boost"),
        F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.5).otherwise(0.0).alias("app_boost"), F.when(k % 4 != 0, F.col("value")).alias("score"),
        F.when(day % 2 == 0, "knowledge").alias("kind_hint"), (day * DAY_MS).alias("from_ms"), (day * DAY_MS + DAY_MS - 1).alias("to_ms"),
    )
    return ranking.rank_results(cand)


@query("f5_rank_results", RANK_SQL + "SELECT query_id, id, rn FROM ranked")
def f5(spark, sf):
    return ranked(spark, sf).select("query_id", "id", "rn")


@query("f9_select_for_answer")
def f9(spark, sf):
    return ranking.select_for_answer(ranked(spark, sf))


@query(
    "f11_one_per_bucket",
    RANK_SQL + """SELECT query_id, bucket, id FROM (SELECT *, least(4, greatest(0, (ts_ms - from_ms) // greatest(1, (to_ms - from_ms) // 5))) AS bucket FROM ranked)
QUALIFY row_number() OVER (PARTITION BY query_id, bucket ORDER BY rn) = 1""",
)
def f11(spark, sf):
    return ranking.one_per_bucket(ranked(spark, sf)).select("query_id", "bucket", "id")


@query(
    "f7_lane_order",
    v.more("work") + f"""l AS (SELECT id, ts_ms, CASE WHEN attempts > 0 OR ts_ms < {WORK_NOW} - 600000 THEN 'recovery' ELSE 'realtime' END AS lane FROM work),
r AS (SELECT id, lane, row_number() OVER (PARTITION BY lane ORDER BY CASE WHEN lane = 'recovery' THEN ts_ms ELSE -ts_ms END, id) - 1 AS r FROM l)
SELECT id, lane, CASE WHEN lane = 'realtime' THEN r // 3 * 4 + r % 3 ELSE r * 4 + 3 END AS slot FROM r""",
)
def f7(spark, sf):
    return ranking.lane_order(v.work(spark, sf), WORK_NOW).select("id", "lane", "slot")


@query(
    "f8_last_n",
    v.cte("usage") + "SELECT capability, id, row_number() OVER (PARTITION BY capability ORDER BY ts_ms DESC, id DESC) AS rn FROM usage QUALIFY rn <= 300",
)
def f8(spark, sf):
    return ranking.last_n(v.usage(spark, sf), "capability", 300).select("capability", "id", "rn")


@query(
    "f10_char_budget",
    """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, length(text) AS n FROM conversations),
u AS (SELECT conv_id, turn, rn, CAST(2 + sum(n) OVER (PARTITION BY conv_id ORDER BY rn) + rn - 1 AS BIGINT) AS used FROM c WHERE rn <= 50)
SELECT conv_id, turn, used FROM u WHERE used <= 24000""",
)
def f10(spark, sf):
    return ranking.char_budget(v.table(spark, sf, "conversations"), "conv_id", [F.col("turn")], "text", 50, 24_000).select("conv_id", "turn", "used")


@query(
    "f12_retention_plan",
    v.more("captures") + f"""m AS (SELECT 'capture-' || ts_ms || '-' || id || '.png' AS name, ts_ms AS mtime_ms FROM captures)
SELECT name, row_number() OVER (ORDER BY name DESC) > 1000 OR 1706659200000 - mtime_ms > 172800000 AS delete FROM m""",
)
def f12(spark, sf):
    c = v.captures(spark, sf)
    name = F.concat(F.lit("capture-"), F.col("ts_ms").cast("string"), F.lit("-"), F.col("id").cast("string"), F.lit(".png"))
    m = c.select(name.alias("name"), F.col("ts_ms").alias("mtime_ms"))
    return ranking.retention_plan(m, 1_706_659_200_000, max_age_ms=172_800_000).select("name", "delete")


@query(
    "f13_failure_bursts",
    v.more("usage") + """f AS (SELECT capability, id, ts_ms, count(*) OVER (PARTITION BY capability ORDER BY ts_ms RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW) AS failures,
 coalesce(ts_ms - lag(ts_ms, 2) OVER (PARTITION BY capability ORDER BY ts_ms, id) <= 7200000, false) AS hit FROM usage WHERE status = 'failed')
SELECT capability, id, failures, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY capability ORDER BY ts_ms, id), false) AS tripped FROM f""",
)
def f13(spark, sf):
    failed = v.usage(spark, sf).filter("status = 'failed'")
    return ranking.failure_bursts(failed, "capability", width_ms=7_200_000).select("capability", "id", "failures", "tripped")


@query(
    "f14_trailing_failure_rate",
    v.more("usage") + """u AS (SELECT *, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS bad FROM usage),
w AS (SELECT capability, id, ts_ms, bad, count(*) OVER r AS window_rows, avg(bad) OVER r AS rate, bad <> lag(bad) OVER o AS change FROM u
 WINDOW r AS (PARTITION BY capability ORDER BY ts_ms, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), o AS (PARTITION BY capability ORDER BY ts_ms, id)),
g AS (SELECT *, sum(CASE WHEN change THEN 1 ELSE 0 END) OVER (PARTITION BY capability ORDER BY ts_ms, id) AS island FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY capability, island ORDER BY ts_ms, id) AS run FROM g)
SELECT capability, id, window_rows, round(rate, 9) AS failure_rate, CASE WHEN bad = 1 THEN run ELSE 0 END AS failure_run, CASE WHEN bad = 0 THEN run ELSE 0 END AS success_run FROM n""",
)
def f14(spark, sf):
    out = ranking.trailing_failure_rate(v.usage(spark, sf), "capability")
    return out.drop("ts_ms").withColumn("failure_rate", F.round("failure_rate", 9))


@query(
    "f15_counter_rate",
    v.more("nodes") + """c AS (SELECT thread_id, id, ts_ms, k * 3000000 AS c FROM nodes WHERE thread_id IS NOT NULL),
d AS (SELECT thread_id, id, ts_ms - lag(ts_ms) OVER w AS dt, c - lag(c) OVER w AS dc FROM c WINDOW w AS (PARTITION BY thread_id ORDER BY ts_ms, id))
SELECT thread_id, id, round(greatest(0.0, least(100.0, CASE WHEN dt > 0 THEN dc / dt * 100 ELSE 0.0 END)), 6)::DOUBLE AS rate FROM d""",
)
def f15(spark, sf):
    rows = v.nodes(spark, sf).filter("thread_id IS NOT NULL").select("thread_id", "id", "ts_ms", (F.col("k") * 3_000_000).alias("c"))
    return ranking.counter_rate(rows, "thread_id", "c").select("thread_id", "id", F.round("rate", 6).alias("rate"))


@query(
    "f16_order_evidence",
    v.more("captures") + """e AS (SELECT ts_ms // 86400000 AS query_id, id AS screenshot_id, ts_ms, phash FROM captures)
SELECT query_id, screenshot_id, row_number() OVER (PARTITION BY query_id ORDER BY (phash % 30 = 0) DESC, ts_ms DESC, screenshot_id) AS rn FROM e QUALIFY rn <= 25""",
)
def f16(spark, sf):
    e = v.captures(spark, sf).select(F.floor(F.col("ts_ms") / DAY_MS).alias("query_id"), F.col("id").alias("screenshot_id"), "ts_ms", "phash")
    shown = e.filter("phash % 30 = 0").select("query_id", "screenshot_id")
    return ranking.order_evidence(e, shown).select("query_id", "screenshot_id", "rn")


def summaries(spark, sf):
    """One summary row per non-empty 20-minute window."""
    start = F.floor(F.col("ts_ms") / 1_200_000) * 1_200_000
    n = v.nodes(spark, sf).groupBy(start.alias("window_start")).agg(F.max("id").alias("summary_id"), F.max("k").alias("k"))
    return n.select(
        "summary_id", "window_start", (F.col("window_start") + 1_200_000).alias("window_end"),
        F.when(F.col("k") % 5 == 0, "no_data").when(F.col("k") % 5 == 1, "pending").otherwise("succeeded").alias("status"),
        (F.col("window_start") + F.col("k") * 3_600_000).alias("updated_ms"),
    )


SUMMARIES_SQL = """sm AS (SELECT summary_id, window_start, window_start + 1200000 AS window_end,
 CASE k % 5 WHEN 0 THEN 'no_data' WHEN 1 THEN 'pending' ELSE 'succeeded' END AS status, window_start + k * 3600000 AS updated_ms
 FROM (SELECT ts_ms // 1200000 * 1200000 AS window_start, max(id) AS summary_id, max(k) AS k FROM nodes GROUP BY 1))"""


@query(
    "f17_latest_summary_threads",
    v.more("nodes") + SUMMARIES_SQL + """,
l AS (SELECT * FROM sm WHERE status = 'succeeded' ORDER BY updated_ms DESC, summary_id DESC LIMIT 1)
SELECT DISTINCT summary_id, thread_id FROM (
 SELECT summary_id, thread_id FROM nodes JOIN l ON ts_ms >= window_start AND ts_ms < window_end
 UNION ALL SELECT summary_id, 't' || (k % 9) FROM nodes JOIN l ON id % 50 = summary_id % 50) WHERE thread_id IS NOT NULL""",
)
def f17(spark, sf):
    n, s = v.nodes(spark, sf), summaries(spark, sf)
    ids = s.select("summary_id", (F.col("summary_id") % 50).alias("m"))
    ev = n.select((F.col("id") % 50).alias("m"), F.concat(F.lit("t"), (F.col("k") % 9).cast("string")).alias("thread_id")).distinct()
    events = ids.join(ev, "m").select("summary_id", "thread_id")
    return ranking.latest_summary_threads(s, n.select("thread_id", "ts_ms"), events, 1_200_000)


# --- G: sorted lists ---------------------------------------------------------------------


@query("g1_list_threads", v.cte("threads") + "SELECT thread_id, last_active_ms FROM threads WHERE status <> 'closed' ORDER BY last_active_ms DESC, thread_id LIMIT 50")
def g1(spark, sf):
    return ranking.list_threads(v.threads(spark, sf)).select("thread_id", "last_active_ms")


@query(
    "g5_timeline",
    v.more("nodes") + SUMMARIES_SQL + f"""
SELECT 'window' AS row, window_start AS start_ms, window_end AS end_ms, NULL::VARCHAR AS key FROM sm WHERE window_start <= {HI} AND window_end >= {LO}
UNION ALL SELECT 'event', ts_ms, ts_ms + k * 60000, title FROM nodes WHERE k >= 95 AND ts_ms < {HI} AND ts_ms + k * 60000 > {LO}""",
)
def g5(spark, sf):
    e = v.nodes(spark, sf).filter("k >= 95").select(
        F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.col("k") * 60_000).alias("end_ms"), F.col("title").alias("event_key")
    )
    return ranking.timeline(summaries(spark, sf), e, LO, HI)


@query(
    "g6_recent_errors",
    v.cte("usage") + f"SELECT id, ts_ms, error_code FROM usage WHERE status = 'failed' AND ts_ms BETWEEN {NOW - 48 * HOUR} AND {NOW} ORDER BY ts_ms DESC, id DESC LIMIT 50",
)
def g6(spark, sf):
    return ranking.recent_errors(v.usage(spark, sf), NOW, 50, 48 * HOUR).select("id", "ts_ms", "error_code")


# --- H: set operations -------------------------------------------------------------------


@query(
    "h1_merge_first",
    """WITH u AS (SELECT c_custkey AS id, c_name AS name, 0 AS stage FROM customer WHERE c_custkey % 2 = 0 UNION ALL
SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT p_partkey, p_name, 2 FROM part)
SELECT id, arg_min(name, stage) AS name, min(stage) AS stage FROM u GROUP BY 1""",
)
def h1(spark, sf):
    t = lambda n, k, c: v.table(spark, sf, n).select(F.col(k).alias("id"), F.col(c).alias("name"))
    a = t("customer", "c_custkey", "c_name").filter("id % 2 = 0")
    return sets.merge_first([a, t("supplier", "s_suppkey", "s_name"), t("part", "p_partkey", "p_name")], ["id"])


@query(
    "h2_merge_ids",
    v.more("nodes") + """x AS (SELECT id, unnest(l) AS n, generate_subscripts(l, 1) AS pos FROM
(SELECT id, list_concat([k % 5, id, k % 3], CASE WHEN k % 4 = 0 THEN [] ELSE [k % 7, id + 1, k % 2] END) AS l FROM nodes)),
y AS (SELECT id, n, min(pos) AS pos FROM x GROUP BY 1, 2)
SELECT id, string_agg(n::VARCHAR, ',' ORDER BY pos) AS ids FROM y GROUP BY 1""",
)
def h2(spark, sf):
    k, i = F.col("k"), F.col("id")
    out = sets.merge_ids(F.array(k % 5, i, k % 3), F.when(k % 4 != 0, F.array(k % 7, i + 1, k % 2)))
    return v.nodes(spark, sf).select("id", F.array_join(F.transform(out, lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "h3_merge_entities",
    v.more("nodes") + """x AS (SELECT id, unnest(l) AS n, generate_subscripts(l, 1) AS pos FROM
(SELECT id, list_concat(CASE WHEN k % 3 = 0 THEN [] ELSE entities END, keywords, entities) AS l FROM nodes)),
y AS (SELECT id, n, min(pos) AS pos FROM x GROUP BY 1, 2)
SELECT id, string_agg(n, ',' ORDER BY pos) AS names FROM y GROUP BY 1""",
)
def h3(spark, sf):
    own = F.when(F.col("k") % 3 != 0, F.col("entities"))
    plan = F.concat("keywords", "entities")
    return v.nodes(spark, sf).select("id", F.array_join(sets.merge_entities(own, plan), ",").alias("names"))


@query(
    "h4_two_way_diff",
    ASSIGN_SQL + """, l AS (SELECT DISTINCT batch_id, node_index FROM a WHERE thread_id = 'NEW'), r AS (SELECT DISTINCT batch_id, node_index FROM n)
SELECT *, 'left' AS only_in FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""",
)
def h4(spark, sf):
    a, new, _ = assignment_inputs(spark, sf)
    return sets.two_way_diff(a.filter("thread_id = 'NEW'"), new, ["batch_id", "node_index"])


@query(
    "h5_affected_threads",
    ASSIGN_SQL + "SELECT thread_id FROM a WHERE thread_id <> 'NEW' UNION SELECT 't' || c_custkey FROM customer WHERE c_acctbal < 0",
)
def h5(spark, sf):
    a, _, _ = assignment_inputs(spark, sf)
    u = v.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("thread_id"))
    return sets.affected_threads(a, u)

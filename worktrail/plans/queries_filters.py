"""Queries for filters and predicates (group C) and joins (group D)."""

from pyspark.sql import functions as F

from worktrail.operators import filters as flt
from worktrail.operators import joins, match
from worktrail.operators.blocks import DAY_MS
from worktrail.operators.search import build_index, fts_match
from worktrail.plans import views as v
from worktrail.plans.queries_functions import ALIASES_SQL, PARTS_SQL, aliases, named_parts
from worktrail.plans.registry import query
from worktrail.session import dealt, prepare, spread
from worktrail.sources.tables import scan

NOW = 1_705_363_200_000
LO, HI = 1_704_153_600_000, 1_705_363_200_000
WIN = 1_200_000


# --- C: filters --------------------------------------------------------------------------


@query(
    "c1_active_only",
    v.cte("captures") + "SELECT id, source_key FROM captures WHERE source_key IN (SELECT 'window:' || s_suppkey FROM supplier WHERE s_acctbal > 0)",
)
def c1(spark, sf):
    active = v.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("window:"), F.col("s_suppkey").cast("string")).alias("source_key"))
    return flt.active_only(v.captures(spark, sf), active).select("id", "source_key")


def sources(spark, sf):
    p = named_parts(spark, sf)
    kind = F.when(F.col("id") % 5 == 0, "screen").otherwise("window")
    return p.select("id", "name", kind.alias("type"))


def system(spark, sf):
    p = v.table(spark, sf, "part")
    return p.filter("p_size % 10 = 0").select(F.col("p_type").alias("name")).unionByName(p.filter("p_size = 7").select(F.col("p_name").alias("name"))).distinct()


SYSTEM_SQL = """src AS (SELECT id, name, CASE WHEN id % 5 = 0 THEN 'screen' ELSE 'window' END AS type FROM parts),
sys AS (SELECT DISTINCT lower(name) AS low FROM (SELECT p_type AS name FROM part WHERE p_size % 10 = 0 UNION ALL SELECT p_name FROM part WHERE p_size = 7)),
named AS (SELECT src.*, coalesce(canonical, name) AS app FROM src LEFT JOIN known ON lower(trim(name)) = alias),
keep AS (SELECT * FROM named WHERE type = 'screen' OR (lower(name) NOT IN (SELECT low FROM sys) AND lower(app) NOT IN (SELECT low FROM sys)))"""


@query("c2_drop_system_windows", f"WITH {ALIASES_SQL},\n{PARTS_SQL},\n{SYSTEM_SQL}\nSELECT id, name, type FROM keep")
def c2(spark, sf):
    return flt.drop_system_windows(sources(spark, sf), system(spark, sf), aliases(spark, sf)).select("id", "name", "type")


@query("g7_app_list", f"WITH {ALIASES_SQL},\n{PARTS_SQL},\n{SYSTEM_SQL}\nSELECT id AS source_id, name FROM keep WHERE trim(name) <> ''")
def g7(spark, sf):
    from worktrail.operators.ranking import app_list

    s = sources(spark, sf).withColumnRenamed("id", "source_id")
    return app_list(s, system(spark, sf), aliases(spark, sf)).select("source_id", "name")


@query("c3a_in_range", v.cte("nodes") + f"SELECT id FROM nodes WHERE ts_ms BETWEEN {LO} AND {HI}")
def c3a(spark, sf):
    return flt.within(v.nodes(spark, sf), LO, HI).select("id")


@query("c3b_in_window", v.cte("nodes") + f"SELECT id FROM nodes WHERE ts_ms >= {LO} AND ts_ms < {HI}")
def c3b(spark, sf):
    return flt.within(v.nodes(spark, sf), LO, HI, closed=False).select("id")


@query(
    "c3c_overlaps",
    v.cte("nodes") + f"SELECT id, ts_ms <= {HI} AND ts_ms + k * 60000 >= {LO} AS touches, ts_ms < {HI} AND ts_ms + k * 60000 > {LO} AS overlaps FROM nodes",
)
def c3c(spark, sf):
    s, e = F.col("ts_ms"), F.col("ts_ms") + F.col("k") * 60_000
    return v.nodes(spark, sf).select(
        "id", flt.overlaps(s, e, F.lit(LO), F.lit(HI), True).alias("touches"), flt.overlaps(s, e, F.lit(LO), F.lit(HI), False).alias("overlaps")
    )


@query("c4_in_thread", v.cte("nodes") + "SELECT id FROM nodes WHERE thread_id = 't7'")
def c4(spark, sf):
    return v.nodes(spark, sf).filter(flt.in_thread("thread_id", F.lit("t7"))).select("id")


def wanted(spark, sf):
    b = v.table(spark, sf, "benchmark")
    i = F.col("item_id")
    e = F.when(i % 3 == 0, F.concat(F.lit(" ENT "), (i % 9).cast("string"))).when(i % 3 == 1, F.lit("proj")).otherwise((i % 6).cast("string"))
    return b.select(i.alias("query_id"), F.array(e, F.lit(" ")).alias("entities"))


WANT_SQL = "want AS (SELECT item_id AS query_id, trim(lower(CASE item_id % 3 WHEN 0 THEN ' ENT ' || (item_id % 9) WHEN 1 THEN 'proj' ELSE (item_id % 6)::VARCHAR END)) AS w FROM benchmark)"


@query(
    "c5_entity_match",
    v.more("nodes") + WANT_SQL + """
SELECT id, query_id FROM nodes, want WHERE contains(lower(entities[1]), w) OR contains(lower(entities[2]), w)""",
)
def c5(spark, sf):
    return flt.entity_match(v.nodes(spark, sf), wanted(spark, sf))


def keyword_queries(spark, sf):
    """A query word per benchmark row, some with wildcards."""
    i = F.col("item_id")
    term = F.when(i % 4 == 0, F.concat(F.lit("k_"), (i % 17).cast("string"))).when(i % 4 == 1, F.lit("CLICK")).when(
        i % 4 == 2, F.concat(F.lit("r%"), (i % 10).cast("string"))).otherwise(F.concat(F.lit("iew "), (i % 10).cast("string")))
    return v.table(spark, sf, "benchmark").select(i.alias("query_id"), term.alias("term"))


KWQ_SQL = """kq AS (SELECT item_id AS query_id, translate(CASE item_id % 4 WHEN 0 THEN 'k_' || (item_id % 17) WHEN 1 THEN 'CLICK'
 WHEN 2 THEN 'r%' || (item_id % 10) ELSE 'iew ' || (item_id % 10) END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
t AS (SELECT DISTINCT term FROM kq),
kh AS (SELECT DISTINCT id, term, ts_ms FROM nodes, t WHERE title LIKE '%' || term || '%' OR array_to_string(keywords, ' ') LIKE '%' || term || '%')
"""


def keyword_nodes(spark, sf):
    return spread(v.nodes(spark, sf)).withColumn("kw", F.array_join("keywords", " "))


@query(
    "c6_keyword_hits",
    v.more("nodes") + KWQ_SQL + "SELECT query_id, count(*) AS hits, CAST(sum(id) AS BIGINT) AS ids FROM kh JOIN kq USING (term) GROUP BY 1",
)
def c6(spark, sf):
    hits = flt.keyword_hits(keyword_nodes(spark, sf), "id", ["title", "kw"], keyword_queries(spark, sf))
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum("id").alias("ids"))


@query(
    "g3_keyword_top",
    v.more("nodes") + KWQ_SQL + """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY ts_ms DESC, id DESC) AS rn
FROM kh JOIN kq USING (term) QUALIFY rn <= 30""",
)
def g3(spark, sf):
    from worktrail.operators.search import keyword_top

    n = keyword_nodes(spark, sf)
    hits = flt.keyword_hits(n, "id", ["title", "kw"], keyword_queries(spark, sf))
    return keyword_top(hits.join(n.select("id", "ts_ms"), "id")).select("query_id", "id", "rn")


@query(
    "c6_keyword_hits_documents",
    """WITH w AS (SELECT item_id AS query_id, unnest(list_concat(
   [translate(trim(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')],
   string_split(translate(left(text, 200), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ')[3:5])) AS term FROM benchmark),
t AS (SELECT DISTINCT term FROM w WHERE length(term) > 1),
d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
h AS (SELECT doc_id, term FROM d JOIN t ON contains(low, term))
SELECT DISTINCT doc_id, query_id FROM h JOIN w USING (term)""",
)
def c6d(spark, sf):
    b = v.table(spark, sf, "benchmark")
    low = match.ascii_lower(F.substring("text", 1, 200))
    whole = match.ascii_lower(F.trim("text"))
    words = F.concat(F.array(whole), F.slice(F.split(low, " ", -1), 3, 3))
    terms = b.select(F.col("item_id").alias("query_id"), F.explode(words).alias("term")).filter(F.length("term") > 1)
    return flt.keyword_hits(dealt(scan(prepare(spark), f"{sf}/documents.parquet").select("doc_id", "text")), "doc_id", ["text"], terms)


def fts_queries(spark, sf):
    """All words of each whole benchmark text."""
    b = v.table(spark, sf, "benchmark")
    from worktrail.functions.text import tokens

    return b.select(F.col("item_id").alias("query_id"), F.array_join(tokens("text"), " ").alias("text"))


def documents(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", "text")


WORDS_SQL = r"""tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS length FROM documents),
qt AS (SELECT query_id, unnest(list_distinct(ws)) AS term, len(list_distinct(ws)) AS n_terms FROM (SELECT item_id AS query_id,
  list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')[4:5] AS ws FROM benchmark))
"""
# All words of the whole texts.
INDEX_SQL = WORDS_SQL.replace("[4:5]", "")


@query(
    "c7_fts_match",
    "WITH " + INDEX_SQL + "SELECT query_id, doc_id FROM post JOIN qt USING (term) GROUP BY 1, 2 HAVING count(*) = max(n_terms)",
)
def c7(spark, sf):
    postings, _ = build_index(documents(spark, sf))
    return fts_match(postings, fts_queries(spark, sf))


MINUTE = "(extract(hour FROM ts) * 60 + extract(minute FROM ts))"


@query(
    "c8_capture_allowed",
    v.cte("ev") + f"""SELECT event_id, CASE WHEN event_type = 'error' THEN true WHEN event_type = 'signup' THEN false ELSE
 {MINUTE} BETWEEN 600 AND 720 OR {MINUTE} BETWEEN 840 AND 1080 END AS allowed FROM ev""",
)
def c8(spark, sf):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    windows = F.array(span("10:00", "12:00"), span("14:00", "18:00"), span("22:00", "06:00"), span("bad", "12:00"))
    override = F.when(F.col("event_type") == "error", "force_on").when(F.col("event_type") == "signup", "force_off").otherwise("none")
    return v.events(spark, sf).select("event_id", flt.capture_allowed(F.col("ts"), windows, override).alias("allowed"))


@query(
    "c9_in_dnd",
    v.cte("ev") + f"""SELECT event_id, CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN {MINUTE} >= 540 AND {MINUTE} < 1020
WHEN 2 THEN {MINUTE} >= 1320 OR {MINUTE} < 420 ELSE false END AS quiet FROM ev""",
)
def c9(spark, sf):
    u = F.col("user_id") % 4
    a = F.when(u == 0, "08:00").when(u == 1, "09:00").when(u == 2, "22:00").otherwise("x")
    b = F.when(u == 0, "08:00").when(u == 1, "17:00").when(u == 2, "07:00").otherwise("09:00")
    return v.events(spark, sf).select("event_id", flt.in_dnd(F.col("ts"), a, b).alias("quiet"))


WORK_NOW = 883_612_800_000  # 1998-01-01, inside the orders table


@query(
    "c10_eligible",
    v.cte("work") + f"""SELECT id FROM work WHERE status IN ('pending', 'failed') AND attempts < 2 AND (next_run_at IS NULL OR next_run_at <= {WORK_NOW})
AND upstream_status = 'succeeded' AND payload IS NOT NULL""",
)
def c10(spark, sf):
    c = F.col
    ok = flt.eligible(c("status"), c("attempts"), c("next_run_at"), F.lit(WORK_NOW), c("upstream_status"), c("payload"))
    return v.work(spark, sf).filter(ok).select("id")


@query(
    "c11_needs_ocr",
    v.cte("captures") + """SELECT id, coalesce(phash % 3 = 1 AND (CASE WHEN app_hint = 'view' THEN 'fr' WHEN app_hint = 'click' THEN 'zh' ELSE 'en' END) IN ('en', 'zh')
AND file_path IS NOT NULL AND storage_state <> 'deleted', false) AS needs FROM captures""",
)
def c11(spark, sf):
    c = F.col
    lang = F.when(c("app_hint") == "view", "fr").when(c("app_hint") == "click", "zh").otherwise("en")
    knowledge = F.when(c("phash") % 3 == 1, "k")
    return v.captures(spark, sf).select("id", flt.needs_ocr(knowledge, lang, c("file_path"), c("storage_state")).alias("needs"))


def capture_batches(spark, sf):
    k = F.col("o_orderkey")
    o = v.table(spark, sf, "orders")
    return o.select(k.alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("pending").alias("vlm_status"))


BATCH_SQL = "b AS (SELECT o_orderkey AS batch_id, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'pending' END AS vlm_status FROM orders)"


@query(
    "c12_retention_candidates",
    v.more("captures") + BATCH_SQL + f"""
SELECT id, batch_id FROM captures JOIN b USING (batch_id) WHERE storage_state = 'ephemeral' AND ts_ms < {NOW} - 86400000 AND file_path IS NOT NULL
AND (ocr_status IS NULL OR ocr_status IN ('succeeded', 'failed_permanent')) AND vlm_status = 'succeeded'""",
)
def c12(spark, sf):
    return flt.retention_candidates(v.captures(spark, sf), capture_batches(spark, sf), NOW).select("id", "batch_id")


@query(
    "c13_notify_gate",
    v.cte("ev") + f"""SELECT event_id, user_id % 5 <> 0 AND NOT (user_id % 2 = 0 AND ({MINUTE} >= 1320 OR {MINUTE} < 420)) AND event_type IN ('error', 'purchase') AS show FROM ev""",
)
def c13(spark, sf):
    u = F.col("user_id")
    types = F.create_map(*[x for t in ("error", "purchase") for x in (F.lit(t), F.lit(True))], F.lit("view"), F.lit(False))
    prefs = F.struct(
        (u % 5 != 0).alias("enabled"), (u % 2 == 0).alias("dnd_enabled"), F.lit("22:00").alias("dnd_from"),
        F.lit("07:00").alias("dnd_to"), types.alias("types"),
    )
    return v.events(spark, sf).select("event_id", flt.notify_gate(F.col("ts"), F.col("event_type"), prefs).alias("show"))


@query(
    "c14_hide_covered_events",
    v.more("nodes") + """e AS (SELECT id, ts_ms // 86400000 AS window_start, thread_id, k >= 80 AS is_long FROM nodes)
SELECT id FROM e WHERE is_long OR thread_id IS NULL OR NOT EXISTS
 (SELECT 1 FROM e AS l WHERE l.is_long AND l.window_start = e.window_start AND l.thread_id = e.thread_id)""",
)
def c14(spark, sf):
    n = v.nodes(spark, sf)
    e = n.select("id", F.floor(F.col("ts_ms") / DAY_MS).alias("window_start"), "thread_id", (F.col("k") >= 80).alias("is_long"))
    return flt.hide_covered_events(e).select("id")


@query(
    "c15_prefer_kind",
    v.more("nodes") + """r AS (SELECT ts_ms // 1200000 AS query_id, id, kind, CASE WHEN (ts_ms // 1200000) % 2 = 0 THEN 'knowledge' END AS hint FROM nodes),
m AS (SELECT *, count(*) FILTER (kind = hint) OVER (PARTITION BY query_id) AS hits FROM r)
SELECT query_id, id FROM m WHERE hits = 0 OR kind = hint""",
)
def c15(spark, sf):
    q = F.floor(F.col("ts_ms") / WIN)
    r = v.nodes(spark, sf).select(q.alias("query_id"), "id", "kind", F.when(q % 2 == 0, "knowledge").alias("kind_hint"))
    return flt.prefer_kind(r).select("query_id", "id")


@query(
    "c16_flags",
    f"""WITH {ALIASES_SQL},
{PARTS_SQL},
imp AS (SELECT lower(canonical) AS low FROM al UNION SELECT lower(alias) FROM al),
n AS (SELECT id, name, coalesce(canonical, name) AS app FROM parts LEFT JOIN known ON lower(trim(name)) = alias)
SELECT id, lower(trim(name)) IN ('null', 'red widget') AS own, lower(name) IN (SELECT low FROM imp) OR lower(app) IN (SELECT low FROM imp) AS important FROM n""",
)
def c16(spark, sf):
    out = flt.flag_important(named_parts(spark, sf), "name", aliases(spark, sf))
    return out.select("id", flt.flag_self("name", ["Null", "red widget"]).alias("own"), "important")


# --- D: joins ----------------------------------------------------------------------------


@query(
    "a3_explode_members",
    v.more("captures") + """bt AS (SELECT o_orderkey AS batch_id, [o_custkey * 3, o_orderkey, o_custkey, -1] AS ids FROM orders),
m AS (SELECT batch_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM bt)
SELECT m.batch_id, pos, id, source_key FROM m JOIN captures USING (id)""",
)
def a3(spark, sf):
    o, c = v.table(spark, sf, "orders"), F.col
    ids = F.array(c("o_custkey") * 3, c("o_orderkey"), c("o_custkey"), F.lit(-1).cast("long"))
    batches = o.select(c("o_orderkey").alias("batch_id"), ids.alias("screenshot_ids"))
    return joins.explode_members(batches, v.captures(spark, sf).select("id", "source_key"))


@query("d1_captures_with_batch", v.more("captures") + BATCH_SQL + "\nSELECT id, batch_id, vlm_status FROM captures JOIN b USING (batch_id)")
def d1(spark, sf):
    return joins.captures_with_batch(v.captures(spark, sf), capture_batches(spark, sf)).select("id", "batch_id", "vlm_status")


def result_nodes(spark, sf):
    o = v.table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").alias("id"))


@query(
    "d2_evidence",
    v.more("links", "captures") + """n AS (SELECT DISTINCT o_custkey % 50 AS query_id, o_orderkey AS node_id FROM orders),
l AS (SELECT DISTINCT * FROM links),
p AS (SELECT query_id, screenshot_id, count(*) AS node_count FROM n JOIN l USING (node_id) GROUP BY 1, 2)
SELECT query_id, screenshot_id, node_count, ts_ms, app_hint FROM p JOIN captures ON id = screenshot_id""",
)
def d2(spark, sf):
    caps = v.captures(spark, sf).select("id", "ts_ms", "app_hint")
    return joins.evidence(result_nodes(spark, sf), v.links(spark, sf), caps)


@query(
    "d3_nodes_for_hits",
    v.more("links") + """h AS (SELECT DISTINCT p_size AS query_id, p_partkey AS screenshot_id FROM part)
SELECT DISTINCT query_id, o_orderkey AS id, o_orderstatus FROM h JOIN links USING (screenshot_id) JOIN orders ON o_orderkey = node_id""",
)
def d3(spark, sf):
    hits = v.table(spark, sf, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("screenshot_id"))
    nodes = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return joins.nodes_for_hits(hits, v.links(spark, sf), nodes)


@query(
    "d4_nodes_for_vectors",
    v.more("nodes") + """m AS (SELECT l_suppkey AS query_id, l_partkey AS vector_id, l_discount + l_tax AS score FROM lineitem),
d AS (SELECT p_partkey AS vector_id, p_partkey // 2 AS ref_id FROM part)
SELECT query_id, id, min(score) AS score, any_value(title) AS title FROM m JOIN d USING (vector_id) JOIN nodes ON id = ref_id GROUP BY 1, 2""",
)
def d4(spark, sf):
    c = F.col
    matches = v.table(spark, sf, "lineitem").select(c("l_suppkey").alias("query_id"), c("l_partkey").alias("vector_id"), (c("l_discount") + c("l_tax")).alias("score"))
    docs = v.table(spark, sf, "part").select(c("p_partkey").alias("vector_id"), F.floor(c("p_partkey") / 2).alias("ref_id"))
    return joins.nodes_for_vectors(matches, docs, v.nodes(spark, sf).select("id", "title"))


def windows(spark, sf):
    n = v.nodes(spark, sf)
    start = F.floor(F.col("ts_ms") / WIN) * WIN
    return n.select(start.alias("window_start"), (start + WIN).alias("window_end")).distinct()


WINDOWS_SQL = "w AS (SELECT DISTINCT ts_ms // 1200000 * 1200000 AS window_start, ts_ms // 1200000 * 1200000 + 1200000 AS window_end FROM nodes)"


@query(
    "d5_range_join",
    v.more("nodes") + WINDOWS_SQL + """,
e AS (SELECT ts_ms AS s, ts_ms + k * 60000 AS e FROM nodes WHERE k >= 95)
SELECT window_start, window_end, EXISTS (SELECT 1 FROM e WHERE s < window_end AND e.e > window_start) AS has_long_event FROM w""",
)
def d5(spark, sf):
    long = v.nodes(spark, sf).filter("k >= 95").select(F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.col("k") * 60_000).alias("end_ms"))
    return joins.overlapped_windows(windows(spark, sf), long)


@query(
    "d6_assign_window",
    v.cte("nodes") + "SELECT id, ts_ms // 1200000 * 1200000 AS window_start, ts_ms // 1200000 * 1200000 + 1200000 AS window_end FROM nodes",
)
def d6(spark, sf):
    return joins.assign_window(v.nodes(spark, sf), "ts_ms").select("id", "window_start", "window_end")


@query(
    "d7_nearest_k",
    v.more("nodes") + """p AS (SELECT thread_id, id AS pivot_id, ts_ms FROM nodes WHERE importance >= 8 AND thread_id IS NOT NULL),
b AS (SELECT pivot_id, 'before' AS side, n.id FROM p JOIN nodes n USING (thread_id) WHERE n.ts_ms <= p.ts_ms
 QUALIFY row_number() OVER (PARTITION BY pivot_id ORDER BY n.ts_ms DESC, n.id DESC) <= 3),
a AS (SELECT pivot_id, 'after' AS side, n.id FROM p JOIN nodes n USING (thread_id) WHERE n.ts_ms >= p.ts_ms
 QUALIFY row_number() OVER (PARTITION BY pivot_id ORDER BY n.ts_ms, n.id) <= 3)
SELECT * FROM b UNION ALL SELECT * FROM a""",
)
def d7(spark, sf):
    n = v.nodes(spark, sf)
    pivots = n.filter("importance >= 8").select("thread_id", F.col("id").alias("pivot_id"), "ts_ms")
    return joins.nearest_k(pivots, n).select("pivot_id", "side", "id")


@query(
    "d8_band_join",
    v.more("nodes") + """p AS (SELECT id AS pivot_id, ts_ms FROM nodes WHERE thread_id IS NULL)
SELECT pivot_id, n.id FROM p JOIN nodes n ON n.ts_ms BETWEEN p.ts_ms - 1800000 AND p.ts_ms + 1800000
QUALIFY row_number() OVER (PARTITION BY pivot_id ORDER BY n.ts_ms, n.id) <= 6""",
)
def d8(spark, sf):
    n = v.nodes(spark, sf)
    pivots = n.filter("thread_id IS NULL").select(F.col("id").alias("pivot_id"), "ts_ms")
    # half an hour instead of two minutes: the test events are minutes apart
    return joins.band_join(pivots, n, radius_ms=1_800_000).select("pivot_id", "id")


def hour_windows(spark, sf):
    o = v.work(spark, sf)
    start = F.floor(F.col("id") * WIN) + 1_704_067_200_000
    return o.select(start.alias("window_start"), (start + WIN).alias("window_end"))


HW_SQL = "hw AS (SELECT o_orderkey * 1200000 + 1704067200000 AS window_start, o_orderkey * 1200000 + 1704067200000 + 1200000 AS window_end FROM orders)"


@query(
    "d9_nonempty_windows",
    v.more("nodes") + HW_SQL + "\nSELECT * FROM hw WHERE window_start IN (SELECT ts_ms // 1200000 * 1200000 FROM nodes)",
)
def d9(spark, sf):
    return joins.nonempty_windows(hour_windows(spark, sf), v.nodes(spark, sf))


@query(
    "d10_unseeded_windows",
    v.more("nodes") + HW_SQL + ",\n" + WINDOWS_SQL + "\nSELECT * FROM w WHERE window_start NOT IN (SELECT window_start FROM hw WHERE window_start % 3600000 = 0)",
)
def d10(spark, sf):
    return joins.unseeded_windows(windows(spark, sf), hour_windows(spark, sf).filter("window_start % 3600000 = 0"))


@query(
    "d11_text_regions",
    v.more("links", "captures") + """f AS (SELECT screenshot_id AS id, min(node_id) AS node_id FROM links GROUP BY 1),
n AS (SELECT o_orderkey AS node_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS text_region FROM orders)
SELECT id, node_id, text_region FROM captures LEFT JOIN f USING (id) LEFT JOIN n USING (node_id)""",
)
def d11(spark, sf):
    k = F.col("o_orderkey")
    nodes = v.table(spark, sf, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("text_region"))
    return joins.text_regions(v.captures(spark, sf).select("id"), v.links(spark, sf), nodes)


@query(
    "d13_match_source",
    f"""WITH {ALIASES_SQL},
apps AS (SELECT DISTINCT c_mktsegment AS app FROM customer UNION SELECT DISTINCT p_brand FROM part UNION SELECT n_name FROM nation),
src AS (SELECT s_suppkey AS position, CASE s_suppkey % 3 WHEN 0 THEN 'NATION_' || s_nationkey || ' of ' || s_name WHEN 1 THEN 'brand#' || (s_suppkey % 25) ELSE 'econ' END AS name FROM supplier),
can AS (SELECT app, coalesce(canonical, app) AS canon FROM apps LEFT JOIN known ON lower(trim(app)) = alias),
forms AS (SELECT app, lower(trim(app)) AS form FROM can UNION SELECT app, lower(canon) FROM can UNION SELECT app, lower(al.alias) FROM can JOIN al ON al.canonical = canon),
hit AS (SELECT app, min(position) AS position FROM forms, src WHERE contains(lower(trim(name)), form) OR contains(form, lower(trim(name))) GROUP BY 1)
SELECT app, position, name FROM hit JOIN src USING (position)""",
)
def d13(spark, sf):
    t = lambda n: v.table(spark, sf, n)
    apps = t("customer").select(F.col("c_mktsegment").alias("app")).union(t("part").select("p_brand")).union(t("nation").select("n_name")).distinct()
    k = F.col("s_suppkey")
    name = (
        F.when(k % 3 == 0, F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"), F.lit(" of "), "s_name"))
        .when(k % 3 == 1, F.concat(F.lit("brand#"), (k % 25).cast("string"))).otherwise(F.lit("econ"))
    )
    return match.match_source(apps, "app", t("supplier").select(k.alias("position"), name.alias("name")), aliases(spark, sf))


@query(
    "d15_enrich_windows",
    f"""WITH {ALIASES_SQL},
{PARTS_SQL},
{SYSTEM_SQL},
s AS (SELECT 'window:' || o_orderkey || ':0' AS source_id, CASE WHEN o_orderkey % 7 = 0 THEN 'screen' ELSE 'window' END AS type, o_orderpriority AS name, o_orderkey AS num FROM orders),
i AS (SELECT id AS num, trim(name) AS app_name, 'w' || id AS window_title, id FROM parts),
x AS (SELECT source_id, s.type, app_name AS name, app_name, window_title, coalesce(canonical, app_name) AS app FROM s JOIN i USING (num) LEFT JOIN known ON lower(app_name) = alias
  WHERE s.type = 'window' AND lower(app_name) <> 'null')
SELECT source_id, type, name, app_name, window_title FROM x WHERE lower(name) NOT IN (SELECT low FROM sys) AND lower(app) NOT IN (SELECT low FROM sys)
UNION ALL SELECT source_id, type, name, NULL, NULL FROM s WHERE type = 'screen'""",
)
def d15(spark, sf):
    k = F.col("o_orderkey")
    src = v.table(spark, sf, "orders").select(
        F.concat(F.lit("window:"), k.cast("string"), F.lit(":0")).alias("source_id"),
        F.when(k % 7 == 0, "screen").otherwise("window").alias("type"), F.col("o_orderpriority").alias("name"),
    )
    i = F.col("id")
    inspector = named_parts(spark, sf).select(
        i.alias("window_number"), F.trim("name").alias("app_name"), F.concat(F.lit("w"), i.cast("string")).alias("window_title")
    )
    return joins.enrich_windows(src, inspector, system(spark, sf), aliases(spark, sf), ["null"])


@query(
    "d16_source_visibility",
    """SELECT c_custkey AS source_id, coalesce(s_name, 'Unknown') AS name, s_name IS NOT NULL AS is_visible FROM customer
LEFT JOIN (SELECT s_suppkey * 7 AS k, s_name FROM supplier) ON k = c_custkey""",
)
def d16(spark, sf):
    asked = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"))
    seen = v.table(spark, sf, "supplier").select((F.col("s_suppkey") * 7).alias("source_id"), F.col("s_name").alias("name"))
    return joins.source_visibility(asked, seen)

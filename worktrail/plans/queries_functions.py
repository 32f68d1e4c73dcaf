"""Queries for the column functions (group B)."""

from pyspark.sql import functions as F

from worktrail.functions import keys, normalize, text
from worktrail.operators import match
from worktrail.plans import views as v
from worktrail.plans.registry import query


def joined(c, sep="|"):
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c, sep)


def docs(spark, sf):
    return v.table(spark, sf, "documents")


def pages(spark, sf):
    return v.table(spark, sf, "pages")


def talks(spark, sf):
    return v.table(spark, sf, "conversations")


# --- JSON, keys, apps --------------------------------------------------------------------


@query(
    "b1_json_or",
    """WITH j AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN replace(props, '}', '') WHEN event_id % 7 = 0 THEN NULL ELSE props END AS js FROM events)
SELECT event_id, CASE WHEN js IS NULL OR NOT json_valid(js) THEN -1 ELSE CAST(js->>'$.k' AS BIGINT) END AS k FROM j""",
)
def b1(spark, sf):
    i = F.col("event_id")
    js = F.when(i % 3 == 0, F.replace("props", F.lit("}"), F.lit(""))).when(i % 7 == 0, None).otherwise(F.col("props"))
    default = F.struct(F.lit(-1).cast("long").alias("k"))
    return v.table(spark, sf, "events").select("event_id", normalize.json_or(js, "k long", default)["k"].alias("k"))


@query(
    "b2_source_key",
    v.more("captures") + """s AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'tab:' || id ELSE source_key END AS sk FROM captures)
SELECT id, starts_with(sk, 'screen:') OR starts_with(sk, 'window:') AS valid,
CASE WHEN starts_with(sk, 'screen:') OR starts_with(sk, 'window:') THEN split_part(sk, ':', 1) END AS kind FROM s""",
)
def b2(spark, sf):
    sk = F.when(F.col("id") % 5 == 0, F.concat(F.lit("tab:"), F.col("id").cast("string"))).otherwise(F.col("source_key"))
    c = v.captures(spark, sf).withColumn("sk", sk)
    return c.select("id", keys.is_source_key("sk").alias("valid"), keys.source_kind("sk").alias("kind"))


def aliases(spark, sf):
    """App dimension out of the parts: the type is the canonical name, the brand an alias."""
    p = v.table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("alias")).agg(F.min("p_type").alias("canonical")).select("canonical", "alias")


ALIASES_SQL = """al AS (SELECT p_brand AS alias, min(p_type) AS canonical FROM part GROUP BY 1),
known AS (SELECT alias, max(canonical) AS canonical FROM
 (SELECT lower(canonical) AS alias, canonical FROM al UNION ALL SELECT lower(alias), canonical FROM al) GROUP BY 1)"""


def named_parts(spark, sf):
    k = F.col("p_partkey")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" ")))
        .when(k % 4 == 1, F.lower("p_type")).when(k % 4 == 2, F.col("p_name")).otherwise(F.lit("null"))
    )
    return v.table(spark, sf, "part").select(k.alias("id"), name.alias("name"))


PARTS_SQL = """parts AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' ' || upper(p_brand) || ' ' WHEN 1 THEN lower(p_type)
WHEN 2 THEN p_name ELSE 'null' END AS name FROM part)"""


@query(
    "b3_canonical_app",
    f"WITH {ALIASES_SQL},\n{PARTS_SQL}\nSELECT id, name, coalesce(canonical, name) AS app FROM parts LEFT JOIN known ON lower(trim(name)) = alias",
)
def b3(spark, sf):
    return match.canonical_app(named_parts(spark, sf), "name", aliases(spark, sf))


@query(
    "b4_clean_app_hint",
    f"""WITH {ALIASES_SQL},
{PARTS_SQL},
c AS (SELECT lower(canonical) AS low, min(canonical) AS canonical FROM al GROUP BY 1),
h AS (SELECT id, CASE WHEN trim(name) <> '' AND lower(trim(name)) <> 'null' THEN trim(name) END AS hint FROM parts)
SELECT id, coalesce(canonical, hint) AS app_hint FROM h LEFT JOIN c ON lower(hint) = low""",
)
def b4(spark, sf):
    return match.canonical_hint(named_parts(spark, sf), "name", aliases(spark, sf)).select("id", "app_hint")


HINT_SQL = "CASE user_id % 6 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'other' WHEN 2 THEN '  ' ELSE ' ' || event_type END"


def hinted(spark, sf):
    u = F.col("user_id") % 6
    hint = F.when(u == 0, " Unknown ").when(u == 1, "other").when(u == 2, "  ").otherwise(F.concat(F.lit(" "), "event_type"))
    return v.events(spark, sf).withColumn("hint", hint)


@query(
    "b5_real_app_hint",
    f"""SELECT event_id, CASE WHEN h = '' OR lower(h) IN ('unknown', 'other') THEN NULL ELSE h END AS hint
FROM (SELECT event_id, trim({HINT_SQL}) AS h FROM events)""",
)
def b5(spark, sf):
    return hinted(spark, sf).select("event_id", normalize.real_app_hint("hint").alias("hint"))


@query(
    "b6_project_key",
    r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' null' WHEN doc_id % 3 = 1 THEN NULL ELSE text END AS key, source || ' ' || lang || '/' || doc_id || ' -- X' AS name FROM documents),
t AS (SELECT doc_id, regexp_replace(key, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS k, regexp_replace(name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS n FROM s),
g AS (SELECT doc_id, k, n,
 left(regexp_replace(regexp_replace(regexp_replace(lower(k), '[\s\p{Z}]+', '-', 'g'), '[^a-z0-9._\-/]', '', 'g'), '-+', '-', 'g'), 80) AS ks,
 left(regexp_replace(regexp_replace(regexp_replace(lower(n), '[\s\p{Z}]+', '-', 'g'), '[^a-z0-9._\-/]', '', 'g'), '-+', '-', 'g'), 80) AS ns FROM t)
SELECT doc_id, coalesce(CASE WHEN lower(k) <> 'null' AND ks <> '' THEN ks END, CASE WHEN lower(n) <> 'null' AND ns <> '' THEN ns END) AS project_key FROM g""",
)
def b6(spark, sf):
    i = F.col("doc_id")
    key = F.when(i % 3 == 0, " null").when(i % 3 == 1, None).otherwise(F.col("text"))
    name = F.concat("source", F.lit(" "), "lang", F.lit("/"), i.cast("string"), F.lit(" -- X"))
    return docs(spark, sf).select("doc_id", text.project_key(key, name).alias("project_key"))


@query(
    "b7_language_bucket",
    """SELECT doc_id, CASE WHEN l LIKE '%en%' THEN 'en' WHEN l LIKE '%zh%' OR l LIKE '%cn%' OR l LIKE '%中文%' THEN 'zh' ELSE 'other' END AS bucket
FROM (SELECT doc_id, lower(CASE WHEN doc_id % 5 = 0 THEN 'Fr' || lang || 'ch' WHEN doc_id % 5 = 1 THEN 'zh-CN' WHEN doc_id % 5 = 2 THEN '中文' ELSE lang END) AS l FROM documents)""",
)
def b7(spark, sf):
    i = F.col("doc_id") % 5
    lang = F.when(i == 0, F.concat(F.lit("Fr"), "lang", F.lit("ch"))).when(i == 1, "zh-CN").when(i == 2, "中文").otherwise(F.col("lang"))
    return docs(spark, sf).select("doc_id", normalize.language_bucket(lang).alias("bucket"))


TYPES = "'person','project','team','org','jira_id','pr_id','commit','document_id','url','repo','other'"
KIND_WORDS = ["person", "URL", "repo", "commit", "widget", "pr_id", "Team"]
KIND_SQL = "['person','URL','repo','commit','widget','pr_id','Team'][1 + event_id % 7]"


def word_of(words, i):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))


@query("b8_entity_type", f"SELECT event_id, CASE WHEN t IN ({TYPES}) THEN t ELSE 'other' END AS type FROM (SELECT event_id, {KIND_SQL} AS t FROM events)")
def b8(spark, sf):
    return v.events(spark, sf).select("event_id", normalize.entity_type(word_of(KIND_WORDS, F.col("event_id"))).alias("type"))


@query(
    "b9_clean_entities",
    f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos FROM w),
q AS (SELECT doc_id, pos, regexp_replace(raw, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS name, CASE WHEN pos % 3 = 0 THEN 'repo' ELSE 'Thing' END AS t, pos / 10.0 - 0.2 AS c FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM q WHERE name <> '')
SELECT doc_id, string_agg(name || ':' || CASE WHEN t IN ({TYPES}) THEN t ELSE 'other' END, '|' ORDER BY rn) AS names,
round(sum(greatest(0.0, least(1.0, c))), 6)::DOUBLE AS total FROM r WHERE rn <= 10 GROUP BY 1""",
)
def b9(spark, sf):
    words = F.transform(
        F.split("text", " ", -1),
        lambda w, i: F.struct(
            w.alias("name"), F.when((i + 1) % 3 == 0, "repo").otherwise("Thing").alias("type"),
            F.lit(None).cast("string").alias("raw"), ((i + 1) / 10.0 - 0.2).alias("confidence"),
        ),
    )
    d = docs(spark, sf).select("doc_id", normalize.clean_entities(words).alias("e")).filter(F.size("e") > 0)
    names = F.transform("e", lambda x: F.concat(x["name"], F.lit(":"), x["type"]))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["confidence"])
    return d.select("doc_id", joined(names).alias("names"), F.round(total, 6).alias("total"))


@query(
    "b10_clean_names",
    r"""WITH p AS (SELECT doc_id, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ws FROM documents)),
q AS (SELECT doc_id, pos, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS name FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM q WHERE name <> '')
SELECT doc_id, md5(string_agg(name, '|' ORDER BY rn) FILTER (rn <= 20)) AS names FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1""",
)
def b10(spark, sf):
    lines = F.split("text", "\n", -1)
    return docs(spark, sf).select("doc_id", F.md5(joined(normalize.clean_names(lines))).alias("names"))


ISSUE_WORDS = ["Error", "bug", "failure_reason", "stderr", "slow", "QUESTION", "blocker"]
ISSUE_SQL = "CASE WHEN event_id % 8 = 0 THEN NULL ELSE ['Error','bug','failure_reason','stderr','slow','QUESTION','blocker'][1 + event_id % 7] END"


@query(
    "b11_issue_type",
    f"""SELECT event_id, CASE WHEN s IS NULL THEN NULL WHEN s IN ('error','bug','blocker','question','warning') THEN s
WHEN s LIKE '%fail%' OR s LIKE '%err%' THEN 'error' ELSE 'warning' END AS type FROM (SELECT event_id, lower({ISSUE_SQL}) AS s FROM events)""",
)
def b11(spark, sf):
    i = F.col("event_id")
    return v.events(spark, sf).select("event_id", normalize.issue_type(F.when(i % 8 != 0, word_of(ISSUE_WORDS, i))).alias("type"))


@query(
    "b12_action_priority",
    """SELECT o_orderkey, CASE WHEN s IN ('high','medium','low') THEN s WHEN s LIKE '%urgent%' OR s LIKE '%critical%' THEN 'high' ELSE 'medium' END AS priority
FROM (SELECT o_orderkey, lower(CASE WHEN o_orderkey % 3 = 0 THEN split_part(o_orderpriority, '-', 2) WHEN o_orderkey % 3 = 1 THEN 'Most ' || o_orderpriority || ' critical' END) AS s FROM orders)""",
)
def b12(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    word = F.when(k % 3 == 0, F.split_part(p, F.lit("-"), F.lit(2))).when(k % 3 == 1, F.concat(F.lit("Most "), p, F.lit(" critical")))
    return v.table(spark, sf, "orders").select("o_orderkey", normalize.action_priority(word).alias("priority"))


@query(
    "b13_action_source",
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'explicit' ELSE 'inferred' END AS source FROM conversations",
)
def b13(spark, sf):
    return talks(spark, sf).select(
        "conv_id", "turn", normalize.action_source(F.when(F.col("role") == "user", "Explicit").otherwise(F.col("role"))).alias("source")
    )


KINDS = ["Focus", "code review", "devbug", "debug", "unit test", "meetup", "phone call", "resting", "surfing", "web", "lunch"]
KINDS_SQL = "['focus','code review','devbug','debug','unit test','meetup','phone call','resting','surfing','web','lunch'][1 + event_id % 11]"


@query(
    "b14_event_kind",
    f"""SELECT event_id, CASE WHEN s IN ('focus','work','meeting','break','browse','coding','debugging') THEN s
WHEN s LIKE '%code%' OR s LIKE '%dev%' THEN 'coding' WHEN s LIKE '%debug%' OR s LIKE '%test%' THEN 'debugging'
WHEN s LIKE '%meet%' OR s LIKE '%call%' THEN 'meeting' WHEN s LIKE '%rest%' OR s LIKE '%pause%' THEN 'break'
WHEN s LIKE '%surf%' OR s LIKE '%web%' THEN 'browse' ELSE 'work' END AS kind FROM (SELECT event_id, {KINDS_SQL} AS s FROM events)""",
)
def b14(spark, sf):
    return v.events(spark, sf).select("event_id", normalize.event_kind(word_of(KINDS, F.col("event_id"))).alias("kind"))


PHASES = ["Meeting prep", "implementing", "research", None, "code", "debugging"]
PHASES_SQL = "['meeting prep','implementing','research',NULL,'code','debugging'][1 + event_id % 6]"


@query(
    "b15_long_event_kind",
    f"""SELECT event_id, CASE WHEN s LIKE '%meeting%' THEN 'meeting' WHEN s LIKE '%break%' THEN 'break'
WHEN s LIKE '%browse%' OR s LIKE '%research%' THEN 'browse' WHEN s LIKE '%debug%' THEN 'debugging'
WHEN s LIKE '%code%' OR s LIKE '%implement%' THEN 'coding' ELSE 'work' END AS kind
FROM (SELECT event_id, coalesce({PHASES_SQL}, '') || ' ' || {KINDS_SQL} AS s FROM events)""",
)
def b15(spark, sf):
    i = F.col("event_id")
    return v.events(spark, sf).select("event_id", normalize.long_event_kind(word_of(PHASES, i), word_of(KINDS, i)).alias("kind"))


@query(
    "b16_clamp",
    "SELECT c_custkey, greatest(0.0, least(10.0, c_acctbal / 500)) AS importance, greatest(0.0, least(1.0, c_acctbal / 5000)) AS confidence FROM customer",
)
def b16(spark, sf):
    b = F.col("c_acctbal")
    return v.table(spark, sf, "customer").select(
        "c_custkey", normalize.clamp(b / 500, 0.0, 10.0).alias("importance"), normalize.clamp(b / 5000, 0.0, 1.0).alias("confidence")
    )


@query(
    "b17_cap",
    "SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], '|') AS five, array_to_string(string_split(text, ' ')[1:8], '|') AS eight FROM documents",
)
def b17(spark, sf):
    words = F.split("text", " ", -1)
    return docs(spark, sf).select("doc_id", joined(normalize.cap(words, 5)).alias("five"), joined(normalize.cap(words, 8)).alias("eight"))


@query(
    "b18_truncate",
    """SELECT doc_id, sha256(CASE WHEN length(text) > 600 THEN left(text, 597) || '...' ELSE text END) AS node,
sha256(CASE WHEN length(text) > 12000 THEN left(text, 11997) || '...' ELSE text END) AS trace, sha256(left(text, 8000)) AS ocr FROM documents""",
)
def b18(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.sha2(text.ellipsis("text", 600), 256).alias("node"), F.sha2(text.ellipsis("text", 12000), 256).alias("trace"),
        F.sha2(text.cut("text", 8000), 256).alias("ocr"),
    )


SQUEEZE = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')"


@query(
    "b19_marker_title",
    f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ' ' || lang || '  ' || source END AS title, CASE WHEN doc_id % 3 <> 0 THEN text END AS about,
CASE WHEN doc_id % 5 <> 0 THEN source END AS kind, lang || CASE WHEN doc_id % 4 = 0 THEN ' ' || source ELSE '' END AS thread FROM documents),
n AS (SELECT *, {SQUEEZE.format('title')} AS t, {SQUEEZE.format('about')} AS a, {SQUEEZE.format('thread')} AS h FROM s),
f AS (SELECT *, regexp_split_to_array(a, '[\\n.。!！?？]')[1] AS first FROM n)
SELECT doc_id, CASE WHEN t <> '' AND t <> h THEN title
 WHEN a <> '' THEN CASE WHEN length(first) > 80 THEN regexp_replace(left(first, 80), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') || '…' ELSE first END
 WHEN t <> '' THEN CASE WHEN kind <> '' THEN kind || ': ' || title ELSE title END
 ELSE CASE WHEN kind <> '' THEN kind || ': ' || thread ELSE thread END END AS marker FROM f""",
)
def b19(spark, sf):
    i = F.col("doc_id")
    d = docs(spark, sf).select(
        "doc_id",
        F.when(i % 2 == 0, F.concat(F.lit(" "), "lang", F.lit("  "), "source")).alias("title"),
        F.when(i % 3 != 0, F.col("text")).alias("about"),
        F.when(i % 5 != 0, F.col("source")).alias("kind"),
        F.when(i % 4 == 0, F.concat("lang", F.lit(" "), "source")).otherwise(F.col("lang")).alias("thread"),
    )
    return d.select("doc_id", text.marker_title(F.col("title"), F.col("about"), F.col("kind"), F.col("thread")).alias("marker"))


@query(
    "b20_node_kind",
    "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'state_snapshot' WHEN value > 10 THEN 'knowledge' ELSE 'event' END AS kind FROM events",
)
def b20(spark, sf):
    snapshot, knowledge = F.when(F.col("user_id") % 3 == 0, "s"), F.when(F.col("value") > 10, "k")
    return v.events(spark, sf).select("event_id", normalize.node_kind(snapshot, knowledge).alias("kind"))


@query(
    "b21_boosted_importance",
    v.cte("nodes") + "SELECT id, CASE WHEN issue THEN greatest(importance, 7) ELSE importance END AS importance FROM nodes",
)
def b21(spark, sf):
    return v.nodes(spark, sf).select("id", normalize.boosted_importance(F.col("importance"), F.col("issue")).alias("importance"))


@query(
    "b22_derived_entities",
    v.more("nodes") + """x AS (SELECT id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM
 (SELECT id, list_concat(keywords, [project_key, ' ' || app_hint || ' ']) AS l FROM nodes)),
y AS (SELECT id, trim(name) AS name, min(pos) AS pos FROM x WHERE trim(name) <> '' GROUP BY 1, 2)
SELECT id, string_agg(name, '|' ORDER BY pos) AS names FROM y GROUP BY 1""",
)
def b22(spark, sf):
    subject = F.concat(F.lit(" "), "app_hint", F.lit(" "))
    names = normalize.derived_entities(F.col("keywords"), F.col("project_key"), subject)
    return v.nodes(spark, sf).select("id", joined(names).alias("names"))


@query(
    "b23_node_text",
    """SELECT conv_id, turn, sha256('Title: ' || role || chr(10) || 'Summary: ' || text || chr(10) || 'Keywords: ' || role || ', ' || turn ||
CASE WHEN turn % 2 = 0 THEN chr(10) || 'Knowledge: ' || role ELSE '' END || CASE WHEN turn % 3 = 0 THEN chr(10) || 'StateSnapshot: ' || turn ELSE '' END) AS digest FROM conversations""",
)
def b23(spark, sf):
    t = F.col("turn").cast("string")
    body = text.node_text(
        F.col("role"), F.col("text"), F.array(F.col("role"), t), F.when(F.col("turn") % 2 == 0, F.col("role")),
        F.when(F.col("turn") % 3 == 0, t),
    )
    return talks(spark, sf).select("conv_id", "turn", text.text_hash(body).alias("digest"))


@query("b24_text_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def b24(spark, sf):
    return docs(spark, sf).select("doc_id", text.text_hash("text").alias("digest"))


@query(
    "b25_batch_id",
    v.cte("captures") + """SELECT id, 'batch_' || left(sha256('{"sourceKey":"' || source_key || '","tsStart":' || ts_ms || ',"tsEnd":' || (ts_ms + phash) ||
',"screenshotIds":[' || id || ',' || (id + 1) || ']}'), 24) AS batch_id FROM captures""",
)
def b25(spark, sf):
    i, t = F.col("id"), F.col("ts_ms")
    return v.captures(spark, sf).select("id", keys.batch_id(F.col("source_key"), t, t + F.col("phash"), F.array(i, i + 1)).alias("batch_id"))


@query(
    "b26_origin_key",
    "SELECT l_orderkey AS batch, 'batch:' || l_orderkey || '|nodes:' || string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS origin FROM lineitem GROUP BY 1",
)
def b26(spark, sf):
    g = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.collect_set("l_linenumber").alias("i"))
    return g.select("batch", keys.origin_key(F.col("batch"), F.col("i")).alias("origin"))


@query(
    "b27_event_key",
    v.cte("nodes") + """SELECT id, 'win_' || (ts_ms // 1200000 * 1200000) || '_evt_' || (id % 7) || '_' || left(lower(hex(encode(kind || ':' || title))), 16) AS event_key, 'thr_' || thread_id AS marker_key FROM nodes""",
)
def b27(spark, sf):
    start = F.floor(F.col("ts_ms") / 1_200_000) * 1_200_000
    return v.nodes(spark, sf).select(
        "id", keys.event_key(start, F.col("id") % 7, F.col("kind"), F.col("title")).alias("event_key"),
        keys.marker_key(F.col("thread_id")).alias("marker_key"),
    )


STATUSES = ["running", "pending", "failed", "failed_permanent", "succeeded", "no_data", "odd"]
STATUS_SQL = "['running','pending','failed','failed_permanent','succeeded','no_data','odd'][1 + event_id % 7]"


@query(
    "b28_status_display",
    f"""SELECT event_id, CASE WHEN s IN ('failed_permanent','failed','succeeded') THEN s WHEN s = 'no_data' THEN 'succeeded' ELSE 'pending' END AS summary_status,
CASE WHEN s IN ('failed_permanent','failed') THEN 'failed' WHEN s = 'succeeded' THEN s ELSE 'pending' END AS details_status
FROM (SELECT event_id, {STATUS_SQL} AS s FROM events)""",
)
def b28(spark, sf):
    e = v.events(spark, sf).withColumn("s", word_of(STATUSES, F.col("event_id")))
    return e.select("event_id", keys.summary_status("s").alias("summary_status"), keys.details_status("s").alias("details_status"))


@query("b29_health_level", "SELECT event_id, CASE WHEN value >= 30 THEN 'critical' WHEN value >= 10 THEN 'warning' ELSE 'healthy' END AS level FROM events")
def b29(spark, sf):
    return v.events(spark, sf).select("event_id", keys.health_level(F.col("value"), 10, 30).alias("level"))


@query(
    "b30_time_context",
    v.more("ev") + """l AS (SELECT event_id, ts_ms, ts + INTERVAL 9 HOUR AS lt FROM ev),
d AS (SELECT *, epoch_us(date_trunc('day', lt)) // 1000 - 32400000 AS s FROM l)
SELECT event_id, strftime(lt, '%Y-%m-%d %H:%M:%S') AS local_time, s AS today_start, s + 86399999 AS today_end,
s - 86400000 AS yesterday_start, s - 1 AS yesterday_end, ts_ms - 604800000 AS week_ago FROM d""",
)
def b30(spark, sf):
    e = v.events(spark, sf).select("event_id", keys.time_context(F.col("ts"), "Asia/Tokyo").alias("c"))
    return e.select("event_id", *[f"c.{n}" for n in ("local_time", "today_start", "today_end", "yesterday_start", "yesterday_end", "week_ago")])


@query(
    "b31_config_hash",
    """SELECT page_id, left(sha256('unified:' || url || ':m' || page_id), 16) AS unified,
left(sha256('separate|vlm:' || url || ':a|text:' || url || ':b|embed:' || url || ':c'), 16) AS separate FROM pages""",
)
def b31(spark, sf):
    u, a, b, c = F.col("url"), F.lit("a"), F.lit("b"), F.lit("c")
    unified = keys.unified_config_hash(u, F.concat(F.lit("m"), F.col("page_id").cast("string")))
    return pages(spark, sf).select("page_id", unified.alias("unified"), keys.separate_config_hash((u, a), (u, b), (u, c)).alias("separate"))


@query(
    "b32_tokens",
    r"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS digest FROM
(SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)""",
)
def b32(spark, sf):
    t = text.tokens("text")
    return docs(spark, sf).select("doc_id", F.size(t).alias("n"), F.md5(joined(t)).alias("digest"))


@query(
    "b33_fts_terms",
    r"""SELECT page_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '["''`]', ' ', 'g'), '[?？!！:：;；(){}\[\]]', ' ', 'g'), '[\s\p{Z}]+'), lambda x: x <> ''), '|') AS terms FROM pages""",
)
def b33(spark, sf):
    return pages(spark, sf).select("page_id", joined(text.fts_terms("html")).alias("terms"))


@query(
    "b34_keyword_terms",
    r"""WITH q AS (SELECT item_id, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM benchmark),
p AS (SELECT item_id, list_concat([s], list_filter(regexp_split_to_array(s, '[\s\p{Z}]+'), lambda x: length(x) > 1), ['Ent ' || (item_id % 7)]) AS l FROM q),
x AS (SELECT item_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM p),
y AS (SELECT item_id, t, min(pos) AS pos FROM x WHERE t <> '' GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM y)
SELECT item_id, string_agg(t, '|' ORDER BY rn) AS terms FROM z WHERE rn <= 8 GROUP BY 1""",
)
def b34(spark, sf):
    ent = F.array(F.concat(F.lit("Ent "), (F.col("item_id") % 7).cast("string")))
    return v.table(spark, sf, "benchmark").select("item_id", joined(text.keyword_terms("text", ent)).alias("terms"))


@query("b35_hamming", v.cte("ev") + "SELECT event_id, bit_count(xor(k, user_id)) AS distance FROM ev")
def b35(spark, sf):
    return v.events(spark, sf).select("event_id", keys.hamming("k", "user_id").alias("distance"))


@query("b36_is_near_dup", v.cte("ev") + "SELECT event_id, coalesce(bit_count(xor(k, CASE WHEN event_id % 4 <> 0 THEN user_id END)) <= 2, false) AS dup FROM ev")
def b36(spark, sf):
    last = F.when(F.col("event_id") % 4 != 0, F.col("user_id"))
    return v.events(spark, sf).select("event_id", keys.is_near_dup(F.col("k"), last, 2).alias("dup"))


@query(
    "b37_clamp_box",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * 7 - 60 AS x, l_tax * 4000 - 50 AS y, l_extendedprice / 100 AS w, l_discount * 900 AS h,
 CAST(l_partkey % 400 AS BIGINT) AS iw, CAST(l_suppkey % 300 AS BIGINT) AS ih FROM lineitem),
a AS (SELECT *, least(greatest(floor(x)::BIGINT, 0), greatest(0, iw - 1)) AS l, least(greatest(floor(y)::BIGINT, 0), greatest(0, ih - 1)) AS t FROM s),
b AS (SELECT *, least(greatest(floor(w)::BIGINT, 1), greatest(1, iw - l)) AS bw, least(greatest(floor(h)::BIGINT, 1), greatest(1, ih - t)) AS bh FROM a)
SELECT l_orderkey, l_linenumber, CASE WHEN iw > 0 AND ih > 0 THEN l END AS "left", CASE WHEN iw > 0 AND ih > 0 THEN t END AS top,
CASE WHEN iw > 0 AND ih > 0 THEN least(bw, iw - l) END AS width, CASE WHEN iw > 0 AND ih > 0 THEN least(bh, ih - t) END AS height FROM b""",
)
def b37(spark, sf):
    c = F.col
    box = keys.clamp_box(
        c("l_quantity") * 7 - 60, c("l_tax") * 4000 - 50, c("l_extendedprice") / 100, c("l_discount") * 900,
        (c("l_partkey") % 400).cast("long"), (c("l_suppkey") % 300).cast("long"),
    )
    out = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return out.select("l_orderkey", "l_linenumber", "b.left", "b.top", "b.width", "b.height")


@query(
    "b38_snake_payload",
    """SELECT page_id, 'article' AS content_type, url AS source_url, CASE WHEN page_id % 3 = 0 THEN 'lib' || page_id END AS project_or_library, 'en' AS language,
CASE WHEN page_id % 2 = 0 THEN 'page' END AS subject_type FROM pages""",
)
def b38(spark, sf):
    i = F.col("page_id")
    name = lambda a, b: F.when(i % 2 == 0, a).otherwise(b)
    js = F.concat(
        F.lit('{"'), name("contentType", "content_type"), F.lit('":"article","'), name("source_url", "sourceUrl"), F.lit('":"'), "url",
        F.when(i % 3 == 0, F.concat(F.lit('","projectOrLibrary":"lib'), i.cast("string"))).otherwise(F.lit("")),
        F.lit('","language":"en"'), F.when(i % 2 == 0, F.lit(',"subjectType":"page"')).otherwise(F.lit("")), F.lit("}"),
    )
    p = pages(spark, sf).withColumn("js", js)
    k, s = normalize.snake_payload("js", normalize.KNOWLEDGE_FIELDS), normalize.snake_payload("js", normalize.SNAPSHOT_FIELDS)
    p = p.select("page_id", k.alias("k"), s.alias("s"))
    return p.select("page_id", "k.content_type", "k.source_url", "k.project_or_library", "k.language", "s.subject_type")


@query(
    "b39_cap_uncited",
    """SELECT event_id, CASE WHEN c > 0.2 AND event_id % 3 = 0 THEN 0.2 ELSE c END AS confidence
FROM (SELECT event_id, greatest(0.0, least(1.0, value / 40)) AS c FROM events)""",
)
def b39(spark, sf):
    cites = F.when(F.col("event_id") % 3 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return v.events(spark, sf).select("event_id", normalize.cap_uncited(F.col("value") / 40, cites).alias("confidence"))


CLOCK_SQL = "lpad((event_id % 27)::VARCHAR, 2, '0') || ':' || lpad((event_id % 67)::VARCHAR, CASE WHEN event_id % 5 = 0 THEN 3 ELSE 2 END, '0')"


def clock(i):
    minute = F.when(i % 5 == 0, F.lpad((i % 67).cast("string"), 3, "0")).otherwise(F.lpad((i % 67).cast("string"), 2, "0"))
    return F.concat(F.lpad((i % 27).cast("string"), 2, "0"), F.lit(":"), minute)


@query(
    "b40_minute_of_day",
    rf"""SELECT event_id, CASE WHEN regexp_matches(t, '^([01]\d|2[0-3]):([0-5]\d)$') THEN CAST(left(t, 2) AS INT) * 60 + CAST(substr(t, 4) AS INT) END AS minute
FROM (SELECT event_id, {CLOCK_SQL} AS t FROM events)""",
)
def b40(spark, sf):
    return v.events(spark, sf).select("event_id", keys.minute_of_day(clock(F.col("event_id"))).alias("minute"))


@query(
    "b41_merge_hints",
    "SELECT event_id, coalesce(CASE WHEN user_id % 2 = 0 THEN event_type END, CASE WHEN user_id % 3 = 0 THEN 'model' END) AS hint FROM events",
)
def b41(spark, sf):
    own, model = F.when(F.col("user_id") % 2 == 0, F.col("event_type")), F.when(F.col("user_id") % 3 == 0, F.lit("model"))
    return v.events(spark, sf).select("event_id", normalize.merge_hints(own, model).alias("hint"))


@query(
    "b42_text_region",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN url ELSE 'body' END AS description,
CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 0 ELSE page_id END::DOUBLE AS top, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 0 END::DOUBLE AS width FROM pages""",
)
def b42(spark, sf):
    i = F.col("page_id")
    obj = F.concat(F.lit('{"description":"body","box":{"top":'), i.cast("string"), F.lit(',"left":1},"confidence":0.5}'))
    raw = F.when(i % 3 == 1, F.col("url")).when(i % 3 == 2, obj)
    r = pages(spark, sf).select("page_id", normalize.text_region(raw).alias("r"))
    return r.select("page_id", "r.description", "r.box.top", "r.box.width")


@query(
    "b43_parse_window_name",
    v.cte("captures") + """SELECT id, window_title, upper(app_hint) AS app, regexp_extract(window_title, ' - (.*)$', 1) AS title FROM captures""",
)
def b43(spark, sf):
    c = v.captures(spark, sf).select("id", "app_hint", "window_title")
    al = c.select(F.upper("app_hint").alias("canonical"), F.col("app_hint").alias("alias")).distinct()
    return match.parse_window_name(c.drop("app_hint"), "window_title", al)

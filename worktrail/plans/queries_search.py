"""Queries for search and similarity (group J), search limits (G2, G4) and model replies (A5)."""

from pyspark.sql import functions as F

from worktrail.functions.text import tokens
from worktrail.operators import joins, search, vectors
from worktrail.operators.blocks import DAY_MS
from worktrail.plans import views as v
from worktrail.plans.queries_filters import INDEX_SQL, WORDS_SQL, documents, fts_queries, wanted
from worktrail.plans.queries_ranking import RANK_SQL, ranked
from worktrail.plans.registry import query
from worktrail.session import cut
from worktrail.sources import ingest

START = 1_704_067_200_000
SHORT = 1_000_000  # added to the id of a short query


# --- vectors -----------------------------------------------------------------------------


def vector_rows(spark, sf):
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), "embedding")


def vector_queries(spark, sf):
    """Every vector asks all vectors."""
    return vector_rows(spark, sf).withColumnRenamed("vector_id", "query_id")


KNN_SQL = """vec AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
knn AS (SELECT a.vec_id AS query_id, b.vec_id AS vector_id, list_distance(a.e, b.e) ** 2 AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rn FROM vec a, vec b QUALIFY rn <= 20)
"""


@query("j1_knn_exact", "WITH " + KNN_SQL + "SELECT query_id, vector_id, round(score, 6) AS score, rn FROM knn")
def j1(spark, sf):
    out = vectors.knn_exact(vector_queries(spark, sf), vector_rows(spark, sf))
    return out.select("query_id", "vector_id", F.round("score", 6).alias("score"), "rn")


@query("d12_knn_grid", "WITH " + KNN_SQL + "SELECT query_id, vector_id, round(score, 6) AS score, rn FROM knn")
def d12(spark, sf):
    # the layout for more queries than may be sent to every task
    out = vectors.knn_exact(vector_queries(spark, sf), vector_rows(spark, sf), max_broadcast=0, cell_queries=250, cell_vectors=250)
    return out.select("query_id", "vector_id", F.round("score", 6).alias("score"), "rn")


@query("j2_knn_lsh")
def j2(spark, sf):
    return vectors.knn_hyperplanes(vector_queries(spark, sf), vector_rows(spark, sf))


@query("j8_phash")
def j8(spark, sf):
    """Fingerprints of grids laid out from the embeddings: 64 values repeated over 1024 cells."""
    e = v.table(spark, sf, "embeddings")
    cell = lambda i: F.floor((F.col("embedding")[(i % 64).cast("int")] + 1) * 127).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.lit(1023)), cell)
    return e.select("vec_id", vectors.phash(grid).alias("phash"))


# --- full text ---------------------------------------------------------------------------

SCORE_SQL = """, st AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
sc AS (SELECT query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
 FROM post JOIN qt USING (term) JOIN dfs USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2 HAVING count(*) = max(n_terms))
"""
BM25_SQL = INDEX_SQL + SCORE_SQL


def scored(spark, sf):
    postings, lengths = search.build_index(documents(spark, sf))
    return search.bm25(postings, lengths, fts_queries(spark, sf))


@query("j3_bm25", "WITH " + BM25_SQL + "SELECT query_id, doc_id, round(score, 6) AS score FROM sc")
def j3(spark, sf):
    return scored(spark, sf).withColumn("score", F.round("score", 6))


@query("j3_build_index", "WITH " + INDEX_SQL + "SELECT term, doc_id, tf, length FROM post JOIN len USING (doc_id)")
def j3i(spark, sf):
    postings, lengths = search.build_index(documents(spark, sf))
    # lengths are hashed, so that postings, which lie by document already, are not sorted
    return postings.join(lengths.hint("shuffle_hash"), "doc_id")


@query(
    "g4_bm25_top",
    "WITH " + BM25_SQL + "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM sc QUALIFY rn <= 30",
)
def g4(spark, sf):
    return search.bm25_top(scored(spark, sf)).select("query_id", "doc_id", "rn")


# Cleaned queries by words and phrases: of each benchmark text the whole, and two of its words hyphenated beside a third.
PHRASE_SQL = "WITH " + INDEX_SQL.rstrip() + r""",
asks AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL
 SELECT item_id + 1000000, ws[4] || '-' || ws[5] || ' "' || ws[7] || '!"' FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark)),
cleaned AS (SELECT query_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '["''`]', ' ', 'g'), '[?？!！:：;；(){}\[\]]', ' ', 'g'), '[\s\p{Z}]+') AS parts FROM asks),
ph AS (SELECT DISTINCT query_id, array_to_string(list_filter(regexp_split_to_array(lower(part), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS term FROM (SELECT query_id, unnest(parts) AS part FROM cleaned)),
pq AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM ph WHERE term <> ''),
place AS (SELECT term AS phrase, unnest(ws) AS word, generate_subscripts(ws, 1) AS off, len(ws) AS n FROM (SELECT DISTINCT term, string_split(term, ' ') AS ws FROM pq)),
told AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents)),
starts AS (SELECT phrase, doc_id, pos - off AS begins FROM told JOIN place USING (word) GROUP BY phrase, doc_id, pos - off HAVING count(*) = max(n)),
pp AS (SELECT phrase AS term, doc_id, count(*) AS tf FROM starts GROUP BY 1, 2)"""
PHRASE_SCORE_SQL = PHRASE_SQL + SCORE_SQL.replace("FROM post", "FROM pp").replace("JOIN qt", "JOIN pq")


def phrase_queries(spark, sf):
    """Each whole benchmark text, and words 4 and 5 of it hyphenated beside word 7 with query punctuation."""
    b, ws = v.table(spark, sf, "benchmark"), tokens("text")
    pair = F.concat(F.try_element_at(ws, F.lit(4)), F.lit("-"), F.try_element_at(ws, F.lit(5)))
    short = F.concat(pair, F.lit(' "'), F.try_element_at(ws, F.lit(7)), F.lit('!"'))
    i = F.col("item_id")
    both = F.array(F.struct(i.alias("query_id"), F.col("text").alias("text")), F.struct((i + SHORT).alias("query_id"), short.alias("text")))
    return b.select(F.inline(both))


@query(
    "c7_phrase_match",
    PHRASE_SQL + " SELECT query_id, doc_id FROM pp JOIN pq USING (term) GROUP BY 1, 2 HAVING count(*) = max(n_terms)",
)
def c7_phrase(spark, sf):
    return search.phrase_match(search.build_positions(documents(spark, sf)), phrase_queries(spark, sf))


def phrase_scored(spark, sf):
    docs = documents(spark, sf)
    lengths = docs.select("doc_id", F.size(tokens("text")).cast("long").alias("length"))
    return search.phrase_bm25(search.build_positions(docs), cut(lengths), phrase_queries(spark, sf))


@query("j3_phrase_bm25", PHRASE_SCORE_SQL + "SELECT query_id, doc_id, round(score, 6) AS score FROM sc")
def j3_phrase(spark, sf):
    return phrase_scored(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "g4_phrase_top",
    PHRASE_SCORE_SQL + "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM sc QUALIFY rn <= 30",
)
def g4_phrase(spark, sf):
    return search.bm25_top(phrase_scored(spark, sf)).select("query_id", "doc_id", "rn")


# --- candidates, fusion, neighbours ------------------------------------------------------


def range_queries(spark, sf):
    """Time ranges out of the parts; every third names a thread."""
    k = F.col("p_partkey")
    lo = F.lit(START) + (k % 29) * DAY_MS
    return v.table(spark, sf, "part").select(
        k.alias("query_id"), lo.alias("from_ms"), (lo + F.col("p_size") * 3_600_000).alias("to_ms"),
        F.when(k % 3 == 0, F.concat(F.lit("t"), (k % 150).cast("string"))).alias("thread_id"),
    )


@query(
    "g2_time_recall",
    v.more("nodes") + f"""q AS (SELECT p_partkey AS query_id, {START} + p_partkey % 29 * 86400000 AS from_ms, {START} + p_partkey % 29 * 86400000 + p_size * 3600000 AS to_ms,
 CASE WHEN p_partkey % 3 = 0 THEN 't' || (p_partkey % 150) END AS th FROM part)
SELECT query_id, id FROM q JOIN nodes ON ts_ms BETWEEN from_ms AND to_ms AND (th IS NULL OR thread_id = th)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts_ms DESC, id DESC) <= 2000""",
)
def g2(spark, sf):
    return search.time_recall(v.nodes(spark, sf), range_queries(spark, sf), 2000).select("query_id", "id")


@query(
    "j4_fuse",
    v.more("nodes") + """u AS (SELECT ts_ms // 86400000 AS query_id, id, NULL::DOUBLE AS score FROM nodes WHERE k % 2 = 0
UNION ALL SELECT ts_ms // 86400000, id, 0.0 FROM nodes WHERE k % 5 = 0 UNION ALL SELECT ts_ms // 86400000, id, value FROM nodes WHERE k % 3 = 0)
SELECT query_id, id, min(score) AS score FROM u GROUP BY 1, 2""",
)
def j4(spark, sf):
    n = v.nodes(spark, sf).withColumn("query_id", F.floor(F.col("ts_ms") / DAY_MS))
    return search.fuse(n.filter("k % 2 = 0"), n.filter("k % 5 = 0"), n.filter("k % 3 = 0").withColumn("score", F.col("value")))


NEIGHBORS_SQL = """p AS (SELECT DISTINCT coalesce(q_thread, thread_id) AS th, id AS pivot_id, ts_ms FROM best),
nb AS (SELECT th, pivot_id, n.id FROM p JOIN nodes n ON n.thread_id = th WHERE n.ts_ms <= p.ts_ms QUALIFY row_number() OVER (PARTITION BY th, pivot_id ORDER BY n.ts_ms DESC, n.id DESC) <= 3),
na AS (SELECT th, pivot_id, n.id FROM p JOIN nodes n ON n.thread_id = th WHERE n.ts_ms >= p.ts_ms QUALIFY row_number() OVER (PARTITION BY th, pivot_id ORDER BY n.ts_ms, n.id) <= 3),
nt AS (SELECT NULL AS th, pivot_id, n.id FROM p JOIN nodes n ON n.ts_ms BETWEEN p.ts_ms - 120000 AND p.ts_ms + 120000 WHERE th IS NULL QUALIFY row_number() OVER (PARTITION BY pivot_id ORDER BY n.ts_ms, n.id) <= 6),
near AS (SELECT DISTINCT query_id, x.id FROM best JOIN (SELECT * FROM nb UNION SELECT * FROM na UNION SELECT * FROM nt) x
 ON x.pivot_id = best.id AND x.th IS NOT DISTINCT FROM coalesce(best.q_thread, best.thread_id))"""


@query(
    "j5_expand_neighbors",
    RANK_SQL.rstrip() + """,
best AS (SELECT query_id, id, thread_id, ts_ms, CASE WHEN query_id % 5 = 0 THEN 't9' END AS q_thread FROM ranked WHERE rn <= 5),
""" + NEIGHBORS_SQL + "\nSELECT query_id, id FROM near",
)
def j5(spark, sf):
    r = ranked(spark, sf)
    q = r.select("query_id").distinct().withColumn("thread_id", F.when(F.col("query_id") % 5 == 0, "t9"))
    return search.expand_neighbors(r, v.nodes(spark, sf), q)


def plans(spark, sf):
    i = F.col("item_id")
    return v.table(spark, sf, "benchmark").select(
        i.alias("query_id"), (i % 10 / 10.0).alias("confidence"), (F.lit(START) + i * DAY_MS).alias("from_ms"), (F.lit(START) + (i + 2) * DAY_MS).alias("to_ms"),
        F.when(i % 2 == 0, "click").otherwise("Unheard").alias("app_hint"), F.array(F.lit("a"), F.concat(F.lit("p"), (i % 3).cast("string"))).alias("entities"),
    )


@query(
    "j7_merge_filters",
    f"""WITH m AS (SELECT item_id AS query_id, item_id % 10 >= 5 AS use, CASE WHEN item_id % 3 = 0 THEN {START} END AS f0, CASE WHEN item_id % 3 = 0 THEN {START} + 1 END AS t0,
 {START} + item_id * 86400000 AS f1, {START} + (item_id + 2) * 86400000 AS t1, CASE WHEN item_id % 4 = 0 THEN 'view' END AS a0, CASE WHEN item_id % 2 = 0 THEN 'click' END AS a1 FROM benchmark)
SELECT query_id, CASE WHEN use AND f0 IS NULL THEN f1 ELSE f0 END AS from_ms, CASE WHEN use AND t0 IS NULL THEN t1 ELSE t0 END AS to_ms, CASE WHEN use THEN coalesce(a0, a1) ELSE a0 END AS app_hint,
array_to_string(list_concat(['p' || (query_id % 2), 'q'], CASE WHEN use THEN list_filter(['a', 'p' || (query_id % 3)], lambda x: x <> 'p' || (query_id % 2)) ELSE [] END), ',') AS names FROM m""",
)
def j7(spark, sf):
    i = F.col("item_id")
    user = v.table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.when(i % 3 == 0, F.lit(START)).alias("from_ms"), F.when(i % 3 == 0, F.lit(START + 1)).alias("to_ms"),
        F.when(i % 4 == 0, "view").alias("app_hint"), F.array(F.concat(F.lit("p"), (i % 2).cast("string")), F.lit("q")).alias("entities"),
    )
    known = v.events(spark, sf).select(F.col("event_type").alias("canonical")).distinct()
    out = search.merge_filters(user, plans(spark, sf), known)
    return out.select("query_id", "from_ms", "to_ms", "app_hint", F.array_join("entities", ",").alias("names"))


# --- the whole search --------------------------------------------------------------------


def search_queries(spark, sf):
    """Two queries per benchmark text: the whole text with a vector, and two of its words; filters on some."""
    i = F.col("item_id")
    named = lambda prefix, n: F.concat(F.lit(prefix), (i % n).cast("string"))
    b = v.table(spark, sf, "benchmark").select(
        i, F.explode(F.array(F.struct(i.alias("query_id"), F.col("text").alias("text")), F.struct((i + SHORT).alias("query_id"), F.array_join(F.slice(tokens("text"), 4, 2), " ").alias("text")))).alias("x"),
        F.when(i % 2 == 0, F.lit(START) + i % 20 * DAY_MS).alias("from_ms"), F.when(i % 2 == 0, F.lit(START) + (i % 20 + 3) * DAY_MS).alias("to_ms"),
        F.when(i % 5 == 0, named("t", 40)).alias("thread_id"), F.when(i % 3 == 0, F.array(named("ent ", 7))).otherwise(F.array().cast("array<string>")).alias("entities"),
        F.when(i % 4 == 1, "Click").when(i % 4 == 2, "pur").alias("app_hint"), F.when(i % 2 == 1, "knowledge").alias("kind_hint"),
    ).select("x.*", "from_ms", "to_ms", "thread_id", "entities", "app_hint", "kind_hint")
    return b.join(v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def search_plans(spark, sf):
    """What a planner made of each query: sure enough for half of them."""
    i = F.col("item_id")
    rows = v.table(spark, sf, "benchmark").select(
        F.explode(F.array(i, i + SHORT)).alias("query_id"), (i % 10 / 10.0).alias("confidence"), (F.lit(START) + i % 29 * DAY_MS).alias("from_ms"), (F.lit(START) + (i % 29 + 2) * DAY_MS).alias("to_ms"),
        F.when(i % 2 == 0, "click").otherwise("Unheard").alias("app_hint"), F.array(F.concat(F.lit("proj-"), (i % 4).cast("string"))).alias("entities"),
    )
    return rows


def whole_search(spark, sf):
    """The composed search over all nodes, captures, documents and vectors."""
    # nodes are a projection of a scan and are read again by each step: writing them would take more disk than the table
    n = v.nodes(spark, sf).withColumns({"summary": F.col("project_key"), "kw": F.array_join("keywords", " "), "names": F.array_join("entities", " ")})
    postings, lengths = search.build_index(documents(spark, sf))
    index = postings, cut(lengths)
    docs = vector_rows(spark, sf).withColumn("ref_id", F.col("vector_id") * 3)
    known = v.events(spark, sf).select(F.col("event_type").alias("canonical")).distinct()
    captures = v.captures(spark, sf).select("id", "ts_ms", "app_hint")
    return search.search(search_queries(spark, sf), n, v.links(spark, sf), captures, index, docs, ["title", "summary", "kw", "names"], search_plans(spark, sf), known)


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_LIKE = " OR ".join(f"lower({c}) LIKE '%' || lower(term) || '%'" for c in ("title", "project_key", "array_to_string(keywords, ' ')", "array_to_string(entities, ' ')"))
SEARCH_SQL = v.more("nodes", "links", "captures") + WORDS_SQL[: WORDS_SQL.index("qt AS")] + f"""qb AS (SELECT item_id AS i, item_id AS query_id, text FROM benchmark UNION ALL SELECT item_id, item_id + {SHORT}, array_to_string({_TOKENS}[4:5], ' ') FROM benchmark),
qt AS (SELECT query_id, unnest(list_distinct(ws)) AS term, len(list_distinct(ws)) AS n_terms FROM (SELECT query_id, {_TOKENS} AS ws FROM qb))
""" + SCORE_SQL.rstrip() + f""",
qu AS (SELECT *, i % 10 >= 5 AS use, CASE WHEN i % 2 = 0 THEN {START} + i % 20 * 86400000 END AS f0, CASE WHEN i % 2 = 0 THEN {START} + (i % 20 + 3) * 86400000 END AS t0,
 CASE WHEN i % 4 = 1 THEN 'click' WHEN i % 4 = 2 THEN 'pur' END AS a0, CASE WHEN i % 2 = 0 THEN 'click' END AS a1, CASE WHEN i % 3 = 0 THEN ['ent ' || (i % 7)] ELSE [] END AS e0 FROM qb),
q AS (SELECT query_id, trim(text) AS text, CASE WHEN use AND f0 IS NULL THEN {START} + i % 29 * 86400000 ELSE f0 END AS from_ms, CASE WHEN use AND t0 IS NULL THEN {START} + (i % 29 + 2) * 86400000 ELSE t0 END AS to_ms,
 CASE WHEN i % 5 = 0 THEN 't' || (i % 40) END AS q_thread, CASE WHEN use THEN list_concat(e0, ['proj-' || (i % 4)]) ELSE e0 END AS ents, CASE WHEN use THEN coalesce(a0, a1) ELSE a0 END AS q_app,
 CASE WHEN i % 2 = 1 THEN 'knowledge' END AS kind_hint FROM qu),
tr AS (SELECT query_id, id FROM q JOIN nodes ON ts_ms BETWEEN from_ms AND to_ms AND (q_thread IS NULL OR thread_id = q_thread)
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts_ms DESC, id DESC) <= 2000),
trl AS (SELECT query_id, list_concat([text], list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 1), ents) AS l FROM q),
trm AS (SELECT DISTINCT query_id, unnest(list_filter(l, lambda x, j: x <> '' AND list_position(l, x) = j)[1:8]) AS term FROM trl),
dir AS (SELECT query_id, id FROM trm JOIN q USING (query_id) JOIN nodes ON ({_LIKE})
 WHERE term <> '' AND (from_ms IS NULL OR ts_ms BETWEEN from_ms AND to_ms) AND (q_thread IS NULL OR thread_id = q_thread) GROUP BY query_id, id, ts_ms
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts_ms DESC, id DESC) <= 30),
bt AS (SELECT query_id, doc_id FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 30),
fh AS (SELECT DISTINCT query_id, node_id AS id FROM bt JOIN links ON screenshot_id = doc_id WHERE node_id IN (SELECT id FROM nodes)),
vec AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
kn AS (SELECT a.vec_id AS query_id, b.vec_id * 3 AS id, list_distance(a.e, b.e) ** 2 AS score FROM vec a, vec b WHERE a.vec_id IN (SELECT query_id FROM q)
 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) <= 20),
fus AS (SELECT query_id, id, min(score) AS score FROM (SELECT query_id, id, NULL::DOUBLE AS score FROM tr UNION ALL SELECT query_id, id, 0.0 FROM dir
 UNION ALL SELECT query_id, id, 0.0 FROM fh UNION ALL SELECT query_id, id, score FROM kn) GROUP BY 1, 2),
"""


def _ready_sql(cand: str, out: str) -> str:
    return f"""{out}_r AS (SELECT c.query_id, c.id, c.score, n.thread_id, n.ts_ms, n.app_hint, n.importance, n.issue, n.kind, q_thread, kind_hint, ents,
  CASE WHEN len(list_filter(ents, lambda e: contains(lower(entities[1]), e) OR contains(lower(entities[2]), e))) > 0 THEN 1 ELSE 0 END AS entity_boost,
  CASE WHEN q_app IS NULL THEN 0 WHEN q_app = n.app_hint THEN 1 WHEN contains(n.app_hint, q_app) OR contains(q_app, n.app_hint) THEN 0.5 ELSE 0 END AS app_boost
  FROM {cand} c JOIN nodes n USING (id) JOIN q USING (query_id) WHERE (q_thread IS NULL OR n.thread_id = q_thread) AND (from_ms IS NULL OR n.ts_ms BETWEEN from_ms AND to_ms)),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY issue DESC, entity_boost DESC, app_boost DESC, (score IS NOT NULL) DESC,
  score * (1.2::DOUBLE - importance / 10) ASC NULLS FIRST, ts_ms DESC, id) AS rn FROM {out}_r WHERE len(ents) = 0 OR entity_boost = 1)"""


WHOLE_SQL = (
    SEARCH_SQL + _ready_sql("fus", "first") + ",\nbest AS (SELECT * FROM first WHERE rn <= 5),\n" + NEIGHBORS_SQL
    + ",\nmrg AS (SELECT query_id, id, min(score) AS score FROM (SELECT * FROM fus UNION ALL SELECT query_id, id, NULL FROM near) GROUP BY 1, 2),\n"
    + _ready_sql("mrg", "final")
)


@query("j6_search", WHOLE_SQL + "\nSELECT query_id, id, rn FROM final")
def j6(spark, sf):
    return whole_search(spark, sf)["ranked"].select("query_id", "id", "rn")


@query(
    "j6_search_shown",
    WHOLE_SQL + """,
m AS (SELECT query_id, id, rn, kind, kind_hint, count(*) FILTER (kind = kind_hint) OVER (PARTITION BY query_id) AS hits FROM final)
SELECT query_id, id, rn FROM m WHERE hits = 0 OR kind = kind_hint""",
)
def j6_shown(spark, sf):
    return whole_search(spark, sf)["shown"].select("query_id", "id", "rn")


@query(
    "j6_search_evidence",
    WHOLE_SQL + """,
pr AS (SELECT query_id, screenshot_id, count(*) AS node_count FROM final JOIN (SELECT DISTINCT * FROM links) ON node_id = id GROUP BY 1, 2)
SELECT query_id, screenshot_id, node_count, c.ts_ms, c.app_hint FROM pr JOIN captures c ON c.id = screenshot_id""",
)
def j6_evidence(spark, sf):
    return whole_search(spark, sf)["evidence"]


@query("j6_search_answer")
def j6_answer(spark, sf):
    """The rows to answer from; their stages have no SQL (``f9_select_for_answer`` is tested on its own)."""
    return whole_search(spark, sf)["answer"]


@query(
    "j9_answer_payload",
    RANK_SQL.rstrip() + """,
top AS (SELECT * FROM ranked WHERE rn <= 100),
lk AS (SELECT DISTINCT l_orderkey AS node_id, l_partkey AS screenshot_id FROM lineitem),
pn AS (SELECT query_id, node_id, screenshot_id FROM top JOIN lk ON node_id = id QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY screenshot_id) <= 8),
ids AS (SELECT query_id, node_id AS id, string_agg(screenshot_id::VARCHAR, ',' ORDER BY screenshot_id) AS captures FROM pn GROUP BY 1, 2)
SELECT query_id, id, rn, kind, coalesce(captures, '') AS captures FROM top LEFT JOIN ids USING (query_id, id)""",
)
def j9(spark, sf):
    r = payload_results(spark, sf)
    nodes = search.answer_payload(r, v.links(spark, sf), payload_captures(spark, sf))["nodes"]
    ids = F.array_join(F.transform("screenshot_ids", lambda x: x.cast("string")), ",")
    return nodes.select("query_id", "id", "rn", "kind", ids.alias("captures"))


def payload_results(spark, sf):
    n = v.nodes(spark, sf).select("id", "title", F.col("title").alias("summary"), "keywords", "entities")
    return ranked(spark, sf).select("query_id", "id", "rn", "ts_ms", "kind").join(n, "id")


def payload_captures(spark, sf):
    return v.captures(spark, sf).select("id", "ts_ms", "app_hint")


@query(
    "j9_answer_evidence",
    RANK_SQL.rstrip() + """,
lk AS (SELECT DISTINCT l_orderkey AS node_id, l_partkey AS screenshot_id FROM lineitem),
pn AS (SELECT query_id, node_id, screenshot_id FROM ranked JOIN lk ON node_id = id WHERE rn <= 100 QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY screenshot_id) <= 8),
al AS (SELECT DISTINCT query_id, screenshot_id FROM ranked JOIN lk ON node_id = id),
pd AS (SELECT DISTINCT query_id, screenshot_id, true AS hit FROM pn),
fl AS (SELECT query_id, screenshot_id, coalesce(hit, false) AS linked, e.ts_ms FROM al LEFT JOIN pd USING (query_id, screenshot_id) JOIN nodes e ON e.id = screenshot_id)
SELECT query_id, screenshot_id, linked, row_number() OVER (PARTITION BY query_id ORDER BY linked DESC, ts_ms DESC, screenshot_id) AS rn FROM fl QUALIFY rn <= 25""",
)
def j9e(spark, sf):
    proof = search.answer_payload(payload_results(spark, sf), v.links(spark, sf), payload_captures(spark, sf))["evidence"]
    return proof.select("query_id", "screenshot_id", (F.col("linked") == 1).alias("linked"), "rn")


# --- inputs ------------------------------------------------------------------------------


@query("a1_read_table", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 3")
def a1(spark, sf):
    """A typed scan: declared schema, pruned columns, pushed filter."""
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return v.prepare(spark).read.schema(schema).parquet(f"{sf}/customer.parquet").filter("c_nationkey = 3").select("c_custkey", "c_name", "c_nationkey")


def feed(spark, sf):
    e, u = v.events(spark, sf), F.col("user_id")
    screen = F.col("event_type") == "view"
    return e.select(
        F.when(screen, "screen").otherwise("window").alias("type"), u.cast("string").alias("source_id"),
        F.when(screen & (u % 2 == 0), F.concat(F.lit("d"), u.cast("string"))).alias("display_id"), F.col("event_type").alias("name"),
        F.when(u % 3 == 0, " null ").otherwise(F.concat(F.lit(" "), "event_type")).alias("app_name"),
        F.when(u % 4 == 0, "  ").otherwise(F.concat(F.lit("w"), F.col("k").cast("string"))).alias("window_title"), "ts", F.col("k").alias("phash"),
        F.lit(None).cast("string").alias("file_path"),
    )


@query(
    "a2_ingest_captures",
    v.cte("ev") + """SELECT ts_ms, CASE WHEN event_type = 'view' THEN 'screen:' || CASE WHEN user_id % 2 = 0 THEN 'd' ELSE '' END || user_id ELSE 'window:' || user_id END AS source_key,
CASE WHEN user_id % 3 <> 0 THEN event_type END AS app_hint, CASE WHEN user_id % 4 = 0 THEN event_type ELSE 'w' || k END AS window_title, 'ephemeral' AS storage_state FROM ev""",
)
def a2(spark, sf):
    out = ingest.ingest_captures(feed(spark, sf))
    return out.select(F.unix_millis("ts").alias("ts_ms"), "source_key", "app_hint", "window_title", "storage_state")


@query(
    "a5_explode_model_nodes",
    """WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1),
n AS (SELECT conv_id, unnest([1, 2, 99]) AS idx, unnest([0, 1, 2]) AS node_index, last FROM c WHERE conv_id % 7 <> 0)
SELECT n.conv_id AS batch_id, node_index, turn AS screenshot_id, 'T' || n.conv_id AS title, CASE WHEN idx = 1 THEN 'Mail' END AS app_hint,
least(10, n.conv_id)::DOUBLE AS importance, 'high' AS priority FROM n JOIN m ON m.conv_id = n.conv_id AND m.pos = idx""",
)
def a5(spark, sf):
    t, c = v.table(spark, sf, "conversations"), F.col("conv_id").cast("string")
    # members are the turns in order: an ordered fold would number long talks, turns are numbered already
    ids = t.groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("ids"))
    members = ids.select(F.col("conv_id").alias("batch_id"), F.posexplode("ids").alias("pos", "id"))
    node = lambda idx, hint: F.concat(
        F.lit(f'{{"screenshot_index":{idx},"title":"T'), c, F.lit(f'","summary":"s","app_context":{{"app_hint":"{hint}","source_key":"window:1"}},"knowledge":null,'
        '"entities":[],"action_items":[{"action":"a","priority":"urgent","source":"x"}],"importance":'), c, F.lit(',"confidence":5,"keywords":["k"]}'),
    )
    whole = F.concat(F.lit('{"nodes":['), node(1, "Mail"), F.lit(","), node(2, "null"), F.lit(","), node(99, "Mail"), F.lit("]}"))
    replies = ids.select(F.col("conv_id").alias("batch_id"), F.when(F.col("conv_id") % 7 == 0, "{broken").otherwise(whole).alias("reply"))
    rows = ingest.explode_model_nodes(replies, members)
    clean = rows.select("batch_id", "node_index", "screenshot_id", *ingest.normalize_reply_node(F.col("n")))
    return clean.select("batch_id", "node_index", "screenshot_id", "title", "app_hint", "importance", F.col("action_items")[0]["priority"].alias("priority"))


@query(
    "a8_scan_manifest",
    v.more("captures") + """m AS (SELECT CASE WHEN id % 9 = 0 THEN 'thumb-' ELSE 'capture-' END || ts_ms || CASE id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.webp' ELSE '.txt' END AS name FROM captures)
SELECT name FROM m WHERE regexp_matches(name, '^capture-.*\\.(jpeg|png|webp)$')""",
)
def a8(spark, sf):
    i = F.col("id")
    ext = F.when(i % 4 == 0, ".png").when(i % 4 == 1, ".jpeg").when(i % 4 == 2, ".webp").otherwise(".txt")
    name = F.concat(F.when(i % 9 == 0, "thumb-").otherwise("capture-"), F.col("ts_ms").cast("string"), ext)
    return ingest.capture_files(v.captures(spark, sf).select(name.alias("name")))

"""Search as a job over a table of queries: full text, keyword, semantic, fusion and payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrail.functions.normalize import cap
from worktrail.functions.text import ellipsis, fts_terms, keyword_terms, strip, tokens
from worktrail.operators.aggregates import result_summary
from worktrail.operators.blocks import BLOCK, in_ranges, running, top_n
from worktrail.operators.filters import keyword_hits, names_match, prefer_kind, within
from worktrail.operators.joins import band_join, evidence, nearest_k, nodes_for_hits, nodes_for_vectors
from worktrail.operators.match import ascii_lower
from worktrail.operators.ranking import app_boost, order_evidence, rank_results, select_for_answer
from worktrail.operators.sets import merge_entities, term_postings
from worktrail.operators.vectors import knn_exact
from worktrail.session import SHARED_ROWS, cut, shared, stored

# Fixed values.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
KEYWORD_LIMIT, TIME_LIMIT, EXPAND_TOP = 30, 2000, 5
PLAN_CONFIDENCE = 0.5
# Bounds: rows of a timeline in one pack, the spans that one copy of a pack serves, and the even cells of a timeline whose
# rows are counted before any is ordered.
PACK_ROWS, PACK_SPANS = 1024, 1000
CELLS = 4096
MAX_NODES, SUMMARY_CHARS, NODE_KEYWORDS, NODE_ENTITIES, NODE_CAPTURES = 100, 600, 10, 8, 8


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings ``(term, doc_id, tf)`` and lengths ``(doc_id, length)`` of ``docs(doc_id, text)``."""
    postings = term_postings(docs)
    lengths = docs.select("doc_id", F.size(tokens("text")).cast("long").alias("length"))
    return postings, lengths


def build_positions(docs: DataFrame) -> DataFrame:
    """Postings with places, ``(term, doc_id, positions)``: where each word of a document stands, from 0.

    One row per word and document; a null or empty text has none.  ``doc_id`` is a key.
    """
    words = docs.select("doc_id", F.posexplode(tokens("text")).alias("pos", "term"))
    return words.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms ``(query_id, term, n_terms)`` of ``queries(query_id, text)``."""
    terms = queries.select("query_id", F.array_distinct(tokens("text")).alias("t"))
    return terms.select("query_id", F.explode("t").alias("term"), F.size("t").alias("n_terms"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """Distinct phrases ``(query_id, term, n_terms)``: the words of each cleaned query term, joined by a space.

    A term that breaks into several words, such as a hyphenated one, asks for them side by side; one
    without letters or digits asks for nothing.
    """
    phrases = F.transform(fts_terms("text"), lambda t: F.array_join(tokens(t), " "))
    asked = queries.select("query_id", F.array_distinct(F.filter(phrases, lambda t: t != "")).alias("t"))
    return asked.select("query_id", F.explode("t").alias("term"), F.size("t").alias("n_terms"))


def phrase_postings(positions: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``(term, doc_id, tf)`` of the asked words and phrases; ``tf`` counts the places a phrase starts.

    A document that has a phrase has its rarest word, so a phrase meets the documents of that word only;
    its places there are what the lists of its words, each shifted by the word's offset, have in common.
    """
    asked = terms.select("term").distinct().withColumn("words", F.split("term", " "))
    words = asked.select(F.explode("words").alias("term")).distinct()
    # read by every step below; only asked words are kept, so an index made on the fly is never shuffled whole
    hit = cut(positions.join(words, "term", "left_semi"))
    single = hit.join(asked.filter(F.size("words") == 1).select("term"), "term", "left_semi").select("term", "doc_id", F.size("positions").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    places = asked.filter(F.size("words") > 1).select(F.col("term").alias("phrase"), "words", F.posexplode("words").alias("at", "term"))
    known = places.join(df, "term").groupBy("phrase").agg(
        F.count("*").alias("known"), F.min(F.struct("df", "term", "at")).alias("least"), F.first("words").alias("words")
    )
    rarest = known.filter(F.col("known") == F.size("words")).select("phrase", F.col("least.term").alias("term"))
    cands = hit.select("term", "doc_id").join(rarest, "term").select("phrase", "doc_id")
    rows = cands.join(places.select("phrase", "at", "term"), "phrase").join(hit, ["term", "doc_id"])
    starts = rows.select("phrase", "doc_id", F.transform("positions", lambda p: p - F.col("at")).alias("starts"))
    # the lists of one phrase in one document: as many as the phrase has words
    lists = starts.groupBy("phrase", "doc_id").agg(F.collect_list("starts").alias("lists"))
    n_words = F.size(F.split("phrase", " "))
    common = F.aggregate(F.slice("lists", 2, n_words), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    both = lists.filter(F.size("lists") == n_words).select(F.col("phrase").alias("term"), "doc_id", F.size(common).alias("tf"))
    return single.unionByName(both.filter("tf > 0"))


def _few(terms: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Marks a frame of at most a row per asked term to be sent to every task, if the queries ask for few enough."""
    return F.broadcast if terms.count() <= SHARED_ROWS else lambda df: df


def _full_matches(postings: DataFrame, terms: DataFrame, df: DataFrame) -> DataFrame:
    """Postings ``(query_id, term, doc_id, tf)`` of the documents that have every term of the query.

    A document that has all terms has the rarest, so the other terms are looked up only in the
    documents of that one; a query with a term that no document has is out.  ``df(term, df)``.
    A candidate meets what the document has of all asked terms as one row, and is tested there: what the queries
    ask is sent to every task as long as it is small, so that such rows, one per candidate, are never shuffled.
    """
    share = _few(terms)
    per_query = terms.join(df, "term").groupBy("query_id").agg(
        F.max("n_terms").alias("n_terms"), F.min(F.struct("df", "term")).alias("least"), F.collect_list("term").alias("asked")
    )
    per_query = per_query.filter(F.size("asked") == F.col("n_terms"))
    rarest = per_query.select("query_id", F.col("least.term").alias("term"))
    cands = postings.select("term", "doc_id").join(share(rarest), "term").select("query_id", "doc_id")
    met = postings.join(cands.select("doc_id").distinct(), "doc_id", "left_semi")
    of_doc = met.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("has"))
    rows = cands.join(of_doc, "doc_id").join(share(per_query.select("query_id", "asked")), "query_id")
    full = rows.filter(F.forall("asked", lambda t: F.map_contains_key("has", t)))
    found = F.transform("asked", lambda t: F.struct(t.alias("term"), F.try_element_at("has", t).alias("tf")))
    return full.select("query_id", "doc_id", F.inline(found))


def _asked(postings: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the terms that a query has, and each one's count of documents."""
    hit = postings.join(terms.select("term").distinct(), "term", "left_semi")
    return hit, hit.groupBy("term").agg(F.count("*").alias("df"))


def fts_match(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs ``(query_id, doc_id)`` where the document has every term of the query."""
    terms = query_terms(queries)
    hit, df = _asked(postings, terms)
    return _full_matches(hit, terms, df).select("query_id", "doc_id").distinct()


def phrase_match(positions: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs ``(query_id, doc_id)`` where the document has every word and phrase of the cleaned query."""
    terms = query_phrases(queries)
    hit = cut(phrase_postings(positions, terms))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    return _full_matches(hit, terms, df).select("query_id", "doc_id").distinct()


def _scores(hit: DataFrame, lengths: DataFrame, terms: DataFrame) -> DataFrame:
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    n_docs = lengths.select(F.count("*").alias("n")).scalar()
    mean = lengths.select(F.avg("length").alias("m")).scalar()
    idf = F.greatest(F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    tf, size = F.col("tf"), F.col("length") / mean
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size))
    return (
        _full_matches(hit, terms, df)
        .join(_few(terms)(df), "term")
        .join(lengths, "doc_id")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(part).alias("score"))
    )


def bm25(postings: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 score of each document that has every term of the query; larger is better.

    Only postings of terms that a query has are read on; a term's document count and the
    collection's size and mean length are aggregates of the index.
    """
    terms = query_terms(queries)
    return _scores(_asked(postings, terms)[0], lengths, terms)


def phrase_bm25(positions: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 score by words and phrases of the cleaned query; a phrase counts as one term.

    Its frequency is the number of places where it starts, its document count that of the documents that have it.
    """
    terms = query_phrases(queries)
    return _scores(cut(phrase_postings(positions, terms)), lengths, terms)


def bm25_top(scores: DataFrame, limit: int = KEYWORD_LIMIT) -> DataFrame:
    return top_n(scores, ["query_id"], [F.round("score", 9).desc(), F.col("doc_id")], limit)


def keyword_top(hits: DataFrame, limit: int = KEYWORD_LIMIT) -> DataFrame:
    """Newest hits per query."""
    return top_n(hits, ["query_id"], [F.col("ts_ms").desc(), F.col("id").desc()], limit)


def time_extent(rows: DataFrame) -> tuple[int, int]:
    """First and last millisecond of ``rows``; both 0 if none has a time."""
    lo, hi = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    return (0, 0) if lo is None else (lo, hi)


def _near_ends(spans: DataFrame, rows: DataFrame, keys: list[str], limit: int, extent: tuple[int, int], cells: int = CELLS) -> DataFrame:
    """The rows that may be among the last ``limit`` up to the end of a span of their key, and few others.

    Rows are counted per key and even cell of time first.  A cell stays if a span ends in it, or if fewer than ``limit`` rows
    lie between it and the next cell in which one ends; rows of other cells cannot be among the last.  So a key and end keep
    ``limit`` rows and two cells at most, whatever the table holds, and only counts are shuffled for it.
    """
    if keys:
        rows = rows.join(shared(spans.select(*keys).distinct()), keys, "left_semi")
    lo, hi = extent
    cell = lambda at: F.floor((at - lo) / ((hi - lo) // cells + 1))
    # rows without a time come before all others
    rows = rows.withColumn("__cell", F.coalesce(cell(F.col("ts_ms")), F.lit(-1)).cast("int"))
    last = F.greatest(cell(F.least("to_ms", F.lit(hi))), F.lit(-1)).cast("int")
    ends = spans.select(*keys, last.alias("__cell"), F.lit(0).cast("long").alias("__rows"), F.lit(True).alias("__end")).distinct()
    counts = rows.groupBy(*keys, "__cell").agg(F.count("*").alias("__rows")).withColumn("__end", F.lit(False))
    line = counts.unionByName(ends).groupBy(*keys, "__cell").agg(F.sum("__rows").alias("__rows"), F.max("__end").alias("__end"))
    # as many rows per key as there are cells
    upward = Window.partitionBy(*keys).orderBy("__cell")
    downward = Window.partitionBy(*keys).orderBy(F.col("__cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("__upto", F.sum("__rows").over(upward))
    line = line.withColumn("__next", F.last(F.when(F.col("__end"), F.col("__upto") - F.col("__rows")), ignorenulls=True).over(downward))
    line = cut(line.select(*keys, "__cell", "__rows", (F.col("__end") | F.coalesce(F.col("__next") - F.col("__upto") < limit, F.lit(False))).alias("__kept")))
    held, kept = line.agg(F.sum("__rows"), F.sum(F.when(F.col("__kept"), F.col("__rows")))).first()
    out = rows.join(shared(line.filter("__kept AND __rows > 0").select(*keys, "__cell")), [*keys, "__cell"], "left_semi").drop("__cell")
    # ordering reads its rows twice; where most stay, writing them would cost more
    return cut(out) if (kept or 0) <= (held or 0) / 2 else out


def newest_in_spans(
    spans: DataFrame, rows: DataFrame, keys: list[str], order: list[str], limit: int, pack_rows: int = PACK_ROWS,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """The last ``limit`` rows of the key's timeline in each span, as pairs of the span's columns and the row's ``order``.

    ``spans`` has the keys, ``from_ms`` (null: from the start) and ``to_ms``, both ends counted; ``order`` begins with
    ``ts_ms`` and ends in an id.  Rows get their number in the key's timeline, so a span is a stretch of numbers; rows
    lie in packs of ``pack_rows`` numbers, and a span meets the packs of its stretch only.  A pack that many spans ask
    for is copied once per ``PACK_SPANS`` of them.  Pairs are made at the end and never shuffled or sorted here.
    Only rows near the end of a span are numbered; ``extent`` is what ``time_extent`` gives for the rows or more of them.
    """
    rows = _near_ends(spans, rows.select(*keys, *order), keys, limit, extent or time_extent(rows))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    marker = lambda c, side: spans.select(*keys, F.col(c).alias("ts_ms"), F.lit(side).alias("__side"), *[none(c) for c in order[1:]])
    marks = marker("from_ms", -1).filter("ts_ms IS NOT NULL").unionByName(marker("to_ms", 1)).distinct()
    place = ["ts_ms", "__side", *order[1:]]
    line = in_ranges(rows.select(*keys, *order, F.lit(0).alias("__side")).unionByName(marks), keys, place)
    line = cut(running(line, keys, place, BLOCK, {"__n": ("sum", F.when(F.col("__side") == 0, 1).otherwise(0).cast("long"))}))
    at = lambda side, c, n: line.filter(F.col("__side") == side).select(*keys, F.col("ts_ms").alias(c), F.col("__n").alias(n))
    asked = spans.join(at(1, "to_ms", "__last"), [*keys, "to_ms"]).join(at(-1, "from_ms", "__before"), [*keys, "from_ms"], "left")
    asked = asked.withColumn("__first", F.greatest(F.coalesce("__before", F.lit(0)), F.col("__last") - limit) + 1).drop("__before")
    pack = lambda n: F.floor((n - 1) / pack_rows).cast("long")
    asked = asked.filter("__first <= __last").withColumn("__pack", F.explode(F.sequence(pack(F.col("__first")), pack(F.col("__last")))))
    cell = [*keys, "__pack"]
    copies = asked.groupBy(*cell).agg(F.ceil(F.count("*") / PACK_SPANS).cast("int").alias("__copies"))
    packed = line.filter("__side = 0").groupBy(*keys, pack(F.col("__n")).alias("__pack")).agg(F.array_sort(F.collect_list(F.struct("__n", *order))).alias("__rows"))
    packed = packed.join(copies, cell).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    asked = asked.join(copies, cell).withColumn("__copy", F.pmod(F.xxhash64(*spans.columns), F.col("__copies")).cast("int"))
    first = F.greatest(F.col("__first") - F.col("__pack") * pack_rows, F.lit(1)).cast("int")
    last = F.least(F.col("__last") - F.col("__pack") * pack_rows, F.lit(pack_rows)).cast("int")
    met = asked.join(packed, [*cell, "__copy"])
    return met.select(*spans.columns, F.inline(F.slice("__rows", first, last - first + 1))).drop("__n")


def time_recall(nodes: DataFrame, queries: DataFrame, limit: int = TIME_LIMIT, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Newest ``limit`` nodes in each query's closed range (``from_ms``, ``to_ms``), and thread if it names one.

    A query's nodes are a stretch of the (thread's) timeline, looked up by number; only queries whose id is there
    more than once have their found nodes ordered together.
    """
    asked = queries.filter("from_ms IS NOT NULL AND to_ms IS NOT NULL")
    # the span of all ranges bounds the scan
    earliest, latest = asked.agg(F.min("from_ms"), F.max("to_ms")).first()
    nodes = within(nodes, earliest, latest).select("ts_ms", "id", "thread_id")
    extent = time_extent(nodes)

    def look_up(part: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
        spans = part.groupBy("query_id", *keys, "from_ms", "to_ms").agg(F.count("*").alias("__times"))
        spans = cut(spans.withColumn("__of", F.sum("__times").over(Window.partitionBy("query_id"))))

        def found(some: DataFrame) -> DataFrame:
            rows = newest_in_spans(some, pool, keys, ["ts_ms", "id"], limit, pack_rows, extent)
            return rows.select("query_id", "id", "ts_ms", "__times")

        alone = found(spans.filter("__of = 1")).drop("__times")
        if spans.filter("__of > 1").isEmpty():
            return alone
        rows = found(spans.filter("__of > 1")).withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        best = top_n(rows, ["query_id"], [F.col("ts_ms").desc(), F.col("id").desc()], limit)
        return alone.unionByName(best.select("query_id", "id", "ts_ms"))

    anywhere = look_up(asked.filter("thread_id IS NULL"), nodes, [])
    threaded = look_up(asked.filter("thread_id IS NOT NULL"), nodes.filter("thread_id IS NOT NULL"), ["thread_id"])
    return anywhere.unionByName(threaded)


def merge_filters(queries: DataFrame, plans: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Query filters after the plan: ignored below 0.5 confidence, and it never overwrites a filter.

    Time range and app fill gaps (the app only if it is a canonical name), entities are united,
    the thread is never taken from the plan.
    ``plans(query_id, confidence, from_ms, to_ms, app_hint, entities)``.
    """
    cols = ("confidence", "from_ms", "to_ms", "app_hint", "entities")
    p = plans.select("query_id", *[F.col(c).alias(f"__{c}") for c in cols])
    if canonical is not None:
        known = canonical.select(F.col("canonical").alias("__app_hint")).distinct().withColumn("__ok", F.lit(True))
        p = p.join(known, "__app_hint", "left").withColumn("__app_hint", F.when(F.col("__ok"), F.col("__app_hint"))).drop("__ok")
    joined = queries.join(p, "query_id", "left")
    use = F.coalesce(F.col("__confidence") >= PLAN_CONFIDENCE, F.lit(False))
    unset = F.col("from_ms").isNull() & F.col("to_ms").isNull()
    ranged = use & unset
    out = joined.withColumns(
        {
            "from_ms": F.when(ranged, F.col("__from_ms")).otherwise(F.col("from_ms")),
            "to_ms": F.when(ranged, F.col("__to_ms")).otherwise(F.col("to_ms")),
            "app_hint": F.when(use, F.coalesce("app_hint", "__app_hint")).otherwise(F.col("app_hint")),
            "entities": F.when(use, merge_entities(F.col("entities"), F.col("__entities"))).otherwise(F.col("entities")),
        }
    )
    return out.drop(*[f"__{c}" for c in cols])


def fuse(time: DataFrame, keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Candidates ``(query_id, id)`` with the smallest score: keyword 0, semantic its distance, time none."""
    none = F.lit(None).cast("double")
    rows = (
        time.select("query_id", "id", none.alias("score"))
        .unionByName(keyword.select("query_id", "id", F.lit(0.0).alias("score")))
        .unionByName(semantic.select("query_id", "id", F.col("score").cast("double").alias("score")))
    )
    return rows.groupBy("query_id", "id").agg(F.min("score").alias("score"))


def _ready(cands: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates that pass the query's filters, with the columns ranking needs.

    Entities are compared on the candidates only: a node is never met by a query that did not find it.
    """
    q = queries.select(
        "query_id", F.col("thread_id").alias("q_thread"), "from_ms", "to_ms", F.col("entities").alias("q_entities"),
        F.col("app_hint").alias("q_app"), "kind_hint",
    )
    rows = cands.join(nodes, "id").join(q, "query_id")
    named = F.filter(F.transform(F.coalesce("q_entities", F.array().cast("array<string>")), lambda e: F.lower(strip(e))), lambda e: e != "")
    match = F.exists(named, lambda e: names_match(F.col("entities"), e))
    rows = rows.withColumn("entity_boost", F.when(match, 1).otherwise(0))
    ok = (
        (F.col("q_thread").isNull() | F.col("thread_id").eqNullSafe(F.col("q_thread")))
        & (F.col("from_ms").isNull() | F.col("ts_ms").between(F.col("from_ms"), F.col("to_ms")))
        & ((F.size(named) == 0) | (F.col("entity_boost") == 1))
    )
    return rows.filter(ok).withColumn("app_boost", app_boost(F.col("app_hint"), F.col("q_app")))


def expand_neighbors(ranked: DataFrame, nodes: DataFrame, queries: DataFrame, top: int = EXPAND_TOP) -> DataFrame:
    """``(query_id, id)`` of the nodes next to each query's best: in the thread, else in time.

    A query that names a thread looks there.
    """
    best = ranked.filter(F.col("rn") <= top).select("query_id", "id", "thread_id", "ts_ms")
    best = best.join(queries.select("query_id", F.col("thread_id").alias("q_thread")), "query_id")
    best = best.select("query_id", "id", F.coalesce("q_thread", "thread_id").alias("thread_id"), "ts_ms")
    # the same pivot may serve many queries: neighbours are looked up once per pivot and thread
    pivots = cut(best.select("thread_id", F.col("id").alias("pivot_id"), "ts_ms").distinct())
    threaded = nearest_k(pivots, nodes).select("thread_id", "pivot_id", "id").distinct()
    lone = band_join(pivots.filter("thread_id IS NULL"), nodes).select("pivot_id", "id")
    ask = best.select("query_id", F.col("id").alias("pivot_id"), "thread_id")
    a = ask.join(threaded, ["thread_id", "pivot_id"]).select("query_id", "id")
    b = ask.filter("thread_id IS NULL").join(lone, "pivot_id").select("query_id", "id")
    return a.unionByName(b).distinct()


def _posted(rows: DataFrame) -> DataFrame:
    """``(id, nth, ts_ms, thread_id, value)`` of ``rows(id, ts_ms, thread_id, __values)``: each row of an id with each value of the id.

    Only rows of ids that come more than once are brought together by id.
    """
    cols = ["id", "nth", "ts_ms", "thread_id", F.explode("__values").alias("value")]
    again = cut(rows.groupBy("id").agg(F.count("*").alias("__times")).filter("__times > 1").select("id"))
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(0)).select(*cols)
    again = shared(again)
    of_id = rows.join(again, "id", "left_semi").groupBy("id").agg(
        F.array_distinct(F.flatten(F.collect_list("__values"))).alias("__values"), F.collect_list(F.struct("ts_ms", "thread_id")).alias("__rows")
    )
    alike = of_id.select("id", "__values", F.posexplode("__rows").alias("nth", "__row")).select("id", "nth", "__row.*", "__values")
    return rows.join(again, "id", "left_anti").withColumn("nth", F.lit(0)).select(*cols).unionByName(alike.select(*cols))


def _newest_direct(queries: DataFrame, nodes: DataFrame, cols: list[str], limit: int = KEYWORD_LIMIT) -> DataFrame:
    """Newest ``limit`` nodes per query, in its range and thread, that have one of its keyword terms in a column.

    Columns are labels whose values recur: each distinct value is searched once, and a query reads the newest
    ``limit`` nodes of each value that it matches off that value's timeline.  All hits are never pairs.
    """
    terms = queries.select("query_id", F.explode(keyword_terms("text", F.col("entities"))).alias("term"))
    folded = F.array_distinct(F.array_compact(F.array(*[ascii_lower(F.col(c)) for c in cols])))
    # an id's rows share their values; each row counts towards the limit
    # read by every step below: written as columns, in which recurring labels take a byte or two, they are folded once
    rows = stored(nodes.filter("id IS NOT NULL").select("id", "ts_ms", "thread_id", folded.alias("__values")), "labels")
    values = cut(rows.select(F.explode("__values").alias("value")).distinct())
    matched = cut(keyword_hits(values.select("value", F.col("value").alias("label")), "value", ["label"], terms, repeated=True))
    posted = _posted(rows)
    extent = time_extent(rows)
    # an open range begins before all times, and rows without one are before these; a range half open has no rows
    scoped = queries.filter("from_ms IS NULL OR to_ms IS NOT NULL").select(
        "query_id", "from_ms", F.when(F.col("from_ms").isNull(), F.lit(2**63 - 1)).otherwise(F.col("to_ms")).alias("to_ms"), "thread_id"
    )
    # rows of one query id are one list, in which each brings its hits
    scoped = scoped.groupBy("query_id", "from_ms", "to_ms", "thread_id").agg(F.count("*").alias("__times"))
    spans = cut(matched.join(scoped, "query_id"))
    of_hit = ["query_id", "from_ms", "to_ms", "thread_id", "__times", "id", "ts_ms", "nth"]

    def look_up(some: DataFrame, keys: list[str]) -> DataFrame:
        return newest_in_spans(some, posted, keys, ["ts_ms", "id", "nth"], limit, extent=extent).select(*of_hit)

    anywhere = look_up(spans.filter("thread_id IS NULL"), ["value"])
    threaded = look_up(spans.filter("thread_id IS NOT NULL"), ["value", "thread_id"])
    found = anywhere.unionByName(threaded).distinct()
    return keyword_top(found.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("query_id", "id", "ts_ms"), limit)


def _of_ids(nodes: DataFrame, few: DataFrame) -> DataFrame:
    """The nodes whose id is in ``few(id)``; nodes are only scanned as long as ``few`` may be sent to every task."""
    return nodes.join(shared(few.select("id").distinct()), "id", "left_semi")


def keyword_search(
    queries: DataFrame, nodes: DataFrame, links: DataFrame, index: tuple[DataFrame, DataFrame], cols: list[str]
) -> DataFrame:
    """Keyword candidates ``(query_id, id)``: newest direct hits, and nodes of the best full-text hits.

    ``index`` is what ``build_index`` gave for the captures' texts, normally two stored tables;
    ``links(node_id, screenshot_id)``.
    """
    direct = _newest_direct(queries, nodes, cols)
    postings, lengths = index
    # scoring reads the postings of asked words three times, so these are written; links and nodes are met by the few ids of the hits
    few = stored(postings.join(shared(query_terms(queries).select("term").distinct()), "term", "left_semi"), "asked-postings")
    hits = cut(bm25_top(bm25(few, lengths, queries)).select("query_id", F.col("doc_id").alias("screenshot_id")))
    linked = cut(links.join(shared(hits.select("screenshot_id").distinct()), "screenshot_id", "left_semi").distinct())
    held = _of_ids(nodes.select("id"), linked.select(F.col("node_id").alias("id")))
    text = nodes_for_hits(hits, linked, held).select("query_id", "id")
    return direct.select("query_id", "id").unionByName(text).distinct()


def rank_search(
    queries: DataFrame, nodes: DataFrame, links: DataFrame, index: tuple[DataFrame, DataFrame], vector_docs: DataFrame,
    cols: list[str], k: int = 20,
) -> DataFrame:
    """Ranked results per query: candidates, filters, ranking, neighbours of the best, ranking again.

    ``queries(query_id, text, embedding, from_ms, to_ms, thread_id, entities, app_hint, kind_hint)``;
    ``nodes(id, ts_ms, thread_id, app_hint, importance, issue, kind, entities, ...)``;
    ``vector_docs(vector_id, ref_id, embedding)``.
    """
    time = time_recall(nodes, queries)
    keyword = keyword_search(queries, nodes, links, index, cols)
    matches = cut(knn_exact(queries.filter("embedding IS NOT NULL"), vector_docs, k))
    docs = vector_docs.select("vector_id", "ref_id").join(shared(matches.select("vector_id").distinct()), "vector_id", "left_semi")
    semantic = nodes_for_vectors(matches, docs, _of_ids(nodes.select("id"), docs.select(F.col("ref_id").alias("id"))))
    # candidates are few next to the nodes; both rankings and the neighbours start from them
    fused = cut(fuse(time, keyword, semantic))
    first = cut(rank_results(_ready(fused, _of_ids(nodes, fused), queries)).filter(F.col("rn") <= EXPAND_TOP))
    near = cut(expand_neighbors(first, nodes, queries).withColumn("score", F.lit(None).cast("double")))
    merged = fused.unionByName(near.select("query_id", "id", "score")).groupBy("query_id", "id").agg(
        F.min("score").alias("score")
    )
    return rank_results(_ready(merged, _of_ids(nodes, fused.select("id").unionByName(near.select("id"))), queries))


def search(
    queries: DataFrame, nodes: DataFrame, links: DataFrame, captures: DataFrame, index: tuple[DataFrame, DataFrame],
    vector_docs: DataFrame, cols: list[str], plans: DataFrame | None = None, canonical: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The whole search: ranked results, results to show, evidence and the rows to answer from.

    ``plans`` (with ``canonical`` app names) fill gaps of the queries' filters first.  All four frames share
    one written ranking; evidence is read for its rows only.
    """
    asked = cut(merge_filters(queries, plans, canonical) if plans is not None else queries)
    ranked = cut(rank_search(asked, nodes, links, index, vector_docs, cols))
    # of the links only those of ranked nodes are made distinct
    links = links.join(shared(ranked.select(F.col("id").alias("node_id")).distinct()), "node_id", "left_semi")
    return {
        "ranked": ranked,
        "shown": prefer_kind(ranked),
        "evidence": evidence(ranked, links, captures),
        "answer": select_for_answer(ranked),
    }


def answer_payload(results: DataFrame, links: DataFrame, captures: DataFrame) -> dict[str, DataFrame]:
    """What an answer is written from: nodes and captures cut to size, and a summary over them.

    ``results(query_id, id, rn, ts_ms, kind, title, summary, keywords, entities)``.
    """
    top = results.filter(F.col("rn") <= MAX_NODES)
    linked = top.select("query_id", F.col("id").alias("node_id")).join(links.distinct(), "node_id")
    per_node = top_n(linked, ["query_id", "node_id"], [F.col("screenshot_id")], NODE_CAPTURES, "cap_no")
    ids = per_node.groupBy("query_id", F.col("node_id").alias("id")).agg(
        F.array_sort(F.collect_list("screenshot_id")).alias("screenshot_ids")
    )
    nodes = top.join(ids, ["query_id", "id"], "left").select(
        "query_id", "id", "rn", "kind", "title", ellipsis("summary", SUMMARY_CHARS).alias("summary"),
        cap("keywords", NODE_KEYWORDS).alias("keywords"), cap("entities", NODE_ENTITIES).alias("entities"), "ts_ms",
        F.coalesce("screenshot_ids", F.array().cast("array<bigint>")).alias("screenshot_ids"),
    )
    proof = order_evidence(evidence(results, links, captures), per_node)
    return {"nodes": nodes, "evidence": proof, "summary": result_summary(top, proof)}

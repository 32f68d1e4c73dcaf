"""Ranking, selection, ordered rates and sorted lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrail.operators.blocks import (
    BLOCK, CARRY, DAY_MS, HOUR_MS, in_ranges, lag_in_blocks, running, time_block, top_n, with_carry,
)
from worktrail.operators.filters import drop_system_windows, within

# Fixed values.
MAX_CANDIDATES, FALLBACK_CANDIDATES, LENS_THREADS = 3, 1, 6
LANE_WEIGHTS = (3, 1)
LANE_AGE_MS = 10 * 60_000
ANSWER_BUDGET, PINNED_CAP, HINTED_CAP, THREAD_CAP, PER_THREAD, DIVERSITY_CAP = 50, 20, 15, 10, 3, 5
MAX_EVENT_ITEMS, MAX_EVENT_CHARS = 50, 24_000
KEEP_FILES, KEEP_MS = 1000, 7 * DAY_MS
BURST_MS, BURST_COUNT = 10_000, 3
RATE_WINDOW = 20
MAX_EVIDENCE, CAPTURES_PER_NODE = 25, 8
DEFAULT_IMPORTANCE = 5


def recent_n(df: DataFrame, key: str, n: int, ts_ms: str = "ts_ms", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows per key, numbered oldest first."""
    newest = top_n(df.filter(F.col(key).isNotNull()), [key], [F.col(ts_ms).desc(), F.col(tie).desc()], n, "__new")
    w = Window.partitionBy(key).orderBy(F.col("__new").desc())  # at most n rows per key
    return newest.withColumn("pos", F.row_number().over(w)).drop("__new")


def last_n(df: DataFrame, key: str, n: int, ts_ms: str = "ts_ms", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows per key, numbered newest first."""
    return top_n(df, [key], [F.col(ts_ms).desc(), F.col(tie).desc()], n)


def gap_sessions(df: DataFrame, key: str, gap_ms: int, ranges: int | None = None) -> DataFrame:
    """Session number of each row: a step longer than ``gap_ms`` starts a new one.

    Rows without key or time have no session and are left out; rows of one time are ordered by ``id``, if there is one.
    """
    order = [c for c in ("ts_ms", "id") if c in df.columns]
    rows = in_ranges(df.filter(F.col(key).isNotNull() & F.col("ts_ms").isNotNull()), [key], order, ranges)
    rows = lag_in_blocks(rows, [key], order, BLOCK, {"__prev": ("ts_ms", 1)})
    starts = F.when(F.col("__prev").isNull() | (F.col("ts_ms") - F.col("__prev") > gap_ms), 1).otherwise(0).cast("long")
    return running(rows, [key], order, BLOCK, {"session": ("sum", starts)}).drop("__prev", BLOCK)


def two_ended(df: DataFrame, order: Sequence[str], cap: int) -> DataFrame:
    """Newest half and oldest half of the cap; a row that is in both is kept once."""
    half = -(-cap // 2)
    newest = df.orderBy(*[F.col(c).desc() for c in order]).limit(half)
    oldest = df.orderBy(*order).limit(half)
    return newest.unionByName(oldest).dropDuplicates(list(order))


def _pinned(threads: DataFrame, pins: DataFrame) -> DataFrame:
    return threads.join(pins.select("owner", "thread_id"), ["owner", "thread_id"]).filter(F.col("status") != "closed")


def thread_candidates(threads: DataFrame, pins: DataFrame, n: int = MAX_CANDIDATES) -> DataFrame:
    """Threads a new batch may join, per owner: the pinned one, then active ones by recency.

    An owner without an active thread falls back to the newest thread that is not closed.
    """
    recency = [F.col("last_active_ms").desc(), F.col("thread_id")]
    active = top_n(threads.filter("status = 'active'"), ["owner"], recency, n)
    rest = threads.filter("status <> 'closed'").join(active.select("owner").distinct(), "owner", "left_anti")
    base = active.unionByName(top_n(rest, ["owner"], recency, FALLBACK_CANDIDATES)).drop("rn").withColumn("__pri", F.lit(1))
    both = base.unionByName(_pinned(threads, pins).withColumn("__pri", F.lit(0)))
    once = top_n(both, ["owner", "thread_id"], [F.col("__pri")], 1).drop("rn")
    return top_n(once, ["owner"], [F.col("__pri"), *recency], n, "position").drop("__pri")


def lens_state(threads: DataFrame, pins: DataFrame, n: int = LENS_THREADS) -> DataFrame:
    """Threads on display per owner: the pinned one and the most recent, in order of recency.

    ``resolved`` marks the current thread: the pinned one, else the newest active, else the first.
    """
    recency = [F.col("last_active_ms").desc(), F.col("thread_id")]
    recent = top_n(threads.filter("status <> 'closed'"), ["owner"], recency, n).drop("rn").withColumn("pinned", F.lit(False))
    both = recent.unionByName(_pinned(threads, pins).withColumn("pinned", F.lit(True)))
    once = top_n(both, ["owner", "thread_id"], [F.col("pinned").desc()], 1).drop("rn")
    shown = top_n(once, ["owner"], [F.col("pinned").desc(), *recency], n).drop("rn")
    by_recency = Window.partitionBy("owner").orderBy(*recency)  # at most n rows per owner
    pick = Window.partitionBy("owner").orderBy(F.col("pinned").desc(), (F.col("status") == "active").desc(), *recency)
    return shown.withColumn("position", F.row_number().over(by_recency)).withColumn("resolved", F.row_number().over(pick) == 1)


def rank_results(candidates: DataFrame) -> DataFrame:
    """Rank per query: issue, entity match, app match, scored first, weighted score, newest.

    ``candidates`` has ``query_id, id, issue, entity_boost, app_boost, score, importance, ts_ms``;
    a smaller score is better and importance scales it by 1.2 - importance / 10.
    """
    weight = F.lit(1.2) - F.coalesce("importance", F.lit(DEFAULT_IMPORTANCE)) / 10
    order = [
        F.col("issue").desc(),
        F.col("entity_boost").desc(),
        F.col("app_boost").desc(),
        F.col("score").isNotNull().desc(),
        (F.col("score") * weight).asc(),
        F.col("ts_ms").desc(),
        F.col("id"),
    ]
    return candidates.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def app_boost(node_app: Column, wanted: Column) -> Column:
    """1 for the wanted app, 0.5 when either name contains the other, else 0."""
    a, b = F.lower(node_app), F.lower(wanted)
    part = F.contains(a, b) | F.contains(b, a)
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).when(part, 0.5).otherwise(0.0)


def lane_order(df: DataFrame, now_ms: int, ts_ms: str = "ts_ms", weights: tuple[int, int] = LANE_WEIGHTS,
               age_ms: int = LANE_AGE_MS, by_attempts: bool = True, ranges: int | None = None) -> DataFrame:
    """Dispatch slot: realtime rows newest first and recovery rows oldest first, three to one.

    Rows are numbered inside their lane over even ranges, so no lane is sorted in one task.  A row without
    a time counts as realtime if it was never tried, and comes first in its lane.
    """
    old = F.col(ts_ms) < now_ms - age_ms
    recovery = (F.col("attempts") > 0) | old if by_attempts else old
    laned = df.withColumn("lane", F.when(recovery, "recovery").otherwise("realtime"))
    laned = laned.withColumn("__ord", F.when(F.col("lane") == "recovery", F.col(ts_ms)).otherwise(-F.col(ts_ms)))
    laned = in_ranges(laned, ["lane"], ["__ord", "id"], ranges)
    ranked = running(laned, ["lane"], ["__ord", "id"], BLOCK, {"__r": ("sum", F.lit(1).cast("long"))})
    fast, slow = weights
    r = F.col("__r") - 1
    slot = F.when(F.col("lane") == "realtime", F.floor(r / fast) * (fast + slow) + r % fast).otherwise(
        F.floor(r / slow) * (fast + slow) + fast + r % slow
    )
    return ranked.withColumn("slot", slot.cast("long")).drop("__ord", BLOCK, "__r")


def char_budget(df: DataFrame, key: str, order: Sequence[Column], col: str,
                max_items: int = MAX_EVENT_ITEMS, max_chars: int = MAX_EVENT_CHARS) -> DataFrame:
    """Longest prefix per key whose JSON array fits the item and character budgets."""
    first = top_n(df, [key], order, max_items)
    upto = Window.partitionBy(key).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)  # at most max_items rows
    used = F.lit(2) + F.sum(F.length(col)).over(upto) + F.col("rn") - 1
    return first.withColumn("used", used.cast("long")).filter(F.col("used") <= max_chars)


def time_bucket(ts_ms: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Number of the equal slice of ``[lo, hi]`` that holds a time; null outside."""
    size = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), hi - lo) / buckets))
    slot = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((ts_ms - lo) / size)))
    return F.when(ts_ms.between(lo, hi), slot.cast("long"))


def one_per_bucket(ranked: DataFrame, buckets: int = DIVERSITY_CAP) -> DataFrame:
    """Best-ranked row of each time slice of the query's range (``from_ms``, ``to_ms``)."""
    slot = time_bucket(F.col("ts_ms"), F.col("from_ms"), F.col("to_ms"), buckets)
    rows = ranked.withColumn("bucket", slot).filter("bucket IS NOT NULL")
    return top_n(rows, ["query_id", "bucket"], [F.col("rn")], 1, "__first").drop("__first")


def retention_plan(manifest: DataFrame, now_ms: int, max_count: int = KEEP_FILES, max_age_ms: int = KEEP_MS) -> DataFrame:
    """Which files to delete: all but the newest ``max_count`` by name (then path), and those too old."""
    by = [c for c in ("name", "path") if c in manifest.columns]  # a name may occur in several folders
    keep = manifest.orderBy(*[F.col(c).desc() for c in by]).limit(max_count).select(*by, F.lit(True).alias("__keep"))
    joined = manifest.join(keep, by, "left")
    delete = F.col("__keep").isNull() | (now_ms - F.col("mtime_ms") > max_age_ms)
    return joined.withColumn("delete", delete).drop("__keep")


def failure_bursts(df: DataFrame, key: str, width_ms: int = BURST_MS, n: int = BURST_COUNT) -> DataFrame:
    """Failures with the number of failures in the trailing window, and the first to reach ``n``.

    Each failure is also placed into the next two bins of the window's width, so a bin holds
    all that its own rows and their predecessors look back on.
    """
    rows = df.select(key, "id", "ts_ms").withColumn("__bin", time_block("ts_ms", width_ms))
    spread = rows.withColumn("__at", F.explode(F.array(*[F.col("__bin") + i for i in range(3)])))
    in_bin = Window.partitionBy(key, "__at").orderBy("ts_ms").rangeBetween(-width_ms, 0)
    counted = spread.withColumn("failures", F.count("*").over(in_bin))
    step = Window.partitionBy(key, "__at").orderBy("ts_ms", "id")
    nth = F.lag("ts_ms", n - 1).over(step)
    reached = F.coalesce(F.col("ts_ms") - nth <= width_ms, F.lit(False))
    counted = counted.withColumn("__reached", reached)
    before = F.coalesce(F.lag("__reached").over(step), F.lit(False))
    flagged = counted.withColumn("tripped", F.col("__reached") & ~before)
    return flagged.filter("__at = __bin").select(key, "id", "ts_ms", "failures", "tripped")


def trailing_failure_rate(df: DataFrame, key: str, n: int = RATE_WINDOW, ranges: int | None = None) -> DataFrame:
    """Failure share of the last ``n`` rows per key, and the length of the run the row ends.

    The frame reaches into earlier ranges of the key through carried rows; run lengths come from the running
    row number and the number at which the run began.  Rows without a key are left out, those without a time come first.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, "id", "ts_ms", F.when(F.col("status") == "failed", 1).otherwise(0).alias("bad"))
    order = ["ts_ms", "id"]
    rows = in_ranges(rows, [key], order, ranges)
    carried = with_carry(rows, [key], order, BLOCK, ["bad"], n - 1)
    w = Window.partitionBy(key, BLOCK).orderBy(*order)
    frame = w.rowsBetween(-(n - 1), 0)
    rated = (
        carried.withColumn("window_rows", F.count("*").over(frame))
        .withColumn("failure_rate", F.avg("bad").over(frame))
        .withColumn("__prev", F.lag("bad").over(w))
        .filter(~F.col(CARRY))
        .drop(CARRY)
    )
    numbered = running(rated, [key], order, BLOCK, {"__no": ("sum", F.lit(1).cast("long"))})
    begins = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("bad")), F.col("__no"))
    runs = running(numbered, [key], order, BLOCK, {"__from": ("max", begins)})
    length = F.col("__no") - F.col("__from") + 1
    return runs.select(
        key, "id", "ts_ms", "window_rows", "failure_rate",
        F.when(F.col("bad") == 1, length).otherwise(0).alias("failure_run"),
        F.when(F.col("bad") == 0, length).otherwise(0).alias("success_run"),
    )


def counter_rate(df: DataFrame, key: str, counter: str, ranges: int | None = None) -> DataFrame:
    """Growth of a counter per elapsed millisecond in percent, within 0 and 100."""
    rows = in_ranges(df, [key], ["ts_ms", "id"], ranges)
    rows = lag_in_blocks(rows, [key], ["ts_ms", "id"], BLOCK, {"__t": ("ts_ms", 1), "__c": (counter, 1)})
    dt = F.col("ts_ms") - F.col("__t")
    rate = F.when(dt > 0, (F.col(counter) - F.col("__c")) / dt * 100).otherwise(F.lit(0.0))
    return rows.withColumn("rate", F.greatest(F.lit(0.0), F.least(F.lit(100.0), rate))).drop("__t", "__c", BLOCK)


def order_evidence(evidence: DataFrame, shown: DataFrame, n: int = MAX_EVIDENCE) -> DataFrame:
    """Captures of the shown nodes first, then the newest; at most ``n`` per query."""
    linked = shown.select("query_id", "screenshot_id").distinct().withColumn("__linked", F.lit(1))
    rows = evidence.join(linked, ["query_id", "screenshot_id"], "left").withColumn(
        "linked", F.coalesce("__linked", F.lit(0))
    )
    order = [F.col("linked").desc(), F.col("ts_ms").desc(), F.col("screenshot_id")]
    return top_n(rows.drop("__linked"), ["query_id"], order, n)


def latest_summary_threads(summaries: DataFrame, nodes: DataFrame, events: DataFrame, width_ms: int) -> DataFrame:
    """Threads of the summary that succeeded last: those with a node in its window or an event of it."""
    latest = summaries.filter("status = 'succeeded'").orderBy(F.col("updated_ms").desc(), F.col("summary_id").desc())
    latest = F.broadcast(latest.limit(1).select("summary_id", "window_start"))  # one row
    start = time_block("ts_ms", width_ms) * width_ms
    a = nodes.select("thread_id", start.alias("window_start")).join(latest, "window_start")
    b = events.select("thread_id", "summary_id").join(latest, "summary_id")
    both = a.select("summary_id", "thread_id").unionByName(b.select("summary_id", "thread_id"))
    return both.filter("thread_id IS NOT NULL").distinct()


def list_threads(threads: DataFrame, limit: int = 50) -> DataFrame:
    return threads.filter("status <> 'closed'").orderBy(F.col("last_active_ms").desc(), "thread_id").limit(limit)


def timeline(summaries: DataFrame, events: DataFrame, lo: int, hi: int) -> DataFrame:
    """Windows that touch the range and events that overlap it, newest first."""
    a = summaries.filter((F.col("window_start") <= hi) & (F.col("window_end") >= lo)).select(
        F.lit("window").alias("row"), F.col("window_start").alias("start_ms"), F.col("window_end").alias("end_ms"),
        F.lit(None).cast("string").alias("key"),
    )
    b = events.filter((F.col("start_ms") < hi) & (F.col("end_ms") > lo)).select(
        F.lit("event").alias("row"), "start_ms", "end_ms", F.col("event_key").alias("key")
    )
    return a.unionByName(b).orderBy(F.col("row").desc(), F.col("start_ms").desc(), "key")


def recent_errors(usage: DataFrame, now_ms: int, limit: int = 50, width_ms: int = HOUR_MS) -> DataFrame:
    """Newest failures of the last hour, returned oldest first."""
    failed = within(usage, now_ms - width_ms, now_ms).filter("status = 'failed'")
    return failed.orderBy(F.col("ts_ms").desc(), F.col("id").desc()).limit(limit).orderBy("ts_ms", "id")


def app_list(sources: DataFrame, system: DataFrame, aliases: DataFrame) -> DataFrame:
    """Named sources that are no system window, by name."""
    named = sources.filter(F.trim("name") != "")
    return drop_system_windows(named, system, aliases).orderBy("name", "source_id")


def answer_pool(ranked: DataFrame, budget: int = ANSWER_BUDGET) -> DataFrame:
    """Rows that ``select_for_answer`` could possibly take: a bounded number per query.

    Each stage skips only rows taken before it, so it can reach no further down its own order
    than its cap plus what was taken before.
    """
    q = ["query_id"]
    rank = [F.col("rn")]
    events = ranked.filter((F.col("kind") == "event") & (F.col("entity_boost") > 0))
    pinned = top_n(events, q, [F.col("ts_ms").desc(), F.col("rn")], PINNED_CAP, "__p")
    hinted = top_n(ranked.filter(F.col("kind") == F.col("kind_hint")), q, rank, PINNED_CAP + HINTED_CAP, "__p")
    chosen = pinned.unionByName(hinted).filter("thread_id IS NOT NULL").select("query_id", "thread_id").distinct()
    of_threads = ranked.join(chosen, ["query_id", "thread_id"], "left_semi")
    taken = PINNED_CAP + HINTED_CAP
    threads = top_n(of_threads, ["query_id", "thread_id"], rank, taken + PER_THREAD, "__p")
    slot = time_bucket(F.col("ts_ms"), F.col("from_ms"), F.col("to_ms"), DIVERSITY_CAP)
    slotted = ranked.withColumn("__slot", slot).filter("__slot IS NOT NULL")
    slots = top_n(slotted, ["query_id", "__slot"], rank, taken + THREAD_CAP + DIVERSITY_CAP, "__p").drop("__slot")
    per_app = top_n(ranked.filter("app_hint <> ''"), ["query_id", "app_hint"], rank, 1, "__p")
    apps = top_n(per_app.drop("__p"), q, rank, budget + DIVERSITY_CAP, "__p")
    fill = top_n(ranked, q, rank, 2 * budget, "__p")
    pool = pinned
    for part in (hinted, threads, slots, apps, fill):
        pool = pool.unionByName(part)
    return pool.drop("__p").dropDuplicates(["query_id", "id"])


def answer_caps(budget: int) -> tuple[int, int, int, int]:
    """Rows for entity events, the hinted kind, their threads, and variety: each of what the budget leaves."""
    caps, left = [], budget
    for most in (PINNED_CAP, HINTED_CAP, THREAD_CAP, DIVERSITY_CAP):
        caps.append(min(most, left))
        left -= caps[-1]
    return tuple(caps)


def _stage(pool: DataFrame, name: str, fits: Column, order: list[Column], most: Column | int) -> DataFrame:
    """Give the first ``most`` rows without a stage, among those that fit, this stage and the next positions."""
    query = Window.partitionBy("query_id")
    free = F.col("stage").isNull() & F.coalesce(fits, F.lit(False))
    rank = F.row_number().over(Window.partitionBy("query_id", "__free").orderBy(*order))
    taken = F.count("stage").over(query)
    ranked = pool.withColumn("__free", free).withColumns({"__rank": rank, "__taken": taken})
    place = F.col("__taken") + F.col("__rank")
    now = F.col("__free") & (F.col("__rank") <= most) & (place <= F.col("budget"))
    marked = {"position": F.when(now, place).otherwise(F.col("position")), "stage": F.when(now, F.lit(name)).otherwise(F.col("stage"))}
    return ranked.withColumns(marked).drop("__free", "__rank", "__taken")


def _first_free(group: list[str]) -> Column:
    """Whether a row is the best one without a stage in its group."""
    mine = Window.partitionBy("query_id", *group)
    return F.col("rn") == F.min(F.when(F.col("stage").isNull(), F.col("rn"))).over(mine)


def select_for_answer(ranked: DataFrame, budget: int = ANSWER_BUDGET) -> DataFrame:
    """Up to ``budget`` ranked rows per query, chosen in stages, with position and stage.

    Stages: events that match an entity, the hinted kind, threads of those (latest thread first, three
    rows each), one row per time slice, apps not seen yet, then rank order.  The pool per query is
    bounded beforehand; each stage is a ranked take from the rows that have none yet.
    """
    pinned, hinted, threads, varied = answer_caps(budget)
    slot = time_bucket(F.col("ts_ms"), F.col("from_ms"), F.col("to_ms"), max(1, varied))
    cols = ["query_id", "id", "rn", "kind", "kind_hint", "entity_boost", "ts_ms", "thread_id", "app_hint"]
    none = {"budget": F.lit(budget), "stage": F.lit(None).cast("string"), "position": F.lit(None).cast("long")}
    pool = answer_pool(ranked, budget).select(*cols, slot.alias("slot")).withColumns(none)
    best = [F.col("rn")]
    pool = _stage(pool, "entity", (F.col("kind") == "event") & (F.col("entity_boost") > 0), [F.col("ts_ms").desc_nulls_last(), *best], pinned)
    pool = _stage(pool, "kind", F.col("kind") == F.col("kind_hint"), best, hinted)

    thread = Window.partitionBy("query_id", "thread_id")
    begun = F.col("stage").isNotNull() & (F.col("thread_id") != "")
    latest, found = F.max(F.when(begun, F.col("ts_ms"))).over(thread), F.min(F.when(begun, F.col("position"))).over(thread)
    within = F.row_number().over(Window.partitionBy("query_id", "thread_id", F.col("stage").isNull()).orderBy("rn"))
    pool = pool.withColumns({"__latest": latest, "__found": found, "__within": within})
    of_thread = F.col("__found").isNotNull() & (F.col("__within") <= PER_THREAD)
    pool = _stage(pool, "thread", of_thread, [F.col("__latest").desc_nulls_last(), F.col("__found"), *best], threads).drop("__latest", "__found", "__within")

    if varied:
        pool = pool.withColumn("__first", F.col("slot").isNotNull() & _first_free(["slot"]))
        pool = _stage(pool, "time", F.col("__first"), best, varied).drop("__first")
        seen = F.max(F.col("stage").isNotNull().cast("int")).over(Window.partitionBy("query_id", "app_hint")) == 1
        pool = pool.withColumn("__first", (F.col("app_hint") != "") & ~seen & _first_free(["app_hint"]))
        pool = _stage(pool, "app", F.col("__first"), best, varied).drop("__first")
    pool = _stage(pool, "fill", F.lit(True), best, budget)
    return pool.where("stage IS NOT NULL").select("query_id", "id", F.col("position").cast("int").alias("position"), "stage")

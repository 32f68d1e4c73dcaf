"""Counts, rollups and per-thread or per-window summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrail.functions.keys import health_level
from worktrail.functions.normalize import real_app_hint
from worktrail.functions.text import strip
from worktrail.operators.blocks import HOUR_MS, time_block, top_n
from worktrail.operators.filters import within

# Fixed values.
GAP_MS = 10 * 60_000
RECENT_NODES = 50
KEY_ENTITIES, THREAD_APPS, WINDOW_TOP = 20, 20, 5
LONG_EVENT_MS = 25 * 60_000
CAPABILITIES = ["vlm", "text", "embedding"]
BACKLOG_WARNING, BACKLOG_CRITICAL = 50, 200
WINDOW_MS = 20 * 60_000


def ordered_list(rank: str, value: Column) -> Column:
    """Values of a small ranked group as an array in rank order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), value.alias("v")))), lambda s: s["v"])


def queue_status(queues: dict[str, DataFrame]) -> DataFrame:
    """Pending, running and failed rows per queue; each frame has one ``status`` column.

    Each frame is counted before the union, so only one row per queue and status moves.
    """
    parts = [
        df.filter(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("n")).withColumn("queue", F.lit(q))
        for q, df in queues.items()
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    of = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0))
    counted = union.groupBy("queue").agg(
        of("pending").alias("pending"), of("running").alias("running"), of("failed", "failed_permanent").alias("failed")
    )
    return counted


def total_backlog(status: DataFrame, warning: int = BACKLOG_WARNING, critical: int = BACKLOG_CRITICAL) -> DataFrame:
    total = status.agg(F.coalesce(F.sum(F.col("pending") + F.col("running")), F.lit(0)).alias("backlog"))
    return total.withColumn("level", health_level(F.col("backlog"), warning, critical))


def _usage(usage: DataFrame, lo: int, hi: int, config_hash: str | None) -> DataFrame:
    kept = within(usage, lo, hi)
    return kept if config_hash is None else kept.filter(F.col("config_hash") == config_hash)


def usage_summary(usage: DataFrame, lo: int, hi: int, config_hash: str | None = None) -> DataFrame:
    """Tokens and requests in a closed range."""
    return _usage(usage, lo, hi, config_hash).agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def usage_by_model(usage: DataFrame, lo: int, hi: int, config_hash: str | None = None) -> DataFrame:
    return (
        _usage(usage, lo, hi, config_hash)
        .groupBy("model", "capability")
        .agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.count("*").alias("requests"))
        .orderBy(F.col("total_tokens").desc(), "model", "capability")
    )


def usage_daily(usage: DataFrame, lo: int, hi: int, tz: str = "UTC", config_hash: str | None = None) -> DataFrame:
    """Tokens and requests per local calendar day."""
    day = F.to_date(F.from_utc_timestamp("ts", tz))
    return (
        _usage(usage, lo, hi, config_hash)
        .groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"))
        .agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.count("*").alias("requests"))
        .orderBy("day")
    )


def usage_rollup(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """The daily rollup table: one row per day, model and capability."""
    day = F.date_format(F.from_utc_timestamp("ts", tz), "yyyy-MM-dd")
    return usage.groupBy(day.alias("day"), "model", "capability").agg(
        F.count_if(F.col("status") == "succeeded").alias("request_count_succeeded"),
        F.count_if(F.col("status") == "failed").alias("request_count_failed"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens_sum"),
    )


def error_rate(usage: DataFrame, now_ms: int, widths: dict[str, int], capabilities: Sequence[str] = tuple(CAPABILITIES)) -> DataFrame:
    """Failures per capability in trailing windows that end now; every capability has a column."""
    widest = max(widths.values())
    failed = within(usage, now_ms - widest, now_ms).filter("status = 'failed'")
    return failed.agg(
        *[
            F.count_if((F.col("ts_ms") >= now_ms - w) & (F.col("capability") == c)).alias(f"{name}_{c}")
            for name, w in widths.items()
            for c in capabilities
        ]
    )


def top_errors(usage: DataFrame, now_ms: int, n: int = 10, width_ms: int = HOUR_MS) -> DataFrame:
    """Most frequent error codes of the last hour; no code counts as ``unknown``."""
    return (
        within(usage, now_ms - width_ms, now_ms)
        .filter("status = 'failed'")
        .groupBy(F.coalesce("error_code", F.lit("unknown")).alias("error_code"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "error_code")
        .limit(n)
    )


def gap_duration(df: DataFrame, key: str, ts_ms: str = "ts_ms", gap_ms: int = GAP_MS, block_ms: int = HOUR_MS) -> DataFrame:
    """Start, end, row count and gap-limited duration per key.

    The duration adds the steps between consecutive rows that are above zero and at most
    ``gap_ms``.  Rows of one time are counted first, so a block holds at most one row per millisecond.
    Steps inside a ``(key, block)`` group are added there; the steps across block borders come from the
    blocks' first and last times.
    """
    times = df.filter(F.col(key).isNotNull()).groupBy(key, F.col(ts_ms).alias("t")).agg(F.count("*").alias("same"))
    rows = times.withColumn("__block", time_block("t", block_ms))
    inside = Window.partitionBy(key, "__block").orderBy("t")
    counted = lambda d: F.when((d > 0) & (d <= gap_ms), d).otherwise(F.lit(0))
    blocks = (
        rows.withColumn("d", F.col("t") - F.lag("t").over(inside))
        .groupBy(key, "__block")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("same").alias("n"), F.sum(counted(F.col("d"))).alias("dur"))
    )
    across = Window.partitionBy(key).orderBy("__block")
    step = F.col("lo") - F.lag("hi").over(across)
    return (
        blocks.withColumn("step", counted(step))
        .groupBy(key)
        .agg(
            F.min("lo").alias("start_ms"),
            F.max("hi").alias("last_active_ms"),
            F.sum("n").alias("node_count"),
            F.sum(F.col("dur") + F.col("step")).alias("duration_ms"),
        )
    )


def thread_rollup(nodes: DataFrame, key: str = "thread_id", gap_ms: int = GAP_MS, block_ms: int = HOUR_MS) -> DataFrame:
    """Start, last activity, node count and gap-limited duration over all nodes of a thread."""
    return gap_duration(nodes, key, "ts_ms", gap_ms, block_ms)


def recent_nodes(nodes: DataFrame, n: int = RECENT_NODES, key: str = "thread_id") -> DataFrame:
    """The newest ``n`` nodes per thread, numbered from the newest."""
    return top_n(nodes.filter(F.col(key).isNotNull()), [key], [F.col("ts_ms").desc(), F.col("id").desc()], n, "recency")


def main_project(nodes: DataFrame, recent: int = RECENT_NODES) -> DataFrame:
    """Most frequent project key of the newest nodes; ties in binary order."""
    counts = (
        recent_nodes(nodes.select("thread_id", "id", "ts_ms", "project_key"), recent)
        .filter(strip("project_key") != "")
        .groupBy("thread_id", strip("project_key").alias("main_project"))
        .agg(F.count("*").alias("n"))
    )
    return top_n(counts, ["thread_id"], [F.col("n").desc(), F.col("main_project")], 1).drop("rn", "n")


def key_entities(nodes: DataFrame, recent: int = RECENT_NODES, n: int = KEY_ENTITIES) -> DataFrame:
    """Most frequent entities of the newest nodes, each once per node; ties in binary order."""
    rows = recent_nodes(nodes.select("thread_id", "id", "ts_ms", "names"), recent)
    counts = (
        rows.select("thread_id", F.explode(F.array_distinct("names")).alias("name"))
        .groupBy("thread_id", "name")
        .agg(F.count("*").alias("n"))
    )
    ranked = top_n(counts, ["thread_id"], [F.col("n").desc(), F.col("name")], n)
    return ranked.groupBy("thread_id").agg(ordered_list("rn", F.col("name")).alias("key_entities"))


def thread_apps(nodes: DataFrame, recent: int = RECENT_NODES, n: int = THREAD_APPS) -> DataFrame:
    """Distinct app hints of the newest nodes, in the order they first appear from the newest on."""
    seen = (
        recent_nodes(nodes.select("thread_id", "id", "ts_ms", "app_hint"), recent)
        .filter(strip("app_hint") != "")
        .groupBy("thread_id", strip("app_hint").alias("app"))
        .agg(F.min("recency").alias("first"))
    )
    ranked = top_n(seen, ["thread_id"], [F.col("first")], n)
    return ranked.groupBy("thread_id").agg(ordered_list("rn", F.col("app")).alias("apps"))


def _top_names(rows: DataFrame, keys: Sequence[str], name: str, top: int, out: str) -> DataFrame:
    """Most frequent names per key; ties by first appearance in time, then name."""
    counts = rows.groupBy(*keys, name).agg(F.count("*").alias("n"), F.min(F.struct("ts_ms", "id")).alias("first"))
    ranked = top_n(counts, keys, [F.col("n").desc(), F.col("first"), F.col(name)], top)
    return ranked.groupBy(*keys).agg(ordered_list("rn", F.col(name)).alias(out))


def window_stats(nodes: DataFrame, width_ms: int = WINDOW_MS, top: int = WINDOW_TOP) -> DataFrame:
    """Activity window statistics: node count, distinct threads, top apps and top entities."""
    start = (time_block("ts_ms", width_ms) * width_ms).alias("window_start")
    counts = nodes.groupBy(start).agg(F.count("*").alias("node_count"), F.count_distinct("thread_id").alias("thread_count"))
    apps = nodes.select(start, real_app_hint("app_hint").alias("app"), "ts_ms", "id").filter("app IS NOT NULL")
    names = nodes.select(start, "ts_ms", "id", F.explode("entities").alias("name")).filter("name <> ''")
    out = counts.join(_top_names(apps, ["window_start"], "app", top, "top_apps"), "window_start", "left").join(
        _top_names(names, ["window_start"], "name", top, "top_entities"), "window_start", "left"
    )
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("top_apps", "top_entities")})


def result_summary(results: DataFrame, evidence: DataFrame, top_apps: int = 5, top_entities: int = 10) -> DataFrame:
    """Per query: time span over nodes and evidence, top apps, first distinct entities, kind counts.

    ``results`` has ``query_id, id, rn, ts_ms, kind, entities``; ``evidence`` has
    ``query_id, screenshot_id, rn, ts_ms, app_hint``.
    """
    times = results.select("query_id", "ts_ms").unionByName(evidence.select("query_id", "ts_ms"))
    span = times.groupBy("query_id").agg(F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms"))
    kinds = results.groupBy("query_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("event", "knowledge", "state_snapshot")]
    )
    app_counts = (
        evidence.filter(F.col("app_hint") != "")
        .groupBy("query_id", "app_hint")
        .agg(F.count("*").alias("n"), F.min("rn").alias("first"))
    )
    apps = top_n(app_counts, ["query_id"], [F.col("n").desc(), F.col("first")], top_apps, "rk")
    label = F.concat("app_hint", F.lit(":"), F.col("n").cast("string"))
    apps = apps.groupBy("query_id").agg(ordered_list("rk", label).alias("top_apps"))
    seen = (
        results.select("query_id", "rn", F.posexplode("entities").alias("pos", "name"))
        .groupBy("query_id", "name")
        .agg(F.min(F.struct("rn", "pos")).alias("first"))
    )
    names = top_n(seen, ["query_id"], [F.col("first")], top_entities, "rk")
    names = names.groupBy("query_id").agg(ordered_list("rk", F.col("name")).alias("top_entities"))
    empty = F.array().cast("array<string>")
    out = span.join(kinds, "query_id", "left").join(apps, "query_id", "left").join(names, "query_id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("top_apps", "top_entities")})


def long_threads(nodes: DataFrame, keys: Sequence[str] = ("window_start", "thread_id"), min_ms: int = LONG_EVENT_MS) -> DataFrame:
    """Threads of a window whose last snapshot says they have run for at least 25 minutes."""
    at = F.struct("ts_ms", "id")
    latest = nodes.filter(F.col("thread_id").isNotNull()).groupBy(*keys).agg(
        F.max_by("snapshot", F.when(F.col("snapshot").isNotNull(), at)).alias("snapshot"),
        F.max("ts_ms").alias("last_active_ms"),
        F.count("*").alias("node_count"),
    )
    return latest.filter(F.col("snapshot.duration_ms") >= min_ms)


def vector_dims(vectors: DataFrame, expected: int | None = None) -> DataFrame:
    """Rows per vector dimension, and whether it is the wrong one.

    Without an expected dimension the most frequent one counts as right.
    """
    counts = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    # one row per dimension that occurs: small enough for one window
    usual = F.max_by("dim", F.struct("n", (-F.col("dim")).alias("neg"))).over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("mismatch", F.col("dim") != (usual if expected is None else F.lit(expected)))


def latency_percentiles(
    df: DataFrame, ts_ms: str, value: str, width_ms: int, ps: Sequence[float] = (0.5, 0.95), accuracy: int = 10_000
) -> DataFrame:
    """Exact percentiles (nearest rank) per interval, in two passes over the values.

    A mergeable sketch, whose rank is off by one part in ``accuracy`` at most, first gives each percentile a range
    of values that holds it.  Then values inside a range are counted one by one and those between ranges as one
    group, so what is put in order is about ``4 / accuracy`` of an interval's values per percentile, wherever
    they lie.  A range that missed its percentile would be an error, not a wrong number.  Null values do not count.
    """
    start = (time_block(ts_ms, width_ms) * width_ms).alias("window_start")
    rows = df.filter(F.col(value).isNotNull()).select(start, F.col(value).alias("v"))
    slack = 2 / accuracy
    ends = lambda p: F.percentile_approx("v", [max(p - slack, 0.0), min(p + slack, 1.0)], accuracy)
    ranges = rows.groupBy("window_start").agg(F.count("*").alias("total"), *[ends(p).alias(f"__r{i}") for i, p in enumerate(ps)])
    low, high = ([F.col(f"__r{i}")[j] for i in range(len(ps))] for j in (0, 1))
    inside, passed = F.lit(False), F.lit(0)
    for lo, hi in zip(low, high):
        inside, passed = inside | F.col("v").between(lo, hi), passed + (F.col("v") > hi).cast("int") + (F.col("v") >= lo).cast("int")
    # one group per value inside a range, one per gap between ranges
    cells = rows.join(ranges, "window_start").select("window_start", "total", "v", inside.alias("inside"), passed.alias("__gap"))
    counts = cells.groupBy("window_start", "inside", "__gap", F.when(F.col("inside"), F.col("v")).alias("__v")).agg(
        F.max("v").alias("v"), F.count("*").alias("n"), F.first("total").alias("total")
    )
    ranked = counts.withColumn("cum", F.sum("n").over(Window.partitionBy("window_start").orderBy("v")))
    at = lambda p: F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * F.lit(p)), F.struct("v", "inside")))
    found = ranked.groupBy("window_start").agg(F.max("total").alias("n"), *[at(p).alias(f"__p{i}") for i, p in enumerate(ps)])
    missed = F.raise_error(F.lit("a percentile lies outside its range: raise the accuracy"))
    cell = lambda i: F.when(F.col(f"__p{i}.inside"), F.col(f"__p{i}.v")).otherwise(missed)
    return found.select("window_start", "n", *[cell(i).alias(f"p{round(p * 100)}") for i, p in enumerate(ps)])


def merge_events(events: DataFrame, min_ms: int = LONG_EVENT_MS) -> DataFrame:
    """One row per event key from rows in order of ``seq``.

    Widest interval, length and long flag recomputed; title and kind of the last row;
    thread, summary and scores of the last row that has them; node ids in first-seen order.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    base = events.groupBy("event_key").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.max_by("title", "seq").alias("title"),
        F.max_by("kind", "seq").alias("kind"),
        last("thread_id"), last("summary_id"), last("confidence"), last("importance"),
    )
    members = (
        events.select("event_key", "seq", F.posexplode("node_ids").alias("pos", "node_id"))
        .groupBy("event_key", "node_id")
        .agg(F.min(F.struct("seq", "pos")).alias("first"))
        .groupBy("event_key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "node_id"))), lambda s: s["node_id"]).alias("node_ids"))
    )
    length = F.col("end_ms") - F.col("start_ms")
    return (
        base.join(members, "event_key", "left")
        .withColumn("node_ids", F.coalesce("node_ids", F.array().cast("array<bigint>")))
        .withColumn("duration_ms", length)
        .withColumn("is_long", length >= min_ms)
    )


def latest_activity(summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Time of the latest activity and where it comes from: a summary if there is one, else a node."""
    a = summaries.agg(F.max("window_end").alias("v")).withColumn("source", F.lit("summary"))
    b = nodes.agg(F.max("ts_ms").alias("v")).withColumn("source", F.lit("node"))
    both = a.unionByName(b).agg(
        F.max(F.when(F.col("source") == "summary", F.col("v"))).alias("s"),
        F.max(F.when(F.col("source") == "node", F.col("v"))).alias("n"),
    )
    label = F.when(F.col("s").isNotNull(), "summary").when(F.col("n").isNotNull(), "node")
    return both.select(F.coalesce("s", "n").alias("latest_ms"), label.alias("source"))


def call_stats(traces: DataFrame) -> DataFrame:
    """Calls, rounded mean latency and errors per capability."""
    return traces.groupBy("capability").agg(
        F.count("*").alias("calls"),
        F.floor(F.avg("duration_ms") + 0.5).cast("long").alias("mean_ms"),
        F.count_if(F.col("status") == "failed").alias("errors"),
    )


def log_levels(logs: DataFrame) -> DataFrame:
    """Lines and share per level."""
    counts = logs.groupBy("level").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per level
    return counts.select("level", "n", F.round(F.col("n") * 100.0 / total, 1).alias("percent"))


def log_modules(logs: DataFrame, n: int = 5) -> DataFrame:
    return logs.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "module").limit(n)


def log_recent(logs: DataFrame, levels: Sequence[str], n: int = 10) -> DataFrame:
    """The last ``n`` lines of the given levels, newest first."""
    return logs.filter(F.col("level").isin(list(levels))).orderBy(F.col("line_ts").desc(), F.col("message")).limit(n)

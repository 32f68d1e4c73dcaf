"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrail.functions.keys import minute_of_day
from worktrail.functions.text import strip, tokens
from worktrail.operators.match import ascii_lower, canonical_app, substring_join

# Fixed values.
MAX_ATTEMPTS = 2
RETENTION_MS = 24 * 3_600_000
OCR_LANGUAGES = ["en", "zh"]
OCR_DONE = ["succeeded", "failed_permanent"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def active_only(captures: DataFrame, active: DataFrame) -> DataFrame:
    """Captures whose source is in the active list."""
    return captures.join(active.select("source_key").distinct(), "source_key", "left_semi")


def drop_system_windows(sources: DataFrame, system: DataFrame, aliases: DataFrame) -> DataFrame:
    """Windows named like a system window, raw or canonical, go; screens stay."""
    names = system.select(F.lower("name").alias("__sys")).distinct()
    named = canonical_app(sources, "name", aliases, out="__app")
    raw = named.join(names, (F.col("type") == "window") & (F.lower("name") == F.col("__sys")), "left_anti")
    return raw.join(names, (F.col("type") == "window") & (F.lower("__app") == F.col("__sys")), "left_anti").drop("__app")


def in_range(ts: str | Column, lo: Column, hi: Column) -> Column:
    """Closed range, as searches use it."""
    return _c(ts).between(lo, hi)


def in_window(ts: str | Column, lo: Column, hi: Column) -> Column:
    """Half-open range, as windows use it."""
    return (_c(ts) >= lo) & (_c(ts) < hi)


def within(
    df: DataFrame, lo: int | None = None, hi: int | None = None, ts_ms: str = "ts_ms", ts: str = "ts", closed: bool = True
) -> DataFrame:
    """Rows whose milliseconds lie in a range; ``hi`` counts as inside if ``closed``, and either end may be open.

    Where the table also stores the time itself (``ts``, of which ``ts_ms`` is the millisecond), the same
    bounds are put on that column too: a scan can skip files, row groups and days by it, but not by an expression.
    Rows without a time go, as in any comparison.
    """
    end = hi + 1 if hi is not None and closed else hi
    for c, at in ((ts_ms, lambda ms: F.lit(ms)), (ts, lambda ms: F.timestamp_millis(F.lit(ms)))):
        if c not in df.columns:
            continue
        if lo is not None:
            df = df.filter(F.col(c) >= at(lo))
        if end is not None:
            df = df.filter(F.col(c) < at(end))
    return df


def overlaps(start: Column, end: Column, lo: Column, hi: Column, closed: bool) -> Column:
    """Interval overlap: touching ends count for timeline windows, not for events."""
    return (start <= hi) & (end >= lo) if closed else (start < hi) & (end > lo)


def in_thread(thread: str | Column, wanted: Column) -> Column:
    return _c(thread) == wanted


def names_match(entities: Column, wanted: Column) -> Column:
    """Whether an entity name equals, contains or has as a token the wanted text, case-folded."""

    def one(name: Column) -> Column:
        low = F.lower(strip(name))
        return (wanted != "") & (F.contains(low, wanted) | F.array_contains(tokens(low), wanted))

    return F.coalesce(F.exists(entities, one), F.lit(False))


def entity_match(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs ``(id, query_id)`` where a node entity matches a wanted entity of the query.

    A token is a substring of its name, so equality, containment and token equality all
    reduce to containment, and distinct names meet distinct wanted texts once.
    """
    folded = F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.lower(strip(e)))
    # a set of names per node, and queries per set: pairs are made last, once each, and never shuffled
    named = nodes.groupBy("id").agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(folded))))).alias("__set"))
    wanted = queries.select("query_id", F.explode("entities").alias("__e")).select(
        "query_id", F.lower(strip("__e")).alias("want")
    )
    sets = named.select("__set").distinct()
    in_set = sets.select("__set", F.explode("__set").alias("name"))
    names = in_set.select(F.col("name").alias("nid"), "name").distinct()
    wants = wanted.filter("want <> ''").select("want").distinct().select(F.col("want").alias("wid"), "want")
    pairs = substring_join(names, "nid", "name", wants, "wid", "want")
    asked = pairs.join(wanted, F.col("wid") == F.col("want")).select(F.col("nid").alias("name"), "query_id").distinct()
    of_set = in_set.join(asked, "name").groupBy("__set").agg(F.collect_set(F.struct("query_id")).alias("__queries"))
    return named.join(of_set, "__set").select("id", F.inline("__queries"))


def keyword_hits(nodes: DataFrame, node_id: str, cols: Sequence[str], terms: DataFrame, repeated: bool = False) -> DataFrame:
    """Pairs ``(node_id, query_id)``: any term of the query is LIKE-contained in any of the columns.

    ``terms`` has ``query_id`` and ``term``; ``%`` and ``_`` in a term stay wildcards.  With ``repeated`` (columns of
    labels, whose values recur) each distinct value is searched once and brings its queries to its nodes.
    """
    folded = terms.select("query_id", ascii_lower(F.col("term")).alias("term")).filter("term <> ''").distinct()
    distinct = folded.select("term").distinct().select(F.col("term").alias("tid"), "term")
    columns = F.array(*[ascii_lower(F.col(c)) for c in cols])
    texts = nodes.select(F.col(node_id), F.posexplode(columns).alias("__pos", "__text")).filter("__text IS NOT NULL")
    if repeated:
        values = texts.select(F.col("__text").alias("__value")).distinct().withColumn("__text", F.col("__value"))
        pairs = substring_join(values, "__value", "__text", distinct, "tid", "term", wildcards=True)
        asked = pairs.join(folded, F.col("tid") == F.col("term")).select(F.col("__value").alias("__text"), "query_id").distinct()
        return texts.join(asked, "__text").select(node_id, "query_id").distinct()
    cells = texts.select(F.struct(node_id, "__pos").alias("__cell"), "__text")
    pairs = substring_join(cells, "__cell", "__text", distinct, "tid", "term", wildcards=True)
    # made distinct once, as two ids: terms are texts, and all hits by term would fill a task's memory
    pairs = pairs.select(F.col(f"__cell.{node_id}").alias(node_id), "tid")
    return pairs.join(folded, F.col("tid") == F.col("term")).select(node_id, "query_id").distinct()


def minute_of(ts: Column, tz: str = "UTC") -> Column:
    local = F.from_utc_timestamp(ts, tz)
    return F.hour(local) * 60 + F.minute(local)


def capture_allowed(ts: Column, windows: Column, override: Column | None = None, tz: str = "UTC") -> Column:
    """Whether capture is allowed: inside a window (both ends count, no midnight wrap).

    ``windows`` is an array of ``{start, end}`` in ``HH:MM``; null means no schedule.
    ``force_on`` and ``force_off`` win over it.
    """
    now = minute_of(ts, tz)

    def inside(w: Column) -> Column:
        a, b = minute_of_day(w["start"]), minute_of_day(w["end"])
        return F.coalesce((b > a) & now.between(a, b), F.lit(False))

    allowed = F.when(windows.isNull(), True).otherwise(F.exists(windows, inside))
    if override is None:
        return allowed
    return F.when(override == "force_on", True).when(override == "force_off", False).otherwise(allowed)


def in_dnd(ts: Column, start: Column, end: Column, tz: str = "UTC") -> Column:
    """Do-not-disturb: equal ends mean always; a start after the end wraps midnight; the end is out."""
    now, a, b = minute_of(ts, tz), minute_of_day(start), minute_of_day(end)
    inside = F.when(a == b, True).when(a < b, (now >= a) & (now < b)).otherwise((now >= a) | (now < b))
    return F.when(a.isNull() | b.isNull(), False).otherwise(inside)


def eligible(
    status: Column, attempts: Column, due: Column, now: Column, upstream: Column | None = None, payload: Column | None = None
) -> Column:
    """Work that may run now: open, attempts left, due, its input done and its payload there."""
    ok = status.isin("pending", "failed") & (attempts < MAX_ATTEMPTS) & (due.isNull() | (due <= now))
    if upstream is not None:
        ok = ok & F.coalesce(upstream == "succeeded", F.lit(False))
    if payload is not None:
        ok = ok & payload.isNotNull()
    return F.coalesce(ok, F.lit(False))


def needs_ocr(knowledge: Column, language: Column, file_path: Column, storage_state: Column) -> Column:
    return F.coalesce(
        knowledge.isNotNull() & language.isin(OCR_LANGUAGES) & file_path.isNotNull() & (storage_state != "deleted"),
        F.lit(False),
    )


def retention_candidates(captures: DataFrame, batches: DataFrame, now_ms: int, age_ms: int = RETENTION_MS) -> DataFrame:
    """Captures whose file may go: ephemeral, old, still there, fully processed."""
    old = within(captures, hi=now_ms - age_ms, closed=False).filter(
        (F.col("storage_state") == "ephemeral")
        & F.col("file_path").isNotNull()
        & (F.col("ocr_status").isNull() | F.col("ocr_status").isin(OCR_DONE))
    )
    done = batches.filter(F.col("vlm_status") == "succeeded").select("batch_id")
    return old.join(done, "batch_id")


def notify_gate(ts: Column, kind: Column, prefs: Column, tz: str = "UTC") -> Column:
    """Whether a notification may show: switched on, its type switched on, not in do-not-disturb.

    ``prefs`` is ``{enabled, dnd_enabled, dnd_from, dnd_to, types: map<string, boolean>}``.
    """
    quiet = F.coalesce(prefs["dnd_enabled"], F.lit(False)) & in_dnd(ts, prefs["dnd_from"], prefs["dnd_to"], tz)
    typed = F.coalesce(prefs["types"][kind], F.lit(False))
    return F.coalesce(prefs["enabled"], F.lit(False)) & ~quiet & typed


def hide_covered_events(events: DataFrame) -> DataFrame:
    """Short events go where a long event of the same thread is in the same window."""
    long = events.filter("is_long").select("window_start", "thread_id").distinct().withColumn("__covered", F.lit(True))
    joined = events.join(long, ["window_start", "thread_id"], "left")
    return joined.filter(F.col("is_long") | F.col("__covered").isNull()).drop("__covered")


def prefer_kind(results: DataFrame, hint: str = "kind_hint") -> DataFrame:
    """Only the hinted kind, unless that would leave the query without results."""
    match = F.coalesce(F.col("kind") == F.col(hint), F.lit(False))
    any_hit = results.filter(match).select("query_id").distinct().withColumn("__any", F.lit(True))
    joined = results.join(any_hit, "query_id", "left")
    return joined.filter(match | F.col("__any").isNull()).drop("__any")


def flag_self(name: str | Column, own_names: Sequence[str]) -> Column:
    """Whether the name is one of the recorder's own, case-folded."""
    return F.lower(strip(name)).isin([n.lower() for n in own_names])


def flag_important(df: DataFrame, col: str, aliases: DataFrame, out: str = "important") -> DataFrame:
    """Whether the name, raw or canonical, is a known app or alias."""
    known = aliases.select(F.explode(F.array(F.lower("canonical"), F.lower("alias"))).alias("__known")).distinct()
    known = known.withColumn("__hit", F.lit(True))
    named = canonical_app(df, col, aliases, out="__app")
    raw = named.join(known, F.lower(col) == F.col("__known"), "left").withColumnRenamed("__hit", "__hit_raw").drop("__known")
    both = raw.join(known, F.lower("__app") == F.col("__known"), "left")
    flag = F.coalesce("__hit_raw", "__hit", F.lit(False))
    return both.withColumn(out, flag).drop("__known", "__hit", "__hit_raw", "__app")

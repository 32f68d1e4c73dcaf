"""Identifiers, status folds, time of day, fingerprints and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOURCE_PREFIXES = ["screen:", "window:"]
DUPLICATE_DISTANCE = 8
BATCH_HASH_CHARS = 24
CONFIG_HASH_CHARS = 16
CLOCK = r"^([01]\d|2[0-3]):([0-5]\d)$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_source_key(c: str | Column) -> Column:
    c = _c(c)
    return c.startswith(SOURCE_PREFIXES[0]) | c.startswith(SOURCE_PREFIXES[1])


def source_kind(c: str | Column) -> Column:
    return F.when(is_source_key(c), F.split_part(_c(c), F.lit(":"), F.lit(1)))


def source_key(kind: Column, source_id: Column, display_id: Column) -> Column:
    """``screen:<display or own id>`` or ``window:<own id>``."""
    screen = F.concat(F.lit("screen:"), F.coalesce(F.when(display_id != "", display_id), source_id))
    return F.when(kind == "screen", screen).otherwise(F.concat(F.lit("window:"), source_id))


def batch_id(source: Column, start_ms: Column, end_ms: Column, ids: Column) -> Column:
    """Same members, same id: a digest of the batch written as one JSON object."""
    payload = F.to_json(
        F.struct(source.alias("sourceKey"), start_ms.alias("tsStart"), end_ms.alias("tsEnd"), ids.alias("screenshotIds"))
    )
    return F.concat(F.lit("batch_"), F.substring(F.sha2(payload, 256), 1, BATCH_HASH_CHARS))


def origin_key(batch: Column, indices: Column) -> Column:
    idx = F.array_join(F.transform(F.array_sort(indices), lambda i: i.cast("string")), ",")
    return F.concat(F.lit("batch:"), batch.cast("string"), F.lit("|nodes:"), idx)


def thread_id_of(origin: Column) -> Column:
    """Deterministic thread id, so that a rerun gives the same one."""
    return F.sha2(origin, 256)


def event_key(window_start: Column, index: Column, kind: Column, title: Column) -> Column:
    label = F.concat(kind, F.lit(":"), title)
    digest = F.substring(F.lower(F.hex(F.encode(label, "UTF-8"))), 1, 16)
    return F.concat(
        F.lit("win_"), window_start.cast("string"), F.lit("_evt_"), index.cast("string"), F.lit("_"), digest
    )


def marker_key(thread: Column) -> Column:
    return F.concat(F.lit("thr_"), thread.cast("string"))


def summary_status(c: str | Column) -> Column:
    """Status shown for a window summary."""
    c = _c(c)
    return (
        F.when(c.isin("failed_permanent", "failed", "succeeded"), c).when(c == "no_data", "succeeded").otherwise("pending")
    )


def details_status(c: str | Column) -> Column:
    """Status shown for event details."""
    c = _c(c)
    return F.when(c.isin("failed_permanent", "failed"), "failed").when(c == "succeeded", c).otherwise("pending")


def health_level(value: Column, warning: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("healthy")


def config_hash(*parts: Column) -> Column:
    """Signature of a model configuration: mode, then endpoints and models, as one string."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, CONFIG_HASH_CHARS)


def unified_config_hash(base_url: Column, model: Column) -> Column:
    return config_hash(F.lit("unified:"), base_url, F.lit(":"), model)


def separate_config_hash(vlm: tuple[Column, Column], text: tuple[Column, Column], embed: tuple[Column, Column]) -> Column:
    parts = [F.lit("separate")]
    for name, (url, model) in {"vlm": vlm, "text": text, "embed": embed}.items():
        parts += [F.lit(f"|{name}:"), url, F.lit(":"), model]
    return config_hash(*parts)


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def fingerprint(hex16: str | Column) -> Column:
    """Signed 64-bit value of a 16-digit hex fingerprint."""
    return F.conv(_c(hex16), 16, -10).cast("long")


def is_near_dup(a: str | Column, b: str | Column, threshold: int = DUPLICATE_DISTANCE) -> Column:
    """Whether two fingerprints are within the threshold; no earlier one is no duplicate."""
    return F.coalesce(hamming(a, b) <= threshold, F.lit(False))


def clamp_box(left: Column, top: Column, width: Column, height: Column, image_w: Column, image_h: Column) -> Column:
    """Crop box inside the image: whole pixels, at least 1 by 1, no overrun; null for an empty image."""

    def interval(start: Column, length: Column, size: Column) -> tuple[Column, Column]:
        """First pixel and length of an interval, moved and cut so that it lies on the axis."""
        first = F.least(F.greatest(F.floor(start), F.lit(0).cast("long")), size - 1)
        room = size - first
        return first, F.when(length < 1, F.lit(1).cast("long")).when(length >= room, room).otherwise(F.floor(length))

    (x, w), (y, h) = interval(left, width, image_w), interval(top, height, image_h)
    box = F.struct(x.alias("left"), y.alias("top"), w.alias("width"), h.alias("height"))
    return F.when((image_w > 0) & (image_h > 0), box)


def minute_of_day(c: str | Column) -> Column:
    """Minutes after midnight of ``HH:MM``; anything else is null."""
    c = _c(c)
    minutes = F.regexp_extract(c, CLOCK, 1).try_cast("int") * 60 + F.regexp_extract(c, CLOCK, 2).try_cast("int")
    return F.when(c.rlike(CLOCK), minutes)


def time_context(now: Column, tz: str = "UTC") -> Column:
    """Local time and the day bounds around a moment, as epoch milliseconds.

    A day ends at 23:59:59.999; yesterday is today less 24 hours.
    """
    local = F.from_utc_timestamp(now, tz)
    day = F.date_trunc("day", local)
    start = F.unix_millis(F.to_utc_timestamp(day, tz))
    end = F.unix_millis(F.to_utc_timestamp(F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND") + day, tz))
    now_ms = F.unix_millis(now)
    day_ms = F.lit(86_400_000)
    return F.struct(
        F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time"),
        now_ms.alias("now_ms"),
        start.alias("today_start"),
        end.alias("today_end"),
        (start - day_ms).alias("yesterday_start"),
        (end - day_ms).alias("yesterday_end"),
        (now_ms - 7 * day_ms).alias("week_ago"),
    )

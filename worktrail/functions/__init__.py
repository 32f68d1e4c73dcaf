"""Column functions, and the ones that are offered as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from worktrail.functions import keys, normalize, text


def _words(values: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _pattern(p: str) -> str:
    return "r'" + p.replace("'", r"\x27") + "'"


_SPACE = text.SPACE
_ENDS = _pattern(f"^{_SPACE}+|{_SPACE}+$")
_RUN = _pattern(f"{_SPACE}+")
_CLOCK = _pattern(keys.CLOCK)


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_ENDS}, '')"


def _tokens(c: str) -> str:
    return f"filter(split(lower({c}), {_pattern(text.TOKEN_BREAK)}), t -> t <> '')"


def _has(c: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


_FTS = f"regexp_replace(regexp_replace(c, {_pattern(text.FTS_QUOTES)}, ' '), {_pattern(text.FTS_PUNCTUATION)}, ' ')"
_LOW = "lower(coalesce(c, ''))"

# SQL bodies of pure functions, registered per session as temporary functions.
SQL_FUNCTIONS = {
    "wt_hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "wt_is_near_dup(a BIGINT, b BIGINT) RETURNS BOOLEAN": f"coalesce(bit_count(a ^ b) <= {keys.DUPLICATE_DISTANCE}, false)",
    "wt_fingerprint(c STRING) RETURNS BIGINT": "CAST(conv(c, 16, -10) AS BIGINT)",
    "wt_is_source_key(k STRING) RETURNS BOOLEAN": "startswith(k, 'screen:') OR startswith(k, 'window:')",
    "wt_source_kind(k STRING) RETURNS STRING": "IF(startswith(k, 'screen:') OR startswith(k, 'window:'), split_part(k, ':', 1), NULL)",
    "wt_source_key(kind STRING, source_id STRING, display_id STRING) RETURNS STRING":
        "IF(kind = 'screen', concat('screen:', coalesce(nullif(display_id, ''), source_id)), concat('window:', source_id))",
    "wt_clamp(c DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE": "IF(c IS NULL, NULL, greatest(lo, least(hi, c)))",
    "wt_ellipsis(c STRING, n INT) RETURNS STRING": "IF(length(c) > n, concat(substring(c, 1, n - 3), '...'), c)",
    "wt_strip(c STRING) RETURNS STRING": _strip("c"),
    "wt_squeeze(c STRING) RETURNS STRING": f"regexp_replace({_strip('c')}, {_RUN}, ' ')",
    "wt_blank_to_null(c STRING) RETURNS STRING": f"nullif({_strip('c')}, '')",
    "wt_tokens(c STRING) RETURNS ARRAY<STRING>": _tokens("c"),
    "wt_fts_terms(c STRING) RETURNS ARRAY<STRING>":
        f"filter(split(regexp_replace({_strip(_FTS)}, {_RUN}, ' '), ' '), t -> t <> '')",
    "wt_window_start(ms BIGINT, width BIGINT) RETURNS BIGINT": "floor(ms / width) * width",
    "wt_minute_of_day(c STRING) RETURNS INT":
        f"IF(c RLIKE {_CLOCK}, try_cast(regexp_extract(c, {_CLOCK}, 1) AS INT) * 60 + try_cast(regexp_extract(c, {_CLOCK}, 2) AS INT), NULL)",
    "wt_health(v DOUBLE, warn DOUBLE, crit DOUBLE) RETURNS STRING":
        "CASE WHEN v >= crit THEN 'critical' WHEN v >= warn THEN 'warning' ELSE 'healthy' END",
    "wt_summary_status(c STRING) RETURNS STRING":
        "CASE WHEN c IN ('failed_permanent', 'failed', 'succeeded') THEN c WHEN c = 'no_data' THEN 'succeeded' ELSE 'pending' END",
    "wt_details_status(c STRING) RETURNS STRING":
        "CASE WHEN c IN ('failed_permanent', 'failed') THEN 'failed' WHEN c = 'succeeded' THEN c ELSE 'pending' END",
    "wt_text_hash(c STRING) RETURNS STRING": "sha2(c, 256)",
    "wt_marker_key(c STRING) RETURNS STRING": "concat('thr_', c)",
    "wt_origin_key(batch STRING, indices ARRAY<INT>) RETURNS STRING":
        "concat('batch:', batch, '|nodes:', array_join(transform(array_sort(indices), i -> CAST(i AS STRING)), ','))",
    "wt_clean_app_hint(c STRING) RETURNS STRING": f"IF({_strip('c')} <> '' AND lower({_strip('c')}) <> 'null', {_strip('c')}, NULL)",
    "wt_real_app_hint(c STRING) RETURNS STRING":
        f"IF({_strip('c')} <> '' AND lower({_strip('c')}) NOT IN ({_words(normalize.PLACEHOLDER_HINTS)}), {_strip('c')}, NULL)",
    "wt_language_bucket(c STRING) RETURNS STRING":
        f"CASE WHEN {_has(_LOW, 'en')} THEN 'en' WHEN {_has(_LOW, 'zh', 'cn', '中文')} THEN 'zh' ELSE 'other' END",
    "wt_entity_type(c STRING) RETURNS STRING": f"IF(c IN ({_words(normalize.ENTITY_TYPES)}), c, 'other')",
    "wt_issue_type(c STRING) RETURNS STRING":
        f"CASE WHEN c IS NULL THEN NULL WHEN lower(c) IN ({_words(normalize.ISSUE_TYPES)}) THEN lower(c) "
        f"WHEN {_has('lower(c)', 'fail', 'err')} THEN 'error' ELSE 'warning' END",
    "wt_action_priority(c STRING) RETURNS STRING":
        f"CASE WHEN {_LOW} IN ({_words(normalize.PRIORITIES)}) THEN {_LOW} WHEN {_has(_LOW, 'urgent', 'critical')} THEN 'high' ELSE 'medium' END",
    "wt_action_source(c STRING) RETURNS STRING": f"IF({_LOW} IN ({_words(normalize.ACTION_SOURCES)}), {_LOW}, 'inferred')",
    "wt_clean_names(c ARRAY<STRING>) RETURNS ARRAY<STRING>":
        f"nullif(slice(filter(transform(c, x -> {_strip('x')}), n -> n <> ''), 1, {normalize.QUERY_ENTITIES}), array())",
    "wt_merge_hints(capture STRING, model STRING) RETURNS STRING": "coalesce(capture, model)",
    "wt_boosted_importance(importance INT, issue BOOLEAN) RETURNS INT":
        f"IF(coalesce(issue, false), greatest(importance, {normalize.ISSUE_IMPORTANCE}), importance)",
    "wt_cap_uncited(confidence DOUBLE, citations ARRAY<STRING>) RETURNS DOUBLE":
        "CASE WHEN confidence IS NULL THEN NULL WHEN coalesce(size(citations), 0) <= 0 "
        f"THEN least({normalize.UNCITED_CONFIDENCE}D, greatest(0D, least(1D, confidence))) ELSE greatest(0D, least(1D, confidence)) END",
}


def register(spark: SparkSession) -> None:
    """Make the SQL functions known to a session; they inline into the plan."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

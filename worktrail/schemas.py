"""Entity schemas.  Times are timestamps in UTC; nested values are real columns, not JSON text."""

from __future__ import annotations

from pyspark.sql import types as T

from worktrail.functions.normalize import ENTITY

L, S, D, B, TS = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
I = T.IntegerType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


APP_CONTEXT = struct(app_hint=S, window_title=S, source_key=S, project_name=S, project_key=S)
KNOWLEDGE = struct(
    content_type=S, source_url=S, project_or_library=S, key_insights=T.ArrayType(S), language=S, text_region=S
)
ISSUE = struct(detected=B, type=S, description=S, severity=D)
STATE_SNAPSHOT = struct(subject_type=S, subject=S, current_state=S, metrics=T.MapType(S, S), issue=ISSUE)
THREAD_SNAPSHOT = struct(
    thread_id=S, title=S, summary=S, duration_ms=L, start_ms=L, last_active_ms=L, current_phase=S, current_focus=S,
    main_project=S,
)
ACTION_ITEM = struct(action=S, priority=S, source=S)
MILESTONE = struct(time=L, description=S)

TABLES: dict[str, T.StructType] = {
    "captures": struct(
        id=L, source_key=S, ts=TS, phash=L, width=I, height=I, app_hint=S, window_title=S, ocr_text=S, ocr_status=S,
        ocr_attempts=I, ocr_next_run_at=TS, batch_id=S, file_path=S, storage_state=S, created_at=TS, updated_at=TS,
    ),
    "batches": struct(
        batch_id=S, source_key=S, screenshot_ids=T.ArrayType(L), ts_start=TS, ts_end=TS, vlm_status=S, vlm_attempts=I,
        vlm_next_run_at=TS, vlm_error=S, thread_llm_status=S, thread_llm_attempts=I, thread_llm_next_run_at=TS,
        created_at=TS, updated_at=TS,
    ),
    "nodes": struct(
        id=L, batch_id=S, title=S, summary=S, event_time=TS, thread_id=S, thread_snapshot=THREAD_SNAPSHOT,
        app_context=APP_CONTEXT, knowledge=KNOWLEDGE, state_snapshot=STATE_SNAPSHOT, ui_text_snippets=T.ArrayType(S),
        action_items=T.ArrayType(ACTION_ITEM), importance=D, confidence=D, keywords=T.ArrayType(S),
        entities=T.ArrayType(ENTITY), embedding_status=S, created_at=TS, updated_at=TS,
    ),
    "node_capture_links": struct(node_id=L, screenshot_id=L),
    "threads": struct(
        thread_id=S, origin_key=S, title=S, summary=S, current_phase=S, current_focus=S, status=S, start_time=TS,
        last_active_at=TS, duration_ms=L, node_count=L, apps=T.ArrayType(S), main_project=S,
        key_entities=T.ArrayType(S), milestones=T.ArrayType(MILESTONE),
    ),
    "vector_documents": struct(
        vector_id=S, doc_type=S, ref_id=L, text_content=S, text_hash=S, meta=T.MapType(S, S),
        embedding=T.ArrayType(T.FloatType()), embedding_status=S, embedding_attempts=I, embedding_next_run_at=TS,
        index_status=S, index_attempts=I, index_next_run_at=TS,
    ),
    "activity_summaries": struct(
        window_start=TS, window_end=TS, status=S, attempts=I, next_run_at=TS, title=S, summary_text=S,
        highlights=T.ArrayType(S),
        stats=struct(top_apps=T.ArrayType(S), top_entities=T.ArrayType(S), node_count=L, thread_count=L),
    ),
    "activity_events": struct(
        event_key=S, title=S, kind=S, start_ts=TS, end_ts=TS, duration_ms=L, summary_id=L, thread_id=S, is_long=B,
        details_text=S, details_status=S, details_attempts=I, details_next_run_at=TS, node_ids=T.ArrayType(L),
        confidence=D, importance=D,
    ),
    "model_usage_events": struct(
        ts=TS, capability=S, operation=S, status=S, error_code=S, model=S, provider=S, config_hash=S, total_tokens=L,
        usage_status=S,
    ),
    "model_usage_daily": struct(
        day=T.DateType(), model=S, capability=S, request_count_succeeded=L, request_count_failed=L, total_tokens_sum=L
    ),
    "ocr_postings": struct(term=S, doc_id=L, tf=L),
    "app_aliases": struct(canonical=S, alias=S),
    "system_windows": struct(name=S),
}

# Enumerations a column is checked against.
ENUMS: dict[str, list[str]] = {
    "processing_status": ["pending", "running", "succeeded", "failed", "failed_permanent"],
    "thread_status": ["active", "inactive", "closed"],
    "summary_status": ["pending", "running", "succeeded", "failed", "failed_permanent", "no_data"],
    "capability": ["vlm", "text", "embedding"],
    "call_status": ["succeeded", "failed"],
    "storage_state": ["ephemeral", "persisted", "deleted"],
    "node_kind": ["event", "knowledge", "state_snapshot"],
    "event_kind": ["focus", "work", "meeting", "break", "browse", "coding", "debugging", "unknown"],
}

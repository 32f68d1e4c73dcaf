"""Clean-up of model output: enumerations, caps, clamps, entity lists and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.functions.text import blank_to_null, strip

# Enumerations, in the order the data model lists them.
ENTITY_TYPES = [
    "person", "project", "team", "org", "jira_id", "pr_id", "commit", "document_id", "url", "repo", "other",
]
EVENT_KINDS = ["focus", "work", "meeting", "break", "browse", "coding", "debugging"]
ISSUE_TYPES = ["error", "bug", "blocker", "question", "warning"]
PRIORITIES = ["high", "medium", "low"]
ACTION_SOURCES = ["explicit", "inferred"]
PLACEHOLDER_HINTS = ["unknown", "other"]
# Caps per field.
NODE_ENTITIES, QUERY_ENTITIES = 10, 20
ACTION_ITEMS, SNIPPETS, NODE_KEYWORDS, QUERY_KEYWORDS, BULLETS = 5, 5, 5, 10, 8
ISSUE_IMPORTANCE = 7
UNCITED_CONFIDENCE = 0.2

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("top", "left", "width", "height")])
REGION = T.StructType(
    [T.StructField("description", T.StringType()), T.StructField("box", BOX), T.StructField("confidence", T.DoubleType())]
)
ENTITY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_match(c: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Value of the first rule one of whose substrings occurs in ``c``."""
    out = None
    for value, parts in rules:
        hit = c.contains(parts[0])
        for p in parts[1:]:
            hit = hit | c.contains(p)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def json_or(c: str | Column, schema: str | T.DataType, default: Column) -> Column:
    """Parse JSON text; null, empty or broken text gives ``default``."""
    c = _c(c)
    parsed = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    broken = F.when(F.try_parse_json(c).isNull(), True).otherwise(False)
    return F.when(broken | parsed.isNull(), default).otherwise(parsed)


def clean_app_hint(c: str | Column) -> Column:
    """Blank text and the word ``null`` are no hint."""
    s = strip(c)
    return F.when((s != "") & (F.lower(s) != "null"), s)


def real_app_hint(c: str | Column) -> Column:
    """A hint fit to show: placeholders of the model are dropped."""
    s = strip(c)
    return F.when((s != "") & ~F.lower(s).isin(PLACEHOLDER_HINTS), s)


def language_bucket(c: str | Column) -> Column:
    """``en`` is looked for first, anywhere in the text: ``french`` counts as ``en``."""
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    return _first_match(s, [("en", ["en"]), ("zh", ["zh", "cn", "中文"])], "other")


def entity_type(c: str | Column) -> Column:
    return F.when(_c(c).isin(ENTITY_TYPES), _c(c)).otherwise("other")


def clean_entities(c: str | Column, limit: int = NODE_ENTITIES) -> Column:
    """Trim names, drop blank ones, clamp confidence to [0, 1], keep the first ``limit``."""
    kept = F.filter(_c(c), lambda e: strip(e["name"]) != "")
    return F.transform(
        F.slice(kept, 1, limit),
        lambda e: F.struct(
            strip(e["name"]).alias("name"),
            entity_type(e["type"]).alias("type"),
            F.when(e["raw"] != "", strip(e["raw"])).alias("raw"),
            clamp(e["confidence"], 0.0, 1.0).alias("confidence"),
        ),
    )


def clean_names(c: str | Column, limit: int = QUERY_ENTITIES) -> Column:
    kept = F.slice(F.filter(F.transform(_c(c), strip), lambda n: n != ""), 1, limit)
    return F.when(F.size(kept) > 0, kept)


def issue_type(c: str | Column) -> Column:
    """Null stays null; the five known types stay; failures and errors are ``error``."""
    s = F.lower(_c(c))
    other = _first_match(s, [("error", ["fail", "err"])], "warning")
    return F.when(s.isNull(), None).when(s.isin(ISSUE_TYPES), s).otherwise(other)


def action_priority(c: str | Column) -> Column:
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.when(s.isin(PRIORITIES), s).otherwise(_first_match(s, [("high", ["urgent", "critical"])], "medium"))


def action_source(c: str | Column) -> Column:
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.when(s.isin(ACTION_SOURCES), s).otherwise("inferred")


def event_kind(c: str | Column) -> Column:
    """Kind of an event from free text; the order of the rules matters."""
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    rules = [
        ("coding", ["code", "dev"]),
        ("debugging", ["debug", "test"]),
        ("meeting", ["meet", "call"]),
        ("break", ["rest", "pause"]),
        ("browse", ["surf", "web"]),
    ]
    return F.when(s.isin(EVENT_KINDS), s).otherwise(_first_match(s, rules, "work"))


def long_event_kind(phase: str | Column, title: str | Column) -> Column:
    """Kind of a long event from its phase and title; not the order of ``event_kind``."""
    s = F.lower(F.concat_ws(" ", F.coalesce(_c(phase), F.lit("")), F.coalesce(_c(title), F.lit(""))))
    rules = [
        ("meeting", ["meeting"]),
        ("break", ["break"]),
        ("browse", ["browse", "research"]),
        ("debugging", ["debug"]),
        ("coding", ["code", "implement"]),
    ]
    return _first_match(s, rules, "work")


def clamp(c: str | Column, lo: float, hi: float) -> Column:
    """Bounded value; null stays null."""
    c = _c(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def cap(c: str | Column, n: int) -> Column:
    return F.slice(_c(c), 1, n)


def node_kind(snapshot: Column, knowledge: Column) -> Column:
    return F.when(snapshot.isNotNull(), "state_snapshot").when(knowledge.isNotNull(), "knowledge").otherwise("event")


def boosted_importance(importance: Column, issue: Column) -> Column:
    return F.when(F.coalesce(issue, F.lit(False)), F.greatest(importance, F.lit(ISSUE_IMPORTANCE))).otherwise(importance)


def derived_entities(keywords: Column, project: Column, subject: Column) -> Column:
    """Keywords, project or library, and subject: trimmed, first occurrence kept."""
    parts = F.concat(F.coalesce(keywords, F.array().cast("array<string>")), F.array(project, subject))
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda s: s != ""))


def merge_hints(capture: Column, model: Column) -> Column:
    """The capture's own hint wins over the model's."""
    return F.coalesce(capture, model)


def cap_uncited(confidence: Column, citations: Column) -> Column:
    """Confidence in [0, 1], and at most 0.2 without a citation."""
    c = clamp(confidence, 0.0, 1.0)
    bare = F.coalesce(F.size(citations), F.lit(0)) <= 0
    return F.when(bare & (c > UNCITED_CONFIDENCE), F.lit(UNCITED_CONFIDENCE)).otherwise(c)


def text_region(c: str | Column) -> Column:
    """A region given as JSON object or as bare text; bare text gets a zero box."""
    c = _c(c)
    obj = F.from_json(c, REGION)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    box = lambda b: F.struct(*[zero(b[n]).alias(n) for n in ("top", "left", "width", "height")])
    is_object = F.trim(c).startswith("{")
    return F.when(
        c.isNotNull(),
        F.struct(
            F.when(is_object, obj["description"]).otherwise(c).alias("description"),
            box(F.when(is_object, obj["box"])).alias("box"),
            F.when(is_object, zero(obj["confidence"])).otherwise(F.lit(0.0)).alias("confidence"),
        ),
    )


def snake_payload(c: str | Column, fields: dict[str, tuple[str, ...]]) -> Column:
    """Struct of a JSON object whose fields may be spelled in camel or snake case."""
    c = _c(c)
    return F.struct(
        *[F.coalesce(*[F.get_json_object(c, f"$.{s}") for s in spelt]).alias(name) for name, spelt in fields.items()]
    )


# Field spellings of the two payloads.
KNOWLEDGE_FIELDS = {
    "content_type": ("contentType", "content_type"),
    "source_url": ("sourceUrl", "source_url"),
    "project_or_library": ("projectOrLibrary", "project_or_library"),
    "key_insights": ("keyInsights", "key_insights"),
    "language": ("language",),
    "text_region": ("textRegion", "text_region"),
}
SNAPSHOT_FIELDS = {
    "subject_type": ("subjectType", "subject_type"),
    "subject": ("subject",),
    "current_state": ("currentState", "current_state"),
    "metrics": ("metrics",),
    "issue": ("issue",),
}


def window_title(c: str | Column) -> Column:
    return blank_to_null(c)

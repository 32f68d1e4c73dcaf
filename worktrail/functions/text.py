"""Text expressions: trimming, cutting, joining, hashing and term lists.

Lengths count Unicode code points.  All are plain ``Column`` expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that decide results.
SPACE = r"[\s\p{Z}]"
SENTENCE_END = r"[\n.。!！?？]"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
FTS_QUOTES = "[\"'`]"
FTS_PUNCTUATION = r"[?？!！:：;；(){}\[\]]"
TITLE_CHARS = 80
PROJECT_KEY_CHARS = 80
KEYWORD_TERMS = 8


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.regexp_replace(_c(c), f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: str | Column) -> Column:
    """Trim, and turn each run of white space into one space."""
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def blank_to_null(c: str | Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def ellipsis(c: str | Column, n: int) -> Column:
    """Over ``n`` characters: the first ``n - 3`` and three dots."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def cut(c: str | Column, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def text_hash(c: str | Column) -> Column:
    return F.sha2(_c(c), 256)


def project_key(key: str | Column, name: str | Column) -> Column:
    """Slug of the key, else of the name; null when neither leaves anything."""

    def slug(c: Column) -> Column:
        s = F.lower(strip(c))
        t = F.regexp_replace(s, f"{SPACE}+", "-")
        t = F.regexp_replace(t, r"[^a-z0-9._\-/]", "")
        t = F.substring(F.regexp_replace(t, "-+", "-"), 1, PROJECT_KEY_CHARS)
        return F.when((s != "null") & (t != ""), t)

    return F.coalesce(slug(_c(key)), slug(_c(name)))


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(_c(c)), TOKEN_BREAK), lambda t: t != "")


def counted(words: Column) -> Column:
    """Words of a sorted array with their counts, ``{term, tf}``; null for an empty one.

    ``words`` should be a column, not an expression: it is read at every place.
    """
    new = lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), new)
    # each start beside the next one: the end of a run is where the next begins
    ends = F.concat(F.slice(starts, 2, F.size(words)), F.array(F.size(words)))
    run = lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).cast("long").alias("tf"))
    return F.when(F.size(words) > 0, F.zip_with(starts, ends, run))


def fts_terms(c: str | Column) -> Column:
    """Terms of a full-text query: quotes and query punctuation become spaces; all are required."""
    s = F.regexp_replace(F.regexp_replace(_c(c), FTS_QUOTES, " "), FTS_PUNCTUATION, " ")
    return F.filter(F.split(squeeze(s), " "), lambda t: t != "")


def keyword_terms(c: str | Column, entities: Column | None = None, limit: int = KEYWORD_TERMS) -> Column:
    """The whole query, its words longer than one character, then entities; distinct, first eight."""
    whole = strip(c)
    words = F.filter(F.split(whole, f"{SPACE}+"), lambda t: F.length(t) > 1)
    parts = [F.filter(F.array(whole), lambda t: t != ""), words]
    if entities is not None:
        named = F.filter(F.transform(entities, strip), lambda t: t != "")
        parts.append(F.coalesce(named, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.concat(*parts)), 1, limit)


def node_text(title: Column, summary: Column, keywords: Column, knowledge: Column, snapshot: Column) -> Column:
    """Searchable text of a node, one labelled line per part that is present."""
    label = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Summary: "), summary),
        F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "))),
        label("Knowledge", knowledge),
        label("StateSnapshot", snapshot),
    )


def marker_title(event_title: Column, description: Column, kind: Column, thread_title: Column) -> Column:
    """Title of a long-event marker.

    An event title that says more than the thread title is taken as is; else the first
    sentence of the description; else the title (or the thread's) after its kind.
    """
    title, about, thread = squeeze(event_title), squeeze(description), F.coalesce(thread_title, F.lit(""))
    first = F.split(about, SENTENCE_END)[0]
    short = F.when(
        F.length(first) > TITLE_CHARS, F.concat(strip(F.substring(first, 1, TITLE_CHARS)), F.lit("…"))
    ).otherwise(first)
    with_kind = lambda c: F.when(kind.isNotNull() & (kind != ""), F.concat(kind, F.lit(": "), c)).otherwise(c)
    return (
        F.when((title != "") & (title != squeeze(thread)), event_title)
        .when(about != "", short)
        .when(title != "", with_kind(event_title))
        .otherwise(with_kind(thread))
    )

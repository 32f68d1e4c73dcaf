"""Text containment joins and app-name matching, without comparing every pair.

``substring_join`` finds the (text, term) pairs where the text contains the term.  A term
can only occur where its rarest piece of three characters occurs, so texts and terms meet
in an equi-join on that piece and only those candidates are verified.  There is no bound
on either side and no cut on candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.text import strip

GRAM = 3
# Bound on the terms sent to every task, in characters.
BROADCAST_CHARS = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What may stand between app name and title in a window name.
DELIMITERS = "[-–—|｜:·•]"


def ascii_lower(c: Column) -> Column:
    """Case folding of the LIKE operator: ASCII letters only."""
    return F.translate(c, UPPER, LOWER)


def _grams(c: Column, n: int) -> Column:
    """Distinct pieces of ``n`` characters, taken in one pass by a look-ahead at every position."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def like_contains(text: Column, term: Column) -> Column:
    """``text LIKE '%term%'`` with ``%`` and ``_`` of the term as wildcards and no escape character."""
    pattern = F.concat(F.lit("%"), F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    wild = F.contains(term, F.lit("%")) | F.contains(term, F.lit("_"))
    return F.when(wild, F.like(text, pattern)).otherwise(F.contains(text, term))


def substring_join(
    texts: DataFrame, text_id: str, text: str, terms: DataFrame, term_id: str, term: str, wildcards: bool = False,
    max_broadcast: int = BROADCAST_CHARS,
) -> DataFrame:
    """Pairs ``(text_id, term_id)`` where the text contains the term (both sides already case-folded).

    Terms must be non-empty and ``term_id`` unique.  Terms of at most ``max_broadcast`` characters
    in all are sent to every task and the texts are only scanned; more terms than that meet the
    texts' pieces in a shuffle, and the candidates fetch their text by id.
    """
    literal = F.split(F.col(term), "[%_]") if wildcards else F.array(F.col(term))
    longest = F.reduce(literal, F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))
    sized = terms.select(term_id, term, longest.alias("__seg")).withColumn("__g", F.least(F.lit(GRAM), F.length("__seg")))
    # one small row: which piece lengths occur (at most GRAM + 1), and how much text the terms are
    facts = sized.agg(F.collect_set("__g").alias("sizes"), F.coalesce(F.sum(F.length(term)), F.lit(0)).alias("chars")).first()
    sizes, small = sorted(facts["sizes"]), facts["chars"] <= max_broadcast
    share = F.broadcast if small else (lambda df: df)

    def pieces(c: Column) -> Column:
        parts = ([F.array(F.lit(""))] if 0 in sizes else []) + [_grams(c, n) for n in sizes if n > 0]
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    def own_pieces() -> Column:
        out = F.when(F.col("__g") == 0, F.array(F.lit("")))
        for n in range(1, GRAM + 1):
            out = out.when(F.col("__g") == n, _grams(F.col("__seg"), n))
        return out

    term_grams = sized.select(term_id, F.explode(own_pieces()).alias("__gram"))
    text_grams = texts.select(text_id, text, F.explode(pieces(F.col(text))).alias("__gram"))
    needed = text_grams.select("__gram").join(share(term_grams.select("__gram").distinct()), "__gram", "left_semi")
    frequency = needed.groupBy("__gram").agg(F.count("*").alias("__df"))
    rarest = (
        term_grams.join(frequency, "__gram")
        .groupBy(term_id)
        .agg(F.min(F.struct("__df", "__gram")).alias("__best"))
        .select(F.col(term_id), F.col("__best.__gram").alias("__gram"))
    )
    chosen = rarest.join(sized.select(term_id, term), term_id)
    hit = like_contains(F.col(text), F.col(term)) if wildcards else F.contains(F.col(text), F.col(term))
    if small:
        return text_grams.join(F.broadcast(chosen), "__gram").filter(hit).select(text_id, term_id)
    candidates = text_grams.select(text_id, "__gram").join(chosen, "__gram").select(text_id, term_id, term)
    return candidates.join(texts.select(text_id, text), text_id).filter(hit).select(text_id, term_id)


def alias_table(aliases: DataFrame) -> DataFrame:
    """Lower-case name to canonical name; a canonical name stands for itself."""
    own = aliases.select(F.lower("canonical").alias("alias"), "canonical")
    both = own.unionByName(aliases.select(F.lower("alias").alias("alias"), "canonical"))
    return both.groupBy("alias").agg(F.max("canonical").alias("canonical"))


def canonical_app(df: DataFrame, col: str, aliases: DataFrame, out: str = "app") -> DataFrame:
    """Canonical app name of a column; unknown names stay as they are."""
    known = alias_table(aliases).withColumnsRenamed({"alias": "__alias", "canonical": "__canonical"})
    joined = df.join(known, F.lower(strip(col)) == F.col("__alias"), "left")
    return joined.withColumn(out, F.coalesce("__canonical", F.col(col))).drop("__alias", "__canonical")


def canonical_hint(df: DataFrame, col: str, aliases: DataFrame, out: str = "app_hint") -> DataFrame:
    """A hint that equals a canonical name but for case takes its spelling; aliases do not count."""
    known = aliases.select("canonical").distinct().groupBy(F.lower("canonical").alias("__low")).agg(
        F.min("canonical").alias("__canonical")
    )
    hint = F.when((strip(col) != "") & (F.lower(strip(col)) != "null"), strip(col))
    joined = df.withColumn("__hint", hint).join(known, F.lower("__hint") == F.col("__low"), "left")
    return joined.withColumn(out, F.coalesce("__canonical", "__hint")).drop("__hint", "__low", "__canonical")


def parse_window_name(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """``app`` and ``title`` of a raw window name.

    The longest alias whose first occurrence stands on word boundaries names the app; the
    title is what the delimiter separates from it.  Each distinct name is cut into the
    spans between boundaries, and the spans are joined to the aliases.
    """
    names = df.select(F.col(col).alias("__name")).filter(F.col("__name").isNotNull()).distinct()
    forms = aliases.select("canonical", "alias").unionByName(
        aliases.select("canonical", F.col("canonical").alias("alias"))
    )
    forms = forms.select("canonical", F.lower("alias").alias("__form")).filter("__form <> ''").distinct()
    longest = forms.agg(F.max(F.length("__form"))).first()[0] or 0
    low = F.lower("__name")
    n = F.length("__name")
    word = "[a-zA-Z0-9]"
    edge = lambda i: (i < 1) | (i > n) | ~F.rlike(F.substr(F.col("__name"), i, F.lit(1)), F.lit(word))
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: edge(i - 1))
    spans = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.filter(F.sequence(i, F.least(n, i + (longest - 1))), lambda j: edge(j + 1)),
                lambda j: F.struct(i.alias("at"), F.substr(low, i, j - i + 1).alias("form")),
            ),
        )
    )
    found = (
        names.filter(n > 0)
        .select("__name", F.explode(spans).alias("__span"))
        .select("__name", F.col("__span.at").alias("__at"), F.col("__span.form").alias("__form"))
        .join(forms, "__form")
        .filter(F.expr("locate(__form, lower(__name))") == F.col("__at"))
    )
    best = found.groupBy("__name").agg(
        F.max(F.struct(F.length("__form").alias("len"), "canonical", F.col("__form").alias("form"))).alias("__best")
    )
    trimmed = strip("__name")
    # The title is what stands after the app and a delimiter, or before a delimiter and the app.
    form = F.col("__best.form")
    size = F.length(form)
    after = strip(F.substr(trimmed, size + 1))
    before = strip(F.substr(trimmed, F.lit(1), F.length(trimmed) - size))
    at_front, at_back = F.lower(trimmed).startswith(form), F.lower(trimmed).endswith(form)
    title = F.when(at_front & F.substr(after, F.lit(1), F.lit(1)).rlike(DELIMITERS), strip(F.substr(after, F.lit(2)))).when(
        at_back & F.substr(before, F.length(before)).rlike(DELIMITERS), strip(F.substr(before, F.lit(1), F.length(before) - 1))
    )
    parsed = best.select(
        F.col("__name"), F.col("__best.canonical").alias("app"), F.when(title != "", title).alias("title")
    )
    return df.join(parsed, df[col] == parsed["__name"], "left").drop("__name")


def match_source(apps: DataFrame, app: str, sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each app name, the first source (by ``position``) that matches one of its names.

    Names match when either contains the other.  ``sources`` has ``position`` and ``name``.
    """
    named = apps.select(F.col(app).alias("__app")).distinct()
    canon = canonical_app(named, "__app", aliases, out="__canon")
    own = canon.select("__app", F.explode(F.array(F.lower(strip("__app")), F.lower("__canon"))).alias("form"))
    listed = canon.join(aliases.withColumnRenamed("canonical", "__canon"), "__canon").select(
        "__app", F.lower("alias").alias("form")
    )
    forms = own.unionByName(listed).filter("form <> ''").distinct()
    form_rows = forms.select("form").distinct()
    source_rows = sources.select(F.lower(strip("name")).alias("low"), "position").filter("low <> ''")
    first = source_rows.groupBy("low").agg(F.min("position").alias("position"))
    left = form_rows.select(F.col("form").alias("fid"), "form")
    right = first.select(F.col("low").alias("sid"), "low")
    inside = substring_join(right, "sid", "low", left, "fid", "form")
    outside = substring_join(left, "fid", "form", right, "sid", "low")
    pairs = inside.select("fid", "sid").unionByName(outside.select("fid", "sid")).distinct()
    best = (
        forms.join(pairs, F.col("form") == F.col("fid"))
        .join(first, F.col("sid") == F.col("low"))
        .groupBy("__app")
        .agg(F.min("position").alias("position"))
    )
    return best.join(sources, "position").select(F.col("__app").alias(app), "position", "name")

"""Quality rules with host-level verdicts: built-in expressions only.

Rules are checked on each document; failures are added up by host; a host's failure rate for a rule is
shrunk towards all hosts by a beta prior that is fitted to the hosts' own rates; hosts whose shrunk rate
is too high get a verdict, which is joined back to their documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.store import written

WINDOW = 8
# Characters that count as symbols, and the blanks between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows whose sequence occurs in the text twice or more, from the hashes of the windows."""
    marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda a, i: F.get(s, i)["h"].eqNullSafe(a["h"])
        twice = F.array_sort(F.transform(F.filter(s, lambda a, i: same(a, i - 1) | same(a, i + 1)), lambda a: a["i"]))
        return _bound(twice, lambda t: F.aggregate(F.transform(t, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(t, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    return _bound(marked, covered)


def document_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The given columns with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` (long).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null text has none and all counts are zero.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    hashed = F.transform(F.col("_words"), lambda w: F.xxhash64(w))
    windows = _bound(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    repeats = _bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _repeat_words(w)).otherwise(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = docs.withColumns(
        {
            "_words": words,
            "word_chars": F.length(F.translate(text, BLANKS, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        }
    )
    out = out.withColumns({"n_words": F.size("_words"), "n_repeat_words": F.when(F.size("_words") > WINDOW, repeats).otherwise(0)})
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}).drop("_words")


def rule_failures() -> dict[str, Column]:
    """The rules whose failures are added up by host."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "short": F.col("n_words") < 20,
        "repetitive": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > c,
        "duplicate_lines": (F.col("n_dup_lines") > 2) & (20 * F.col("n_dup_lines") > n),
        "word_length": (c < 2 * n) | (c > 15 * n),
    }


def host_verdicts(ruled: DataFrame, rules: list[str], host_col: str, max_rate: float = 0.4) -> DataFrame:
    """A row per host: documents, shrunk failure rate of each rule (``rate_<rule>``) and ``host_rejected``.

    ``ruled`` has a boolean column ``fail_<rule>`` per rule.  The prior of a rule is the beta distribution with
    the mean and variance of the hosts' rates (of at least the strength of two documents, also where rates
    do not vary or there is one host).  A host is rejected if a shrunk rate is above ``max_rate`` and above
    twice the mean of all hosts.  Hosts are summed map-side first, so a hot one is a row per task.
    """
    sums = {f"f_{r}": F.sum(F.col(f"fail_{r}").cast("long")) for r in rules}
    hosts = ruled.groupBy(F.col(host_col).alias("_host")).agg(F.count(F.lit(1)).alias("n_docs"), *[v.alias(k) for k, v in sums.items()])
    hosts = written(hosts, "hosts")
    rate = lambda r: F.col(f"f_{r}") / F.col("n_docs")
    moments = hosts.agg(*[x for r in rules for x in (F.avg(rate(r)).alias(f"m_{r}"), F.coalesce(F.var_samp(rate(r)), F.lit(0.0)).alias(f"v_{r}"))]).first()
    priors = {}
    for r in rules:
        m, v = (moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0) if moments else (0.0, 0.0)
        strength = max(2.0, min(1000.0, m * (1 - m) / v - 1 if v > 0 else 1000.0))
        priors[r] = (m * strength, strength, m)
    shrunk = {f"rate_{r}": (F.col(f"f_{r}") + a) / (F.col("n_docs") + s) for r, (a, s, _) in priors.items()}
    bad = reduce(lambda x, y: x | y, [(F.col(f"rate_{r}") > max_rate) & (F.col(f"rate_{r}") > 2 * m) for r, (_, _, m) in priors.items()])
    return hosts.withColumns(shrunk).select("_host", "n_docs", *shrunk, bad.alias("host_rejected"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = 0.4) -> DataFrame:
    """Documents with their counts, ``base_failed``, ``host_rejected`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 % of words in repeated windows.  ``kept``: not so, and not
    a document that fails any rule on a rejected host; a clean document of such a host stays.
    Null hosts are one host of their own; null texts have no words (base failed); repeated rows each count;
    an empty table gives no rows; other columns are not carried.
    """
    rules = rule_failures()
    ruled = document_rules(docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text")), "_text")
    ruled = ruled.withColumns({f"fail_{r}": c for r, c in rules.items()}).drop("_text")
    ruled = written(ruled, "rules")  # a short row per document: texts are read once
    verdicts = host_verdicts(ruled, list(rules), "_host", max_rate).withColumnRenamed("_host", "_of")
    joined = ruled.join(verdicts, F.col("_host").eqNullSafe(F.col("_of")), "left")
    base = F.col("fail_short") | F.col("fail_repetitive")
    any_rule = reduce(lambda a, b: a | b, [F.col(f"fail_{r}") for r in rules])
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~(F.col("host_rejected") & any_rule)).alias("kept"),
        *[f"rate_{r}" for r in rules],
        "host_rejected",
    )


def op1_host_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Rules and host verdicts of all documents; the source is the host."""
    done = host_quality(spark.read.parquet(f"{sf}/documents.parquet"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")

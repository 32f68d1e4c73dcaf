"""Toxicity scores and added secrets against plain versions over whole tables."""

import math
import re
from collections import defaultdict

import pytest
from brute import ALNUM_WORD, SECRETS, lower
from pyspark.sql import functions as F

from worktrail.llm import secrets, toxicity

SF = "/root/testdata/sf0.001"


# --- toxicity ----------------------------------------------------------------------------


def distances(term, word):
    """Edits between the whole term and each beginning of the word."""
    row = list(range(len(word) + 1))
    for i, c in enumerate(term, 1):
        new = [i]
        for j, d in enumerate(word, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row


def best_match(word, terms, loose):
    """Highest weight and the errors of the best term, as ``(weight, errors)``."""
    best = (0.0, 0)
    for term, stem, weight in terms:
        most = 1 if term in loose and not stem else toxicity.tolerance(term, stem)
        if not stem and abs(len(term) - len(word)) > most:
            continue
        row = distances(term, word)
        errors = min(row) if stem else row[-1]
        if errors <= most and weight * 0.8**errors > best[0] * 0.8 ** best[1] + 1e-12:
            best = (weight, errors)
    return best


def plain_score(text, terms, coefficients, seen, loose):
    text = text or ""
    found = [(m.group().lower(), m.start(), m.end()) for m in ALNUM_WORD.finditer(lower(text))]
    for w, _, _ in found:
        if w not in seen:
            seen[w] = best_match(w, terms, loose)
    direct = quoted = near = wrong = plain = 0.0
    for i, (w, a, b) in enumerate(found):
        weight, errors = seen[w]
        if not weight:
            continue
        lo, hi = max(0, i - toxicity.WINDOW), min(len(found), i + toxicity.WINDOW + 1)
        around = found[lo:hi]
        beside = sum(seen[x][0] > 0 for x, _, _ in around) - 1
        opened = sum(c in toxicity.QUOTES for c in text[found[lo][1] : a])
        closed = any(c in toxicity.QUOTES for c in text[b : found[hi - 1][2]])
        mention = any(x in toxicity.REPORTING for x, _, _ in around) or (opened % 2 == 1 and closed)
        score = weight * 0.8**errors
        wrong += errors > 0
        if mention:
            quoted += score
        else:
            direct += score * (1 + 0.25 * min(beside, 4))
            near = max(near, math.log1p(beside))
            plain += 1
    x = [math.log1p(direct), math.log1p(quoted), near, math.log1p(wrong), 10 * plain / max(len(found), 10)]
    z = coefficients[0] + sum(a * b for a, b in zip(x, coefficients[1:], strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_equal_the_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    extra = [(-1, ""), (-2, None), (-3, "they said it is a word"), (-4, " ".join(t for t, _, _ in model.terms[:50])), (-5, '"' + " ".join(t[1:] for t, _, _ in model.terms[:9]) + '"')]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, docs.select("doc_id", "text").schema))
    got = {r.doc_id: r.score for r in toxicity.score_texts(rows, model).collect()}
    seen, coefficients = {}, [float(c) for c in model.coefficients]
    want = {r.doc_id: plain_score(r.text, model.terms, coefficients, seen, model.loose) for r in rows.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in want) < 1e-5  # weights are kept in single precision
    assert any(s >= 0.3 for s in want.values()) and any(s < 0.3 for s in want.values())


def test_a_short_term_takes_an_error_only_where_clean_texts_lack_its_neighbours(spark):
    seen = [("scum", 2), ("scam", 3), ("dolt", 0), ("bolt", 1), ("do", 500), ("doolt", 1), ("twit", 5), ("twits", 0)]
    counts = spark.createDataFrame(seen, "word string, clean long")
    terms = [("scum", False, 1.0), ("dolt", False, 1.0), ("twit", False, 1.0), ("idio", True, 1.0), ("moron", False, 1.0)]
    assert toxicity.loose_terms(counts, terms, 2_000) == {"dolt", "twit"}
    assert toxicity.loose_terms(counts, terms, 1_999) == {"twit"}
    assert toxicity.loose_terms(counts, terms[3:], 2_000) == frozenset()
    trie = toxicity.Trie(terms, {"dolt"})
    assert trie.match("doolt") == (1.0, 1) and trie.match("scm") == (0.0, 0) and trie.match("scum") == (1.0, 0)


# --- secrets -----------------------------------------------------------------------------

# The forms of candidates beyond the base, in their order.
WIDER = [(k, re.compile(p), g, least) for k, (p, g, least) in secrets.WIDER.items()]


def plain_secrets(rows, max_owners):
    """``rows`` of (id, text, repo, owner): per row the spans, those added, and counts of live and copied candidates."""
    found, owners = [], defaultdict(set)
    for _, text, _, owner in rows:
        spans = lambda forms, first: [(m.start(), first + k, kind, m.end(), m.group(g)) for k, (kind, p, g, least) in enumerate(forms) for m in p.finditer(text or "") if len(m.group(g)) >= least]
        base = sorted(spans(SECRETS, 0))
        wider = [w for w in sorted(spans(WIDER, len(SECRETS))) if not any(b[0] < w[3] and w[0] < b[3] for b in base)]
        found.append((base, wider))
        for s in base + wider:
            owners[s[4]].add(owner)
    out = []
    for (i, _, _, _), (base, wider) in zip(rows, found, strict=True):
        live = [len(owners[s[4]]) <= max_owners for s in base + wider]
        added = [w for w in wider if len(owners[w[4]]) <= max_owners]
        text = lambda spans: ",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in spans)
        out.append((i, text(base), text(added), sum(live), len(live) - sum(live)))
    return sorted(out)


FORMS = [
    "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0{n}.dBjftJeZ4CVPmB92K27uhbUJU1p1r", "ghp_{n}A9b8C7d6E5f4G3h2", "xoxb-{n}-abcDEF0123456789", "Zx9{n}Qw8Er7Ty6Ui5Op4As3Df2",
    "AKIA{n}ABCDEFGHIJKLMN", "{n}deadbeef0123456789abcdef", 'password = "hunter{n}!x"', "API_KEY: 'k{n}ghp_0123456789abcdefABCD'", "token:short",
]


@pytest.mark.parametrize("max_owners", [1, 2, 3])
def test_added_spans_equal_the_plain_version(spark, max_owners):
    rows = []
    for i in range(240):
        # value n is held by about n % 5 owners; every sixth row holds the most copied value, some two forms side by side
        n = 1_000 + (0 if i % 6 == 0 else i % 40)
        text = f"line {i} é😀 " + FORMS[i % len(FORMS)].format(n=n) + (" , " if i % 2 else "") + FORMS[(i * 7) % len(FORMS)].format(n=n) + " end"
        rows.append((i, text, f"repo{i % 11}", f"owner{(i // 40) % (1 + n % 5)}"))
    rows += [(240, None, "r", "o"), (241, "", None, None), (242, rows[6][1], None, None), (243, rows[6][1], "repo1", None), (244, rows[1][1] * 300, "repo2", "owner1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string").repartition(5)
    got = secrets.scan_secrets(df, repo_col="repo", owner_col="owner", max_owners=max_owners)
    got = got.select("doc_id", secrets.span_text(F.col("base")).alias("b"), secrets.span_text(F.col("added")).alias("a"), "n_live", "n_copied")
    want = plain_secrets(rows, max_owners)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(a for _, _, a, _, _ in want) and any(copied for *_, copied in want)


def test_whole_table_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = secrets.scan_secrets(docs).select("doc_id", secrets.span_text(F.col("base")).alias("b"), secrets.span_text(F.col("added")).alias("a"), "n_live", "n_copied")
    rows = [(r.doc_id, r.text, r.source, r.source) for r in docs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == plain_secrets(rows, secrets.MAX_OWNERS)

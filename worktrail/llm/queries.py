"""Registered queries of this subpackage, with their SQL where SQL can say it.

Scores, token ids, shuffles and spans behind lookarounds have no SQL; ``tests/llm`` holds those against plain versions.
"""

from __future__ import annotations

from worktrail.llm import bpe, collocations, counts, decontaminate, minhash, quality, recurrent, resampling, secrets, sharding, substrings, tokenfiles, toxicity

QUERIES = {
    "op1_host_quality": quality.op1_host_quality,
    "op2_bpe_pair_index": bpe.op2_bpe_pair_index,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_counts": counts.op4_token_counts,
    "op5_circulant_minhash": minhash.op5_circulant_minhash,
    "op6_positional_index": decontaminate.op6_positional_index,
    "op7_seed_extend": substrings.op7_seed_extend,
    "op8_secret_ownership": secrets.op8_secret_ownership,
    "op9_two_pass_shuffle": sharding.op9_two_pass_shuffle,
    "op10_token_files": tokenfiles.op10_token_files,
    "op11_quotient_phrases": collocations.op11_quotient_phrases,
    "op12_recurrent_scores": recurrent.op12_recurrent_scores,
    "op13_importance_draw": resampling.op13_importance_draw,
}

_BLANKS = "[\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS w FROM documents)"
_OP7 = f"""WITH {_WORDS},
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s+19], ' ') ORDER BY doc_id, s) AS rn FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE rn > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (doc_id, i) GROUP BY 1),
e AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM g),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (step IS NULL OR step > 1) AS n_repeats FROM e GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_repeats, 0)::INT AS n_repeats
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _alnum(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_OP6 = f"""WITH d AS (SELECT doc_id, {_alnum('text')} AS w FROM documents), b AS (SELECT item_id, {_alnum('text')} AS w FROM benchmark),
v AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0),
m AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s+9], ' ') AS t FROM v),
z AS (SELECT DISTINCT n FROM m),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, z WHERE len(w) >= n),
h AS (SELECT doc_id, s, p.n AS n, item_id FROM p JOIN m ON m.n = p.n AND m.t = array_to_string(w[s:s+p.n-1], ' ')),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""
_OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_BLANKS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS sh
 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id, doc_id <= coalesce(m.least, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
_OP1 = f"""WITH {_WORDS},
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8),
t AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, array_to_string(w[s:s+7], ' ')) AS c FROM p),
g AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, unnest(range(s, s + 8)) AS i FROM t WHERE c > 1) GROUP BY 1),
b AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
 (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(string_split(text, chr(10))) AS x) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN g USING (doc_id)),
f AS (SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 10 * n_symbols > greatest(word_chars, 1) AS f3, n_dup_lines > 2 AND 20 * n_dup_lines > greatest(n_words, 1) AS f4,
 greatest(word_chars, 1) < 2 * greatest(n_words, 1) OR greatest(word_chars, 1) > 15 * greatest(n_words, 1) AS f5 FROM b),
h AS (SELECT source, r, count(*) AS n, sum(bad::INT) AS k FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS r, unnest([f1, f2, f3, f4, f5]) AS bad FROM f) GROUP BY 1, 2),
q AS (SELECT r, avg(k / n) AS m, coalesce(var_samp(k / n), 0) AS v FROM h GROUP BY 1),
u AS (SELECT r, m, greatest(2.0, least(1000.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS strength FROM q),
j AS (SELECT source, bool_or((k + m * strength) / (n + strength) > 0.4 AND (k + m * strength) / (n + strength) > 2 * m) AS host_rejected FROM h JOIN u USING (r) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT (host_rejected AND (f1 OR f2 OR f3 OR f4 OR f5)) AS kept, host_rejected
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source"""
_OP11 = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM d)),
g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS ph FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ph, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, ph, a, string_split(ph, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
i AS (SELECT lang, a, array_to_string(w[i:i+m-1], ' ') AS ph FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
x AS (SELECT DISTINCT c.lang, c.ph FROM c JOIN i ON c.lang = i.lang AND c.ph = i.ph AND 100::HUGEINT * i.a >= 80 * c.a),
s AS (SELECT c.lang, c.ph, c.a, j, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c ANTI JOIN x USING (lang, ph)) c
 JOIN f l ON l.lang = c.lang AND l.k = j AND l.ph = array_to_string(c.w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.ph = array_to_string(c.w[j+1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank FROM b)
SELECT lang, rank, ph AS phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""

SQL: dict[str, str] = {
    "op1_host_quality": _OP1,
    "op5_circulant_minhash": _OP5,
    "op6_positional_index": _OP6,
    "op7_seed_extend": _OP7,
    "op11_quotient_phrases": _OP11,
}

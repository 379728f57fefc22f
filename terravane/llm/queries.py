"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_nb_svm_quality": "quality",
    "op2_site_style_tree": "htmltext",
    "op3_bag_min_hash": "neardup",
    "op4_mpeg_audio": "mpeg",
    "op5_best_fit_packing": "packing",
    "op6_impact_top_k": "topk",
    "op7_suffix_dedup": "suffixes",
    "op8_warc": "warc",
    "op9_sentencepiece_scan": "pieces",
    "op10_weak_supervision_pii": "pii",
    "op11_hilbert_windows": "curves",
    "op12_phrase_collocations": "phrases",
    "op13_block_max": "blockmax",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op6_impact_top_k": OP6, "op8_warc": OP8, "op12_phrase_collocations": OP12, "op13_block_max": OP13}


OP8 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest AS dg, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to, true AS verified
FROM d LEFT JOIN f ON payload_digest = dg
"""

OP6 = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS query, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.r <> q.r WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
one AS (SELECT lang, unnest(w) AS p, 1 AS k FROM w),
two AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS p FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w)),
three AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
f1 AS (SELECT lang, p, count(*) AS f FROM one GROUP BY ALL), f2 AS (SELECT lang, p, count(*) AS f FROM two GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM three GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS p, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
c2 AS (SELECT x.lang, x.p AS phrase, x.f AS a, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * x.f * x.f // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.p = string_split(x.p, ' ')[1] JOIN f1 r ON r.lang = x.lang AND r.p = string_split(x.p, ' ')[2]
  LEFT JOIN longer g ON g.lang = x.lang AND g.p = x.p WHERE x.f >= 10 AND (g.f IS NULL OR 100 * g.f < 50 * x.f)),
c3 AS (SELECT x.lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, x.f AS a, a1.f AS l1, b1.f AS r1, a2.f AS l2, b2.f AS r2,
    CAST(1000000 AS HUGEINT) * x.f * x.f // (CAST(a1.f AS HUGEINT) * b1.f) AS s1, CAST(1000000 AS HUGEINT) * x.f * x.f // (CAST(a2.f AS HUGEINT) * b2.f) AS s2
  FROM f3 x JOIN f1 a1 ON a1.lang = x.lang AND a1.p = w1 JOIN f2 b1 ON b1.lang = x.lang AND b1.p = w2 || ' ' || w3
  JOIN f2 a2 ON a2.lang = x.lang AND a2.p = w1 || ' ' || w2 JOIN f1 b2 ON b2.lang = x.lang AND b2.p = w3),
c AS (SELECT lang, phrase, a, l, r, score FROM c2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""

_TERMS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
held AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM held),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark)),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM held) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * N_ + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, N_),
x AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_) // L_)) AS impact FROM p, s),
t AS (SELECT i, item_id, r, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM t WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""

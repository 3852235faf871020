"""DuckDB SQL for the text queries that can be said in it."""

from __future__ import annotations


def _secrets() -> str:
    kinds = {
        "assign": (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""regexp_extract(hit, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)""", 6),
        "access": ("AKIA[A-Z0-9]+", "hit", 20),
        "hex": ("[0-9a-f]{24,}", "hit", 24),
        "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", "hit", 0),
        "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "hit", 0),
        "hub": ("gh[pousr]_[A-Za-z0-9]{36,}", "hit", 0),
    }
    out = "WITH d AS (SELECT doc_id, row_number() OVER () AS nth, coalesce(text, '') AS text FROM documents),\n"
    for no, (kind, (pattern, value, least)) in enumerate(kinds.items(), 1):
        out += f"""
s{no} AS (
  SELECT nth, '{kind}' AS kind, {no} AS no, list_sum([len(g) for g in gaps[1:i]])::BIGINT + coalesce(list_sum([len(h) for h in hits[1:i - 1]]), 0)::BIGINT AS b, len(hit) AS n, length({value}) >= {least} AS ok
  FROM (SELECT nth, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i, gaps, hits
        FROM (SELECT nth, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM d))
),"""
    out += "\ns AS (" + " UNION ALL ".join(f"SELECT nth, kind, no, b, kind || ':' || b || ':' || (b + n) AS span FROM s{k} WHERE ok" for k in range(1, len(kinds) + 1)) + """)
SELECT d.doc_id, count(*) FILTER (no = 1) AS n_assign, count(*) FILTER (no = 2) AS n_access, count(*) FILTER (no = 3) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY b, no) FILTER (no <= 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY b, no), '') AS spans
FROM d LEFT JOIN s USING (nth) GROUP BY d.nth, d.doc_id"""
    return out


LEXICAL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS nth,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents
),
a AS (SELECT count(*)::BIGINT AS total, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark)
  GROUP BY item_id, term
),
p AS (
  SELECT nth, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT nth, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q)
  GROUP BY nth, doc_id, n, term
),
w AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, a GROUP BY term),
s AS (
  SELECT item_id, nth, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), a GROUP BY item_id, nth, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, embedding AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
x AS (SELECT vec_id, label, unnest(range(1, len(vec) + 1)) AS k, floor(256 * unnest(vec)::DOUBLE)::BIGINT AS v FROM e),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, any_value(a.label) = any_value(c.label) AS same, sum(a.v * c.v)::BIGINT AS score
  FROM x a JOIN x c USING (k) WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id GROUP BY a.vec_id, c.vec_id
),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS n FROM s WHERE same) WHERE n <= 5
),
r AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS n
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, n::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE n <= 5
"""

SQL = {"op11_hard_negatives": NEGATIVES, "op12_secret_ledger": _secrets(), "op13_ranked_search": LEXICAL}

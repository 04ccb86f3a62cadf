"""Queries and DuckDB SQL of this package, by name."""

from __future__ import annotations

from traceloom.llm.ann import op6_ann
from traceloom.llm.codebooks import op13_codebooks
from traceloom.llm.embedding_dedup import op8_embedding_dedup
from traceloom.llm.hard_negatives import op12_hard_negatives
from traceloom.llm.html_text import op7_html
from traceloom.llm.language import op5_language
from traceloom.llm.mixture import op4_mixture
from traceloom.llm.packing import op9_packing
from traceloom.llm.quality import op11_quality
from traceloom.llm.repeats import op10_suffix_dedup
from traceloom.llm.simhash import op1_simhash
from traceloom.llm.token_counts import op2_token_counts
from traceloom.llm.token_files import op3_token_ids

QUERIES = {
    "op1_simhash": op1_simhash,
    "op3_token_ids": op3_token_ids,
    "op4_mixture": op4_mixture,
    "op5_language": op5_language,
    "op6_ann": op6_ann,
    "op7_html": op7_html,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op11_quality": op11_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_codebooks": op13_codebooks,
}


def _assigned(n: int) -> str:
    """SQL: each part's smallest distance x 64 + entry among the codebook after n rounds."""
    return f"""
a{n} AS (SELECT v.vec_id, v.label, v.p, v.x, min(CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + b.e) AS best FROM v JOIN b{n} b ON b.p = v.p GROUP BY ALL)"""


def _round(n: int) -> str:
    """SQL: the assignment by codebook n, and the codebook that it gives."""
    return _assigned(n) + f""",
u{n} AS (SELECT p, best % 64 AS e, i, CAST(floor(sum(x[CAST(i AS INTEGER)]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS y FROM a{n}, unnest(range(1, len(x) + 1)) r(i) GROUP BY ALL),
b{n + 1} AS (SELECT b.p, coalesce(w.x, b.x) AS x, b.e FROM b{n} b LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS x FROM u{n} GROUP BY p, e) w ON w.p = b.p AND w.e = b.e)"""


ORACLES: dict[str, str] = {
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS r FROM embeddings UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.r)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.c AS component_id, r.c = e.vec_id AS kept FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id JOIN (SELECT node, min(r) AS c FROM reach GROUP BY node) r ON r.node = e.vec_id
""",
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS j, unnest(list_transform(range(0, length(h) // 2), lambda i: substr(h, CAST(2 * i + 1 AS INTEGER), 100))) AS s FROM d),
m AS (SELECT s, min(doc_id) AS first FROM w WHERE length(s) = 100 GROUP BY s),
f AS (SELECT w.doc_id, w.j, substr(w.s, 1, 2) AS b, CASE WHEN m.first < w.doc_id THEN 1 ELSE 0 END AS hit FROM w LEFT JOIN m ON m.s = w.s),
g AS (SELECT doc_id, j, b, max(hit) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), 0) = 0 THEN 1 ELSE 0 END AS span FROM g),
r AS (SELECT doc_id, sum(gone) AS n_removed, sum(span) AS n_spans, string_agg(CASE WHEN gone = 0 THEN b ELSE '' END, '' ORDER BY j) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id
""",
    "op12_hard_negatives": """
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS mate, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, score FROM s WHERE mate QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.mate AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 10
""",
    "op13_codebooks": f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, p, x[CAST(p * (len(x) // 16) + 1 AS INTEGER):CAST((p + 1) * (len(x) // 16) AS INTEGER)] AS x FROM k, range(16) r(p)),
b0 AS (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM v QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64),{_round(0)},{_round(1)},{_assigned(2)},
t AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
d AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM t, d
""",
}

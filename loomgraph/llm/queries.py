"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from loomgraph.llm.decontaminate import op8_decontaminate
from loomgraph.llm import licenses
from loomgraph.llm.langid import op7_language_id
from loomgraph.llm.licenses import op3_licenses
from loomgraph.llm.mixing import op9_mixing
from loomgraph.llm.paragraphs import op2_fingerprints
from loomgraph.llm.sharding import op4_sharding
from loomgraph.llm.simhash import op1_simhash
from loomgraph.llm.tokencount import op10_token_counts
from loomgraph.llm.toxicity import op5_toxicity
from loomgraph.llm.urlrules import op6_urls

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_fingerprints": op2_fingerprints,
    "op3_licenses": op3_licenses,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_urls": op6_urls,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
}

ORACLES = {
    "op3_licenses": licenses.oracle(),
    "op8_decontaminate": r"""
WITH w AS (
  SELECT doc_id, ws FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)
), b AS (
  SELECT item_id, ws, least(10, len(ws)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i + 1:i + k], ' ') AS g
  FROM b, (SELECT unnest(range(0, (SELECT max(len(ws)) FROM b))) AS i) WHERE i + k <= len(ws)
), ks AS (SELECT DISTINCT k FROM win),
place AS (
  SELECT doc_id, i, k, array_to_string(ws[i + 1:i + k], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w), ks WHERE i + k <= len(ws)
), hit AS (
  SELECT p.doc_id, p.i, p.k, win.item_id FROM place p JOIN win ON win.g = p.g AND win.k = p.k
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS src, md5('mix-0|' || coalesce(doc_id::VARCHAR, '')) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, coalesce(text, '') AS text
  FROM documents
), k AS (SELECT *, (('0x' || h[1:8])::BIGINT % 1024) AS b FROM d),
tok AS (SELECT src, sum(n)::BIGINT AS t FROM k GROUP BY src),
corpus AS (SELECT sum(t)::DOUBLE AS total, count(*) FILTER (t > 0) AS live FROM tok),
grid AS (SELECT unnest(range(0, 4097)) AS g),
raised AS (SELECT g, src, t, pow(t / total, g / 4096.0) AS r FROM grid, tok, corpus WHERE t > 0),
w AS (SELECT g, src, t, r / sum(r) OVER (PARTITION BY g) AS w FROM raised),
per AS (SELECT g, -sum(w * ln(w)) AS e, max(w * total / t) AS reps FROM w, corpus GROUP BY g),
chosen AS (
  SELECT greatest(coalesce((SELECT max(g) FROM per WHERE e >= CASE WHEN live > 1 THEN 0.95 * ln(live) ELSE 0 END), 0),
    coalesce((SELECT min(g) FROM per WHERE reps <= 4.0), 4096)) AS g FROM corpus
), plan AS (
  SELECT tok.src, coalesce(w.w, 0.0) AS weight, floor(coalesce(w.w * total / w.t, 1.0) + 1e-9)::INTEGER AS whole,
    round(greatest(0.0, coalesce(w.w * total / w.t, 1.0) - floor(coalesce(w.w * total / w.t, 1.0) + 1e-9)) * tok.t)::BIGINT AS part
  FROM tok CROSS JOIN corpus LEFT JOIN (SELECT w.* FROM w JOIN chosen USING (g)) w ON w.src = tok.src
), blocks AS (
  SELECT src, b, sum(sum(n)) OVER (PARTITION BY src ORDER BY md5('mix-0|pass|' || src || '|' || b::VARCHAR), b) - sum(n) AS before
  FROM k GROUP BY src, b
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY src, b ORDER BY h, n, text ROWS UNBOUNDED PRECEDING) AS upto FROM k
)
SELECT doc_id, source, n AS n_tokens, round(weight, 9) AS weight,
  (whole + CASE WHEN n > 0 AND before + upto <= part THEN 1 ELSE 0 END)::INTEGER AS copies, h AS pass_order
FROM placed JOIN blocks USING (src, b) JOIN plan USING (src)
""",
}

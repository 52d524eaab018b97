"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, 3 * source_size AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sources
), ordered AS (
  -- Caps are reached in the order of cap per weight, so the capped sources are a prefix.
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), capped AS (
  SELECT *, (total - cap_before) * weight >= CAST(cap AS HUGEINT) * weight_from AS at_cap FROM ordered
), level AS (
  SELECT any_value(total) - coalesce(sum(cap) FILTER (at_cap), 0) AS tokens,
         coalesce(sum(weight) FILTER (NOT at_cap), 0) AS weight
  FROM capped
), targets AS (
  SELECT c.source, c.source_size,
         CASE WHEN c.at_cap THEN CAST(c.cap AS DOUBLE)
              ELSE CAST(l.tokens AS DOUBLE) * c.weight / CAST(l.weight AS DOUBLE) END AS target
  FROM capped c, level l
), drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM drawn
"""

OP3 = r"""
WITH masks AS (
  SELECT m, k.a, k.b FROM (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 2), (4, 1, 3), (5, 2, 3)) k(m, a, b)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), lengths AS (
  SELECT DISTINCT least(13, len(w)) AS l FROM item_words WHERE len(w) >= 8
), doc_windows AS (
  SELECT doc_id, l, p - 1 AS pos, w[p:p + l - 1] AS t
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM doc_words, lengths WHERE len(w) >= l)
), item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, w[p:p + least(13, len(w)) - 1] AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM item_words WHERE len(w) >= 8)
), doc_keys AS (
  SELECT d.*, m, CASE WHEN l < 13 THEN hash(t) ELSE hash([t[i] FOR i IN range(1, 14) IF (i - 1) % 4 IN (a, b)]) END AS k
  FROM doc_windows d, masks
), item_keys AS (
  SELECT d.*, m, CASE WHEN l < 13 THEN hash(t) ELSE hash([t[i] FOR i IN range(1, 14) IF (i - 1) % 4 IN (a, b)]) END AS k
  FROM item_windows d, masks
), hits AS (
  SELECT DISTINCT d.doc_id, i.item_id, d.pos
  FROM doc_keys d JOIN item_keys i ON d.k = i.k AND d.m = i.m AND d.l = i.l
  WHERE len([x FOR x IN range(1, d.l + 1) IF d.t[x] <> i.t[x]]) <= CASE WHEN d.l < 13 THEN 0 ELSE 2 END
)
SELECT doc_id, item_id, min(pos) AS first_token, count(*) AS n_windows FROM hits GROUP BY doc_id, item_id
"""

OP13 = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), counted AS (
  SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), sizes AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), scaled AS (
  SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM sizes, totals
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counted, totals GROUP BY term
), item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT i.item_id, c.doc_id, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * s.m))) AS BIGINT) AS score
  FROM item_terms i JOIN weights w USING (term) JOIN counted c USING (term) JOIN scaled s ON s.doc_id = c.doc_id
  GROUP BY i.item_id, c.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""

LLM_ORACLES = {"op3_decontaminate": OP3, "op2_mix_sources": OP2, "op13_lexical_search": OP13}

"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS place,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src) - 1 AS k FROM d GROUP BY src
), w AS (
  SELECT src, source_size, CAST(source_size * 3 AS DOUBLE) AS most,
    CASE k % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight,
    CASE k % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE -0.5::DOUBLE END AS slope
  FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights,
    coalesce(sum(most) OVER before, 0) AS most_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM w
  WINDOW before AS (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, most / weight <= (total - most_before) / (weights - weight_before) AS is_full FROM l
), t AS (
  SELECT src, source_size, slope, CASE WHEN is_full THEN most ELSE
    (total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())
      / (weights - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ()) * weight END AS target
  FROM f
), b AS (
  SELECT doc_id, size, source_size, target, slope, CAST(coalesce(sum(size) OVER (
    PARTITION BY src ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t USING (src)
), n AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (start + size / 2 < target)::BIGINT + (source_size + start + size / 2 < target)::BIGINT
    + (2 * source_size + start + size / 2 < target)::BIGINT END AS n
  FROM b
), p AS (
  SELECT *, start / target AS first_share, ((n - 1) * source_size + start) / target AS last_share FROM n
)
SELECT doc_id, size, source_size, target, size * n AS taken,
  CASE WHEN n = 0 THEN NULL WHEN slope = 0 THEN round(first_share, 9)
    ELSE round((sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * first_share, 0)) - (1 - slope)) / (2 * slope), 9) + 0.0 END AS first_position,
  CASE WHEN n = 0 THEN NULL WHEN slope = 0 THEN round(last_share, 9)
    ELSE round((sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * last_share, 0)) - (1 - slope)) / (2 * slope), 9) + 0.0 END AS last_position
FROM p
""",
    "op11_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, c.rid AS other, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.rid <> a.rid AND len(a.v) = len(c.v)
), p AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) AS place
  FROM s WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.rid, place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.rid = p.rid AND NOT s.same
  AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
""",
}

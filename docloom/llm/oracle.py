"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

KNN = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.own <> c.own
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

MIXING = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM per
), x AS (
  SELECT *, 3 * source_size / weight AS ratio FROM w
), y AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
         coalesce(sum(3 * source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS capped_weight
  FROM x WINDOW before AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), z AS (
  SELECT *, (all_size - capped)::DOUBLE / (all_weight - capped_weight)::DOUBLE AS level FROM y
), t AS (
  SELECT source, source_size,
         CASE WHEN (SELECT count(*) FROM z WHERE level <= ratio) = 0 THEN (3 * source_size)::DOUBLE
              ELSE least((3 * source_size)::DOUBLE, weight * (SELECT arg_min(level, ratio) FROM z WHERE level <= ratio)) END AS target
  FROM z
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), b AS (
  SELECT *, round(target)::BIGINT - whole * source_size AS budget FROM g
), h AS (
  SELECT d.*, b.source_size, b.target, b.whole, b.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash)::BIGINT AS inside
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN upto <= budget THEN size WHEN upto - inside < budget THEN floor((budget - (upto - inside)) * size / inside) ELSE 0 END)::BIGINT AS taken,
       source
FROM h
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (k // 8 * 10 + 1)::INTEGER, 10))::BIGINT >> (35 - k % 8 * 5)) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN top END AS refers_to
FROM p
"""

USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: Integer division that rounds down.
MEAN = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"


def _code_round(k: int) -> str:
    """a{k}: the nearest entries of book b{k}; b{k + 1}: the book that follows."""
    return f"""a{k} AS (
  SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT v.row, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM v JOIN b{k} b USING (part, dim) GROUP BY 1, 2, 3) GROUP BY 1, 2
), b{k + 1} AS (
  SELECT part, entry, dim, coalesce(m.x, b.x) AS x FROM b{k} b
  LEFT JOIN (SELECT part, entry, dim, {MEAN} AS x FROM v JOIN a{k} USING (row, part) GROUP BY 1, 2, 3) m USING (part, entry, dim)
)"""


CODES = f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE {USABLE}
), w AS (SELECT ((max(len(q)) + 15) // 16)::BIGINT AS size FROM e
), v AS (
  SELECT row, i // size AS part, i % size AS dim, coalesce(q[(i + 1)::INTEGER], 0) AS x FROM e, w, LATERAL (SELECT unnest(range(16 * size)) AS i)
), b0 AS (SELECT part, row AS entry, dim, x FROM v WHERE row < 64
), {_code_round(0)}, {_code_round(1)}, {_code_round(2).partition(", b3 AS")[0]},
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, dim)) AS codebooks_sha256 FROM b2
), c AS (SELECT row, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN e USING (row), s
"""


def _cluster_round(k: int) -> str:
    return f"""a{k} AS (
  SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} c USING (dim) GROUP BY 1, 2) GROUP BY 1
), c{k + 1} AS (
  SELECT cluster, dim, coalesce(m.x, c.x) AS x FROM c{k} c
  LEFT JOIN (SELECT cluster, dim, {MEAN} AS x FROM v JOIN a{k} USING (row) GROUP BY 1, 2) m USING (cluster, dim)
)"""


CLUSTERS = f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) - 1 AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND {USABLE}
), v AS (SELECT row, generate_subscripts(q, 1) AS dim, unnest(q) AS x FROM e
), c0 AS (SELECT row AS cluster, dim, x FROM v WHERE row < 16
), {_cluster_round(0)}, {_cluster_round(1)}, {_cluster_round(2)}, {_cluster_round(3).partition(", c4 AS")[0]},
s AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY 1)
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN e USING (row) JOIN s USING (cluster)
"""

SQL: dict[str, str] = {"op2_knn": KNN, "op10_mixing": MIXING, "op11_warc": WARC, "op12_codes": CODES, "op13_clusters": CLUSTERS}

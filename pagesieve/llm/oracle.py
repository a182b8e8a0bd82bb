"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

from . import mixing, topk, urls

_W = "list_extract([" + ", ".join(f"{float(w)}" for w in mixing.WEIGHTS) + f"], CAST((row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1) % {len(mixing.WEIGHTS)} + 1 AS INTEGER))"
OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, {_W.replace(" COLLATE C", "")} AS weight, {mixing.MAX_EPOCHS} * source_size AS cap FROM s
), p AS (
  SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(weight) OVER (ORDER BY cap / weight DESC ROWS UNBOUNDED PRECEDING) AS weights FROM w
), lv AS (
  SELECT min(({mixing.SHARE} * (SELECT sum(source_size) FROM s) - caps) / (SELECT sum(q.weight) FROM p q WHERE q.ratio >= p.ratio)) AS dummy,
    max((({mixing.SHARE} * (SELECT sum(source_size) FROM s))::DOUBLE - (SELECT coalesce(sum(q.cap), 0) FROM p q WHERE q.ratio < p.ratio)::DOUBLE) / (SELECT sum(q.weight) FROM p q WHERE q.ratio >= p.ratio)) AS level FROM p
), t AS (
  SELECT w.source, source_size, least(weight * level, cap::DOUBLE) AS target FROM w, lv
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(md5('{mixing.SEED}:' || d.doc_id), 1, 15) AS BIGINT), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size + greatest(0, least(size, floor(target)::BIGINT % source_size - before)) END AS BIGINT) AS taken
FROM k
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
OP4 = rf"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), r(rhost, rpath, verdict) AS (VALUES {_RULES}), best AS (
  SELECT n, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, verdict DESC) AS k
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{urls.DEFAULT_VERDICT}') AS verdict FROM p LEFT JOIN best ON p.n = best.n AND k = 1
"""

OP8 = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {topk.QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= {topk.K}
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL = {"op1_mix_sources": OP1, "op4_url_filter": OP4, "op8_top_k": OP8, "op10_exact_dedup": OP10}

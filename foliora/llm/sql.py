"""Standard SQL for those queries of this subpackage that it can express."""

_RANKED = """
WITH items AS (
  SELECT query_id, id, min(raw_distance) AS a, min(raw_bm25) AS b, min(-keyword_score) AS c, min(-rerank_score) AS d, min(-click_count) AS e
  FROM search_results WHERE id IS NOT NULL GROUP BY query_id, id),
ranked AS (
  SELECT query_id, id,
    rank() OVER (PARTITION BY query_id ORDER BY a NULLS LAST) + (count(*) OVER (PARTITION BY query_id, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY query_id ORDER BY b NULLS LAST) + (count(*) OVER (PARTITION BY query_id, b) - 1) / 2.0 AS rb,
    rank() OVER (PARTITION BY query_id ORDER BY c NULLS LAST) + (count(*) OVER (PARTITION BY query_id, c) - 1) / 2.0 AS rc,
    rank() OVER (PARTITION BY query_id ORDER BY d NULLS LAST) + (count(*) OVER (PARTITION BY query_id, d) - 1) / 2.0 AS rd,
    rank() OVER (PARTITION BY query_id ORDER BY e NULLS LAST) + (count(*) OVER (PARTITION BY query_id, e) - 1) / 2.0 AS re
  FROM items),
placed AS (
  SELECT query_id, id, CAST(list_sort([ra, rb, rc, rd, re])[3] AS DOUBLE) AS median_rank, CAST((ra + rb + rc + rd + re) / 5.0 AS DOUBLE) AS mean_rank FROM ranked),
final AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, id) AS INTEGER) AS place FROM placed)
"""

SQL = {
    "p5_found": _RANKED + "SELECT query_id, id FROM final WHERE place = 1",
    "p5_ranking": _RANKED + "SELECT query_id, id, round(median_rank, 6) AS median_rank, round(mean_rank, 6) AS mean_rank, place FROM final",
    "p7_found": r"""
SELECT 'documents' AS item_table, CAST(d.doc_id AS VARCHAR) AS item_key
FROM (SELECT DISTINCT doc_id, text, file_type FROM documents) d JOIN chunk_limits l ON l.item_table = 'documents' AND l.file_type = lower(d.file_type)
WHERE length(regexp_replace(d.text, '[^\p{L}\p{N}]', '', 'g')) > l.max_size
UNION ALL
SELECT 'chunks', c.chunk_id
FROM (SELECT DISTINCT chunk_id, content FROM chunks) c JOIN chunk_limits l ON l.item_table = 'chunks' AND l.file_type = '*'
WHERE length(regexp_replace(c.content, '[^\p{L}\p{N}]', '', 'g')) > l.max_size""",
}

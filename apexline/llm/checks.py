"""Check SQL, where SQL can express an operator."""

CHECKS = {
    "op3_lines": """
WITH line AS (
  SELECT doc_id, n - 1 AS line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(l, '\\s+'), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
class AS (SELECT w, len(w) AS size, min((doc_id, line_no)) AS head FROM line WHERE len(w) > 0 GROUP BY w),
word AS (SELECT head, w, size, unnest(w) AS x FROM class),
rarity AS (SELECT x, count(*) AS n FROM word GROUP BY x),
prefix AS (
  SELECT head, w, size, x FROM word JOIN rarity USING (x)
  QUALIFY row_number() OVER (PARTITION BY head ORDER BY n, x) <= size - (4 * size + 4) // 5 + 1),
near AS (
  SELECT DISTINCT a.head FROM prefix a JOIN prefix b ON a.x = b.x AND b.head < a.head
    AND 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)
  WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.size + b.size)),
judged AS (
  SELECT doc_id, line_no, c.head <> (doc_id, line_no) OR c.head IN (SELECT head FROM near) AS gone
  FROM line JOIN class c USING (w))
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, count(j.line_no) AS n_removed,
  coalesce(string_agg(CAST(j.line_no AS VARCHAR), ',' ORDER BY j.line_no), '') AS removed
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id AND j.gone GROUP BY d.doc_id, text""",
    "op6_suffixes": """
WITH shown AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
place AS (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM shown),
piece AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS INTEGER), 200)) AS w FROM place),
again AS (
  SELECT doc_id, i FROM piece QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
marked AS (
  SELECT doc_id, i, i > 100 + coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS opens FROM again),
run AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked) GROUP BY doc_id, r),
edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
rest AS (
  SELECT e.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) AS kept
  FROM edge e JOIN shown USING (doc_id) GROUP BY e.doc_id)
SELECT s.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS INTEGER)))) AS kept_sha256
FROM shown s LEFT JOIN rest r USING (doc_id)""",
}

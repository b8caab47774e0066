"""SQL for line and sentence deduplication."""

OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k,
         len(string_split(coalesce(text, ''), chr(10))) AS n
  FROM documents),
placed AS (
  SELECT *, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM lines),
line_units AS (
  SELECT doc_id, line AS unit, pos AS s, pos + length(line) + CASE WHEN k < n THEN 1 ELSE 0 END AS e FROM placed),
parts AS (
  SELECT doc_id, k, pos, regexp_extract_all(line, '[^.!?]*[.!?]+[ \t]*|[^.!?]+$') AS p FROM placed),
sentences AS (
  SELECT doc_id, k, pos, unnest(p) AS unit, generate_subscripts(p, 1) AS j FROM parts WHERE len(p) > 1),
sentence_units AS (
  SELECT doc_id, unit, pos + o AS s, pos + o + length(unit) AS e
  FROM (SELECT *, (coalesce(sum(length(unit)) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS o FROM sentences)),
units AS (
  SELECT doc_id, s, e, least_words, trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS u
  FROM (SELECT *, 1 AS least_words FROM line_units UNION ALL SELECT *, 6 AS least_words FROM sentence_units)),
counted AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id, s, e) AS r FROM units WHERE u <> '' AND length(u) - length(replace(u, ' ', '')) + 1 >= least_words),
gone AS (SELECT DISTINCT doc_id, s, e FROM counted WHERE r > 1),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gone),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS run FROM reach),
merged AS (SELECT doc_id, run, min(s) AS s, max(e) AS e, count(*) AS n FROM runs GROUP BY doc_id, run),
passages AS (
  SELECT doc_id, count(*) AS n_passages FROM merged JOIN documents USING (doc_id)
  WHERE len(regexp_extract_all(substr(text, 1 + s, e - s), '[^\x20\x09-\x0D]+')) >= 25 GROUP BY doc_id),
kept AS (
  SELECT doc_id, sum(n)::BIGINT AS n_removed, string_agg(s || ':' || e, ',' ORDER BY s) AS removed, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM merged GROUP BY doc_id),
cleaned AS (
  SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
    CASE WHEN n_removed IS NULL THEN coalesce(text, '')
         ELSE array_to_string(list_transform(range(1, len(ss) + 2), lambda i: substr(text, 1 + CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END,
           CASE WHEN i > len(ss) THEN length(text) ELSE ss[i] END - CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END)), '') END AS clean
  FROM documents d LEFT JOIN kept USING (doc_id))
SELECT doc_id, n_removed, coalesce(n_passages, 0)::BIGINT AS n_passages, removed, length(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256
FROM cleaned LEFT JOIN passages USING (doc_id)
"""

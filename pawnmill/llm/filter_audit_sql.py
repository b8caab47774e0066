"""DuckDB SQL for the filter audit."""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(least < w.doc_id, false)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), n AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), k AS (SELECT unnest(range(1, 6)) AS k), o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM k a JOIN k b ON b.k <> a.k JOIN k c ON c.k NOT IN (a.k, b.k) JOIN k d ON d.k NOT IN (a.k, b.k, c.k) JOIN k e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), s AS (
  SELECT ks, array_to_string(list_transform(ks, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, k.k AS step, ks[k.k] AS own, ks[1:k.k - 1] AS before FROM o, k
), e AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS its, len(list_filter(before, lambda x: fails[x])) > 0 AS earlier,
         len(list_filter(fails, lambda x: x)) AS many
  FROM n, s
), r AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         coalesce(sum(n) FILTER (NOT its AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (its AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (its AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (its AND many = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (its AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (its AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM e GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

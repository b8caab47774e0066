"""SQL for the mix: its totals in closed form, and the places from the golden-ratio schedule."""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS draw
  FROM documents),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source),
weighted AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, [5, 2, 1][1 + ((nth - 1) % 3)::INT] AS weight FROM per_source),
levels AS (
  SELECT *, most / weight AS ratio,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
       - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted),
fill AS (SELECT arg_min(level, ratio) AS fill FROM levels WHERE level <= ratio),
goals AS (SELECT source, source_size, least(most, fill * weight) AS target, round(least(most, fill * weight))::BIGINT AS budget FROM levels, fill),
spans AS (
  SELECT g.source, budget, s.source_size, ceil(s.source_size / 1024) AS blocks, sum(target) OVER (ORDER BY nth) AS upto, target, sum(target) OVER () AS whole
  FROM goals g JOIN per_source s ON g.source IS NOT DISTINCT FROM s.source),
points AS (
  SELECT slot, (((floor(slot / 65536) * 0.4754867131123319::DOUBLE) % 1) + (((slot % 65536) * 0.6180339887498949::DOUBLE) % 1)) % 1 AS point
  FROM (SELECT unnest(generate_series(0, (SELECT ceil(max(whole) / 1024)::BIGINT - 1 FROM spans))) AS slot)),
drawn AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth_slot
  FROM points JOIN spans ON budget > 0 AND point >= (upto - target) / whole AND point < upto / whole),
places AS (
  SELECT source, nth_slot, slot FROM drawn
  UNION ALL  -- what the schedule's discrepancy leaves short comes after all its slots
  SELECT source, nth_slot, (SELECT count(*) FROM points) + nth_slot
  FROM (SELECT s.source, unnest(generate_series((SELECT count(*) FROM drawn d WHERE d.source IS NOT DISTINCT FROM s.source), (ceil(source_size / 1024)::BIGINT - 1))) AS nth_slot FROM spans s WHERE budget > 0))
SELECT p.doc_id, size, g.source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (budget // g.source_size) * size
    + greatest(least(start + size, budget % g.source_size) - start, 0) END::BIGINT AS taken,
  CASE WHEN size > 0 AND start < budget THEN t.slot::BIGINT END AS first_slot
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
LEFT JOIN places t ON p.source IS NOT DISTINCT FROM t.source AND t.nth_slot = p.start // 1024
"""

"""DuckDB SQL for the conversation prefix trie."""

OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), bits AS (  -- CRC-32 of the decimal id, bit by bit: a byte comes in before its first shift
  SELECT *, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS b FROM turns
), heads AS (
  SELECT conv_id, s, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END), 4294967295) % 4 AS h
  FROM bits
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s FROM heads c LEFT JOIN turns b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, s[1:d] AS p, d AS depth, len(s) = d AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * len(regexp_extract_all(coalesce(p[depth].t, ''), '[^\x20\x09-\x0D]+')) AS saving
  FROM prefixes GROUP BY p, depth
), children AS (
  SELECT p[1:depth - 1] AS of, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY of
), tops AS (
  SELECT n.depth AS d, n.saving, c.n IS NULL AS leaf, n.p[1:a.a] AS top FROM nodes n LEFT JOIN children c ON c.of = n.p, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS a) a
), subtrees AS (
  SELECT top, count(*) AS size, count(*) FILTER (leaf) AS n_leaves, sum(saving) AS saved FROM tops GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes q ON n.depth > 0 AND q.p = n.p[1:n.depth - 1] LEFT JOIN children c ON c.of = n.p JOIN subtrees s ON s.top = n.p
"""

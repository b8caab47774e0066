"""SQL of the workflow queries."""

from __future__ import annotations

from .oracle import N_EVAL, N_TEST, VOCAB, _holdout, _win
from .queries import MOVETEXTS

_quote = lambda t: "NULL" if t is None else "'" + t.replace("'", "''") + "'"
_TEXTS = ", ".join(f"({k}, {_quote(n)}, {_quote(t)}, {_quote(u)})" for k, (n, t, u) in enumerate(MOVETEXTS))

RAW = f"""
texts AS (SELECT * FROM (VALUES {_TEXTS}) v(k, name, movetext, uci)),
raw AS (
  SELECT o_orderkey, movetext, uci, CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' WHEN 'P' THEN '1/2-1/2' ELSE '*' END AS result,
    CASE WHEN o_orderkey % 13 <> 0 THEN 800 + o_orderkey % 1900 END AS white, 900 + o_custkey % 1700 AS black, o_orderkey % 40 AS dw, -(o_orderkey % 33) AS db,
    CASE WHEN o_orderkey % 10 <> 0 THEN 'Normal' ELSE 'Time forfeit' END AS termination,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Rated Bullet game' ELSE 'Rated Blitz game' END AS event
  FROM orders JOIN texts ON o_orderkey % {len(MOVETEXTS)} = k),
base AS (SELECT * FROM raw WHERE termination = 'Normal' AND contains(lower(event), 'blitz'))"""


def _examples(source: str) -> str:
    return f"""
classed AS (
  SELECT o_orderkey, uci, CASE result WHEN '1-0' THEN 'white' WHEN '0-1' THEN 'black' WHEN '1/2-1/2' THEN 'draw' END AS result,
    CASE WHEN white IS NULL THEN 'unknown' WHEN (white + black) // 2 < 1200 THEN '<1200' WHEN (white + black) // 2 < 1600 THEN '1200-1600' WHEN (white + black) // 2 < 2000 THEN '1600-2000' ELSE '2000+' END AS elo_bucket,
    CASE split_part(uci, ' ', 1) WHEN 'e2e4' THEN 'e4' WHEN 'd2d4' THEN 'd4' WHEN 'c2c4' THEN 'c4' WHEN 'g1f3' THEN 'Nf3' ELSE 'other' END AS opening_family,
    CASE WHEN result = '1/2-1/2' THEN 'draw' ELSE 'decisive' END AS termination_type
  FROM {source} WHERE uci IS NOT NULL),
sided AS (SELECT *, unnest(CASE result WHEN 'draw' THEN ['<WHITE>', '<BLACK>'] WHEN 'white' THEN ['<WHITE>'] ELSE ['<BLACK>'] END) AS side FROM classed WHERE result IS NOT NULL),
examples AS (
  SELECT o_orderkey, elo_bucket, result, opening_family, termination_type, side || ' ' || uci || CASE WHEN result = 'draw' THEN ' <DRAW>' ELSE '' END || ' <EOS>' AS sequence FROM sided)"""


SQL = {
    "process_games": f"WITH {RAW}, {_examples('raw')} SELECT * FROM examples",
    "prepare_examples": f"WITH {RAW}, firsts AS (SELECT * FROM base ORDER BY o_orderkey LIMIT 2000), {_examples('firsts')} SELECT * FROM examples",
    "high_elo_games": f"WITH {RAW} SELECT o_orderkey FROM base WHERE white >= 1200 AND black >= 1200 AND abs(dw) <= 25 AND abs(db) <= 25 AND abs(white - black) <= 300",
    "first_rows": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000",
    "strip_columns": "SELECT item_id, length(text)::INT AS n FROM benchmark",
    "raw_game_scan": f"WITH {RAW} SELECT result AS Result, movetext, count(*) AS n FROM base GROUP BY ALL",
    "shard_round_trip": "SELECT o_orderkey, o_custkey, true AS numbered FROM orders",
    "split_round_trip": f"""
WITH {_holdout('SELECT doc_id, lang FROM documents', 'lang', 'doc_id', f'SELECT ({N_EVAL}) + ({N_TEST})', '42')},
test AS (SELECT doc_id FROM holdout ORDER BY md5('42:split:' || doc_id), doc_id LIMIT ({N_TEST}))
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM holdout) AND doc_id NOT IN (SELECT doc_id FROM test)""",
    "record_log": "SELECT 'per_legal_rate' AS record_type, doc_id::VARCHAR AS position_id, toxic::VARCHAR AS model_move, quality = 1 AS legal FROM labels",
    "record_log_file": "SELECT 'per_legal_rate' AS record_type, doc_id::VARCHAR AS position_id, toxic::VARCHAR AS model_move, quality = 1 AS legal FROM labels",
    "record_stream": "SELECT doc_id::VARCHAR AS position_id, quality = 1 AS legal FROM labels",
    "example_stream": f"""
WITH {RAW}, {_examples('base')}
SELECT elo_bucket, result, opening_family, termination_type, count(*) AS n, sum(len(string_split(sequence, ' ')))::BIGINT AS tokens FROM examples GROUP BY ALL""",
    "fen_lines": "SELECT 'positions.fen:' || (n_nationkey + 1) AS position_id, 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - ' || n_nationkey || ' ' || (n_nationkey + 1) AS fen FROM nation WHERE n_nationkey % 4 <> 3",
    "sequence_lines": """
SELECT 'g' || item_id AS id, CASE WHEN item_id % 5 <> 0 THEN 2 ELSE 0 END AS n,
  CASE WHEN item_id % 3 = 2 THEN 'perspective must be white or black' WHEN item_id % 5 = 0 THEN 'moves must be a list that is not empty' END AS error
FROM benchmark ORDER BY item_id LIMIT 30""",
    "score_games": f"""
WITH {RAW}, v AS ({VOCAB}),
s AS (SELECT o_orderkey, string_split(CASE WHEN o_orderkey % 2 = 0 THEN '<WHITE> ' ELSE '<BLACK> ' END || uci || CASE WHEN result = '1/2-1/2' THEN ' <DRAW>' ELSE '' END, ' ') AS w FROM raw WHERE o_orderkey % 11 < 9),
e AS (SELECT o_orderkey, unnest(w) AS token, generate_subscripts(w, 1) AS k, len(w) AS n FROM s)
SELECT o_orderkey, string_agg(id::VARCHAR, ' ' ORDER BY k) AS ids, (any_value(n) - 1)::INT AS n, round(-(any_value(n) - 1) * ln(1974), 9) AS total FROM e JOIN v USING (token) GROUP BY o_orderkey""",
    "legal_predictions": f"""
WITH {RAW} SELECT o_orderkey::VARCHAR AS position_id, CASE WHEN len(string_split(uci, ' ')) % 2 = 0 THEN 'white' ELSE 'black' END AS perspective, '<PAD>' AS model_move, false AS legal FROM raw WHERE uci IS NOT NULL""",
    "sample_top_k": """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings)
SELECT vec_id, arg_min(id, (-x, id))::INT AS greedy, arg_min(id, (-x, id))::INT AS best, true AS among_five FROM e GROUP BY vec_id""",
    "illegal_negatives": """
WITH r AS (SELECT l_orderkey, l_linenumber, list_transform(range(0, l_linenumber % 4 + 1), lambda i: (i * 3 + l_partkey) % 10) AS legal FROM lineitem),
x AS (SELECT *, list_filter(range(10), lambda k: NOT list_contains(legal, k)) AS rest FROM r)
SELECT l_orderkey, l_linenumber, rest[1 + (('0x' || substr(md5('11:' || l_orderkey || ':' || l_linenumber), 1, 12))::BIGINT % len(rest))::INT]::VARCHAR AS rejected FROM x""",
    "pgn_round_trip": f"""
SELECT printf('game-%04d', (row_number() OVER (ORDER BY k) - 1)::INT) AS game_id, name, uci FROM (VALUES {_TEXTS}) v(k, name, movetext, uci) WHERE uci IS NOT NULL""",
    "puzzle_scan": """
SELECT p_partkey AS puzzle_id, p_brand || ' ' || p_size AS solution, p_size * 40 AS rating, 2 AS n_themes FROM part WHERE p_size * 40 BETWEEN 500 AND 1500 AND substr(p_brand, 7, 1) IN ('1', '3')""",
    "vocabulary_file": VOCAB,
    "report_match": _win("true", True, "*, 4 AS skill"),
    "run_names": """
SELECT c_custkey, printf('game-%04d', c_custkey) AS game_id, printf('game-%04d', c_custkey) || ':ply' || (c_custkey % 90) AS position_id, '2026-04-19T20-15-00_some-name_legal-rate' AS run_id FROM customer""",
    "run_folder": "SELECT 'legal_rate' AS evaluator, 'r' AS run_id, 'c' AS checkpoint, 'p.fen' AS positions_path, 0.5::DOUBLE AS temperature",
    "game_move_join": "SELECT o_orderstatus AS result, l_linenumber AS ply, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "balanced_eval": """
WITH d AS (SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars // 100 < 20 THEN 'short' WHEN n_chars // 100 < 60 THEN 'middle' ELSE 'long' END AS length FROM documents)
SELECT doc_id, length FROM d QUALIFY row_number() OVER (PARTITION BY length ORDER BY md5('3:' || doc_id), doc_id) <= 40""",
    "time_controls": f"""
WITH {RAW}, c AS (SELECT CASE WHEN contains(lower(event), 'bullet') THEN 'bullet' WHEN contains(lower(event), 'blitz') THEN 'blitz' ELSE 'other' END AS control, len(string_split(uci, ' ')) AS plies FROM raw)
SELECT control, CASE WHEN plies IS NULL THEN 'unknown' WHEN plies < 20 THEN 'short' WHEN plies < 60 THEN 'middle' ELSE 'long' END AS length, count(*) AS n FROM c GROUP BY ALL""",
    "played_games": """
SELECT printf('game-%04d', i::INT) AS game_id, CASE WHEN i % 2 = 0 THEN 'white' ELSE 'black' END AS model_side, '*' AS result, 'max-plies' AS termination, 6 AS ply_count FROM range(12) t(i)""",
}

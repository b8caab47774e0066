"""The same queries as SQL over the driver's views."""

from __future__ import annotations

from .queries import MOVETEXTS, POSITIONS

VOCAB = """
WITH sq AS (SELECT a.range % 8 AS f1, a.range // 8 AS r1, b.range % 8 AS f2, b.range // 8 AS r2 FROM range(64) a, range(64) b),
named AS (SELECT *, abs(f1 - f2) AS df, abs(r1 - r2) AS dr,
  substr('abcdefgh', (f1 + 1)::INT, 1) || (r1 + 1) || substr('abcdefgh', (f2 + 1)::INT, 1) || (r2 + 1) AS token FROM sq),
every AS (
  SELECT 0 AS block, s, t AS token FROM (VALUES ('00', '<PAD>'), ('01', '<UNK>'), ('02', '<EOS>'), ('03', '<WHITE>'), ('04', '<BLACK>'), ('05', '<DRAW>')) v(s, t)
  UNION ALL SELECT 1, token, token FROM named WHERE ((df = 0 OR dr = 0 OR df = dr) AND df + dr > 0) OR df * dr = 2
  UNION ALL SELECT 2, token || p, token || p FROM named, (VALUES ('q'), ('r'), ('b'), ('n')) v(p) WHERE df <= 1 AND ((r1 = 6 AND r2 = 7) OR (r1 = 1 AND r2 = 0)))
SELECT token, row_number() OVER (ORDER BY block, s) - 1 AS id FROM every
"""

GAMES = """
SELECT CASE WHEN o_orderkey % 17 = 0 THEN '*' WHEN o_orderstatus = 'F' THEN '1-0' WHEN o_orderstatus = 'O' THEN '0-1' WHEN o_orderstatus = 'P' THEN '1/2-1/2' ELSE '*' END AS result,
       CASE WHEN o_orderkey % 2 = 0 THEN 'white' ELSE 'black' END AS model_side FROM orders
"""


def _win(where: str, sides: bool, only: str = "*") -> str:
    strata = "('overall', 'overall')" + (", ('model_side', 'white'), ('model_side', 'black')" if sides else "")
    return f"""
WITH g AS (SELECT * FROM ({GAMES}) WHERE {where}),
s AS (SELECT * FROM (VALUES {strata}) v(dimension, stratum)),
c AS (SELECT dimension, stratum, count(result) AS games,
    count(*) FILTER ((result = '1-0' AND model_side = 'white') OR (result = '0-1' AND model_side = 'black')) AS wins,
    count(*) FILTER ((result = '1-0' AND model_side = 'black') OR (result = '0-1' AND model_side = 'white')) AS losses,
    count(*) FILTER (result = '1/2-1/2') AS draws, count(*) FILTER (result = '*') AS unfinished
  FROM s LEFT JOIN g ON dimension = 'overall' OR stratum = model_side GROUP BY dimension, stratum),
r AS (SELECT *, coalesce(wins::DOUBLE / nullif(games - unfinished, 0), 0.0)::DOUBLE AS win_rate,
    coalesce((wins + 0.5::DOUBLE * draws) / nullif(games - unfinished, 0), 0.0)::DOUBLE AS score_rate FROM c)
SELECT {only} FROM r
"""


MOVES = """
SELECT l_orderkey || '-' || l_linenumber AS fen_before, l_orderkey AS game_id, l_linenumber AS ply,
  CASE WHEN l_linenumber % 2 = 0 THEN 'white' ELSE 'black' END AS side_to_move, (l_partkey % 50)::VARCHAR AS model_move,
  CASE WHEN l_suppkey % 5 <> 0 THEN (l_partkey % 49)::VARCHAR END AS sf_best_move, (l_suppkey % 7)::VARCHAR AS raw_sample_move,
  l_suppkey % 7 <> 3 AS raw_sample_legal, l_returnflag <> 'A' AS mask_used,
  trunc(l_quantity * 10)::INT AS before_cp, floor(l_tax * 1000)::INT AS after_cp FROM lineitem
"""
LOSSES = f"SELECT *, greatest(0, CASE WHEN side_to_move = 'black' THEN after_cp - before_cp ELSE before_cp - after_cp END) AS loss FROM ({MOVES})"

WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
WORD_VOCAB = rf"""
SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT DISTINCT unnest({WORDS}) AS token FROM benchmark)
"""

LOGPROBS = "SELECT vec_id, label, list_transform(embedding, lambda x: -abs(x::DOUBLE)) AS lp FROM embeddings"


def _ppl(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
WITH t AS (SELECT {lead}count(*) AS num_sequences, sum(len(lp))::BIGINT AS num_tokens, sum(coalesce(list_sum(lp), 0)) AS s FROM ({LOGPROBS}) {group}),
n AS (SELECT *, CASE WHEN num_tokens > 0 THEN -s / num_tokens ELSE 0 END AS nll FROM t)
SELECT {lead}num_sequences, num_tokens, round(nll, 9) AS mean_nll, round(nll / ln(2), 9) AS bits_per_token,
  round(CASE WHEN num_tokens > 0 THEN exp(nll) ELSE 0 END, 9) AS perplexity FROM n
"""


def _holdout(source: str, strata: str, key: str, size: str, seed: str) -> str:
    """Common table expressions that end in ``holdout``."""
    return f"""
base AS (SELECT *, md5('{seed}:' || {key}) AS o, md5('{seed}:cut:' || {key}) AS c FROM ({source})),
quotas AS (SELECT {strata}, least(greatest(1, round_even(({size})::DOUBLE * count(*) / sum(count(*)) OVER (), 0)), count(*)) AS quota FROM base GROUP BY {strata}),
ranked AS (SELECT b.*, quota, row_number() OVER (PARTITION BY {', '.join('b.' + s.strip() for s in strata.split(','))} ORDER BY o) AS r FROM base b JOIN quotas q USING ({strata})),
chosen AS (SELECT * FROM ranked WHERE r <= quota ORDER BY c, {key} LIMIT ({size})),
rest AS (SELECT *, 1 AS late FROM base WHERE {key} NOT IN (SELECT {key} FROM chosen)),
pool AS (SELECT {key}, o, 0 AS late FROM chosen UNION ALL SELECT {key}, o, 1 FROM rest),
holdout AS (SELECT {key} FROM pool ORDER BY late, o, {key} LIMIT ({size}))
"""


N_EVAL = "SELECT greatest(1, round_even(count(*) * 0.04::DOUBLE, 0))::BIGINT FROM documents"
N_TEST = "SELECT greatest(1, round_even(count(*) * 0.01::DOUBLE, 0))::BIGINT FROM documents"


def _values() -> str:
    quote = lambda t: "NULL" if t is None else "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({quote(n)}, {quote(u)})" for n, _, u in MOVETEXTS)


LARGE = f"""
d AS (SELECT doc_id, {WORDS.replace('text', "coalesce(text, '')", 1)} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM d),
v AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT token FROM e GROUP BY token HAVING count(DISTINCT doc_id) >= 2))"""


def _fit(rounds: int, prior: float) -> str:
    """The rounds of the rating fit, one common table expression each."""
    steps = [f"""
r{k} AS (SELECT p.player, any_value(won) / (sum(games / (a.s + b.s)) + {prior}::DOUBLE / (any_value(a.s) + 1)) AS s
  FROM p JOIN r{k - 1} a ON a.player = p.player JOIN r{k - 1} b ON b.player = p.opponent JOIN t ON t.player = p.player GROUP BY p.player)""" for k in range(1, rounds + 1)]
    return f"""
WITH g AS (SELECT o_custkey % 40 AS a, 40 + o_orderkey % 25 AS b, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0 ELSE 0.5 END AS x FROM orders),
p AS (SELECT a AS player, b AS opponent, count(*) AS games, sum(x) AS points FROM g GROUP BY ALL UNION ALL SELECT b, a, count(*), sum(1 - x) FROM g GROUP BY ALL),
t AS (SELECT player, sum(points) + {prior}::DOUBLE / 2 AS won FROM p GROUP BY player), r0 AS (SELECT player, 1.0::DOUBLE AS s FROM t),{','.join(steps)}
SELECT player AS player_id, round(s, 9) AS strength, round(400 * log10(s), 9) AS elo FROM r{rounds}"""


SQL = {
    "vocab_build": VOCAB,
    "base_filter": "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = 'Brand#4' AND contains(lower(p_type), 'eco')",
    "range_anomaly_filter": """
SELECT event_id, a, b FROM (SELECT event_id, props->>'$.k' AS a, floor(value)::BIGINT::VARCHAR AS b, (event_id % 60)::INT AS da, CASE WHEN event_id % 7 <> 0 THEN 5 END AS db FROM events)
WHERE try_cast(a AS INT) >= 10 AND try_cast(b AS INT) >= 10 AND abs(da) <= 30 AND abs(db) <= 30 AND abs(try_cast(a AS INT) - try_cast(b AS INT)) <= 200""",
    "bucketize": """
SELECT c_custkey, floor(v)::BIGINT AS floored, CASE WHEN v IS NULL THEN 'unknown' WHEN v < 0 THEN '<0' WHEN v < 2500 THEN '0-2500' WHEN v < 5000 THEN '2500-5000' ELSE '5000+' END AS bucket
FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS v FROM customer)""",
    "rating_bucket": """
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' WHEN m < 1200 THEN '<1200' WHEN m < 1600 THEN '1200-1600' WHEN m < 2000 THEN '1600-2000' ELSE '2000+' END AS bucket
FROM (SELECT o_orderkey, floor((800 + o_orderkey % 1900 + 900 + o_custkey % 1700) / 2) AS m FROM orders)""",
    "map_default": """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'other' END AS family,
  CASE o_orderstatus WHEN 'F' THEN 'white' WHEN 'O' THEN 'black' END AS outcome, CASE WHEN o_orderstatus = 'P' THEN 'draw' ELSE 'decisive' END AS kind FROM orders""",
    "outcome_expand": """
SELECT o_orderkey, unnest(CASE o_orderstatus WHEN 'P' THEN ['white', 'black'] WHEN 'F' THEN ['white'] WHEN 'O' THEN ['black'] END) AS perspective FROM orders""",
    "skip_counts": """
SELECT count(*) AS processed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS skipped, sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END)::BIGINT AS examples FROM orders""",
    "tokenize_whitespace": f"SELECT conv_id, turn, len(w)::INT AS n_words, w[1] AS first_word FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations)",
    "encode_ids": f"""
WITH v AS ({WORD_VOCAB}), t AS (SELECT conv_id, turn, {WORDS.replace('text', "coalesce(text, '')", 1)} AS w FROM conversations),
e AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM t),
s AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (id IS NULL) AS u, sum(coalesce(id, 1)) AS total, string_agg(coalesce(id, 1)::VARCHAR, ' ' ORDER BY k) AS ids FROM e LEFT JOIN v USING (token) GROUP BY conv_id, turn)
SELECT coalesce(ids, '') AS ids, t.conv_id, t.turn, coalesce(n, 0)::INT AS n_ids, coalesce(u, 0)::INT AS n_unknown, coalesce(total, 0)::BIGINT AS id_sum, coalesce(n, 0)::INT AS n_mask FROM t LEFT JOIN s USING (conv_id, turn)""",
    "decode_roundtrip": f"SELECT item_id, array_to_string({WORDS}, ' ') AS decoded FROM benchmark",
    "sequence_format": """
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '<WHITE> ' ELSE '<BLACK> ' END || string_agg(role, ' ' ORDER BY turn) || CASE WHEN conv_id % 3 = 0 THEN ' <DRAW>' ELSE '' END || ' <EOS>' AS sequence
FROM conversations GROUP BY conv_id""",
    "strata_counts": """
SELECT lang, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS length, source, count(*) AS n FROM documents GROUP BY ALL""",
    "frequencies": """
SELECT 'lang' AS dimension, lang AS stratum, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""",
    "stratified_holdout": f"WITH {_holdout('SELECT doc_id, lang, source FROM documents', 'lang, source', 'doc_id', '50', '42')} SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM holdout)",
    "three_way_split": f"""
WITH {_holdout('SELECT doc_id, lang FROM documents', 'lang', 'doc_id', f'SELECT ({N_EVAL}) + ({N_TEST})', '42')},
test AS (SELECT doc_id FROM holdout ORDER BY md5('42:split:' || doc_id), doc_id LIMIT ({N_TEST}))
SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM test) THEN 'test' WHEN doc_id IN (SELECT doc_id FROM holdout) THEN 'eval' ELSE 'train' END AS split FROM documents""",
    "sample_positions": """
WITH g AS (SELECT conv_id, list(role ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, unnest(range(len(m)))::INT AS ply, m FROM g)
SELECT conv_id, ply, coalesce(array_to_string(m[1:ply], ' '), '') AS prefix FROM p ORDER BY md5('0:' || conv_id || ':' || ply), conv_id, ply LIMIT 100""",
    "phase_by_ply": """
SELECT CASE WHEN ply < 5 THEN 'opening' WHEN ply < 15 THEN 'middle' ELSE 'endgame' END AS phase, CASE WHEN ply % 2 = 0 THEN 'white' ELSE 'black' END AS side, count(*) AS n
FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply FROM events) GROUP BY ALL""",
    "prior_move": """
SELECT conv_id, turn, role, length(text)::INT AS n, lag(role) OVER w AS prior_role, lag(length(text)::INT) OVER w AS prior_n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "event_ids": """
WITH l AS (SELECT conv_id % 5 AS run, conv_id, turn AS ply, false AS is_game, NULL::BIGINT AS ply_count FROM conversations
  UNION ALL SELECT conv_id % 5, conv_id, NULL, true, count(*) FROM conversations GROUP BY conv_id)
SELECT *, (row_number() OVER (PARTITION BY run ORDER BY conv_id, is_game, ply) - 1)::INT AS event_id FROM l""",
    "win_rate": _win("true", False),
    "win_rate_by_side": _win("true", True),
    "win_rate_empty": _win("false", True),
    "score_summary": _win("true", False, "wins, losses, draws, unfinished, round(100 * score_rate, 6) AS pct, round(400 * log10(score_rate / (1 - score_rate)), 6) AS elo"),
    "legal_rate_strata": """
WITH m AS (SELECT quality = 1 AS legal, CASE WHEN n_chars // 100 < 20 THEN 'opening' WHEN n_chars // 100 < 60 THEN 'middle' ELSE 'endgame' END AS phase, lang FROM documents JOIN labels USING (doc_id)),
s AS (SELECT * FROM (VALUES ('overall', 'overall'), ('phase', 'opening'), ('phase', 'middle'), ('phase', 'endgame'), ('lang', 'de'), ('lang', 'en'), ('lang', 'es'), ('lang', 'fr'), ('lang', 'it')) v(dimension, stratum)
  UNION SELECT 'lang', lang FROM m)
SELECT dimension, stratum, count(legal) AS n, count(*) FILTER (legal) AS legal, coalesce(count(*) FILTER (legal) / nullif(count(legal), 0), 0)::DOUBLE AS rate
FROM s LEFT JOIN m ON dimension = 'overall' OR (dimension = 'phase' AND stratum = phase) OR (dimension = 'lang' AND stratum IS NOT DISTINCT FROM lang) GROUP BY dimension, stratum""",
    "legality_union": """
SELECT 'overall' AS dimension, 'overall' AS stratum, count(*) AS n, count(*) FILTER (ok) AS legal, (count(*) FILTER (ok) / count(*))::DOUBLE AS rate
FROM (SELECT quality = 1 AS ok FROM labels UNION ALL SELECT toxic = 1 FROM labels)""",
    "perplexity": _ppl(""),
    "ppl_by_label": _ppl("label"),
    "record_discriminate": """
WITH k AS (SELECT CASE event_id % 6 WHEN 0 THEN 'per_move' WHEN 1 THEN 'per_game' WHEN 2 THEN 'per_puzzle' WHEN 3 THEN 'per_perplexity' WHEN 4 THEN 'per_legal_rate'
  ELSE CASE WHEN list_contains(json_keys(props), 'ply') THEN 'per_move' ELSE 'invalid' END END AS record_type FROM events)
SELECT record_type, count(*) AS n FROM k GROUP BY record_type""",
    "topk_per_row": """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) - 1 AS rank FROM e)
SELECT vec_id, rank::INT AS rank, id::INT AS id, round(x, 9) AS logprob FROM r WHERE rank < 3""",
    "topk_per_group": """
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 2""",
    "log_softmax_rows": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
n AS (SELECT vec_id, x, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS z FROM e)
SELECT vec_id, round(list_max(x) - z, 9) AS best, round(x[1] - z, 9) AS first, round(list_sum(x) - 64 * z, 6) AS total FROM n""",
    "mask_argmax": """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings),
a AS (SELECT vec_id, unnest(list_transform(range(0, vec_id % 4 + 1), lambda i: i * 7 + vec_id % 5)) AS id FROM embeddings WHERE vec_id % 9 <> 0),
m AS (SELECT vec_id, arg_min(id, (-x, id)) AS move FROM e JOIN a USING (vec_id, id) GROUP BY vec_id),
r AS (SELECT vec_id, arg_min(id, (-x, id)) AS raw_move FROM e GROUP BY vec_id)
SELECT vec_id, move::INT AS move, raw_move::INT AS raw_move FROM r LEFT JOIN m USING (vec_id)""",
    "config_cross": _win("true", False, "games, win_rate, score_rate, 'vs_stockfish' AS evaluator, 3 AS stockfish_skill"),
    "pref_legality": f"SELECT fen_before AS prompt, model_move AS chosen, raw_sample_move AS rejected FROM ({MOVES}) WHERE mask_used AND NOT raw_sample_legal",
    "pref_quality": f"SELECT fen_before AS prompt, sf_best_move AS chosen, model_move AS rejected FROM ({LOSSES}) WHERE loss > 200 AND sf_best_move IS NOT NULL",
    "pref_engine": f"SELECT sf_best_move AS chosen, count(*) AS n FROM ({MOVES}) WHERE sf_best_move <> model_move GROUP BY sf_best_move",
    "blunder_rate": f"""
SELECT side_to_move, count(*) AS n, sum(loss)::BIGINT AS loss, count(*) FILTER (loss > 200) AS blunders, round(count(*) FILTER (loss > 200) / count(*), 9) AS rate FROM ({LOSSES}) GROUP BY side_to_move""",
    "engine_agreement": f"""
SELECT n, agreement, agreement > 0.5 OR 0.7 > 0.6 AS passes FROM (SELECT count(*) AS n, round(count(*) FILTER (model_move = sf_best_move) / count(*), 9) AS agreement FROM ({MOVES}) WHERE sf_best_move IS NOT NULL)""",
    "topk_accuracy": """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) AS rank FROM e),
a AS (SELECT rank FROM r WHERE id = vec_id % 64)
SELECT count(*) AS n, round(count(*) FILTER (rank <= 1) / count(*), 9) AS top1, round(count(*) FILTER (rank <= 5) / count(*), 9) AS top5, round(count(*) FILTER (rank <= 10) / count(*), 9) AS top10 FROM a""",
    "puzzle_accuracy": """
WITH p AS (SELECT CASE WHEN l_partkey % 2000 < 500 THEN '<500' WHEN l_partkey % 2000 < 1500 THEN '500-1500' ELSE '1500+' END AS bucket, l_returnflag AS a, l_linestatus AS b, l_suppkey % 3 = l_partkey % 3 AS ok FROM lineitem),
u AS (SELECT 'overall' AS dimension, 'overall' AS stratum, ok FROM p UNION ALL SELECT 'rating_bucket', bucket, ok FROM p UNION ALL SELECT 'theme', a, ok FROM p UNION ALL SELECT 'theme', b, ok FROM p)
SELECT dimension, stratum, count(*) AS n, count(*) FILTER (ok) AS solved, round(count(*) FILTER (ok) / count(*), 9) AS accuracy FROM u GROUP BY ALL""",
    "stratified_metrics": """
WITH u AS (SELECT 'overall' AS dimension, 'overall' AS stratum, l_quantity FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag, l_quantity FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_quantity FROM lineitem)
SELECT dimension, stratum, count(*) AS n, count(*) FILTER (l_quantity > 25) AS late FROM u GROUP BY ALL""",
    "minimax_depth2": """
WITH w AS (SELECT o_custkey, o_orderkey, min(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, o_orderkey, value FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY value DESC, o_orderkey) = 1""",
    "holdout_exclusion": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT md5('7:' || o_orderkey) < '4'",
    "illegal_set": """
WITH r AS (SELECT l_orderkey, l_linenumber, list_transform(range(0, l_linenumber % 4 + 1), lambda i: (i * 3 + l_partkey) % 10) AS legal FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter(range(10), lambda k: NOT list_contains(legal, k)), '') AS illegal,
  array_to_string(list_transform(range(10), lambda k: CASE WHEN list_contains(legal, k) THEN 1 ELSE 0 END), '') AS labels FROM r""",
    "uniform_scores": f"SELECT item_id, greatest(len(w) - 1, 0)::INT AS n, round(-greatest(len(w) - 1, 0) * ln(1974), 9) AS total FROM (SELECT item_id, {WORDS} AS w FROM benchmark)",
    "pad_batches": f"""
WITH b AS (SELECT item_id, (max(len(w)) OVER (PARTITION BY item_id // 8))::INT AS n, list_transform(w, lambda x: length(x)::VARCHAR) AS w FROM (SELECT item_id, {WORDS} AS w FROM benchmark))
SELECT item_id, n, array_to_string(list_concat(w, list_transform(range(n - len(w)), lambda i: '0')), ' ') AS ids,
  array_to_string(list_concat(w, list_transform(range(n - len(w)), lambda i: '-100')), ' ') AS labels FROM b""",
    "pgn_fixture": f"SELECT * FROM (VALUES {_values()}) v(name, uci)",
    "game_results": """
SELECT * FROM (VALUES ('mate', 'rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3', '0-1'),
  ('open', 'rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1', '*'),
  ('threefold', 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 8 5', '1/2-1/2')) v(name, fen, result)""",
    "legal_move_counts": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', {k})" for n, f, k in POSITIONS) + ") v(name, fen, n)",
    "move_kinds": "SELECT * FROM (VALUES ('pawn', 2), ('quiet', 1), (NULL, 1), ('castle', 1), ('capture', 3)) v(kind, n)",
    "prefix_reuse": """
WITH t AS (
  SELECT user_id, event_id, event_type = 'error' AS ended, (row_number() OVER w - 1)::INT AS ply, ((row_number() OVER w - 1) % 40 - CASE WHEN event_id % 5 = 0 THEN 3 ELSE 0 END)::INT AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, list_transform(range(0, greatest(n, 0) + 1), lambda k: k * (user_id % 7) + CASE WHEN event_id % 4 = 0 AND k = n THEN 1 ELSE 0 END) AS ids FROM t),
p AS (SELECT *, CASE WHEN lag(ended) OVER w THEN [] ELSE lag(ids) OVER w END AS prior FROM i WINDOW w AS (PARTITION BY user_id ORDER BY ply))
SELECT user_id::VARCHAR AS game_id, ply, len(ids)::INT AS n_tokens, CASE WHEN len(prior) < len(ids) AND ids[1:len(prior)] = prior THEN len(prior) ELSE 0 END::INT AS n_reused FROM p""",
    "encode_ids_large": f"""
WITH {LARGE} SELECT doc_id, coalesce(count(k), 0)::INT AS n_ids, coalesce(count(k) FILTER (id IS NULL), 0)::INT AS n_unknown, md5(coalesce(string_agg(coalesce(id, 1)::VARCHAR, ' ' ORDER BY k), '')) AS ids_md5
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN v USING (token) GROUP BY doc_id""",
    "decode_ids_large": f"""
WITH {LARGE} SELECT doc_id, md5(coalesce(string_agg(CASE WHEN id IS NULL THEN '<UNK>' ELSE token END, ' ' ORDER BY k), '')) AS text_md5
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN v USING (token) GROUP BY doc_id""",
    "interval_matches": """
WITH r AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 29 <> 0 THEN round(p_retailprice % 173, 2) END AS low FROM part),
b AS (SELECT p_partkey, low, CASE WHEN p_partkey % 31 <> 0 THEN round(low + p_size / 10 - 1, 2) END AS high FROM r)
SELECT p_partkey, count(*) AS n, min(event_id) AS first_event, max(value) AS largest FROM events JOIN b ON (low IS NULL OR low <= value) AND (high IS NULL OR value < high) GROUP BY p_partkey""",
    "bucketize_by_table": """
WITH b AS (SELECT s_acctbal / 20 AS bound, min(s_name) AS label FROM supplier GROUP BY bound), e AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN value END AS value FROM events),
f AS (SELECT event_id, value, min(bound) AS bound FROM e LEFT JOIN b ON value < bound GROUP BY ALL)
SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' ELSE coalesce(label, 'above all') END AS bucket FROM f LEFT JOIN b USING (bound)""",
    "backward_induction": """
WITH l AS (SELECT l_orderkey, l_linenumber, min(round(l_extendedprice * 100)::BIGINT) AS score, 'l' || lpad(l_orderkey::VARCHAR, 12, '0') || l_linenumber AS node FROM lineitem GROUP BY ALL),
o AS (SELECT o_custkey, 'o' || lpad(o_orderkey::VARCHAR, 12, '0') AS node, max(score) AS value, arg_min(l.node, (-score, l.node)) AS best FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY ALL),
c AS (SELECT c_nationkey, 'c' || lpad(c_custkey::VARCHAR, 12, '0') AS node, min(value) AS value, arg_min(o.node, (value, o.node)) AS best FROM customer JOIN o ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT 'n' || lpad(n_nationkey::VARCHAR, 12, '0') AS node, max(value) AS value, arg_min(c.node, (-value, c.node)) AS best FROM nation JOIN c ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT node, 2 AS ply, value, best FROM o UNION ALL SELECT node, 1, value, best FROM c UNION ALL SELECT node, 0, value, best FROM n""",
    "rating_fit": _fit(6, 2.0),
    "budget_batches": f"""
WITH d AS (SELECT doc_id, len({WORDS.replace('text', "coalesce(text, '')", 1)})::INT AS n FROM documents), c AS (SELECT *, greatest((n + 63) // 64, 1) * 64 AS padded_to FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY padded_to ORDER BY n, doc_id) - 1 AS nth, greatest(65536, padded_to) // padded_to AS room FROM c)
SELECT doc_id, n, padded_to, nth // room AS batch, nth % room AS place FROM r""",
    "bottom_k_positions": """
SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ORDER BY md5('0:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber LIMIT 500""",
    "wellformed_moves": "SELECT move, regexp_full_match(move, '[a-h][1-8][a-h][1-8][qrbn]?') AND substr(move, 1, 2) <> substr(move, 3, 2) AS ok FROM (VALUES ('e2e4'), ('a7a8q'), ('e2e2'), ('z9z9'), ('e2e4x'), (''), ('0000')) v(move)",
}


def oracle_sql() -> dict[str, str]:
    from .workflow_oracle import SQL as WORKFLOW

    return SQL | WORKFLOW

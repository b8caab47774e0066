"""Spark schemas of raw games, examples, scoring sequences and evaluation records."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _b, _d = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()
_strings = T.ArrayType(_s)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: Elo and rating differences stay text and are converted with try_cast.
RAW_GAME = _struct(movetext=_s, Result=_s, WhiteElo=_s, BlackElo=_s, WhiteRatingDiff=_s, BlackRatingDiff=_s, Termination=_s, Event=_s)
EXAMPLE = _struct(input_ids=T.ArrayType(_i), attention_mask=T.ArrayType(_i), elo_bucket=_s, result=_s, opening_family=_s, termination_type=_s)
SEQUENCE = _struct(id=_s, perspective=_s, moves=_strings, is_draw=_b)
TOP_K = T.ArrayType(_struct(move=_s, logprob=_d))
HEADER = _struct(run_id=_s, event_id=_i, evaluator=_s, checkpoint=_s)

PER_MOVE = _struct(
    game_id=_s, ply=_i, phase=_s, side_to_move=_s, model_side=_s, fen_before=_s, legal_moves=_strings, model_move=_s, model_top_k=TOP_K, mask_used=_b,
    raw_sample_move=_s, raw_sample_legal=_b, prior_opponent_move=_s, sf_best_move=_s, sf_eval_before_cp=_i, sf_eval_after_cp=_i, centipawn_loss=_i, is_blunder=_b,
)
PER_GAME = _struct(game_id=_s, model_side=_s, result=_s, termination=_s, ply_count=_i)
PER_PUZZLE = _struct(puzzle_id=_s, rating=_i, themes=_strings, fen=_s, solution=_strings, model_attempt=_strings, solved=_b)
PER_LEGAL_RATE = _struct(position_id=_s, fen=_s, model_move=_s, legal=_b)
PER_PERPLEXITY = _struct(position_id=_s, fen=_s, token_logprobs=T.ArrayType(_d))

#: record type, the key that tells it, its fields; in the order in which keys are tried.
RECORDS = (
    ("per_move", "ply", PER_MOVE),
    ("per_game", "result", PER_GAME),
    ("per_puzzle", "puzzle_id", PER_PUZZLE),
    ("per_perplexity", "token_logprobs", PER_PERPLEXITY),
    ("per_legal_rate", "legal", PER_LEGAL_RATE),
)
#: Fields whose key must be there while their value may be null.
NULLABLE = ("prior_opponent_move", "sf_best_move", "sf_eval_before_cp", "sf_eval_after_cp", "centipawn_loss", "is_blunder")


def superset() -> T.StructType:
    """One schema that holds every record."""
    fields: dict[str, T.StructField] = {}
    for part in (HEADER, *(r[2] for r in RECORDS)):
        for f in part.fields:
            fields.setdefault(f.name, f)
    return T.StructType(list(fields.values()))


def record_schema(kind: str) -> T.StructType:
    return T.StructType(HEADER.fields + next(s for k, _, s in RECORDS if k == kind).fields)

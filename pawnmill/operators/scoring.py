"""Pluggable scorers, predictions and sequence scoring.

A scorer is an object with ``logits(prefixes) -> array``: for each token-id prefix a row of
scores over the vocabulary. It is built once in each Python worker by a factory, so a model
loads once and scores Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .vocabulary import token_list, with_token_ids

#: Prefixes that a scorer is given at once, whatever a sequence's length.
PREFIXES = 256


class Scorer(Protocol):
    def logits(self, prefixes: list[list[int]]) -> np.ndarray: ...


class UniformScorer:
    """Every token alike: each log probability is -ln(vocabulary size)."""

    def logits(self, prefixes: list[list[int]]) -> np.ndarray:
        return np.zeros((len(prefixes), C.VOCABULARY_SIZE))

    def sequence_logits(self, line: list[int]) -> Iterator[np.ndarray]:
        for at in range(0, len(line) - 1, PREFIXES):
            yield np.zeros((min(PREFIXES, len(line) - 1 - at), C.VOCABULARY_SIZE))


class HashScorer:
    """A reproducible stand-in for a model: scores from a hash of the prefix."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def logits(self, prefixes: list[list[int]]) -> np.ndarray:
        import zlib

        return np.stack([np.random.default_rng([self.seed, zlib.crc32(repr(list(map(int, p))).encode())]).normal(size=C.VOCABULARY_SIZE) for p in prefixes])


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


class IllegalMoveError(ValueError):
    """A move that cannot be played."""


class GameOverError(ValueError):
    """No move can be played."""


@dataclass(frozen=True)
class Prediction:
    move: str | None
    mask_used: bool
    raw_move: str
    raw_legal: bool
    top_k: tuple[tuple[str, float], ...] = ()
    error: str | None = None


def draw(logits: np.ndarray, temperature: float, top_k: int, seed: tuple[int, ...]) -> int:
    """Greedy (the least id of equal scores) at temperature <= 0, else a seeded draw."""
    if temperature <= 0:
        return int(logits.argmax())
    x = logits / temperature
    if top_k > 0:
        least = np.sort(x)[-min(top_k, len(x))]
        x = np.where(x >= least, x, -np.inf)
    return int((x + np.random.default_rng(seed).gumbel(size=len(x))).argmax())


def predict(scorer: Scorer, board, prefix: list[int], constrained: bool = True, temperature: float = 0.0, top_k: int = 0, record_top_k: int = 5, seed: tuple[int, ...] = (0,)) -> Prediction:
    """One move. The unmasked first choice is always recorded, whether a mask is used or not."""
    return choose(scorer.logits([prefix])[0], board, constrained, temperature, top_k, record_top_k, seed)


def choose(logits: np.ndarray, board, constrained: bool = True, temperature: float = 0.0, top_k: int = 0, record_top_k: int = 5, seed: tuple[int, ...] = (0,)) -> Prediction:
    """The move of one row of scores."""
    from ..chess.board import move_uci, parse_uci

    tokens = token_list()
    raw = np.asarray(logits, dtype=np.float64)
    raw_move = tokens[int(raw.argmax())]
    used, is_legal = raw, lambda move: board.is_legal(parse_uci(move))
    if constrained:
        legal = {move_uci(m) for m in board.legal_moves()}
        is_legal = legal.__contains__
        allowed = [i for i, t in enumerate(tokens) if t in legal]
        if not allowed:
            return Prediction(None, True, raw_move, False, (), "game-over")
        used = np.full_like(raw, -np.inf)
        used[allowed] = raw[allowed]
    move = tokens[draw(used, temperature, top_k, seed)]
    ranked: tuple[tuple[str, float], ...] = ()
    if record_top_k > 0:
        lp = log_softmax(used)
        order = np.lexsort((np.arange(len(lp)), -lp))[: min(record_top_k, len(lp))]
        ranked = tuple((tokens[i], float(lp[i])) for i in order)
    return Prediction(move, constrained, raw_move, is_legal(raw_move), ranked, None if is_legal(move) else "illegal-move")


def game_tokens(side: str, moves: list[str]) -> list[int]:
    """A game's ids without outcome marks."""
    ids = _ids()
    return [C.WHITE_ID if side == "white" else C.BLACK_ID, *(ids.get(m, C.UNK_ID) for m in moves)]


def _ids() -> dict[str, int]:
    if not _known:
        _known.update({t: i for i, t in enumerate(token_list())})
    return _known


_known: dict[str, int] = {}


def scored_ids(side: Column, moves: Column, drawn: Column) -> Column:
    """Tokens to be scored: side, moves and the draw mark, no end mark."""
    from .games import sequence_tokens

    return sequence_tokens(side, moves, drawn, end=False)


def check_vocabulary(sequences: DataFrame) -> DataFrame:
    """An error names the row and the move where a move is not in the vocabulary."""
    ids = with_token_ids(sequences, "moves", token_list(), out="__ids", unknown=-1)  # a hash look-up in Arrow, no literal set
    odd = F.get("moves", F.coalesce(F.array_position("__ids", -1), F.lit(0)).cast("int") - 1)
    message = F.concat_ws(": ", F.col("id"), F.concat(F.lit("unknown move "), odd))
    good = F.when(F.coalesce(F.array_position("__ids", -1), F.lit(0)) == 0, F.col("moves")).otherwise(F.raise_error(message).cast("array<string>"))
    return ids.withColumn("moves", good).select(*sequences.columns)


def _logits_along(scorer: Scorer, line: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(place, scores for the tokens from that place on), from place 1 to the end."""
    at = 1
    whole = getattr(scorer, "sequence_logits", None)
    parts = whole(line) if whole else (scorer.logits([line[:k] for k in range(a, min(a + PREFIXES, len(line)))]) for a in range(1, len(line), PREFIXES))
    for logits in parts:
        yield at, logits
        at += len(logits)


def score_sequences(sequences: DataFrame, factory: Callable[[], Scorer], ids: str = "input_ids", out: str = "token_logprobs") -> DataFrame:
    """df with the log probabilities of tokens 1..n-1, each given its prefix; [] below two tokens.

    A scorer with a method ``sequence_logits(line)`` gives the scores after each of a line's
    tokens but the last in one pass (as causal models do), PREFIXES rows at a time. Any other
    is asked prefix by prefix, PREFIXES at a time, so memory is linear in a sequence, but the
    tokens of its prefixes grow with its square.
    """
    columns = sequences.columns
    schema = sequences.schema.simpleString()[7:-1] + f",{out}:array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            values = []
            for line in frame[ids]:
                line = [int(i) for i in line]
                if len(line) < 2:
                    values.append([])
                    continue
                found: list[float] = []
                for at, logits in _logits_along(scorer, line):
                    nexts = line[at : at + len(logits)]
                    lp = log_softmax(np.asarray(logits, dtype=np.float64))
                    found += lp[np.arange(len(nexts)), nexts].tolist()
                values.append(found)
            yield frame[columns].assign(**{out: values})

    return sequences.mapInPandas(run, schema)


def predict_positions(positions: DataFrame, factory: Callable[[], Scorer]) -> DataFrame:
    """positions (position_id, fen, perspective, moves) with model_move and legal, unmasked and greedy.

    A choice depends on position, side and moves alone, so those that repeat in a batch are scored once.
    """
    columns = positions.columns
    schema = positions.schema.simpleString()[7:-1] + ",model_move:string,legal:boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..chess.board import Board

        scorer = factory()
        for frame in frames:
            spots = [(fen, side, tuple(moves) if moves is not None else ()) for fen, side, moves in zip(frame["fen"], frame["perspective"], frame["moves"])]
            each = list(dict.fromkeys(spots))
            found = {}
            for at in range(0, len(each), PREFIXES):
                some = each[at : at + PREFIXES]
                logits = scorer.logits([game_tokens(side, list(moves)) for _, side, moves in some])
                found.update({spot: choose(x, Board(spot[0]), constrained=False, record_top_k=0) for x, spot in zip(logits, some)})
            yield frame[columns].assign(model_move=[found[s].raw_move for s in spots], legal=[found[s].raw_legal for s in spots])

    return positions.mapInPandas(run, schema)

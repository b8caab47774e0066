"""Arrow functions over the chess rules: FEN checks, legal moves, replay, game ends.

A line of moves that repeats in an Arrow batch is replayed once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _valid(fen: str | None) -> bool:
    from ..chess.board import Board

    try:
        Board(fen or "")
        return True
    except ValueError:
        return False


def _of_lines(moves: pd.Series, of: Callable[[tuple], str | None]) -> pd.Series:
    lines = [tuple(line) if line is not None else () for line in moves]
    known = {line: of(line) for line in dict.fromkeys(lines)}
    return pd.Series([known[line] for line in lines], dtype=object)


@F.pandas_udf(T.BooleanType())
def fen_is_valid(fen: pd.Series) -> pd.Series:
    return fen.map(_valid).astype(bool)


@F.pandas_udf(T.StringType())
def normal_fen(fen: pd.Series) -> pd.Series:
    from ..chess.board import Board

    return fen.map(lambda f: Board(f).fen() if _valid(f) else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def legal_moves(fen: pd.Series) -> pd.Series:
    """Sorted UCI moves that are legal; null for an invalid FEN."""
    from ..chess.board import Board

    return fen.map(lambda f: Board(f).legal_uci() if _valid(f) else None)


@F.pandas_udf(T.StringType())
def fen_after(moves: pd.Series) -> pd.Series:
    """The position after UCI moves from the standard start; null when one is illegal."""
    from ..chess.board import Board

    def play(line):
        board = Board()
        try:
            for m in line:
                board.push_uci(m)
        except ValueError:
            return None
        return board.fen()

    return _of_lines(moves, play)


@F.pandas_udf(T.StringType())
def result_after(moves: pd.Series) -> pd.Series:
    """1-0, 0-1, 1/2-1/2 or * after UCI moves from the standard start, claimable draws counted."""
    from ..chess.board import Board

    def play(line):
        board = Board()
        try:
            for m in line:
                board.push_uci(m)
        except ValueError:
            return None
        return board.outcome()

    return _of_lines(moves, play)


@F.pandas_udf(T.StringType())
def kind_of_move(fen: pd.Series, uci: pd.Series) -> pd.Series:
    """check, capture, castle, pawn or quiet; null for an illegal move."""
    from ..chess.board import Board, parse_uci

    def kind(f, u):
        if not _valid(f):
            return None
        board, m = Board(f), parse_uci(u)
        if not board.is_legal(m):
            return None
        piece, capture = board.at[m[0]].upper(), board.is_capture(m)
        castle = piece == "K" and abs(m[0] - m[1]) == 2
        board.push(m)
        return "check" if board.in_check() else "capture" if capture else "castle" if castle else "pawn" if piece == "P" else "quiet"

    return pd.Series([kind(f, u) for f, u in zip(fen, uci)])


def uci_is_wellformed(c: str):
    """Form alone, in the JVM: two different squares and an optional promotion."""
    return F.coalesce(F.rlike(F.col(c), F.lit("^[a-h][1-8][a-h][1-8][qrbn]?$")) & (F.substring(c, 1, 2) != F.substring(c, 3, 2)), F.lit(False))

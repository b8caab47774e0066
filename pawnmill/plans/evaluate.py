"""Evaluation: legality on positions, perplexity of sequences, games against an engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalar import position_id
from ..operators import sampling, scoring
from ..operators.chess_udfs import fen_after
from ..operators.records import with_event_ids
from ..operators.vocabulary import token_list, with_token_ids
from ..schemas import superset
from ..session import checkpointed
from ..sources import scans
from .runs import LegalRateConfig, MatchConfig, PerplexityConfig, PuzzleConfig, Run, config_payload


def positions(spark: SparkSession, config: LegalRateConfig) -> DataFrame:
    """position_id, fen, perspective, moves of the configured source, and the columns (source, place) that give its order."""
    if config.positions_path is not None:
        rows = scans.fen_rows(spark, config.positions_path).select("position_id", "fen", F.array().cast("array<string>").alias("moves"), F.col("file").alias("source"), F.col("lineno").alias("place"))
    else:
        games = scans.read_pgn(spark, config.sample_from_games_path).where("moves IS NOT NULL")
        sampled = sampling.sampled_positions(games, config.sample_n, "game_id", "moves", seed=config.seed)
        rows = sampled.select(position_id("game_id", "ply").alias("position_id"), fen_after("moves").alias("fen"), "moves", F.format_string("%12s", F.substr("game_id", F.lit(6))).alias("source"), F.col("ply").alias("place"))
    return rows.withColumn("perspective", F.when(F.get(F.split("fen", " "), F.lit(1)) == "b", "black").otherwise("white"))


def _headed(rows: DataFrame, run_id: str, evaluator: str, checkpoint: str, kind: str, *order) -> DataFrame:
    # numbering sorts its rows by ranges, which it looks at twice; scores are made once
    named = checkpointed(rows).withColumns({"run_id": F.lit(run_id), "evaluator": F.lit(evaluator), "checkpoint": F.lit(checkpoint), "record_type": F.lit(kind)})
    return with_event_ids(named, "run_id", *order)


def run_legal_rate(spark: SparkSession, factory: Callable[[], scoring.Scorer], config: LegalRateConfig, folder: str, run_id: str, checkpoint: str, extra: Mapping | None = None) -> Run:
    run = Run(spark, folder)
    run.write_config(config_payload("legal_rate", run_id, checkpoint, config, extra))
    found = scoring.predict_positions(positions(spark, config), factory)
    headed = _headed(found.select("position_id", "fen", "model_move", "legal", "source", "place"), run_id, "legal_rate", checkpoint, "per_legal_rate", "source", "place")
    run.append_records(headed.drop("source", "place"))
    return run


def run_perplexity(spark: SparkSession, factory: Callable[[], scoring.Scorer], config: PerplexityConfig, folder: str, run_id: str, checkpoint: str, extra: Mapping | None = None) -> Run:
    run = Run(spark, folder)
    run.write_config(config_payload("perplexity", run_id, checkpoint, config, extra))
    rows = scoring.check_vocabulary(scans.read_sequences(spark, config.sequences_path, config.max_sequences))
    ids = with_token_ids(rows.withColumn("fen", fen_after("moves")), scoring.scored_ids(F.col("perspective"), F.col("moves"), F.col("is_draw")), token_list())
    scored = scoring.score_sequences(ids.select("file", "lineno", F.col("id").alias("position_id"), F.coalesce("fen", F.lit("")).alias("fen"), "input_ids"), factory)
    records = _headed(scored, run_id, "perplexity", checkpoint, "per_perplexity", "file", "lineno")
    run.append_records(records.select("run_id", "event_id", "evaluator", "checkpoint", "record_type", "position_id", "fen", "token_logprobs"))
    return run


class Opponent(Protocol):
    def configure(self, options: Mapping) -> None: ...

    def play(self, board, limit: Mapping) -> str | None:
        """A UCI move, or None to resign."""


class FirstMoveOpponent:
    """Plays the first legal move in alphabetical order."""

    def configure(self, options: Mapping) -> None:
        pass

    def play(self, board, limit: Mapping) -> str | None:
        return next(iter(board.legal_uci()), None)


class UciOpponent:
    """A UCI engine process on the executor."""

    def __init__(self, command: str):
        import subprocess

        self.process = subprocess.Popen([command], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self._send("uci")
        self._until("uciok")

    def _send(self, line: str) -> None:
        self.process.stdin.write(line + "\n")

    def _until(self, word: str) -> str:
        for line in self.process.stdout:
            if line.startswith(word):
                return line.strip()
        raise RuntimeError("the engine ended")

    def configure(self, options: Mapping) -> None:
        for k, v in options.items():
            self._send(f"setoption name {k} value {v}")
        self._send("isready")
        self._until("readyok")

    def play(self, board, limit: Mapping) -> str | None:
        self._send(f"position fen {board.fen()}")
        self._send(f"go movetime {int(1000 * limit['time'])}" if "time" in limit else f"go depth {limit['depth']}")
        move = self._until("bestmove").split()[1]
        return None if move in ("(none)", "0000") else move

    def analyse(self, board, limit: Mapping) -> tuple[str | None, int | None]:
        """The engine's move and its score in centipawns for White; a mate counts as 10,000 less its distance."""
        self._send(f"position fen {board.fen()}")
        self._send(f"go movetime {int(1000 * limit['time'])}" if "time" in limit else f"go depth {limit['depth']}")
        score = None
        for line in self.process.stdout:
            words = line.split()
            if words[:1] == ["bestmove"]:
                return (None if words[1] in ("(none)", "0000") else words[1]), (score if score is None or board.white else -score)
            if "score" in words[:-2]:
                kind, n = words[words.index("score") + 1], int(words[words.index("score") + 2])
                score = n if kind == "cp" else (10_000 - n if n > 0 else -10_000 - n)
        raise RuntimeError("the engine ended")

    def close(self) -> None:
        self._send("quit")
        self.process.wait(timeout=10)


def analysed(record: dict, white: bool, best: str | None, before: int | None, after: int | None, threshold: int) -> None:
    """Put an engine's view of a move into its record; scores are White's."""
    record |= {"sf_best_move": best, "sf_eval_before_cp": before, "sf_eval_after_cp": after}
    if before is not None and after is not None:
        record["centipawn_loss"] = max(0, before - after if white else after - before)
        record["is_blunder"] = record["centipawn_loss"] > threshold


def play_game(
    game_id: str, side: str, scorer: scoring.Scorer, opponent: Opponent, config: MatchConfig, temperature: float = 0.0, top_k: int = 0, analyst: Callable | None = None
) -> tuple[list[dict], dict, list[str]]:
    """Move records, the game record and the moves of one game.

    ``analyst(board, limit)`` gives an engine's move and White's centipawns; it looks at the
    positions before and after each of the model's moves. In order: the end of the game by the rules, the ply limit, the model's turn (its record
    comes before the move is played), the opponent's turn. Only a natural end has a result.
    """
    import zlib

    from ..chess.board import Board

    board, moves, records, prior, termination = Board(), [], [], None, "natural"
    while board.outcome() == "*":
        if board.ply >= config.max_plies:
            termination = "max-plies"
            break
        if (side == "white") == board.white:
            seed = (zlib.crc32(game_id.encode()), board.ply)
            p = scoring.predict(scorer, board, scoring.game_tokens(side, moves), not config.unconstrained, temperature, top_k, config.record_top_k, seed)
            records.append(
                {
                    "game_id": game_id, "ply": board.ply, "phase": C.PHASES[(board.ply >= C.PHASE_BOUNDS[0]) + (board.ply >= C.PHASE_BOUNDS[1])], "side_to_move": side,
                    "model_side": side, "fen_before": board.fen(), "legal_moves": board.legal_uci(), "model_move": p.move, "model_top_k": [{"move": m, "logprob": v} for m, v in p.top_k],
                    "mask_used": p.mask_used, "raw_sample_move": p.raw_move, "raw_sample_legal": p.raw_legal, "prior_opponent_move": prior, "sf_best_move": None,
                    "sf_eval_before_cp": None, "sf_eval_after_cp": None, "centipawn_loss": None, "is_blunder": None,
                }
            )
            if p.error:
                termination = "illegal-move"
                break
            best, before = analyst(board, config.limit()) if analyst else (None, None)
            board.push_uci(p.move)
            if analyst:
                _, after = analyst(board, config.limit())
                analysed(records[-1], side == "white", best, before, after, config.blunder_threshold_cp)
            moves.append(p.move)
        else:
            reply = opponent.play(board, config.limit())
            if reply is None:
                termination = "stockfish-resigned"
                break
            board.push_uci(reply)
            moves.append(reply)
            prior = reply
    result = board.outcome() if termination == "natural" else "*"
    return records, {"game_id": game_id, "model_side": side, "result": result, "termination": termination, "ply_count": board.ply}, moves


def play_games(spark: SparkSession, factory: Callable[[], scoring.Scorer], opponent: Callable[[], Opponent], config: MatchConfig, run_id: str, checkpoint: str, temperature: float = 0.0, top_k: int = 0, analyse: bool = False) -> DataFrame:
    """Superset records of all games; games run in parallel, one group each. With ``analyse`` the opponent also judges the model's moves."""
    from ..functions.scalar import color_for_game, game_id

    settings = asdict(config)
    games = spark.range(config.games).select(game_id("id").alias("game_id"), color_for_game(config.model_color, "id").alias("side"))
    names = [f.name for f in superset().fields if f.name not in ("event_id",)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in superset().fields if f.name in names), "record_type string", "pgn string"])

    def play(frame: pd.DataFrame) -> pd.DataFrame:
        from ..chess.notation import export_pgn

        own, rival = MatchConfig(**settings), opponent()
        rival.configure({"Skill Level": own.stockfish_skill})
        try:
            scorer, rows = factory(), []
            for gid, side in zip(frame["game_id"], frame["side"]):
                head = {"run_id": run_id, "evaluator": "vs_stockfish", "checkpoint": checkpoint}
                records, game, moves = play_game(gid, side, scorer, rival, own, temperature, top_k, rival.analyse if analyse else None)
                names_of = {"White": "model" if side == "white" else "engine", "Black": "engine" if side == "white" else "model", "Result": game["result"], "Termination": game["termination"], "ModelColor": side}
                rows += [{**head, **r, "record_type": "per_move"} for r in records]
                rows.append({**head, **game, "record_type": "per_game", "pgn": export_pgn(moves, names_of)})
        finally:
            if hasattr(rival, "close"):
                rival.close()
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in [*names, "record_type", "pgn"]})

    # played once: records and PGN are of the same games also if an executor is lost
    played = checkpointed(games.groupBy("game_id").applyInPandas(play, schema))
    return with_event_ids(played, "run_id", F.length("game_id"), "game_id", F.col("record_type") == "per_game", "ply")


def run_match(spark: SparkSession, factory: Callable[[], scoring.Scorer], opponent: Callable[[], Opponent], config: MatchConfig, folder: str, run_id: str, checkpoint: str, extra: Mapping | None = None) -> Run:
    run, extra = Run(spark, folder), dict(extra or {})
    run.write_config(config_payload("vs_stockfish", run_id, checkpoint, config, extra))
    records = play_games(spark, factory, opponent, config, run_id, checkpoint, float(extra.get("temperature", 0.0)), int(extra.get("top_k", 0)), bool(extra.get("sf_analyze", False)))
    run.append_records(records)
    games = records.where("record_type = 'per_game'").orderBy("event_id").select("pgn")
    run.write_pgn(r["pgn"] for r in games.toLocalIterator())
    return run


def solve_puzzles(puzzles: DataFrame, factory: Callable[[], scoring.Scorer]) -> DataFrame:
    """puzzle_id, rating, themes, fen, solution, model_attempt and solved of (puzzle_id, fen, solution, rating, themes).

    A puzzle's first move leads to its position; then the model and the solver's opponent take
    turns. The attempt is the solution with the model's first choices (legal moves only) in the
    model's places, up to the first that differs.
    """
    columns = ["puzzle_id", "rating", "themes", "fen", "solution"]
    schema = puzzles.select(*columns).schema.simpleString()[7:-1] + ",model_attempt:array<string>,solved:boolean"

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..chess.board import Board

        scorer = factory()
        for frame in frames:
            attempts, lines = [], []
            for fen, moves in zip(frame["fen"], frame["solution"]):
                first, *line = list(moves) if moves is not None else [None]
                board, played, attempt = Board(fen), [], []
                try:
                    board.push_uci(first)
                    side, played = "white" if board.white else "black", [first]
                    for k, expected in enumerate(line):
                        move = scoring.predict(scorer, board, scoring.game_tokens(side, played), record_top_k=0).move if k % 2 == 0 else expected
                        attempt.append(move)
                        if move != expected:
                            break
                        board.push_uci(move)
                        played.append(move)
                except (ValueError, TypeError):  # a line that can't be played is not solved
                    attempt = []
                attempts.append(attempt)
                lines.append(line)
            yield frame[columns].assign(solution=lines, model_attempt=attempts, solved=[bool(b) and a == b for a, b in zip(attempts, lines)])

    return puzzles.select(*columns).mapInPandas(solve, schema)


def run_puzzles(spark: SparkSession, factory: Callable[[], scoring.Scorer], config: PuzzleConfig, folder: str, run_id: str, checkpoint: str, extra: Mapping | None = None) -> Run:
    run = Run(spark, folder)
    run.write_config(config_payload("puzzles", run_id, checkpoint, config, extra))
    rating = None if config.rating_min is None and config.rating_max is None else (config.rating_min or 0, config.rating_max or 10**6)
    chosen = scans.read_puzzles(spark, config.puzzle_path, rating, config.themes, config.sample, config.seed)
    run.append_records(_headed(solve_puzzles(chosen, factory), run_id, "puzzles", checkpoint, "per_puzzle", "puzzle_id"))
    return run

"""Run ids, checkpoint tags, run folders and run configurations."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..sources import sinks
from ..sources.scans import read_records

TIMESTAMP = "%Y-%m-%dT%H-%M-%S"


def make_run_id(tag: str, evaluator: str, now: datetime | None = None) -> str:
    """time_tag_evaluator; the tag may hold no underscore, the evaluator's become hyphens."""
    if "_" in tag:
        raise ValueError(f"underscores part a run id, so the tag {tag!r} may have none")
    return f"{(now or datetime.now(timezone.utc)).strftime(TIMESTAMP)}_{tag}_{evaluator.replace('_', '-')}"


def derive_checkpoint_tag(checkpoint: str) -> str:
    """name of org/name; run-ckptN of a folder run/checkpoint-N; else the last part of the path."""
    if checkpoint and checkpoint[0] not in "./" and "\\" not in checkpoint and checkpoint.count("/") == 1:
        return checkpoint.split("/")[1]
    path = Path(checkpoint)
    if path.name.startswith("checkpoint-") and path.parent.name and path.is_dir():
        return f"{path.parent.name}-ckpt{path.name[len('checkpoint-'):]}"
    return path.name


def resolve_checkpoint_tag(checkpoint: str, override: str | None = None) -> str:
    if override is None:
        return derive_checkpoint_tag(checkpoint).replace("_", "-")
    if "_" in override:
        raise ValueError(f"the given tag {override!r} has an underscore, which parts a run id")
    return override


def _require(good: bool, message: str) -> None:
    if not good:
        raise ValueError(message)


@dataclass(frozen=True)
class MatchConfig:
    """Games against an engine."""

    games: int = 2
    model_color: str = "alternate"
    stockfish_skill: int = 0
    stockfish_depth: int | None = 1
    stockfish_movetime: float | None = None
    max_plies: int = 400
    unconstrained: bool = False
    record_top_k: int = 5
    blunder_threshold_cp: int = C.BLUNDER_CP

    def __post_init__(self) -> None:
        _require(self.games >= 1, f"a match of {self.games} games: one at least is needed")
        low, high = C.SKILL_RANGE
        _require(low <= self.stockfish_skill <= high, f"skill {self.stockfish_skill} lies outside {low} to {high}")
        _require(self.max_plies >= 1, f"a limit of {self.max_plies} plies leaves no move")
        _require(self.record_top_k >= 0, f"{self.record_top_k} candidates can't be recorded")
        _require(self.stockfish_movetime is not None or (self.stockfish_depth or 0) >= 1, "the engine needs a depth from 1 on or a time for each move")
        _require(self.model_color in ("white", "black", "alternate"), f"the model plays white, black or alternate, not {self.model_color!r}")

    def limit(self) -> dict[str, float]:
        return {"time": self.stockfish_movetime} if self.stockfish_movetime is not None else {"depth": self.stockfish_depth}


@dataclass(frozen=True)
class LegalRateConfig:
    """Unconstrained predictions on FEN lines, or on positions sampled from PGN games."""

    positions_path: str | None = None
    sample_from_games_path: str | None = None
    sample_n: int = C.RESERVOIR_SIZE
    seed: int = C.RESERVOIR_SEED

    def __post_init__(self) -> None:
        _require((self.positions_path is None) != (self.sample_from_games_path is None), "exactly one of positions_path and sample_from_games_path is required")
        _require(self.sample_from_games_path is None or self.sample_n >= 1, f"a sample of {self.sample_n} positions is none")


@dataclass(frozen=True)
class PerplexityConfig:
    """Log probabilities of given sequences."""

    sequences_path: str
    max_sequences: int | None = None

    def __post_init__(self) -> None:
        _require(self.max_sequences is None or self.max_sequences >= 1, f"a limit of {self.max_sequences} sequences leaves none")


@dataclass(frozen=True)
class PuzzleConfig:
    """First choices on puzzles of a CSV file, of some ratings and themes."""

    puzzle_path: str
    rating_min: int | None = None
    rating_max: int | None = None
    themes: tuple[str, ...] | None = None
    sample: int | None = None
    seed: int = C.RESERVOIR_SEED

    def __post_init__(self) -> None:
        _require(self.sample is None or self.sample >= 1, f"a sample of {self.sample} puzzles is none")


def config_payload(evaluator: str, run_id: str, checkpoint: str, config, extra: Mapping | None = None) -> dict:
    """Header, then the configuration's fields, then ``extra``; later values win."""
    fields = {k: str(v) if isinstance(v, Path) else v for k, v in asdict(config).items()}
    if isinstance(config, LegalRateConfig) and config.sample_from_games_path is None:
        fields = {k: v for k, v in fields.items() if k not in ("sample_n", "seed")}
    return {"evaluator": evaluator, "run_id": run_id, "checkpoint": checkpoint, **fields, **(extra or {})}


class Run:
    """A run's folder: config.json, records.jsonl (a folder of JSON lines), metrics.json, games.pgn."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write_config(self, payload: Mapping) -> None:
        sinks.write_json(self.spark, self.path("config.json"), payload)

    def read_config(self) -> dict:
        return json.loads(sinks.read_small(self.spark, self.path("config.json")))

    def append_records(self, records: DataFrame) -> None:
        sinks.append_records(records, self.path("records.jsonl"))

    def read_records(self) -> DataFrame:
        return read_records(self.spark, self.path("records.jsonl"))

    def write_metrics(self, payload: Mapping) -> None:
        sinks.write_json(self.spark, self.path("metrics.json"), payload)

    def read_metrics(self) -> dict:
        return json.loads(sinks.read_small(self.spark, self.path("metrics.json")))

    def write_pgn(self, games: Iterable[str]) -> None:
        sinks.write_pgn(self.spark, self.path("games.pgn"), games)

    def read_pgn(self) -> str:
        return sinks.read_small(self.spark, self.path("games.pgn"))

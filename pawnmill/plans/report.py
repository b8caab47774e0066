"""From records and a run's configuration to its metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from .runs import Run


def _bucket(row, names: tuple[str, ...]) -> dict:
    return {n: row[n] for n in names}


def _nested(table: DataFrame, names: tuple[str, ...]) -> dict:
    """overall and by_* dictionaries; the table has one row for each stratum of fixed enumerations."""
    out: dict = {}
    for row in table.collect():
        if row["dimension"] == metrics.OVERALL:
            out["overall"] = _bucket(row, names)
        else:
            out.setdefault(f"by_{row['dimension']}", {})[row["stratum"]] = _bucket(row, names)
    return out


WIN = ("games", "wins", "losses", "draws", "unfinished", "win_rate", "score_rate")
LEGAL = ("n", "legal", "rate")


def match_metrics(records: DataFrame, config: Mapping) -> dict:
    games, moves = records.where("record_type = 'per_game'"), records.where("record_type = 'per_move'")
    return {
        "evaluator": "vs_stockfish",
        "stockfish_skill": config.get("stockfish_skill"),
        "win_rate": _nested(metrics.win_rate(games), WIN),
        "legal_rate": _nested(metrics.legal_rate(moves), LEGAL),
    }


def legal_rate_metrics(records: DataFrame, config: Mapping) -> dict:
    return {"evaluator": "legal_rate", "legal_rate": {"overall": _bucket(metrics.legality_tally(records).first(), LEGAL)}}


def perplexity_metrics(records: DataFrame, config: Mapping) -> dict:
    row = metrics.perplexity(records.where("record_type = 'per_perplexity'")).first()
    return {"evaluator": "perplexity", **row.asDict()}


#: Bounds of the rating buckets of puzzles.
PUZZLE_BOUNDS, TOP_PUZZLES = ((1000, "<1000"), (1500, "1000-1500"), (2000, "1500-2000"), (2500, "2000-2500")), "2500+"


def puzzle_metrics(records: DataFrame, config: Mapping) -> dict:
    found = metrics.puzzle_accuracy(records.where("record_type = 'per_puzzle'"), PUZZLE_BOUNDS, TOP_PUZZLES, F.col("solved"))
    nested = _nested(found, ("n", "solved", "accuracy"))
    return {"evaluator": "puzzles", "accuracy": {"overall": {"n": 0, "solved": 0, "accuracy": 0.0}} | nested}


#: A new evaluator is one more function here.
BUILDERS: dict[str, Callable[[DataFrame, Mapping], dict]] = {"vs_stockfish": match_metrics, "legal_rate": legal_rate_metrics, "perplexity": perplexity_metrics, "puzzles": puzzle_metrics}


def compute_all(records: DataFrame, config: Mapping) -> dict:
    builder = BUILDERS.get(config.get("evaluator"))
    if builder is None:
        raise ValueError(f"unsupported evaluator {config.get('evaluator')!r}")
    return builder(records, config)


def report(run: Run) -> dict:
    """Compute metrics anew from what the run has on disk; records are only read."""
    payload = compute_all(run.read_records(), run.read_config())
    run.write_metrics(payload)
    return payload


def summary(payload: Mapping) -> str:
    """A few lines for a console."""
    if payload["evaluator"] == "vs_stockfish":
        w = payload["win_rate"]["overall"]
        scored = w["games"] - w["unfinished"]
        score = w["wins"] + 0.5 * w["draws"]
        return f"games {w['games']}: {w['wins']} won, {w['losses']} lost, {w['draws']} drawn, {w['unfinished']} unfinished; score {100 * score / scored if scored else 0:.1f} %"
    if payload["evaluator"] == "legal_rate":
        x = payload["legal_rate"]["overall"]
        return f"positions {x['n']}: {x['legal']} legal, {100 * x['rate']:.1f} %"
    if payload["evaluator"] == "puzzles":
        x = payload["accuracy"]["overall"]
        return f"puzzles {x['n']}: {x['solved']} solved, {100 * x['accuracy']:.1f} %"
    return f"sequences {payload['num_sequences']}, tokens {payload['num_tokens']}: NLL {payload['mean_nll']:.4f}, {payload['bits_per_token']:.4f} bits, perplexity {payload['perplexity']:.2f}"

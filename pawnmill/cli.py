"""Commands: prepare, vs-stockfish, legal-rate, perplexity, puzzles, report."""

from __future__ import annotations

import argparse
import importlib
import sys

from . import constants as C
from .plans import evaluate, prepare, report
from .plans.runs import LegalRateConfig, MatchConfig, PerplexityConfig, PuzzleConfig, Run, make_run_id, resolve_checkpoint_tag
from .session import configure_logging, session


def load_factory(checkpoint: str, name: str | None):
    """module:callable, called with the checkpoint in each worker; the uniform scorer by default."""
    if name is None:
        from .operators.scoring import UniformScorer

        return UniformScorer
    module, _, attribute = name.partition(":")

    def build():
        return getattr(importlib.import_module(module), attribute)(checkpoint)

    return build


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pawnmill")
    commands = top.add_subparsers(dest="command", required=True)
    prep = commands.add_parser("prepare", help="raw games to train, eval and test examples")
    prep.add_argument("--games-path", required=True)
    prep.add_argument("--out", required=True)
    prep.add_argument("--num-games", type=int)
    prep.add_argument("--high-elo", action="store_true")
    prep.add_argument("--min-elo", type=int, default=C.MIN_ELO)
    prep.add_argument("--max-rating-diff", type=int, default=C.MAX_RATING_DIFF)
    prep.add_argument("--max-elo-gap", type=int, default=C.MAX_ELO_GAP)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--checkpoint", required=True)
    shared.add_argument("--checkpoint-tag")
    shared.add_argument("--evals-dir", default="evals")
    shared.add_argument("--scorer", help="module:callable that builds a scorer from the checkpoint")
    match = commands.add_parser("vs-stockfish", parents=[shared], help="games against an engine")
    match.add_argument("--stockfish", default="stockfish")
    match.add_argument("--games", type=int, default=2)
    match.add_argument("--model-color", choices=("white", "black", "alternate"), default="alternate")
    match.add_argument("--stockfish-skill", type=int, default=0)
    match.add_argument("--stockfish-depth", type=int, default=1)
    match.add_argument("--stockfish-movetime", type=float)
    match.add_argument("--max-plies", type=int, default=400)
    match.add_argument("--temperature", type=float, default=0.0)
    match.add_argument("--top-k", type=int, default=0)
    match.add_argument("--unconstrained", action="store_true")
    match.add_argument("--record-top-k", type=int, default=5)
    match.add_argument("--sf-analyze", action="store_true", help="the engine also judges the model's moves")
    match.add_argument("--blunder-threshold-cp", type=int, default=C.BLUNDER_CP)
    legal = commands.add_parser("legal-rate", parents=[shared], help="legality of unmasked predictions")
    legal.add_argument("--positions")
    legal.add_argument("--sample-from-games")
    legal.add_argument("--n", type=int, default=C.RESERVOIR_SIZE)
    legal.add_argument("--seed", type=int, default=C.RESERVOIR_SEED)
    ppl = commands.add_parser("perplexity", parents=[shared], help="log probabilities of sequences")
    ppl.add_argument("--sequences", required=True)
    ppl.add_argument("--max-sequences", type=int)
    puzzles = commands.add_parser("puzzles", parents=[shared], help="first choices on puzzles")
    puzzles.add_argument("--puzzle-db", required=True)
    puzzles.add_argument("--rating-min", type=int)
    puzzles.add_argument("--rating-max", type=int)
    puzzles.add_argument("--sample", type=int)
    puzzles.add_argument("--themes", help="comma separated")
    rep = commands.add_parser("report", help="compute a run's metrics anew")
    rep.add_argument("run_id")
    rep.add_argument("--evals-dir", default="evals")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    configure_logging()
    spark = session()
    if args.command == "prepare":
        from .sources.scans import read_games

        default = C.FINETUNE_GAMES if args.high_elo else C.BASE_GAMES
        counts = prepare.prepare(spark, read_games(spark, args.games_path), args.out, args.num_games or default, args.high_elo, min_elo=args.min_elo, max_diff=args.max_rating_diff, max_gap=args.max_elo_gap)
        print(counts)
        return 0
    if args.command == "report":
        from .sources.sinks import exists

        folder = f"{args.evals_dir}/{args.run_id}"
        if not exists(spark, folder):
            print(f"no such run: {folder}", file=sys.stderr)
            return 1
        print(report.summary(report.report(Run(spark, folder))))
        return 0
    evaluator = args.command.replace("-", "_")
    run_id = make_run_id(resolve_checkpoint_tag(args.checkpoint, args.checkpoint_tag), evaluator)
    folder, factory = f"{args.evals_dir}/{run_id}", load_factory(args.checkpoint, args.scorer)
    if args.command == "vs-stockfish":
        movetime = args.stockfish_movetime
        config = MatchConfig(
            args.games, args.model_color, args.stockfish_skill, args.stockfish_depth if movetime is None else None, movetime, args.max_plies, args.unconstrained, args.record_top_k, args.blunder_threshold_cp
        )
        command = args.stockfish
        extra = {"temperature": args.temperature, "top_k": args.top_k, **({"sf_analyze": True} if args.sf_analyze else {})}
        run = evaluate.run_match(spark, factory, lambda: evaluate.UciOpponent(command), config, folder, run_id, args.checkpoint, extra)
    elif args.command == "legal-rate":
        run = evaluate.run_legal_rate(spark, factory, LegalRateConfig(args.positions, args.sample_from_games, args.n, args.seed), folder, run_id, args.checkpoint)
    elif args.command == "puzzles":
        themes = tuple(args.themes.split(",")) if args.themes else None
        run = evaluate.run_puzzles(spark, factory, PuzzleConfig(args.puzzle_db, args.rating_min, args.rating_max, themes, args.sample), folder, run_id, args.checkpoint)
    else:
        run = evaluate.run_perplexity(spark, factory, PerplexityConfig(args.sequences, args.max_sequences), folder, run_id, args.checkpoint)
    print(report.summary(report.report(run)))
    return 0


if __name__ == "__main__":
    sys.exit(main())

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pawnmill.chess.board import START_FEN, Board
from pawnmill.functions import arrays
from pawnmill.operators import scoring
from pawnmill.operators.vocabulary import token_list
from pawnmill.plans import evaluate as E
from pawnmill.plans import report
from pawnmill.plans.runs import LegalRateConfig, MatchConfig, PerplexityConfig, Run


def test_perplexity_run(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    rows = [{"id": "a", "perspective": "white", "moves": ["e2e4", "e7e5"]}, {"id": "b", "perspective": "black", "moves": ["e2e4", "e7e5", "g1f3"], "is_draw": True}]
    p.write_text("\n".join(map(json.dumps, rows)))
    run = E.run_perplexity(spark, scoring.UniformScorer, PerplexityConfig(str(p)), str(tmp_path / "run"), "r", "c")
    got = {r["position_id"]: r["token_logprobs"] for r in run.read_records().collect()}
    assert [len(got["a"]), len(got["b"])] == [2, 4]
    assert all(x == pytest.approx(-math.log(1974)) for x in got["a"] + got["b"])
    before = sorted(r["value"] for r in spark.read.text(run.path("records.jsonl")).collect())
    payload = report.report(run)
    assert payload["num_tokens"] == 6 and payload["perplexity"] == pytest.approx(1974)
    assert before == sorted(r["value"] for r in spark.read.text(run.path("records.jsonl")).collect())
    assert run.read_metrics()["num_sequences"] == 2 and "perplexity" in report.summary(payload)
    p.write_text(json.dumps(rows[0] | {"moves": ["z9z9"]}))
    with pytest.raises(Exception, match="z9z9"):
        E.run_perplexity(spark, scoring.UniformScorer, PerplexityConfig(str(p)), str(tmp_path / "bad"), "r", "c")


def test_legal_rate_run(spark, tmp_path):
    (tmp_path / "p.fen").write_text(f"{START_FEN}\n")
    run = E.run_legal_rate(spark, scoring.HashScorer, LegalRateConfig(positions_path=str(tmp_path / "p.fen")), str(tmp_path / "run"), "r", "c")
    assert report.report(run)["legal_rate"]["overall"]["n"] == 1
    (tmp_path / "g.pgn").write_text('[Event "a"]\n\n1. e4 e5 2. Nf3 Nc6 *\n\n[Event "b"]\n\n1. d4 d5 2. c4 e6 *\n')
    for n, want in ((4, 4), (1000, 8)):
        config = LegalRateConfig(sample_from_games_path=str(tmp_path / "g.pgn"), sample_n=n)
        rows = E.positions(spark, config).collect()
        assert len(rows) == want and all(Board(r["fen"]).ply == len(r["moves"]) for r in rows)


class Resigns:
    def configure(self, options):
        pass

    def play(self, board, limit):
        return None


def test_match(spark, tmp_path):
    config = MatchConfig(games=3, max_plies=12)
    run = E.run_match(spark, scoring.HashScorer, E.FirstMoveOpponent, config, str(tmp_path / "run"), "r", "c", {"temperature": 0.0})
    records = run.read_records()
    games = {r["game_id"]: r for r in records.where("record_type = 'per_game'").collect()}
    assert [games[g]["model_side"] for g in sorted(games)] == ["white", "black", "white"]
    assert all(r["termination"] in ("max-plies", "natural") for r in games.values())
    ids = sorted(r["event_id"] for r in records.collect())
    assert ids == list(range(len(ids)))
    move = records.where("record_type = 'per_move' AND ply = 0").first()
    assert move["model_move"] in move["legal_moves"] and len(move["model_top_k"]) == 5 and move["prior_opponent_move"] is None
    assert run.read_pgn().count("ModelColor") == 3
    assert report.report(run)["win_rate"]["overall"]["games"] == 3


def test_game_ends():
    scorer = scoring.HashScorer()
    _, game, _ = E.play_game("g", "white", scorer, Resigns(), MatchConfig())
    assert (game["termination"], game["result"], game["ply_count"]) == ("stockfish-resigned", "*", 1)
    records, game, _ = E.play_game("g", "white", scorer, Resigns(), MatchConfig(unconstrained=True))
    assert game["termination"] == "illegal-move" and records[-1]["raw_sample_legal"] is False and not records[-1]["mask_used"]


def test_prediction_modes():
    board, tokens = Board(), token_list()

    class Wants:
        def logits(self, prefixes):
            x = np.zeros((1, len(tokens)))
            x[0, tokens.index("e7e8q")] = 5
            x[0, tokens.index("e2e4")] = 4
            return x

    masked = scoring.predict(Wants(), board, [3])
    assert (masked.move, masked.raw_move, masked.raw_legal, masked.top_k[0][0]) == ("e2e4", "e7e8q", False, "e2e4")
    free = scoring.predict(Wants(), board, [3], constrained=False, record_top_k=0)
    assert (free.move, free.error, free.top_k) == ("e7e8q", "illegal-move", ())
    over = Board("rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3")
    assert scoring.predict(Wants(), over, [3]).error == "game-over"
    draws = {scoring.predict(Wants(), board, [3], temperature=1.0, top_k=3, seed=(k,)).move for k in range(20)}
    assert len(draws) > 1


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0], [0, 3])], "x array<double>, ok array<int>")
    r = df.select(
        arrays.argmax("x").alias("a"), arrays.masked_argmax("x", "ok").alias("m"), arrays.masked_argmax("x", F.array().cast("array<int>")).alias("none"), arrays.log_softmax("x").alias("l"),
        arrays.top_k("x", 2).alias("t"), arrays.top_k("x", 0).alias("z"), arrays.sample_index("x", 0.0, 0).alias("g"), arrays.sample_index("x", 1.0, 2, F.lit(7)).alias("s"),
    ).first()
    assert (r["a"], r["m"], r["none"], r["g"]) == (1, 0, None, 1) and r["s"] in (1, 2)
    assert sum(math.exp(v) for v in r["l"]) == pytest.approx(1)
    assert [(p["id"], p["logprob"]) for p in r["t"]] == [(1, 3.0), (2, 3.0)] and r["z"] == []


def test_uniform_scores(spark):
    df = spark.createDataFrame([(1, [3, 7, 9]), (2, [3]), (3, [])], "id int, input_ids array<int>")
    assert {r["id"]: len(r["token_logprobs"]) for r in scoring.score_sequences(df, scoring.UniformScorer).collect()} == {1: 2, 2: 0, 3: 0}


def test_report_command(spark, tmp_path, capsys):
    from pawnmill import cli

    run = Run(spark, str(tmp_path / "evals" / "r"))
    run.write_config({"evaluator": "perplexity"})
    run.append_records(spark.createDataFrame([("r", 0, "perplexity", "c", "p", "", [-1.0], "per_perplexity")], "run_id string, event_id int, evaluator string, checkpoint string, position_id string, fen string, token_logprobs array<double>, record_type string"))
    assert cli.main(["report", "r", "--evals-dir", str(tmp_path / "evals")]) == 0
    assert "tokens 1" in capsys.readouterr().out
    assert cli.main(["report", "none", "--evals-dir", str(tmp_path / "evals")]) == 1
    args = cli.parser().parse_args(["vs-stockfish", "--checkpoint", "a/b", "--games", "3"])
    assert (args.games, args.stockfish_depth) == (3, 1)


def test_engine_process(tmp_path):
    """The engine protocol, spoken with a small script."""
    from pawnmill.chess.board import Board as B

    log = tmp_path / "log"
    script = tmp_path / "engine"
    script.write_text(
        "#!/usr/bin/env python3\nimport sys\n"
        f"log = open({str(log)!r}, 'w', buffering=1)\n"
        "for line in sys.stdin:\n    line = line.strip()\n    log.write(line + '\\n')\n"
        "    if line == 'uci': print('id name x', 'uciok', sep='\\n', flush=True)\n"
        "    if line == 'isready': print('readyok', flush=True)\n"
        "    if line.startswith('go'): print('info depth 1', 'bestmove ' + ('(none)' if 'movetime' in line else 'e2e4'), sep='\\n', flush=True)\n"
        "    if line == 'quit': break\n"
    )
    script.chmod(0o755)
    engine = E.UciOpponent(str(script))
    engine.configure({"Skill Level": 3})
    assert engine.play(B(), {"depth": 2}) == "e2e4" and engine.play(B(), {"time": 0.05}) is None
    engine.close()
    said = log.read_text().split("\n")
    assert "setoption name Skill Level value 3" in said and "go depth 2" in said and "go movetime 50" in said and said[-2] == "quit"


def test_unknown_moves_and_picked_logprobs(spark):
    df = spark.createDataFrame([("a", ["e2e4"]), ("b", ["e2e4", "e2e9"])], "id string, moves array<string>")
    assert scoring.check_vocabulary(df.where("id = 'a'")).count() == 1
    with pytest.raises(Exception, match="b: unknown move e2e9"):
        scoring.check_vocabulary(df).collect()
    rows = spark.createDataFrame([([[-1.0, -2.0], [-3.0, -4.0]], [0, 1, 0])], "lp array<array<double>>, ids array<int>")
    assert rows.select(arrays.pick_logprobs("lp", "ids").alias("p")).first()["p"] == [-2.0, -3.0]
    labels = spark.createDataFrame([([5, 0, 7],)], "ids array<int>").select(arrays.labels_of("ids").alias("l")).first()["l"]
    assert labels == [5, -100, 7]


def test_scorers_in_one_pass_agree_with_prefixes(spark):
    class Slow:
        def logits(self, prefixes):
            return np.stack([np.sin(np.arange(50) * (1 + sum(p))) for p in prefixes])

    class Fast(Slow):
        def sequence_logits(self, line):
            for at in range(1, len(line), 3):
                yield self.logits([line[:k] for k in range(at, min(at + 3, len(line)))])

    df = spark.createDataFrame([(k, [(j * k) % 50 for j in range(k)]) for k in range(12)], "id int, input_ids array<int>")
    slow, fast = ({r["id"]: r["token_logprobs"] for r in scoring.score_sequences(df, f).collect()} for f in (Slow, Fast))
    assert slow == fast and [len(slow[k]) for k in range(12)] == [0, 0, *range(1, 11)]


def test_legal_rate_events_are_in_source_order(spark, tmp_path):
    (tmp_path / "p.fen").write_text("\n".join([START_FEN] * 12))
    run = E.run_legal_rate(spark, scoring.HashScorer, LegalRateConfig(positions_path=str(tmp_path / "p.fen")), str(tmp_path / "run"), "r", "c")
    rows = run.read_records().orderBy("event_id").collect()
    assert [r["position_id"] for r in rows] == [f"p.fen:{k}" for k in range(1, 13)] and [r["event_id"] for r in rows] == list(range(12))


class Judge(E.FirstMoveOpponent):
    """Likes a pawn move of White's best, and finds each position 50 better for White than plies played."""

    def analyse(self, board, limit):
        return "e2e4", 50 - 300 * board.ply


def test_analysed_moves(spark):
    _, game, _ = E.play_game("g", "white", scoring.HashScorer(), Judge(), MatchConfig(max_plies=4))
    records, _, _ = E.play_game("g", "white", scoring.HashScorer(), Judge(), MatchConfig(max_plies=4), analyst=Judge().analyse)
    assert [(r["sf_best_move"], r["sf_eval_before_cp"], r["sf_eval_after_cp"], r["centipawn_loss"], r["is_blunder"]) for r in records] == [("e2e4", 50, -250, 300, True), ("e2e4", -550, -850, 300, True)]
    records, _, _ = E.play_game("g", "black", scoring.HashScorer(), Judge(), MatchConfig(max_plies=4), analyst=Judge().analyse)
    assert [(r["centipawn_loss"], r["is_blunder"]) for r in records] == [(0, False)] * 2
    found = E.play_games(spark, scoring.HashScorer, Judge, MatchConfig(games=2, max_plies=4), "r", "c", analyse=True)
    assert found.where("record_type = 'per_move' AND sf_best_move = 'e2e4' AND centipawn_loss IS NOT NULL").count() == 4


def test_engine_scores(tmp_path):
    script = tmp_path / "engine"
    script.write_text("#!/usr/bin/env python3\nimport sys\nfor line in sys.stdin:\n    if line.startswith('uci'): print('uciok', flush=True)\n    if line.startswith('go'): print('info depth 1 score cp 35 pv e2e4', 'info depth 2 score ' + ('mate 3' if '2' in line else 'cp 20') + ' pv e2e4', 'bestmove e2e4', sep='\\n', flush=True)\n    if line.startswith('quit'): break\n")
    script.chmod(0o755)
    engine, black = E.UciOpponent(str(script)), Board()
    black.push_uci("e2e4")
    assert engine.analyse(Board(), {"depth": 1}) == ("e2e4", 20) and engine.analyse(black, {"depth": 1})[1] == -20 and engine.analyse(Board(), {"depth": 2})[1] == 9997
    engine.close()


class Knows:
    """Wants the moves of one line, whatever the position."""

    line = ("d8h4", "g2g3", "h4g3")

    def logits(self, prefixes):
        tokens, out = token_list(), np.zeros((len(prefixes), len(token_list())))
        for row, p in zip(out, prefixes):
            row[tokens.index("d8h4")] = 9
        return out


def test_puzzles(spark, tmp_path):
    from pawnmill.plans.runs import PuzzleConfig

    after = "rnbqkbnr/pppp1ppp/8/4p3/8/5P2/PPPPP1PP/RNBQKBNR w KQkq - 0 2"
    (tmp_path / "p.csv").write_text(f"PuzzleId,FEN,Moves,Rating,Themes\n1,{after},g2g4 d8h4,600,mate\n2,{after},g2g4 g8f6,900,mate quiet\n3,{after},a7a5 b2b4,900,mate\n4,{START_FEN},e2e4,900,mate\n5,{after},g2g4 d8h4,2900,mate\n")
    run = E.run_puzzles(spark, Knows, PuzzleConfig(str(tmp_path / "p.csv"), rating_max=2000, themes=("mate",)), str(tmp_path / "run"), "r", "c")
    rows = {r["puzzle_id"]: (r["model_attempt"], r["solution"], r["solved"]) for r in run.read_records().collect()}
    assert rows == {"1": (["d8h4"], ["d8h4"], True), "2": (["d8h4"], ["g8f6"], False), "3": ([], ["b2b4"], False), "4": ([], [], False)}
    payload = report.report(run)
    assert report.summary(payload).startswith("puzzles 4: 1 solved") and payload["accuracy"]["overall"]["n"] == 4 and run.read_metrics() == payload


def test_positions_that_repeat_are_scored_once(spark):
    """400 rows of two lines: a scorer that is asked for more prefixes than there are different ones fails."""

    class Sparing(scoring.HashScorer):
        asked = 0

        def logits(self, prefixes):
            self.asked += len(prefixes)
            assert self.asked <= 2
            return super().logits(prefixes)

    lines = [["e2e4"], ["e2e4", "e7e5"]]
    fens = [Board(), Board()]
    for board, line in zip(fens, lines):
        for m in line:
            board.push_uci(m)
    rows = [(str(k), fens[k % 2].fen(), "black" if k % 2 == 0 else "white", lines[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "position_id string, fen string, perspective string, moves array<string>").coalesce(1)
    found = {r["position_id"]: (r["model_move"], r["legal"]) for r in scoring.predict_positions(df, Sparing).collect()}
    for k in range(400):
        want = scoring.predict(scoring.HashScorer(), fens[k % 2], scoring.game_tokens(rows[k][2], lines[k % 2]), record_top_k=0)
        assert found[str(k)] == (want.raw_move, want.raw_legal)


def test_legality_is_the_same_with_and_without_a_mask():
    board, tokens = Board("r3k2r/P6p/8/3pP3/8/8/7P/R3K2R w KQkq d6 0 1"), token_list()
    for k in range(0, len(tokens)):
        logits = np.zeros(len(tokens))
        logits[k] = 1
        free, masked = (scoring.choose(logits, board, constrained=c, record_top_k=0) for c in (False, True))
        assert (free.raw_move, free.raw_legal) == (masked.raw_move, masked.raw_legal) and (free.error is None) == free.raw_legal


def test_lines_that_repeat_are_replayed_once(monkeypatch):
    import pandas as pd

    from pawnmill.operators import chess_udfs

    played = []
    found = chess_udfs._of_lines(pd.Series([["e2e4"], None, ["e2e4"], []]), lambda line: played.append(line) or str(len(line)))
    assert found.tolist() == ["1", "0", "1", "0"] and played == [("e2e4",), ()]

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pawnmill.operators import metrics as M
from pawnmill.operators import preferences as P
from pawnmill.plans.report import compute_all
from pawnmill.schemas import superset


def by(df):
    return {(r["dimension"], r["stratum"]): r for r in df.collect()}


def test_win_rate(spark):
    rows = [("white", "1-0"), ("white", "0-1"), ("black", "0-1"), ("black", "1/2-1/2"), ("white", "*")]
    found = by(M.win_rate(spark.createDataFrame(rows, "model_side string, result string")))
    o = found["overall", "overall"]
    assert (o["games"], o["wins"], o["losses"], o["draws"], o["unfinished"], o["win_rate"], o["score_rate"]) == (5, 2, 1, 1, 1, 0.5, 0.625)
    b = found["model_side", "black"]
    assert (b["games"], b["wins"], b["draws"], b["win_rate"], b["score_rate"]) == (2, 1, 1, 0.5, 0.75)


def test_legal_rate_and_zero_fill(spark):
    schema = "model_side string, phase string, raw_sample_legal boolean"
    found = by(M.legal_rate(spark.createDataFrame([("white", "opening", True), ("white", "opening", False), ("black", "middle", True)], schema)))
    assert found["overall", "overall"]["rate"] == pytest.approx(2 / 3)
    assert [found["phase", p]["rate"] for p in ("opening", "middle", "endgame")] == [0.5, 1.0, 0.0]
    assert [found["model_side", s]["rate"] for s in ("white", "black")] == [0.5, 1.0]
    empty = by(M.legal_rate(spark.createDataFrame([], schema)))
    assert len(empty) == 6 and all((r["n"], r["legal"], r["rate"]) == (0, 0, 0.0) for r in empty.values())


def test_perplexity(spark):
    df = spark.createDataFrame([([-1.0, -2.0],), ([-3.0, -4.0],)], "token_logprobs array<double>")
    r = M.perplexity(df).first()
    assert (r["num_sequences"], r["num_tokens"], r["mean_nll"]) == (2, 4, 2.5)
    assert r["bits_per_token"] == pytest.approx(2.5 / math.log(2)) and r["perplexity"] == pytest.approx(math.exp(2.5))
    e = M.perplexity(df.where("false")).first()
    assert tuple(e) == (0, 0, 0.0, 0.0, 0.0)
    one = M.perplexity(spark.createDataFrame([([],)], "token_logprobs array<double>")).first()
    assert (one["num_sequences"], one["perplexity"]) == (1, 0.0)


def test_dispatch(spark):
    empty = spark.createDataFrame([], superset().add("record_type", "string"))
    got = compute_all(empty, {"evaluator": "vs_stockfish", "stockfish_skill": 3})
    assert got["stockfish_skill"] == 3 and set(got["win_rate"]["by_model_side"]) == {"white", "black"}
    assert set(got["legal_rate"]["by_phase"]) == {"opening", "middle", "endgame"}
    assert compute_all(empty, {"evaluator": "legal_rate"})["legal_rate"]["overall"] == {"n": 0, "legal": 0, "rate": 0.0}
    assert compute_all(empty, {"evaluator": "perplexity"})["perplexity"] == 0.0
    with pytest.raises(ValueError, match="unsupported evaluator"):
        compute_all(empty, {"evaluator": "unknown"})
    assert compute_all(empty, {"evaluator": "puzzles"})["accuracy"]["overall"] == {"n": 0, "solved": 0, "accuracy": 0.0}


def test_losses_and_pairs(spark):
    rows = [("f1", "g", 1, "white", "a", "b", "x", False, True, 300, 50), ("f2", "g", 2, "black", "a", None, "a", True, True, -50, 300), ("f1", "g", 3, "white", "c", "b", "y", False, False, 0, 90), ("f1", "h", 1, "white", "d", "b", "d", True, True, 500, 100)]
    schema = "fen_before string, game_id string, ply int, side_to_move string, model_move string, sf_best_move string, raw_sample_move string, raw_sample_legal boolean, mask_used boolean, sf_eval_before_cp int, sf_eval_after_cp int"
    moves = P.with_losses(spark.createDataFrame(rows, schema))
    assert [r["centipawn_loss"] for r in moves.orderBy("game_id", "ply").collect()] == [250, 350, 0, 400]
    assert [tuple(r) for r in P.legality_pairs(moves).collect()] == [("f1", "a", "x")]
    assert P.quality_pairs(moves).count() == 2 and P.quality_pairs(moves, dedup=True).count() == 1
    assert P.engine_pairs(moves).count() == 3


def test_minimax_and_types(spark):
    replies = spark.createDataFrame([("p", "a", 3), ("p", "a", -5), ("p", "b", 1), ("p", "b", 2), ("p", "c", 1)], "pos string, cand string, score int")
    assert tuple(P.minimax(replies, ["pos"], "cand", "score").first()) == ("p", "b", 1)
    every = F.array(*map(F.lit, ["a", "b", "c"]))
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "c"])], "id int, legal array<string>")
    rows = df.select(P.illegal_negative(every, "legal", 0, "id").alias("n"), P.legality_labels(every, "legal").alias("l")).collect()
    assert rows[0]["n"] in ("b", "c") and rows[1]["n"] is None
    assert [r["l"] for r in rows] == [[1, 0, 0], [1, 1, 1]]


def test_distribution_and_move_types(spark):
    from pawnmill.functions import scalar
    from pawnmill.operators import preferences
    from pawnmill.plans import prepare

    df = spark.createDataFrame([("a", "draw", "e4"), ("a", "white", "e4"), ("b", "white", "d4")], "elo_bucket string, result string, opening_family string")
    found = [tuple(r) for r in prepare.distribution(df).collect()]
    assert found == sorted(found) and ("elo_bucket", "a", 2) in found and len(found) == 6
    flags = spark.createDataFrame([(True, True, False, False, "check"), (True, False, False, True, "capture"), (False, False, True, False, "castle"), (False, False, False, True, "pawn"), (False, False, False, False, "quiet")], "x boolean, c boolean, k boolean, p boolean, want string")
    assert flags.where(preferences.move_type(F.col("x"), F.col("c"), F.col("k"), F.col("p")) != F.col("want")).count() == 0
    turn = spark.createDataFrame([(True, "white"), (False, "black")], "w boolean, want string")
    assert turn.where(scalar.side_for_turn("w") != F.col("want")).count() == 0


@pytest.mark.parametrize("first", [True, False])
def test_backward_induction_equals_recursion(spark, first):
    import random

    rng, nodes = random.Random(7), [(f"r{k}", None, 0, None) for k in range(3)] + [("lone", None, 0, 4)]
    for ply in range(1, 6):
        above = [n for n, _, p, s in nodes if p == ply - 1 and s is None]
        for k in range(40):
            nodes.append((f"{ply}-{k:02}", rng.choice(above), ply, rng.randrange(9) if ply == 5 or rng.random() < 0.3 else None))
    children = {}
    for n, parent, _, _ in nodes:
        children.setdefault(parent, []).append(n)
    at = {n: (p, s) for n, _, p, s in nodes}
    want = {}

    def value(n):
        ply, score = at[n]
        some = [(v, c) for c in children.get(n, []) if (v := value(c)) is not None]
        if not some:
            return score
        sign = -1 if (ply % 2 == 0) == first else 1
        v, best = min((sign * v, c) for v, c in some)
        want[n] = (ply, sign * v, best)
        return sign * v

    for n in children[None]:
        value(n)
    df = spark.createDataFrame(nodes, "node string, parent string, ply int, score int")
    found = {r["node"]: (r["ply"], r["value"], r["best"]) for r in P.backward_induction(df, 5, maximise_first=first).collect()}
    assert found == want

from __future__ import annotations

import random

import numpy as np
import pytest

from pawnmill.operators import ratings as R


def dense(games, prior=0.0, rounds=20_000):
    """The same rounds over a dense matrix of counts; the fixed point, if there are enough."""
    players = sorted({x for a, b, _ in games for x in (a, b)})
    at = {p: k for k, p in enumerate(players)}
    n, won = np.zeros((len(at),) * 2), np.zeros(len(at))
    for a, b, points in games:
        i, j = at[a], at[b]
        n[i, j] += 1
        n[j, i] += 1
        won[i] += points
        won[j] += 1 - points
    p = np.ones(len(at))
    for _ in range(rounds):
        new = (won + prior / 2) / ((n / (p[:, None] + p[None, :])).sum(1) + prior / (p + 1))
        new = new if prior else new / np.exp(np.log(new[new > 0]).mean())
        if np.abs(new - p).max() < 1e-12:
            break
        p = new
    return dict(zip(players, p))


def games(n_players, n_games, seed):
    rng = random.Random(seed)
    strength = [2 ** rng.gauss(0, 1) for _ in range(n_players)]
    out = []
    for _ in range(n_games):
        a, b = rng.sample(range(n_players), 2)
        out.append((a, b, 0.5 if rng.random() < 0.2 else float(rng.random() < strength[a] / (strength[a] + strength[b]))))
    return out


@pytest.mark.parametrize("prior", [0.0, 2.0])
def test_equals_a_dense_solver(spark, prior):
    rows = games(9, 400, 4)
    if prior:
        rows += [(100, 0, 1.0), (0, 101, 1.0)]  # one who has won everything, one who has lost everything
    df = spark.createDataFrame([*rows, (3, 3, 1.0), (None, 1, 1.0), (1, 2, None)], "a int, b int, x double")
    found = {r["player"]: r["strength"] for r in R.strengths(R.pair_counts(df, "a", "b", "x"), rounds=8, close=0.0, prior=prior).collect()}
    want, fixed = dense(rows, prior, 8), dense(rows, prior)
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-9) and abs(np.log(found[k] / fixed[k])) < (0.5 if k < 100 else 2) for k in want)


def test_two_players_agree_with_the_closed_form(spark):
    df = spark.createDataFrame([("a", "b", 1.0)] * 3 + [("b", "a", 1.0)], "a string, b string, x double")
    elo = {r["player"]: r["elo"] for r in R.ratings(R.pair_counts(df, "a", "b", "x"), close=1e-3).collect()}
    assert elo["a"] - elo["b"] == pytest.approx(400 * np.log10(3), abs=2)
    assert R.ratings(R.pair_counts(df.limit(0), "a", "b", "x")).count() == 0

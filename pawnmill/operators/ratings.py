"""Ratings of many players from pair counts: an iterative maximum-likelihood fit.

A player of strength p beats one of strength q with the chance p / (p + q). Strengths follow
from the counts by minorise-maximise rounds: each player's points over the sum of games /
(own strength + opponent's). A draw is half a point for both. Each round is a join and an
aggregation over the pairs, both by player, and ends in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

ROUNDS, CLOSE = 200, 1e-9


def pair_counts(games: DataFrame, a: str, b: str, points: str) -> DataFrame:
    """player, opponent, games, points: both directions of every pair; ``points`` is a's, 0 to 1. Games against oneself and with nulls leave."""
    some = games.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(points).isNotNull() & (F.col(a) != F.col(b)))
    one = some.groupBy(F.col(a).alias("player"), F.col(b).alias("opponent")).agg(F.count(F.lit(1)).alias("games"), F.sum(F.col(points).cast("double")).alias("points"))
    other = one.select(F.col("opponent").alias("player"), F.col("player").alias("opponent"), "games", (F.col("games") - F.col("points")).alias("points"))
    return one.unionByName(other).groupBy("player", "opponent").agg(F.sum("games").alias("games"), F.sum("points").alias("points"))


def strengths(pairs: DataFrame, rounds: int = ROUNDS, close: float = CLOSE, prior: float = 0.0) -> DataFrame:
    """player, strength (geometric mean 1, all 1 at first) after ``rounds`` rounds, or once none changes by more than ``close`` of itself.

    ``prior`` games, half won, against a player of strength 1 keep those who won or lost all
    games finite; without it such a strength tends to infinity or 0 and never settles.
    """
    pairs = checkpointed(pairs)
    totals = checkpointed(pairs.groupBy("player").agg((F.sum("points") + prior / 2).alias("won")))
    now = totals.select("player", F.lit(1.0).alias("strength"))
    for _ in range(rounds):
        theirs = now.select(F.col("player").alias("opponent"), F.col("strength").alias("theirs"))
        met = pairs.join(theirs, "opponent").join(now, "player")
        load = met.groupBy("player").agg(F.sum(F.col("games") / (F.col("strength") + F.col("theirs"))).alias("load"), F.first("strength").alias("before"))
        load = load.withColumn("load", F.col("load") + F.lit(float(prior)) / (F.col("before") + 1))
        nxt = load.join(totals, "player").select("player", "before", (F.col("won") / F.col("load")).alias("strength"))
        if not prior:  # the scale is free: keep the geometric mean at 1 (of those who have won anything)
            mean = nxt.agg(F.avg(F.when(F.col("strength") > 0, F.log("strength")))).first()[0] or 0.0
            nxt = nxt.withColumn("strength", F.col("strength") / F.exp(F.lit(mean)))
        nxt = checkpointed(nxt)
        moved = nxt.agg(F.max(F.abs(F.col("strength") - F.col("before")) / F.greatest("strength", F.lit(1e-300)))).first()[0]
        now = nxt.select("player", "strength")
        if moved is None or moved <= close:
            break
    return now


def ratings(pairs: DataFrame, rounds: int = ROUNDS, close: float = CLOSE, prior: float = 0.0) -> DataFrame:
    """player, strength and elo (400 for a factor of ten, 0 for strength 1; null for strength 0)."""
    return strengths(pairs, rounds, close, prior).withColumn("elo", F.when(F.col("strength") > 0, F.lit(400.0) * F.log10("strength")))

"""Win rates, legality rates and perplexity with zero-filled strata.

Overall figures and one-way strata are one GROUPING SETS aggregation: one scan, one shuffle
of partial sums. A dimension frame with every stratum, the overall one included, is the left
side of a broadcast join, so strata without rows, and empty inputs, report zeros. Its rows
are the members of fixed enumerations.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.arrays import array_sum
from ..functions.scalar import ratio

OVERALL = "overall"


def stratum_frame(spark: SparkSession, dimensions: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(OVERALL, OVERALL), *((d, m) for d, members in dimensions.items() for m in members)]
    return spark.createDataFrame(rows, "dimension string, stratum string")


def stratified(df: DataFrame, dimensions: Mapping[str, Sequence[str] | None], measures: Mapping[str, Column], zero_fill: bool = True, more: Sequence[str] = ()) -> DataFrame:
    """dimension, stratum and measures: overall and for each member of each dimension.

    A dimension whose members are None reports the members that occur, null included. One
    named in ``more`` reports its members, and besides them others that occur.
    """
    names = list(dimensions)
    keyed = df.select(*[F.col(n).cast("string").alias(f"__{n}") for n in names], *[c.alias(f"__m_{k}") for k, (_, c) in enumerate(_inputs(measures))])
    aggregates = [F.sum(f"__m_{k}").alias(k_name) for k, (k_name, _) in enumerate(_inputs(measures))]
    if names:
        sets = [[], *[[F.col(f"__{n}")] for n in names]]
        grouped = keyed.groupingSets(sets, *[F.col(f"__{n}") for n in names]).agg(F.grouping_id().alias("__gid"), *aggregates)
    else:
        grouped = keyed.agg(F.lit(0).alias("__gid"), *aggregates)
    every = (1 << len(names)) - 1
    which, value = F.when(F.col("__gid") == every, OVERALL), F.when(F.col("__gid") == every, OVERALL)
    for k, n in enumerate(names):
        here = F.col("__gid") == every - (1 << (len(names) - 1 - k))
        which, value = which.when(here, n), value.when(here, F.col(f"__{n}"))
    found = grouped.select(which.alias("dimension"), value.alias("stratum"), *[k for k, _ in _inputs(measures)])
    if not zero_fill:
        return found
    fixed = {n: m for n, m in dimensions.items() if m is not None}
    frame = stratum_frame(df.sparkSession, fixed)
    # at most one row of found for each of the frame's, which the enumerations bound
    known = found.join(F.broadcast(frame), ["dimension", "stratum"], "left_semi")
    filled = frame.join(F.broadcast(known), ["dimension", "stratum"], "left")
    filled = filled.select("dimension", "stratum", *[F.coalesce(k, F.lit(0)).alias(k) for k, _ in _inputs(measures)])
    if more:
        others = found.where(F.col("dimension").isin(list(more))).join(F.broadcast(frame), ["dimension", "stratum"], "left_anti")
        filled = filled.unionByName(others)
    loose = [n for n, m in dimensions.items() if m is None]
    return filled.unionByName(found.where(F.col("dimension").isin(loose))) if loose else filled


def _inputs(measures: Mapping[str, Column]) -> list[tuple[str, Column]]:
    return list(measures.items())


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")


def win_rate(games: DataFrame, result: str = "result", side: str = "model_side", by_side: bool = True) -> DataFrame:
    """games, wins, losses, draws, unfinished, win_rate and score_rate, overall and by side."""
    r, s = F.col(result), F.col(side)
    won = ((r == "1-0") & (s == "white")) | ((r == "0-1") & (s == "black"))
    lost = ((r == "1-0") & (s == "black")) | ((r == "0-1") & (s == "white"))
    measures = {"games": F.lit(1).cast("long"), "wins": _flag(won), "losses": _flag(lost), "draws": _flag(r == "1/2-1/2"), "unfinished": _flag(r == "*")}
    scored = F.col("games") - F.col("unfinished")
    counts = stratified(games, {side: C.SIDES} if by_side else {}, measures)
    return counts.withColumns({"win_rate": ratio(F.col("wins"), scored), "score_rate": ratio(F.col("wins") + F.lit(0.5) * F.col("draws"), scored)})


def legal_rate(moves: DataFrame, legal: str = "raw_sample_legal", dimensions: Mapping[str, Sequence[str] | None] | None = None, more: Sequence[str] = ()) -> DataFrame:
    """n, legal and rate, overall and by each dimension; for ``more`` see ``stratified``."""
    dimensions = {"phase": C.PHASES, "model_side": C.SIDES} if dimensions is None else dimensions
    counts = stratified(moves, dimensions, {"n": F.lit(1).cast("long"), "legal": _flag(F.col(legal))}, more=more)
    return counts.withColumn("rate", ratio(F.col("legal"), F.col("n")))


def legality_tally(records: DataFrame) -> DataFrame:
    """n, legal and rate over per-move and per-position records; other types are ignored."""
    bits = records.where(F.col("record_type").isin("per_move", "per_legal_rate"))
    return legal_rate(bits.withColumn("__legal", F.coalesce("raw_sample_legal", "legal")), "__legal", {})


def perplexity(sequences: DataFrame, logprobs: str = "token_logprobs", by: Sequence[str] = ()) -> DataFrame:
    """Token-weighted figures; sequences count even when empty, and no tokens give zeros."""
    per_row = sequences.select(*by, array_sum(F.coalesce(logprobs, F.array().cast("array<double>"))).alias("s"), F.coalesce(F.size(logprobs), F.lit(0)).cast("long").alias("n"))
    total = per_row.groupBy(*by).agg(F.count(F.lit(1)).alias("num_sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_tokens"), F.sum("s").alias("s"))
    nll = ratio(-F.col("s"), F.col("num_tokens"))
    some = F.col("num_tokens") > 0
    return total.select(
        *by, "num_sequences", "num_tokens", nll.alias("mean_nll"), (nll / F.lit(math.log(2))).alias("bits_per_token"), F.when(some, F.exp(nll)).otherwise(F.lit(0.0)).alias("perplexity")
    )


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    """column, value, n for each of the columns, in one aggregation."""
    return stratified(df, {c: None for c in columns}, {"n": F.lit(1).cast("long")}, zero_fill=False).where(F.col("dimension") != OVERALL)


def strata_counts(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def top_k_accuracy(moves: DataFrame, actual: str, candidates: str = "model_top_k", ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Share of rows whose actual move is among the first k candidates."""
    place = F.array_position(F.transform(candidates, lambda p: p["move"]), F.col(actual))
    return moves.agg(F.count(F.lit(1)).alias("n"), *[ratio(F.sum(_flag(place.between(1, k))), F.count(F.lit(1))).alias(f"top{k}") for k in ks])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def score_columns(games: DataFrame) -> DataFrame:
    """wins, losses, draws, unfinished, pct (of the scored games) and elo of one set of games."""
    w = win_rate(games, by_side=False)
    pct = F.lit(100.0) * ratio(F.col("wins") + 0.5 * F.col("draws"), F.col("games") - F.col("unfinished"))
    return w.select("wins", "losses", "draws", "unfinished", pct.alias("pct"), elo_difference(F.col("score_rate")).alias("elo"))


def with_config(figures: DataFrame, config: Mapping[str, object]) -> DataFrame:
    """figures with a configuration's fields beside every row, as literals."""
    return figures.withColumns({k: F.lit(v) for k, v in config.items()})


def agreement(moves: DataFrame, a: str = "model_move", b: str = "sf_best_move") -> DataFrame:
    """Share of rows with a best move in which both agree."""
    known = moves.where(F.col(b).isNotNull())
    return known.agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(_flag(F.col(a) == F.col(b))), F.count(F.lit(1))).alias("agreement"))


def puzzle_accuracy(puzzles: DataFrame, bounds: Sequence[tuple[float, str]], top: str, solved: Column | None = None) -> DataFrame:
    """n, solved and accuracy overall, by rating bucket and by theme; ``solved`` if not told by equal lines."""
    from ..functions.scalar import bucketize

    solved = F.col("model_attempt") == F.col("solution") if solved is None else solved
    rows = puzzles.select(bucketize("rating", bounds, top).alias("rating_bucket"), "themes", solved.alias("ok"))
    flat = stratified(rows, {"rating_bucket": None}, {"n": F.lit(1).cast("long"), "solved": _flag(F.col("ok"))}, zero_fill=False)
    themed = rows.select(F.explode("themes").alias("theme"), "ok").groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.sum(_flag(F.col("ok"))).alias("solved"))
    both = flat.unionByName(themed.select(F.lit("theme").alias("dimension"), F.col("theme").alias("stratum"), "n", "solved"))
    return both.withColumn("accuracy", ratio(F.col("solved"), F.col("n")))


def elo_difference(score_rate: Column) -> Column:
    """Rating difference that the logistic model gives for a score strictly between 0 and 1."""
    return F.when((score_rate > 0) & (score_rate < 1), F.lit(400.0) * F.log10(score_rate / (F.lit(1.0) - score_rate)))


def gates(illegal_rate: Column, agreement_rate: Column, win: Column) -> Column:
    """The quality gate of a phase: few illegal moves, and agreement or wins."""
    return (illegal_rate < 0.05) & ((agreement_rate > 0.5) | (win > 0.6))

"""Preference pairs, centipawn loss, blunders, illegal negatives, shallow search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalar import hash_order


def centipawn_loss(before: Column | str, after: Column | str, side: Column | str) -> Column:
    """Loss of the side to move, from evaluations given for white; never below 0."""
    before, after, side = (F.col(c) if isinstance(c, str) else c for c in (before, after, side))
    return F.greatest(F.lit(0), F.when(side == "black", after - before).otherwise(before - after))


def is_blunder(loss: Column | str, threshold: int = C.BLUNDER_CP) -> Column:
    return (F.col(loss) if isinstance(loss, str) else loss) > threshold


def with_losses(moves: DataFrame, threshold: int = C.BLUNDER_CP) -> DataFrame:
    loss = centipawn_loss("sf_eval_before_cp", "sf_eval_after_cp", "side_to_move")
    return moves.withColumn("centipawn_loss", loss.cast("int")).withColumn("is_blunder", is_blunder("centipawn_loss", threshold))


def legality_pairs(moves: DataFrame) -> DataFrame:
    """prompt, chosen, rejected where masking replaced an illegal first choice."""
    return moves.where("mask_used AND NOT raw_sample_legal").select(
        F.col("fen_before").alias("prompt"), F.col("model_move").alias("chosen"), F.col("raw_sample_move").alias("rejected")
    )


def quality_pairs(moves: DataFrame, threshold: int = C.BLUNDER_CP, dedup: bool = False, order: Sequence[str] = ("game_id", "ply")) -> DataFrame:
    """prompt, chosen, rejected where the engine's move beats the played one by more than the threshold."""
    rows = moves.where((F.col("centipawn_loss") > threshold) & F.col("sf_best_move").isNotNull())
    if dedup:
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("fen_before").orderBy(*order))).where("__nth = 1")
    return rows.select(F.col("fen_before").alias("prompt"), F.col("sf_best_move").alias("chosen"), F.col("model_move").alias("rejected"))


def engine_pairs(moves: DataFrame, best: str = "sf_best_move", played: str = "model_move", prompt: str = "fen_before") -> DataFrame:
    """A pair for each ply at which the engine prefers another move."""
    return moves.where(F.col(best).isNotNull() & (F.col(best) != F.col(played))).select(F.col(prompt).alias("prompt"), F.col(best).alias("chosen"), F.col(played).alias("rejected"))


def illegal_negative(every: Column, legal: Column | str, seed: object, *keys: Column | str) -> Column:
    """One move of the vocabulary that is not legal, drawn by hash; null if there is none."""
    rest = F.array_except(every, F.col(legal) if isinstance(legal, str) else legal)
    draw = F.pmod(F.conv(F.substring(hash_order(seed, *keys), 1, 12), 16, 10).cast("long"), F.greatest(F.size(rest), F.lit(1)))
    return F.get(rest, draw.cast("int"))


def legality_labels(every: Column, legal: Column | str) -> Column:
    """A 0/1 vector over the vocabulary."""
    return F.transform(every, lambda t: F.array_contains(F.col(legal) if isinstance(legal, str) else legal, t).cast("int"))


def minimax(replies: DataFrame, position: Sequence[str], candidate: str, score: str, best_reply: bool = True) -> DataFrame:
    """The candidate whose worst reply is best, and its value; the least candidate of equal ones.

    Both levels are plain aggregations, so they pre-aggregate map-side.
    """
    worst = replies.groupBy(*position, candidate).agg((F.min(score) if best_reply else F.max(score)).alias("value"))
    best = worst.groupBy(*position).agg(F.min(F.struct((-F.col("value")).alias("down"), F.col(candidate).alias("candidate"))).alias("b"))
    return best.select(*position, F.col("b.candidate").alias(candidate), (-F.col("b.down")).alias("value"))


def backward_induction(nodes: DataFrame, depth: int, node: str = "node", parent: str = "parent", ply: str = "ply", score: str = "score", maximise_first: bool = True) -> DataFrame:
    """value and best child of every inner node of a game tree of any depth, level by level from the leaves.

    ``nodes`` has a row for each node: its parent (null at a root), its ply (0 at roots, up to
    ``depth``) and, at leaves, its score. The side at even plies maximises (or minimises, if
    not ``maximise_first``), the other does the opposite. A node without children has its own
    score; one with neither has no value and is passed over. Of equal children the least is
    best. Each level is one aggregation by parent, map-side first, and one join by node.
    """
    level = lambda k: nodes.where(F.col(ply) == k)
    values = level(depth).select(F.col(node).alias("__node"), F.col(parent).alias("__parent"), F.col(score).alias("__value"))
    out = None
    for k in range(depth - 1, -1, -1):
        up = (k % 2 == 0) == maximise_first
        sign = F.lit(-1 if up else 1)
        best = values.where("__value IS NOT NULL").groupBy("__parent").agg(F.min(F.struct((sign * F.col("__value")).alias("v"), F.col("__node").alias("child"))).alias("b"))
        own = level(k).select(F.col(node).alias("__node"), F.col(parent).alias("__of"), F.col(score).alias("__own"))
        met = own.join(best, F.col("__node") == F.col("__parent"), "left")
        met = met.select("__node", F.col("__of").alias("__parent"), F.coalesce(sign * F.col("b.v"), F.col("__own")).alias("__value"), F.col("b.child").alias("best"))
        rows = met.where("best IS NOT NULL").select(F.col("__node").alias(node), F.lit(k).alias(ply), F.col("__value").alias("value"), "best")
        out = rows if out is None else out.unionByName(rows)
        values = met.drop("best")
    return out


def move_type(capture: Column, check: Column, castle: Column, pawn: Column) -> Column:
    """Class of a move from its features; checks before captures before castling before pawn moves."""
    return F.when(check, "check").when(capture, "capture").when(castle, "castle").when(pawn, "pawn").otherwise("quiet")

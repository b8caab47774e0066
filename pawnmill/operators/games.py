"""Filtering, classifying and expanding games; every function takes column names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalar
from ..functions.arrays import ones_like
from ..functions.scalar import col, safe_int
from .vocabulary import with_token_ids


def base_filter(equal_col: str = "Termination", equal: str = "Normal", text_col: str = "Event", part: str = "blitz") -> Column:
    """Equality and case-insensitive containment, for a WHERE, where null does not pass.

    Kept as a plain conjunction: the equality then reaches the Parquet scan.
    """
    return (F.col(equal_col) == equal) & F.contains(F.lower(text_col), F.lit(part))


def high_elo_filter(
    white: str = "WhiteElo", black: str = "BlackElo", white_diff: str = "WhiteRatingDiff", black_diff: str = "BlackRatingDiff",
    min_elo: int = C.MIN_ELO, max_diff: int = C.MAX_RATING_DIFF, max_gap: int = C.MAX_ELO_GAP,
) -> Column:
    """Both values high, both differences and the gap small, bounds included; anything unparseable is false."""
    w, b, dw, db = map(safe_int, (white, black, white_diff, black_diff))
    fits = (w >= min_elo) & (b >= min_elo) & (F.abs(dw) <= max_diff) & (F.abs(db) <= max_diff) & (F.abs(w - b) <= max_gap)
    return F.coalesce(fits, F.lit(False))


def perspectives(outcome: Column | str) -> Column:
    """The winner's side alone, or white then black for a draw; null for no outcome."""
    o = col(outcome)
    return F.when(o == "draw", F.array(F.lit("white"), F.lit("black"))).when(o.isin("white", "black"), F.array(o))


def side_token(side: Column | str) -> Column:
    return F.when(col(side) == "white", C.SPECIAL_TOKENS[C.WHITE_ID]).otherwise(C.SPECIAL_TOKENS[C.BLACK_ID])


def sequence_tokens(side: Column | str, moves: Column | str, drawn: Column, end: bool = True) -> Column:
    """Side, moves, the draw mark of a draw, and the end mark unless it is to be scored."""
    parts = [F.array(side_token(side)), col(moves), F.when(drawn, F.array(F.lit(C.SPECIAL_TOKENS[C.DRAW_ID]))).otherwise(F.array().cast("array<string>"))]
    return F.concat(*parts, *([F.array(F.lit(C.SPECIAL_TOKENS[C.EOS_ID]))] if end else []))


def expand_outcomes(df: DataFrame, outcome_col: str, side_out: str = "perspective") -> DataFrame:
    """One row for each perspective; rows without an outcome leave."""
    return df.withColumn(side_out, F.explode(perspectives(outcome_col)))


def parse_movetext(df: DataFrame, text_col: str = "movetext", out: str = "moves") -> DataFrame:
    """df with the UCI moves of SAN movetext, null where there are none; Arrow batches.

    Parsing is costly, so texts that repeat in a batch are parsed once; and where files have
    fewer partitions than the cluster has cores, rows are dealt out before (else no shuffle).
    """
    from pyspark.sql.types import ArrayType, StringType, StructType

    schema = StructType([*df.schema.fields]).add(out, ArrayType(StringType()))
    at = df.columns.index(text_col)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..chess.notation import movetext_to_uci

        for batch in batches:
            texts = batch.column(at).to_pylist()
            parsed = {t: movetext_to_uci(t) for t in dict.fromkeys(texts)}
            moves = pa.array([parsed[t] for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, moves], names=[*batch.schema.names, out])

    return spread(df).mapInArrow(parse, schema)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it is a scan of files with fewer; anything else as it is."""
    if df.isStreaming or re.search(r"Join|Aggregate|Sort|Window|Repartition|LogicalRDD|LocalRelation", df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def classify_games(df: DataFrame) -> DataFrame:
    """Parsed games with outcome and the metadata columns; games without moves or outcome leave."""
    return (
        df.withColumn("outcome", scalar.outcome("Result"))
        .where("moves IS NOT NULL AND outcome IS NOT NULL")
        .withColumns(
            {
                "elo_bucket": scalar.elo_bucket("WhiteElo", "BlackElo"),
                "result": F.col("outcome"),
                "opening_family": scalar.opening_family(F.get("moves", F.lit(0))),
                "termination_type": scalar.termination_type("Result"),
            }
        )
    )


def tokenized_examples(games: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Training examples of classified games, one for each perspective."""
    rows = expand_outcomes(games, "outcome")
    tokens = sequence_tokens("perspective", "moves", F.col("outcome") == "draw")
    return with_token_ids(rows, tokens, vocab).withColumn("attention_mask", ones_like("input_ids")).select(*keep, "input_ids", "attention_mask", *C.METADATA_COLUMNS)


def strip_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*C.METADATA_COLUMNS)

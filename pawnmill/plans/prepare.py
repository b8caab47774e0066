"""Corpus preparation: filter, parse, expand, tokenize, split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import games as G
from ..operators import sampling
from ..operators.metrics import frequencies
from ..operators.vocabulary import token_list
from ..sources import scans, sinks

STRATA = ("elo_bucket", "result", "opening_family")


@dataclass(frozen=True)
class Counts:
    """What a preparation did."""

    games: int
    skipped: int
    examples: int
    train: int
    eval: int
    test: int


def select_games(
    raw: DataFrame, num_games: int | None = None, high_elo: bool = False, order: tuple[Column | str, ...] = (), min_elo: int = C.MIN_ELO, max_diff: int = C.MAX_RATING_DIFF, max_gap: int = C.MAX_ELO_GAP
) -> DataFrame:
    """Filters, cheapest first and all before parsing; then the first games, those that will be skipped counted."""
    kept = raw.where(G.base_filter())
    if high_elo:
        kept = kept.where(G.high_elo_filter(min_elo=min_elo, max_diff=max_diff, max_gap=max_gap))
    return kept if num_games is None else sampling.first_games(kept, num_games, *order)


def with_row_ids(examples: DataFrame) -> DataFrame:
    """Stored examples with an id that depends on their content alone."""
    return sampling.with_row_ids(examples, F.concat_ws(" ", F.transform("input_ids", lambda i: i.cast("string")), *C.METADATA_COLUMNS))


def split_examples(examples: DataFrame, id_col: str = "row_id", seed: object = C.SHUFFLE_SEED, group_key: str | None = None) -> DataFrame:
    """examples (stored, with an id) with column split in the standard proportions."""
    total = examples.count() if group_key is None else examples.select(group_key).distinct().count()
    n_eval, n_test = sampling.split_sizes(total)
    return sampling.three_way_split(examples, STRATA, id_col, n_eval, n_test, seed, group_key)


def prepare(
    spark: SparkSession, raw: DataFrame, out: str, num_games: int | None = C.BASE_GAMES, high_elo: bool = False, seed: object = C.SHUFFLE_SEED, **limits: int
) -> Counts:
    """Write train, eval and test under ``out``; staged examples are removed afterwards.

    Parsing is the costly part and runs once, in the partitions of the raw files: examples are
    staged as Parquet, get ids of their content, and the split joins a few marked ids back.
    ``limits`` are those of the high-rating filter: min_elo, max_diff, max_gap.
    """
    staged = f"{out.rstrip('/')}/_shards"
    chosen = select_games(raw, num_games, high_elo, **limits)
    parsed = G.parse_movetext(chosen)
    from pyspark.sql import Observation

    seen = Observation("games")
    usable = parsed.observe(seen, F.count(F.lit(1)).alias("games"), F.count_if(F.col("moves").isNotNull() & F.col("Result").isin(*C.OUTCOMES)).alias("usable"))
    sinks.write_shards(G.tokenized_examples(G.classify_games(usable), token_list()), staged)
    counts = seen.get
    examples = with_row_ids(scans.read_shards(spark, staged))
    split = split_examples(examples, seed=seed)
    sinks.write_splits(G.strip_metadata(split).drop("row_id"), f"{out.rstrip('/')}/splits")
    by = {r["split"]: r["count"] for r in spark.read.parquet(f"{out.rstrip('/')}/splits").groupBy("split").count().collect()}
    sinks.delete(spark, staged)
    return Counts(counts["games"], counts["games"] - counts["usable"], sum(by.values()), by.get("train", 0), by.get("eval", 0), by.get("test", 0))


def distribution(examples: DataFrame) -> DataFrame:
    """Sorted counts of the stratifying columns."""
    return frequencies(examples, *STRATA).orderBy("dimension", "stratum")

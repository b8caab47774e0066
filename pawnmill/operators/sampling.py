"""Reproducible sampling and splits.

Rows are shuffled by a hash of the seed and the row's id, so a sample depends on neither
partitions nor retries. Samples that are a fraction of the table are df under a filter (see
``selection``); no unpartitioned window or limit sees the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalar import half_even, hash_order
from ..session import broadcast_if_small, checkpointed
from . import selection


def split_sizes(total: int, eval_fraction: float = C.EVAL_FRACTION, test_fraction: float = C.TEST_FRACTION) -> tuple[int, int]:
    """Sizes of eval and test, each at least 1; an error when too few rows would be left."""
    n_eval, n_test = (max(1, round(total * f)) for f in (eval_fraction, test_fraction))
    if total <= n_eval + n_test + 1:
        raise ValueError(f"{total} rows are too few to split into train, eval and test")
    return n_eval, n_test


def stratified_holdout(df: DataFrame, strata: Sequence[str], size: int, id_col: str, seed: object = C.SHUFFLE_SEED) -> DataFrame:
    """``size`` rows of df, each stratum in proportion and with at least one row.

    Quotas are max(1, size * n / total rounded half to even). Within a stratum, the rows with
    the least hashes are chosen by a filter (see ``selection``), so neither a stratum's quota
    nor the whole sample is gathered in one task. Surplus is cut, and a shortage filled from
    the rest, in hash order.
    """
    order = hash_order(seed, id_col)
    counts = checkpointed(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    quotas = counts.withColumn("__quota", F.least(F.greatest(F.lit(1), half_even(F.lit(float(size)) * F.col("__n") / F.lit(max(1, total)))), F.col("__n")))
    chosen = checkpointed(selection.first_in_groups(df, strata, quotas, order, id_col))
    n = chosen.count()
    if n > size:
        return selection.first_rows(chosen, size, hash_order(f"{seed}:cut", id_col), id_col, n)
    if n < min(size, total):
        taken = chosen.select(F.col(id_col).alias("__taken")).distinct()
        rest = checkpointed(df.join(taken, df[id_col] == taken["__taken"], "left_anti"))
        chosen = chosen.unionByName(selection.first_rows(rest, size - n, order, id_col))
    return chosen


def three_way_split(
    df: DataFrame, strata: Sequence[str], id_col: str, eval_size: int, test_size: int, seed: object = C.SHUFFLE_SEED, group_key: str | None = None
) -> DataFrame:
    """df with column split: the first ``test_size`` of the shuffled holdout are test, the rest eval, other rows train.

    With ``group_key`` the sizes count groups, and a group's rows stay together.
    """
    if group_key:
        units = df.groupBy(group_key).agg(*[F.min(s).alias(s) for s in strata])
        marked = three_way_split(units, strata, group_key, eval_size, test_size, seed).select(group_key, "split")
        return df.join(marked, group_key)
    holdout = checkpointed(stratified_holdout(df.select(id_col, *strata), strata, eval_size + test_size, id_col, seed).select(id_col))
    test = selection.first_rows(holdout, test_size, hash_order(f"{seed}:split", id_col), id_col).withColumn("__test", F.lit(True))
    marked = holdout.join(test, id_col, "left").select(F.col(id_col).alias("__held"), F.when(F.col("__test"), "test").otherwise("eval").alias("__split"))
    return df.join(marked, df[id_col] == marked["__held"], "left").withColumn("split", F.coalesce("__split", F.lit("train"))).drop("__held", "__split")


def hash_share(order: Column) -> Column:
    """Where a hash_order key lies in its range, from 0 to 1."""
    return F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def reservoir(df: DataFrame, n: int, *keys: str, seed: object = C.RESERVOIR_SEED) -> DataFrame:
    """n rows, uniform and reproducible; all of them when there are no more.

    A bound on the hash, from the number of rows, precedes the sort, so the tasks together
    send little more than n rows.
    """
    order = hash_order(seed, *keys)
    share = (n + 7 * n**0.5 + 60) / max(1, df.count())  # falls short of n with odds below one in 10^9
    return (df.where(hash_share(order) <= share) if share < 1 else df).orderBy(order, *keys).limit(n)


def bottom_k(df: DataFrame, n: int, *keys: str, seed: object = C.RESERVOIR_SEED, fan: int = 64) -> DataFrame:
    """The rows of ``reservoir`` from one scan: a sketch of the n least hashes that merges in any order.

    Each task keeps its own n least rows; then the sketches of some ``fan`` tasks merge in one,
    until one is left, so no task reads more than ``fan`` sketches. Merging a sketch with rows
    that are in it already changes nothing, which makes it safe in a stream (``merge_sketch``).
    """
    keyed = df.withColumn("__order", hash_order(seed, *keys))
    types, order = keyed.schema, ["__order", *keys]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = both.take(pc.select_k_unstable(both, k=n, sort_keys=[(c, "ascending") for c in order])) if both.num_rows > n else both
        if held is not None:
            yield from held.combine_chunks().to_batches()

    sketch = keyed.mapInArrow(least, types).withColumn("__task", F.spark_partition_id())
    tasks = None
    while tasks is None or tasks > 1:
        sketch = checkpointed(sketch)
        tasks = (sketch.agg(F.max("__task")).first()[0] or 0) + 1 if tasks is None else -(-tasks // fan)
        merged = sketch.withColumn("__task", F.floor(F.col("__task") / fan).cast("int")) if tasks > 1 else sketch.withColumn("__task", F.lit(0))
        parts = max(1, -(-tasks // fan))
        sketch = merged.repartition(parts, "__task").drop("__task").mapInArrow(least, types).withColumn("__task", F.spark_partition_id())
        tasks = parts
    return sketch.orderBy(*order).limit(n).select(*df.columns)


def merge_sketch(sketch: DataFrame, more: DataFrame, n: int, *keys: str, seed: object = C.RESERVOIR_SEED) -> DataFrame:
    """The sketch after more rows (unique by keys); the same rows again change nothing."""
    new = more.join(sketch.select(*keys), list(keys), "left_anti")
    return bottom_k(sketch.unionByName(new.select(*sketch.columns)), n, *keys, seed=seed)


def balanced_sample(df: DataFrame, column: str, each: int, id_col: str, seed: object = C.SHUFFLE_SEED) -> DataFrame:
    """``each`` rows of every value of a column, or all of a rarer value's, in hash order."""
    counts = df.groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    keyed = df.withColumn("__order", hash_order(seed, id_col))
    near = keyed.join(broadcast_if_small(counts), F.col(column).eqNullSafe(F.col("__value"))).where(hash_share(F.col("__order")) <= F.lit(each + 7 * each**0.5 + 60) / F.col("__n"))
    return near.withColumn("__rank", F.row_number().over(Window.partitionBy(column).orderBy("__order", id_col))).where(F.col("__rank") <= each).select(*df.columns)


def excluding(df: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """The rows of df whose keys are not in ``held``."""
    return df.join(held.select(*keys).distinct(), list(keys), "left_anti")


def positions_of(df: DataFrame, game: str, moves: str) -> DataFrame:
    """game, ply and the moves before it, for every position that a move was made from."""
    return df.select(game, F.posexplode(moves).alias("ply", "__move"), moves).select(game, "ply", F.slice(moves, 1, F.col("ply")).alias(moves))


def sampled_positions(df: DataFrame, n: int, game: str, moves: str, seed: object = C.RESERVOIR_SEED) -> DataFrame:
    """n of the rows of ``positions_of``: places are drawn first, prefixes made for those only."""
    places = df.where(F.size(moves) > 0).select(game, F.explode(F.sequence(F.lit(0), F.size(moves) - 1)).alias("ply"))
    chosen = reservoir(places, n, game, "ply", seed=seed)
    return chosen.join(df.select(game, moves), game).select(game, "ply", F.slice(moves, 1, F.col("ply")).alias(moves))


def with_places(df: DataFrame, ordered: bool = False) -> DataFrame:
    """df with __file and __row, which order its rows and don't change when they are read again.

    Rows read from files have their file's path and place; others (or all, with ``ordered``:
    rows already range-sorted) are written once, and have their partition and place.
    """
    if not ordered:
        try:
            return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        except AnalysisException:
            pass
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return checkpointed(df.select("*", F.format_string("%010d", F.spark_partition_id()).alias("__file"), inside.alias("__row")))


def first_games(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows, in their own partitions: by ``order`` (whose values are unique), else as files hold them.

    Rows are counted by file; only the file in which the n-th row lies is looked into. What is
    returned is df under a filter, so nothing is gathered in one task.
    """
    if order:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = with_places(df, ordered=bool(order))
    counts = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("__file")))  # one row for each file
    last = upto.where(F.col("upto") >= n).orderBy("upto", "__file").select("__file", (F.lit(n) - F.col("upto") + F.col("n")).alias("need")).first()
    if last is None:
        return rows.drop("__file", "__row")
    inside = rows.where(F.col("__file") == last["__file"]).select("__row").orderBy("__row").limit(last["need"]).agg(F.max("__row")).first()[0]
    kept = (F.col("__file") < last["__file"]) | ((F.col("__file") == last["__file"]) & (F.col("__row") <= (-1 if inside is None else inside)))
    return rows.where(kept).drop("__file", "__row")


def with_row_ids(df: DataFrame, content: Column, out: str = "row_id") -> DataFrame:
    """df with an id of the row's content and its number among rows of equal content.

    Equal rows are interchangeable, so ids, and what is drawn by them, depend neither on
    partitions nor on retries. Equal rows are numbered file by file and files by their counts,
    so no content's rows meet in one task.
    """
    keyed = with_places(df).withColumn("__content", F.sha2(content, 256))
    counts = keyed.groupBy("__content", "__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__content").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    later = counts.withColumn("__first", F.sum("__n").over(before)).where("__first IS NOT NULL").select("__content", "__file", "__first")
    nth = F.row_number().over(Window.partitionBy("__content", "__file").orderBy("__row")) - 1
    numbered = keyed.withColumn("__nth", nth).join(later, ["__content", "__file"], "left")
    return numbered.select(*df.columns, F.concat_ws("-", "__content", (F.col("__nth") + F.coalesce("__first", F.lit(0))).cast("string")).alias(out))

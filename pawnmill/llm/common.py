"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a Python worker handles at a time; one longer text is a part of its own.
PART_ROWS, PART_BYTES = 256, 1 << 20
#: Rows of ids and numbers worth a task of their own, and most rows of a table that is broadcast.
TASK_ROWS, MOST_BROADCAST = 4096, 100_000


_held: dict[str, Callable[[], None]] = {}


def sole_cache(name: str, clear: Callable[[], None]) -> None:
    """A Python worker outlives a stage; what an earlier operator cached in it is let go when another's cache, or none, is used."""
    if name not in _held:
        for other in _held.values():
            other()
        _held.clear()
        _held[name] = clear


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only where it is unset, fall back to a folder of the warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors, cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet beside the checkpoints, which all executors share, and read back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most ``rows`` narrow rows, in as few partitions as that is worth; as it is where they are worth all.

    Every task costs files of each shuffle and checkpoint that it writes, however few its rows.
    """
    n = max(1, -(-rows // TASK_ROWS))
    return df.coalesce(n) if n < shuffle_partitions(df.sparkSession) else df


def looked_up(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most ``rows`` narrow rows, marked for broadcast if these are few, else as it is (and shuffled)."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(col(name), F.lit(""))


def whole_rows(df: DataFrame) -> Column:
    """All columns of df as one struct, so that helper columns beside it can't clash with them."""
    return F.struct(*[col(c) for c in df.columns])


def unpacked(rows: DataFrame, df: DataFrame, row: str = "row") -> DataFrame:
    """The struct of ``whole_rows`` as df's columns again."""
    return rows.select(*[F.col(row).getField(c).alias(c) for c in df.columns])


def parts(batch: pa.RecordBatch, text: int = 1, rows: int = PART_ROWS, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, bounded in rows and in bytes of its text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def keep_one_each(df: DataFrame, id_col: str, mark: Column, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """df without the rows named in ``dropped``, and one row for each key in ``repeated``; both tables hold (id, mark).

    Rows are named by their id (null or not) and ``mark``, a digest of their text. Where keys
    repeat, one of their rows is taken by partial aggregation, so many equal rows never meet.
    """
    rows = df.select(whole_rows(df).alias("row"), col(id_col).alias("id"), mark.alias("mark"))
    on = lambda t: same(rows["id"], t["id"]) & (rows["mark"] == t["mark"])
    gone = dropped.select("id", "mark").unionByName(repeated.select("id", "mark"))
    out = rows.join(gone, on(gone), "left_anti").select("row")
    if repeated.limit(1).count():
        one = rows.join(repeated, on(repeated), "left_semi").groupBy("id", "mark").agg(F.any_value("row").alias("row"))
        out = out.unionByName(one.select("row"))
    return unpacked(out, df)


def least_hashed(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows of df, those with the smallest hash of keys (which are unique, or whose repeats are alike).

    A bound on the hash, from the number of rows, comes before the sort, so the tasks together
    send little more than ``most`` rows, however many they hold.
    """
    n = df.count()
    share = (most + 7 * most**0.5 + 60) / max(n, 1)  # falls short of most with odds below one in 10^9
    hashed = F.xxhash64(*map(col, keys))
    if share < 1:
        df = df.where(hashed <= F.lit(int(-(1 << 63) + share * (1 << 64))))
    return df.orderBy(hashed, *map(col, keys)).limit(most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")

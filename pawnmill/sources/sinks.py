"""Sinks: shards, splits, record logs, small JSON documents, PGN."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..operators.records import encode_records


def write_shards(df: DataFrame, path: str, rows: int = C.SHARD_SIZE) -> None:
    """Parquet files of at most ``rows`` rows; the folder is replaced as a whole."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def name_shards(spark: SparkSession, path: str) -> list[str]:
    """Rename a folder's part files, in their order, to shard_00000.parquet and so on; returns the names."""
    p, fs = _hadoop_path(spark, path)
    parts = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))
    names = [f"shard_{k:05d}.parquet" for k in range(len(parts))]
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for part, name in zip(parts, names):
        fs.rename(here(p, part), here(p, name))
    return names


def write_splits(df: DataFrame, path: str, rows: int = C.SHARD_SIZE) -> None:
    """One folder, partitioned by split: one job, and readers of one split skip the others."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("split").parquet(path)


def name_splits(spark: SparkSession, path: str) -> list[str]:
    """Give the splits that ``write_splits`` has written names of their own, train.parquet and so on; returns the names.

    A folder by split is renamed as a whole, so there are as many renames as splits, whatever
    the number of files.
    """
    p, fs = _hadoop_path(spark, path)
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("split="))
    names = [f"{f.removeprefix('split=')}.parquet" for f in found]
    for folder, name in zip(found, names):
        fs.delete(here(p, name), True)
        fs.rename(here(p, folder), here(p, name))
    return names


def append_records(records: DataFrame, path: str) -> None:
    """Append records as compact JSON lines; each append is whole or absent."""
    encode_records(records).select("value").write.mode("append").text(path)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str | Iterable[str]) -> None:
    """A document written through Spark's file system layer, whole or piece by piece."""
    p, fs = _hadoop_path(spark, path)
    out = fs.create(p, True)
    try:
        for piece in [text] if isinstance(text, str) else text:
            out.write(bytearray(piece.encode("utf-8")))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, payload: Mapping) -> None:
    write_text(spark, path, json.dumps(payload, indent=2) + "\n")


def read_small(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def write_vocabulary(spark: SparkSession, tokens: list[str], path: str, prefix: str | None = None) -> str:
    """vocab.json, with an optional prefix, in the folder; returns its path."""
    target = f"{path.rstrip('/')}/{prefix + '-' if prefix else ''}vocab.json"
    write_json(spark, target, {t: i for i, t in enumerate(tokens)})
    return target


def write_pgn(spark: SparkSession, path: str, games: Iterable[str]) -> None:
    """One file, written game by game: the driver holds one game (of an iterator) at a time."""
    write_text(spark, path, ("\n" * bool(k) + game for k, game in enumerate(games)))

"""Scans: games, shards, splits, FEN and JSON lines, records, PGN, puzzles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import decode_records
from ..schemas import RAW_GAME, SEQUENCE
from ..session import broadcast_if_small, checkpointed
from .sinks import exists

#: Rows of a batch that a scan hands on.
ROWS = 1000
#: Arrow types of the fields that scans make in Python.
ARROW = {"string": pa.string(), "map<string, string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}


def read_games(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw games with a declared schema; only the columns a plan uses are read."""
    return (spark.readStream if stream else spark.read).schema(RAW_GAME).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One of train, eval and test; the partition column prunes the others' files. Splits under names of their own are read by name."""
    if exists(spark, named := f"{path.rstrip('/')}/{split}.parquet"):
        return spark.read.parquet(named)
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def _numbered(spark: SparkSession, path: str, separator: str | None, tally: Callable[[str, bool], int], split: Callable[[str, bool], list], fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """file, number (from 0 on in its file) and fields of what ``split`` makes of each piece of text; and file, block, n, first.

    Text files are cut at ``separator`` (line ends by default) and read in splits of any size.
    A task numbers what it finds in a split; ``tally`` says how much that is, so the counts of
    the splits before it in the file (one row a split) say from where on.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    text = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, bool]]:
        seen = set()
        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                yield file, block, value, block == 0 and file not in seen
                seen.add(file)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[str, int]] = Counter()
        for file, block, value, first in pieces(batches):
            n[file, block] += tally(value, first)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["file", "block", "n"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[str, int]] = Counter()
        types = (pa.string(), pa.int64(), pa.int64(), *map(ARROW.get, fields.values()))
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "nth", *fields])

        for file, block, value, first in pieces(batches):
            for row in split(value, first):
                rows.append((file, block, n[file, block], *row))
                n[file, block] += 1
            if len(rows) >= ROWS:
                yield batch()
                rows = []
        yield batch()

    counts = text.mapInArrow(count, "file string, block bigint, n bigint").groupBy("file", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = checkpointed(counts.select("file", "block", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    rows = text.mapInArrow(make, f"file string, block bigint, nth bigint, {schema}")
    numbered = rows.join(broadcast_if_small(firsts), ["file", "block"]).select("file", (F.col("first") + F.col("nth")).alias("number"), *fields)
    return numbered, firsts


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file (base name), lineno (from 1, blank lines counted) and value of every line that is not blank."""
    lines, _ = _numbered(spark, path, None, lambda line, first: 1, lambda line, first: [(line.strip(),)], {"value": "string"})
    return lines.where("value <> ''").select(F.element_at(F.split("file", "/"), -1).alias("file"), (F.col("number") + 1).cast("int").alias("lineno"), "value")


def where_of(file: str = "file", lineno: str = "lineno") -> Column:
    return F.format_string("%s:%d", F.col(file), F.col(lineno))


def fen_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, lineno, position_id and fen of each line; an error names the place of an invalid FEN."""
    from ..operators.chess_udfs import fen_is_valid

    rows = numbered_lines(spark, path).withColumn("position_id", where_of())
    checked = F.when(fen_is_valid("value"), F.col("value")).otherwise(F.raise_error(F.concat("position_id", F.lit(": invalid FEN"))).cast("string"))
    return rows.select("file", "lineno", "position_id", checked.alias("fen"))


def read_fens(spark: SparkSession, path: str) -> DataFrame:
    """position_id and fen of each line."""
    return fen_rows(spark, path).select("position_id", "fen")


def sequence_error() -> Column:
    """Why a decoded sequence row is not valid; null if it is."""
    return (
        F.when(F.col("__row").isNull() | F.col("__keys").isNull(), "not a JSON object")
        .when(~F.array_contains("__keys", "id") | ~F.array_contains("__keys", "perspective") | ~F.array_contains("__keys", "moves"), "id, perspective and moves are required")
        .when(F.coalesce(~F.col("__row.perspective").isin("white", "black"), F.lit(True)), "perspective must be white or black")
        .when(F.col("__row.moves").isNull() | (F.size("__row.moves") < 1), "moves must be a list that is not empty")
    )


def read_sequences(spark: SparkSession, path: str, most: int | None = None, quarantine: bool = False) -> DataFrame:
    """id, perspective, moves, is_draw of JSON lines, in line order up to ``most`` rows.

    Rows beyond ``most`` are neither decoded nor checked. Invalid rows are an error with
    their place, or with ``quarantine`` stay as rows with a message in ``_error``.
    """
    rows = numbered_lines(spark, path)
    if most is not None:
        if most < 1:
            raise ValueError(f"max_sequences must be >= 1; got {most}")
        rows = rows.orderBy("file", "lineno").limit(most)
    rows = rows.withColumn("__row", F.from_json("value", SEQUENCE, {"mode": "PERMISSIVE"})).withColumn("__keys", F.json_object_keys("value"))
    rows = rows.withColumn("_error", F.when(sequence_error().isNotNull(), F.concat(where_of(), F.lit(": "), sequence_error())))
    columns = ["file", "lineno", "__row.id", "__row.perspective", "__row.moves", F.coalesce("__row.is_draw", F.lit(False)).alias("is_draw")]
    if quarantine:
        return rows.select(*columns, "_error")
    checked = F.when(F.col("_error").isNull(), F.col("__row.id")).otherwise(F.raise_error(F.col("_error")).cast("string"))
    return rows.select("file", "lineno", checked.alias("id"), "__row.perspective", "__row.moves", F.coalesce("__row.is_draw", F.lit(False)).alias("is_draw"))


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Evaluation records of a JSON-lines file or folder."""
    return decode_records(spark.read.text(path), "value", strict)


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_text_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_puzzles(spark: SparkSession, path: str, rating: tuple[int, int] | None = None, themes: Sequence[str] | None = None, sample: int | None = None, seed: object = 0) -> DataFrame:
    """Puzzle CSV (PuzzleId, FEN, Moves, Rating, Themes), filtered by rating and themes, sampled by hash."""
    from ..operators.sampling import reservoir

    rows = spark.read.csv(path, header=True).select(
        F.col("PuzzleId").alias("puzzle_id"), F.col("FEN").alias("fen"), F.split("Moves", " ").alias("solution"), F.col("Rating").try_cast("int").alias("rating"), F.split(F.coalesce("Themes", F.lit("")), " ").alias("themes")
    )
    if rating:
        rows = rows.where(F.col("rating").between(*rating))
    if themes:
        rows = rows.where(F.arrays_overlap("themes", F.array(*map(F.lit, themes))))
    return reservoir(rows, sample, "puzzle_id", seed=seed) if sample else rows


def read_pgn(spark: SparkSession, path: str) -> DataFrame:
    """game_id (game-0000, ... over all files, in the order of their paths), headers and UCI moves of PGN files.

    Files are cut where a blank line precedes a header, so a large file is read in many tasks;
    a file with other line ends is one piece.
    """

    from ..chess.notation import movetext_to_uci, split_games

    def games(piece: str, first: bool) -> list[tuple[dict, str]]:
        return list(split_games(piece if first or piece.lstrip().startswith("[") else "[" + piece))

    def parsed(piece: str, first: bool) -> list[tuple]:
        return [(list(h.items()), movetext_to_uci(b, h.get("FEN"))) for h, b in games(piece, first)]

    rows, firsts = _numbered(spark, path, "\n\n[", lambda piece, first: len(games(piece, first)), parsed, {"headers": "map<string, string>", "moves": "array<string>"})
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = firsts.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = rows.join(broadcast_if_small(files), "file")
    return numbered.select(F.format_string("game-%04d", F.col("earlier") + F.col("number")).alias("game_id"), "file", F.col("number").cast("int").alias("game_index"), "headers", "moves")

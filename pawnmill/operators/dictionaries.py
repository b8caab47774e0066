"""Look-ups of the values in arrays against a table of any size: shuffled dictionary encoding.

A task cuts its rows into chunks and replaces every value by its place among the chunk's
distinct values. Only these distinct values are joined with the table, by plain shuffles (so
Spark splits the rows of a value that most chunks hold), and what they stand for comes back as
one array for each chunk; there the chunk's rows pick by place. So values are shuffled once
for each chunk, not once for each occurrence, nothing is broadcast, and a chunk bounds what a
task holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from .. import constants as C
from ..functions.scalar import col
from ..session import scratch

#: Rows and values of a chunk, at most (one longer array is a chunk of its own).
CHUNK_ROWS, CHUNK_VALUES = 4096, 1 << 19


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = min(at + CHUNK_ROWS, max(at + 1, int(np.searchsorted(ends, before + CHUNK_VALUES, "right"))))
        yield at, to
        at = to


def _nullable(fields: list[StructField]) -> StructType:
    """A schema of these fields in which anything may be null, as in Arrow batches."""
    text = StructType(fields).json()
    for name in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{name}":false', f'"{name}":true')
    return StructType.fromJson(json.loads(text))


def _lists(like: pa.Array, flat: pa.Array) -> pa.ListArray:
    """flat in lists of the sizes, and with the nulls, of ``like``."""
    sizes = pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat, mask=like.is_null())


def _encode(rows: DataFrame, kind: DataType) -> DataFrame:
    """rows whose last column, an array, has become __chunk, __codes (places among the chunk's distinct values) and, in a chunk's first row, __values."""
    schema = _nullable(rows.schema.fields[:-1]).add("__chunk", LongType()).add("__codes", ArrayType(IntegerType())).add("__values", ArrayType(kind))
    names, arrow = [f.name for f in schema.fields], to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).cast(pa.list_(arrow))
            for a, b in _chunks(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)):
                own = lists.slice(a, b - a)
                coded = own.flatten().dictionary_encode()
                first = [coded.dictionary.to_pylist(), *[None] * (b - a - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(np.full(b - a, chunk)), _lists(own, coded.indices.cast(pa.int32())), pa.array(first, pa.list_(arrow))], names=names
                )
                chunk += 1

    return rows.mapInArrow(run, schema)


def look_up_arrays(df: DataFrame, values: Column | str, table: DataFrame, key: str, value: str, out: str, default: object) -> DataFrame:
    """df with ``out``: for every element of the array ``values``, what ``table`` (unique keys) has for it, else ``default``.

    A null array stays null, and a null element has the default. The order of rows is not kept.
    All columns but ``out`` are written and shuffled with the codes, so arrays that are not
    needed afterwards should be replaced: ``out`` may be the column of ``values`` itself.
    """
    spark, kind, result = df.sparkSession, table.schema[key].dataType, table.schema[value].dataType
    path = scratch(spark, "coded")
    kept = df.drop(out)
    rows = df.withColumn("__in", col(values).cast(ArrayType(kind))).select(*kept.columns, "__in")
    _encode(rows, kind).write.parquet(path, compression="zstd")  # read twice
    coded = spark.read.parquet(path)
    entries = coded.where("__values IS NOT NULL").select(F.col("__chunk").alias("__of"), F.posexplode("__values").alias("__code", "__key"))
    told = table.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    met = entries.join(told.hint("merge"), "__key", "left").select("__of", "__code", "__value")
    held = met.groupBy("__of").agg(F.sort_array(F.collect_list(F.struct("__code", "__value"))).getField("__value").alias("__found"))
    own, arrow = kept.columns, to_arrow_type(result)
    schema = _nullable(kept.schema.fields).add(out, ArrayType(result))

    def pick(rows: pa.Table, found: pa.Table) -> pa.Table:
        codes = rows.column("__codes").combine_chunks()
        codes = pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes
        values = pa.array(found.column("__found")[0].as_py() if found.num_rows else [], arrow)
        flat = pc.fill_null(values.take(codes.flatten()), pa.scalar(default, arrow))
        return pa.Table.from_arrays([*(rows.column(c) for c in own), _lists(codes, flat)], names=[*own, out])

    return coded.drop("__values").groupBy("__chunk").cogroup(held.groupBy("__of")).applyInArrow(pick, schema)


def with_token_ids(df: DataFrame, tokens: Column | str, vocab: DataFrame, out: str = "input_ids", unknown: int = C.UNK_ID) -> DataFrame:
    """df with the ids of an array of tokens, by a vocabulary (token, id) of any size."""
    return look_up_arrays(df, tokens, vocab.select(F.col("token").cast(StringType()).alias("token"), F.col("id").cast("int").alias("id")), "token", "id", out, unknown)


def with_tokens(df: DataFrame, ids: Column | str, vocab: DataFrame, out: str = "tokens", unknown: str = C.SPECIAL_TOKENS[C.UNK_ID]) -> DataFrame:
    """The inverse: the tokens of an array of ids."""
    return look_up_arrays(df, ids, vocab.select("token", F.col("id").cast("long").alias("id")), "id", "token", out, unknown)


def build_vocabulary(df: DataFrame, tokens: Column | str, least: int = 1, first_id: int = 0) -> DataFrame:
    """token, id: the distinct tokens that occur in at least ``least`` rows, numbered from ``first_id`` in their order.

    Numbers come from a range sort and the counts of its ranges; no task sees all tokens.
    """
    from .records import with_event_ids

    seen = df.select(F.explode(F.array_distinct(col(tokens))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = seen.where((F.col("n") >= least) & F.col("token").isNotNull()).select("token", F.lit(0).alias("__run"))
    return with_event_ids(kept, "__run", "token", out="id").select("token", (F.col("id") + first_id).alias("id"))

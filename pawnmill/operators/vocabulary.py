"""The move vocabulary from board geometry, and encoding against a vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .. import constants as C
from ..functions.arrays import ones_like
from ..functions.scalar import col, split_words


def _square(f: Column, r: Column) -> Column:
    return F.concat(F.substr(F.lit("abcdefgh"), f + 1, F.lit(1)), (r + 1).cast("string"))


def vocabulary(spark: SparkSession) -> DataFrame:
    """token, id: specials, then queen and knight moves, then promotions, each block sorted.

    The 64 x 64 pairs are an arithmetic range, not a join.
    """
    pair = spark.range(64 * 64).select(
        (F.col("id") % 8).cast("int").alias("f1"),
        (F.floor(F.col("id") / 8) % 8).cast("int").alias("r1"),
        (F.floor(F.col("id") / 64) % 8).cast("int").alias("f2"),
        F.floor(F.col("id") / 512).cast("int").alias("r2"),
    )
    df, dr = F.abs(F.col("f1") - F.col("f2")), F.abs(F.col("r1") - F.col("r2"))
    queen = ((df == 0) | (dr == 0) | (df == dr)) & (df + dr > 0)
    knight = (df * dr == 2)
    token = F.concat(_square(F.col("f1"), F.col("r1")), _square(F.col("f2"), F.col("r2")))
    moves = pair.where(queen | knight).select(F.lit(1).alias("block"), token.alias("token"))
    steps = pair.where((df <= 1) & (((F.col("r1") == 6) & (F.col("r2") == 7)) | ((F.col("r1") == 1) & (F.col("r2") == 0))))
    promotions = steps.select(F.lit(2).alias("block"), F.explode(F.transform(F.array(*map(F.lit, C.PROMOTIONS)), lambda p: F.concat(token, p))).alias("token"))
    specials = spark.range(1).select(F.lit(0).alias("block"), F.posexplode(F.array(*map(F.lit, C.SPECIAL_TOKENS))).alias("k", "token"))
    every = specials.select("block", F.format_string("%02d", "k").alias("sort"), "token").unionByName(moves.unionByName(promotions).withColumn("sort", F.col("token")))
    return every.select("token", (F.row_number().over(Window.orderBy("block", "sort")) - 1).alias("id"))  # 1,974 rows, whatever the data


@lru_cache(maxsize=1)
def token_list() -> tuple[str, ...]:
    """The same vocabulary in the driver, in id order."""
    squares = [f + r for f in "abcdefgh" for r in "12345678"]
    away = lambda a, b: (abs(ord(a[0]) - ord(b[0])), abs(ord(a[1]) - ord(b[1])))
    moves = sorted(a + b for a in squares for b in squares if a != b and (0 in (d := away(a, b)) or d[0] == d[1] or d[0] * d[1] == 2))
    promotions = sorted(a + b + p for a in squares for b in squares if away(a, b)[0] <= 1 and (a[1], b[1]) in (("7", "8"), ("2", "1")) for p in C.PROMOTIONS)
    return (*C.SPECIAL_TOKENS, *moves, *promotions)


class Tokenizer:
    """Encode and decode in the driver, with the same rules as the column functions."""

    def __init__(self, tokens: Iterable[str] | None = None):
        self._tokens = tuple(tokens) if tokens is not None else token_list()
        self._ids = {t: i for i, t in enumerate(self._tokens)}

    @property
    def vocab_size(self) -> int:
        return len(self._tokens)

    def __len__(self) -> int:
        return len(self._tokens)

    def get_vocab(self) -> dict[str, int]:
        return dict(self._ids)

    def encode(self, text: str) -> list[int]:
        return [self._ids.get(t, C.UNK_ID) for t in text.split()]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self._tokens[i] if 0 <= i < len(self._tokens) else C.SPECIAL_TOKENS[C.UNK_ID] for i in ids)

    def id_map(self) -> Column:
        return F.create_map(*[F.lit(x) for pair in self._ids.items() for x in pair])

    def token_array(self) -> Column:
        return F.array(*map(F.lit, self._tokens))


#: A vocabulary is a dimension: it is sent to every task, so its size is checked.
MOST_TOKENS = 2_000_000


def token_values(vocab: DataFrame | Iterable[str]) -> list[str]:
    """Tokens in id order, of a table (token, id) with ids from 0 on or a plain list."""
    if not isinstance(vocab, DataFrame):
        return list(vocab)
    rows = vocab.select("token", "id").orderBy("id").limit(MOST_TOKENS + 1).collect()
    if len(rows) > MOST_TOKENS:
        raise ValueError(f"a vocabulary may have at most {MOST_TOKENS} tokens")
    if [r["id"] for r in rows] != list(range(len(rows))):
        raise ValueError("vocabulary ids must be 0, 1, 2, ...")
    return [r["token"] for r in rows]


def with_token_ids(df: DataFrame, tokens: Column | str, vocab: DataFrame | Iterable[str], out: str = "input_ids", unknown: int = C.UNK_ID) -> DataFrame:
    """df with the ids of an array of tokens.

    A batch's arrays are looked up as one flat Arrow column in a hash table of the
    vocabulary, and keep their offsets: no explode, no shuffle, and no linear search as in a
    map column.
    """
    shared = df.sparkSession.sparkContext.broadcast(token_values(vocab))
    rows = df.withColumn(out, col(tokens))
    schema = StructType([f for f in rows.schema.fields if f.name != out]).add(out, ArrayType(IntegerType()))
    names = [f.name for f in schema.fields]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(len(names) - 1)
            lists = lists.cast(pa.list_(pa.string()))
            flat = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), unknown).cast(pa.int32())
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, flat, mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=names)

    return rows.select(*names).mapInArrow(look_up, schema)


def with_tokens(df: DataFrame, ids: Column | str, vocab: DataFrame | Iterable[str], out: str = "tokens", unknown: str = C.SPECIAL_TOKENS[C.UNK_ID]) -> DataFrame:
    """The inverse of with_token_ids: ids are places in one shared Arrow column, which no plan holds."""
    shared = df.sparkSession.sparkContext.broadcast([*token_values(vocab), unknown])
    rows = df.withColumn(out, F.transform(col(ids), lambda i: i.cast("bigint")))
    schema = StructType([f for f in rows.schema.fields if f.name != out]).add(out, ArrayType(StringType()))
    names = [f.name for f in schema.fields]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(len(names) - 1).cast(pa.list_(pa.int64()))
            flat = pc.fill_null(lists.flatten(), -1)
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(values) - 1))
            words = values.take(pc.if_else(inside, flat, len(values) - 1))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, words, mask=lists.is_null())], names=names)

    return rows.select(*names).mapInArrow(look_up, schema)


def encode_text(df: DataFrame, text: Column | str, vocab: DataFrame) -> DataFrame:
    """df with input_ids and attention_mask of white-space separated text."""
    return with_token_ids(df, split_words(text), vocab).withColumn("attention_mask", ones_like("input_ids"))


def vocabulary_json(vocab: DataFrame) -> str:
    """The vocabulary as one JSON object, for its sink."""
    table = vocab.orderBy("id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "id"))))).alias("json"))
    return table.first()["json"]

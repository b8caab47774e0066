"""Evaluation records: telling types apart, decoding, encoding, numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HEADER, RECORDS, record_schema, superset
from ..session import checkpointed

#: A record's type by the keys of its JSON text; null if none fits.
INVALID = "invalid"


def record_type_of_keys(keys: Column) -> Column:
    """The first fitting type by key presence."""
    chain = reduce(lambda acc, r: acc.when(F.array_contains(keys, r[1]), r[0]), RECORDS[1:], F.when(F.array_contains(keys, RECORDS[0][1]), RECORDS[0][0]))
    return chain.otherwise(INVALID)


def record_type_of_columns() -> Column:
    """The same from typed columns: the telling fields are never null in valid records."""
    chain = reduce(lambda acc, r: acc.when(F.col(r[1]).isNotNull(), r[0]), RECORDS[1:], F.when(F.col(RECORDS[0][1]).isNotNull(), RECORDS[0][0]))
    return chain.otherwise(INVALID)


def has_key(parsed: Column, key: str) -> Column:
    """Whether a parsed object has a key, be its value null or not."""
    return F.variant_get(parsed, f"$.{key}", "variant").isNotNull()


def record_type_of_parsed(parsed: Column) -> Column:
    """The first fitting type of a parsed object (a variant); invalid for anything else."""
    chain = reduce(lambda acc, r: acc.when(has_key(parsed, r[1]), r[0]), RECORDS[1:], F.when(has_key(parsed, RECORDS[0][1]), RECORDS[0][0]))
    return chain.otherwise(INVALID)


def decode_records(lines: DataFrame, text: str = "value", strict: bool = True) -> DataFrame:
    """Typed superset columns and record_type of JSON lines; blank lines leave.

    A line is parsed once, to a variant, from which keys and typed values are read. Strict
    decoding fails on a line of no type or without one of its type's keys, also where the value
    may be null. Bare infinities (and keys that repeat) are no JSON to the variant parser; such
    a line is parsed by schema and told by its typed columns.
    """
    some = lines.where(F.trim(text) != "").select(F.col(text).alias("__line"), F.try_parse_json(F.col(text)).alias("__json"))
    json, plain = F.col("__json"), F.col("__json").isNull()
    loose = F.when(plain, F.from_json("__line", superset(), {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}))
    some = some.withColumn("__loose", loose)
    typed = [F.when(plain, F.col("__loose").getField(f.name)).otherwise(F.try_variant_get(json, f"$.{f.name}", f.dataType.simpleString())).alias(f.name) for f in superset().fields]
    kind = F.when(~plain, record_type_of_parsed(json))
    rows = some.select(*typed, "__line", "__json", kind.alias("record_type"))
    rows = rows.withColumn("record_type", F.coalesce("record_type", record_type_of_columns()))
    if strict:
        complete = F.lit(True)
        for name, _, _ in RECORDS:
            every = reduce(lambda acc, c: acc & c, [has_key(json, f.name) for f in record_schema(name).fields])
            complete = F.when(F.col("record_type") == name, every).otherwise(complete)
        good = (F.col("record_type") != INVALID) & (F.col("__json").isNull() | complete)
        checked = F.when(good, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), F.substring("__line", 1, 200))).cast("string"))
        rows = rows.withColumn("record_type", checked)
    return rows.drop("__json", "__line")


def encode_record(kind: str) -> Column:
    """JSON text of a record, with its null values written out."""
    return F.to_json(F.struct(*[f.name for f in record_schema(kind).fields]), {"ignoreNullFields": "false"})


def encode_records(records: DataFrame) -> DataFrame:
    """value: JSON text of mixed records, each with its own type's fields."""
    have = set(records.columns)
    out = None
    for kind, _, _ in RECORDS:
        if all(f.name in have for f in record_schema(kind).fields):
            test, text = F.col("record_type") == kind, encode_record(kind)
            out = F.when(test, text) if out is None else out.when(test, text)
    if out is None:
        raise ValueError("no record type has all its columns")
    return records.select(*[f.name for f in HEADER.fields if f.name in have], out.alias("value"))


def with_event_ids(df: DataFrame, run: str, *order: Column | str, out: str = "event_id") -> DataFrame:
    """Gap-free numbers from 0 in each run, by ``order``.

    Rows are range-sorted by run and order, and written once; a range numbers its own rows of
    a run, and the ranges before it say from where on. So a run is never sorted in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = checkpointed(df.repartitionByRange(parts, run, *order).withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy(run, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(run).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    later = counts.withColumn("__first", F.sum("__n").over(before)).where("__first IS NOT NULL").select(F.col(run).alias("__of"), F.col("__range").alias("__at"), "__first")
    inside = F.row_number().over(Window.partitionBy(run, "__range").orderBy(*order)) - 1
    numbered = ranges.withColumn("__nth", inside)
    numbered = numbered.join(later, numbered[run].eqNullSafe(later["__of"]) & (F.col("__range") == F.col("__at")), "left")  # a null run is a run
    return numbered.select(*df.columns, (F.col("__nth") + F.coalesce("__first", F.lit(0))).cast("int").alias(out))


def with_games(moves: DataFrame, games: DataFrame, key: str = "game_id") -> DataFrame:
    """Move rows with the columns of their game; moves of unknown games leave."""
    return moves.join(games, key)


def with_prior(df: DataFrame, value: str, group: str, order: str, out: str) -> DataFrame:
    """df with the value of the row before it in its group."""
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(group).orderBy(order)))

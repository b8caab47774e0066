"""Audit of how quality filters interact: what each removes, in every order of applying them.

Words are rows: texts are dealt out by (document, salt), exploded, and counted by (document,
word) and then by document, all in one stage, for the dealing already holds each document's
words together. The totals are outer-joined with the other filters' flags, and one
aggregation with 32 conditional counts for each part (and as many of good and of toxic
documents) holds all that the orders need: which filters a document fails decides what each
order does with it.

A document is told by its id and a hash of its text; equal rows are counted together and
carry their number, so a text repeated in a third of all rows is spread over SALTS tasks.
Smaller ids of equal texts, labels and word totals are written before documents look them up,
so both sides of those joins are plain shuffles and Spark splits a hot key.

Defined results: null text is empty (no words: fails A alone, of A to D); null part is the
empty string; a null id is neither smaller nor larger than any; repeated rows of one id are
not equal to a smaller id's; repeated labels of an id: good (toxic) if any of them says so;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, same, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SIGNS = 200, 50, 3, "[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Tasks over which rows of one id and text are spread.
SALTS = 64


def _mark(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col))


def word_totals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark, words, distinct: of each different pair of id and text, for one copy of it."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")  # any salt will do
    dealt = df.select(col(id_col).alias("id"), _mark(text_col).alias("mark"), salt.alias("salt"), text_or_empty(text_col).alias("text")).repartition("id", "mark", "salt")
    one = F.array(F.lit(None).cast("string"))  # a null beside a copy's words counts the copies
    words = dealt.select("id", "mark", "salt", F.explode(F.concat(one, F.split("text", SPACE))).alias("word")).where("word IS NULL OR word <> ''")
    pairs = words.groupBy("id", "mark", "salt", "word").agg(F.count(F.lit(1)).alias("n"))
    some = pairs.groupBy("id", "mark", "salt").agg(F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("copies"), F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("words"), F.count("word").alias("distinct"))
    each = some.groupBy("id", "mark").agg(F.sum("copies").alias("copies"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.max("distinct").alias("distinct"))
    return each.select("id", "mark", F.expr("words div copies").alias("words"), "distinct")


def failed_filters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, fails (a bit for each of FILTERS, the first the lowest), copies: of rows alike in all of them and in text."""
    text = text_or_empty(text_col)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    flags = df.select(
        col(id_col).alias("id"), F.coalesce(col(part_col), F.lit("")).alias("part"), _mark(text_col).alias("mark"), F.sha2(text, 256).alias("digest"),
        (upper.cast("long") * 100 > F.length(text).cast("long") * MOST_UPPER).alias("c"), text.rlike(SIGNS).alias("d"),
    )
    flags = materialise(flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("copies")))
    totals = materialise(word_totals(df, id_col, text_col))
    least = flags.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    least = materialise(least.select(F.col("digest").alias("its"), "least"))
    joined = flags.join(totals, same(flags["id"], totals["id"]) & (flags["mark"] == totals["mark"]), "left").select(flags["id"], "part", "digest", "c", "d", "copies", "words", "distinct")
    joined = joined.join(least, F.col("digest") == F.col("its"), "left")
    tests = [F.col("words") < LEAST_WORDS, F.col("distinct") * 100 < F.col("words") * LEAST_DISTINCT, F.col("c"), F.col("d"), F.col("least") < F.col("id")]
    bits = [F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)]
    return joined.select("id", "part", sum(bits[1:], bits[0]).cast("int").alias("fails"), "copies")


def failure_counts(failed: DataFrame, labels: DataFrame, n: int = len(FILTERS), id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, and for each of the 2^n sets of failed filters the documents (all), the good and the toxic ones among them, as arrays."""
    marked = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).alias("of")).agg(F.max(F.when(col(good_col) == 1, 1).otherwise(0)).alias("good"), F.max(F.when(col(toxic_col) == 1, 1).otherwise(0)).alias("toxic"))
    rows = failed.join(materialise(marked.where("good = 1 OR toxic = 1")), F.col("id") == F.col("of"), "left")
    kinds = {"every": F.col("copies"), "good": F.col("copies") * F.col("good"), "toxic": F.col("copies") * F.col("toxic")}
    counts = [F.sum(F.when(F.col("fails") == m, F.coalesce(v, F.lit(0))).otherwise(0)).alias(f"{k}{m}") for k, v in kinds.items() for m in range(1 << n)]
    return rows.groupBy("part").agg(*counts).select("part", *[F.array(*[F.col(f"{k}{m}") for m in range(1 << n)]).alias(k) for k in kinds])


def every_order(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts by failed filters."""
    n = len(names)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda at: F.element_at(F.array(*[F.lit(1 << k) for k in range(n)]), F.instr(F.lit(names), F.substring("filter_order", at, 1)))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, j: acc + F.when(j < F.col("step"), bit(j)).otherwise(0))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("before", before)
    both = lambda m, of: m.bitwiseAND(F.col(of)) != 0

    def total(test, of: str = "every", weight=None) -> Column:
        value = lambda m: F.element_at(of, m + 1) * (weight(m) if weight else F.lit(1))
        return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(test(m), value(m)).otherwise(0))

    removed = lambda m: both(m, "own") & ~both(m, "before")
    # of the n! orders, those in which a filter comes first among k failed ones are one in k
    firsts = lambda m: F.lit(factorial(n)) / F.greatest(F.bit_count(m), F.lit(1))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~both(m, "own") & ~both(m, "before")).alias("kept"), total(removed).alias("removed"), total(lambda m: both(m, "own") & both(m, "before")).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        total(lambda m: both(m, "own"), weight=lambda m: firsts(m).cast("long")).alias("shapley"),
    )


def audit_filters(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return every_order(failure_counts(failed_filters(df, id_col, text_col, part_col), labels, id_col=id_col))

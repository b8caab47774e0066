"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1. Every text is reduced to the SHA-256 of its normalised form; (id, digest, row tag) is
   checkpointed, so texts are read once and all later steps move some 100 bytes a row.
2. A Misra-Gries style frequent-items sketch (``approx_top_k``, summed over salted groups)
   names at most ``MAX_HEAVY`` candidate digests. Any digest above ``1 / TRACKED * 3.5`` of
   all rows is certain to be among the tracked items.
3. Candidates are counted exactly with map-side partial aggregation; the verified ones
   (at most ``MAX_HEAVY`` rows, a fixed bound) are broadcast, and their rows leave the
   stream map-side.
4. The remaining digests, none of them frequent, go through one ordinary shuffle.

Defined results: null text counts as empty; an empty table gives no rows; a null id sorts
after every other id; of rows that repeat both id and text, exactly one is kept; columns of
the input other than id and text are ignored by ``duplicate_groups`` and passed through
untouched, whatever their names, by ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, keep_one_each, materialise, text_or_empty

#: Items a sketch tracks, and the most digests that may be split off.
TRACKED, MAX_HEAVY = 2048, 512
#: Groups that merge sketches before the last merge.
SALTS = 64
WHITESPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised_sha256(text_col: str = "text"):
    return F.sha2(F.regexp_replace(text_or_empty(text_col), WHITESPACE_RUN, " "), 256)


def frequent_digests(base: DataFrame) -> DataFrame:
    """Candidate digests (column text_sha256), at most MAX_HEAVY.

    Each salted group sketches its own rows; the groups' estimates (at most SALTS x MAX_HEAVY
    rows) are summed by digest.
    """
    salted = base.groupBy(F.pmod(F.xxhash64("row_tag"), F.lit(SALTS)).alias("salt")).agg(
        F.expr(f"approx_top_k(text_sha256, {MAX_HEAVY}, {TRACKED})").alias("top")
    )
    estimates = salted.select(F.explode("top").alias("t")).groupBy(F.col("t.item").alias("text_sha256")).agg(F.sum("t.count").alias("n"))
    return estimates.where("n > 1").orderBy(F.desc("n"), "text_sha256").limit(MAX_HEAVY).select("text_sha256")


def _winner():
    # null ids last; the row tag decides between repeated rows
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_tag").alias("row_tag")))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of df."""
    return _groups(df, id_col, text_col).drop("row_tag")


def _groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = materialise(
        df.select(col(id_col).alias("doc_id"), normalised_sha256(text_col).alias("text_sha256"), F.monotonically_increasing_id().alias("row_tag"))
    )
    candidates = F.broadcast(frequent_digests(base))
    n = base.count()
    heavy = materialise(
        base.join(candidates, "text_sha256")
        .groupBy("text_sha256")
        .agg(_winner().alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= max(2, n // (2 * TRACKED)))
    )
    frequent = base.join(F.broadcast(heavy), "text_sha256")
    rest = base.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    # aggregated map-side and written, so that the join's sides are plain shuffles, and Spark splits the rows of a digest just below the bound
    several = materialise(rest.groupBy(F.col("text_sha256").alias("its")).agg(_winner().alias("first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_tag").alias("row_tag"))
    rest = rest.join(several, F.col("text_sha256") == F.col("its"), "left").select(
        *base.columns, F.coalesce("first", own).alias("first"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    )
    return frequent.unionByName(rest).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_tag") == F.col("first.row_tag")).alias("kept"),
        "text_sha256",
        "row_tag",
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact deduplication keeps, with df's columns.

    Rows that go are named by (id, digest), a null id being a value of its own; one shuffle of
    df by that key drops them. Where rows repeat both id and text, any one of them stays.
    """
    groups = _groups(df, id_col, text_col).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("mark"), "keep_id", "group_size")
    several = groups.where("group_size > 1")
    dropped = several.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "mark")
    winners = several.where(F.col("id").eqNullSafe(F.col("keep_id")))
    repeated = materialise(winners.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "mark"))
    return keep_one_each(df, id_col, normalised_sha256(text_col), dropped, repeated)

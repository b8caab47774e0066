"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

1. Each source's documents stand in a hashed order on a line of words; the line is cut into
   blocks of equal words (the last may be shorter).
2. Slot k of the mix has the golden-ratio point frac(k * 0.618...). The cumulative target
   weights map it to a source, so that after any number of slots each source's share is near
   its target. A source's r-th slot takes its block r, or block r modulo the number of blocks
   in later rounds.
3. A source stops at its target to the word: the last slot takes a part of its block, and
   what the schedule's discrepancy leaves short (a few slots a source) is appended.
4. Slots and documents' shares of blocks are joined on (source, block). What a slot takes of a
   document is the document's share of the mix, and the slot is its place: ``mix_documents``
   writes copies in the order of their slots, so that any prefix of the mix, too, holds the
   sources near their targets.

Prefix sums and ranks are taken in two levels (as many buckets of the hash as a shuffle has
partitions; chunks of the schedule, as long as there are chunks), so a source with a third of
all rows is spread over many tasks. Only tables with one row a
source (the dimension of the mix) pass through a single task.

Defined results: null text has size 0 and is taken 0 times; null source is a source of its
own, last in order; an empty table gives no rows; repeated rows are documents of their own;
rows with null ids are drawn by their text; extra columns are ignored by ``mix_sources`` and
passed through, whatever their names, by ``mix_documents``.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise, same, shuffle_partitions, text_or_empty, unpacked, whole_rows

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2
#: Words of a block, and cells of the map from points to sources.
BLOCK, CELLS = 1024, 1024
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size and target: shares by weight, none above its limit, the excess reshared.

    The fill level is the first, in order of limit to weight, at which what is left for the
    sources not yet full stays below their limits.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("nth", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "nth")
    everything = Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(float(total)) * F.sum("source_size").over(everything) - full) / open_weight
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))
    return ranked.withColumn("fill", F.min(fits).over(everything).getField("level")).select(
        "source", "source_size", F.least("most", F.col("fill") * F.col("weight")).alias("target"), "nth"
    )


def _key(source: str = "source") -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))


def _lines(df: DataFrame, weights, total, most, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Each row's size, its first word on its source's line and its source's goal; and the goals.

    Totals and goals travel in the table of (source, bucket) sums, so rows are never dealt by
    their source alone.
    """
    buckets = shuffle_partitions(df.sparkSession)
    nameless = F.concat(F.lit("null:"), F.col("mark").cast("string"))
    draw = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), nameless)))
    base = materialise(
        df.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_or_empty(text_col)).alias("mark"), F.monotonically_increasing_id().alias("row_tag"))
        .withColumn("key", _key())
        .withColumn("draw", draw)
        .withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24)).cast("int"))
    )
    sums = materialise(base.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")))
    goals = materialise(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most).withColumn("key", _key()))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first")).join(goals.select("key", "source_size", "target"), "key")
    # rows alike in draw and size are counted by input partition: none of these, nor of an id that many rows repeat, is sorted in one task
    like = ["key", "bucket", "draw", "size", "part"]
    base = base.withColumn("part", F.shiftright("row_tag", 33))
    inside = Window.partitionBy("key", "bucket").orderBy("draw", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    alike = base.groupBy(*like).agg(F.count(F.lit(1)).alias("n")).withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*like).orderBy("row_tag")) - 1
    lines = (
        base.withColumn("nth", nth)
        .join(alike.select(*like, "within"), like)
        .join(firsts, ["key", "bucket"])
        .select("doc_id", "mark", "key", "size", "row_tag", "source_size", "target", (F.col("first") + F.col("within") + F.col("nth") * F.col("size")).alias("start"))
    )
    return materialise(lines), goals


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: key, slot, round, block and words of every slot, from key, source_size, target, nth."""
    spark = goals.sparkSession
    goals = materialise(
        goals.withColumn("budget", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)))
        .withColumn("upto", F.sum("target").over(Window.orderBy("nth")))
        .withColumn("whole", F.sum("target").over(Window.partitionBy(F.lit(0))))
    )
    whole = goals.agg(F.max("whole")).first()[0] or 0.0
    slots = int(-(-whole // block))
    chunk = max(1, isqrt(slots))
    edges = goals.where("budget > 0").select(
        "key", ((F.col("upto") - F.col("target")) / F.col("whole")).alias("low"), (F.col("upto") / F.col("whole")).alias("high")
    )
    cells = edges.select("*", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    # two factors keep the point exact to some 1e-10 for any number of slots
    turn = F.floor(F.col("slot") / 65536) * F.lit(65536 * GOLDEN % 1) % 1 + (F.col("slot") % 65536) * F.lit(GOLDEN) % 1
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", turn % 1).withColumn("cell", F.floor(F.col("point") * CELLS))
    drawn = points.join(cells, "cell").where("point >= low AND point < high").select("key", "slot", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = drawn.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    goal = goals.select("key", "source_size", "blocks", "budget")
    firsts = counts.select("key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).join(goal, "key")
    placed = (
        drawn.withColumn("place", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")))
        .join(firsts, ["key", "chunk"])
        .select("key", "slot", (F.col("first") + F.col("place") - 1).alias("rank"), "source_size", "blocks", "budget")
    )
    needed = F.expr(f"(budget div source_size) * blocks + ceil((budget % source_size) / {block})")
    given = drawn.groupBy("key").agg(F.count(F.lit(1)).alias("given"))
    short = goals.where("budget > 0").join(given, "key", "left").select("key", F.coalesce("given", F.lit(0)).alias("given"), needed.alias("needed"))
    tail = short.where("given < needed").select("key", F.explode(F.expr("sequence(given, needed - 1)")).alias("rank")).select("key", (F.lit(slots) + F.col("rank")).alias("slot"), "rank").join(goal, "key")
    ranked = placed.unionByName(tail)
    ranked = ranked.withColumns({"round": F.expr("rank div blocks"), "block": F.expr("rank % blocks")})
    left = F.col("budget") - F.col("round") * F.col("source_size") - F.col("block") * block
    return ranked.withColumn("words", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, left)).where("words > 0").select("key", "slot", "round", "block", "words")


def mix_sources(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes) and first_slot (where in the mix it comes first; null if not taken) for every row of df."""
    sizes, takes = _mix(df, weights, total, most, block, id_col, text_col, source_col)
    taken = takes.groupBy("row_tag").agg(F.sum("part").alias("taken"), F.min("slot").alias("first_slot"))
    return sizes.join(taken, "row_tag", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def _mix(df: DataFrame, weights, total, most, block, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame]:
    """The rows on their sources' lines; and for each row and slot that takes of it: doc_id, mark, row_tag, size, round, slot and part (words)."""
    sizes, goals = _lines(df, weights, total, most, id_col, text_col, source_col)
    slots = schedule(goals, block).select("key", "slot", "round", "block", "words")
    pieces = sizes.where("size > 0").select(
        "doc_id", "mark", "row_tag", "key", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block")
    )
    # the part of the document that lies in the block, against the block's first `words` words
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.col("words"))
    takes = pieces.join(slots, ["key", "block"]).select("doc_id", "mark", "row_tag", "size", "round", "slot", (high - low).alias("part")).where("part > 0")
    return sizes, takes


def mix_documents(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus, with df's columns: each document as often as the mix takes it, to the nearest whole, in the order of the slots.

    A copy stands at the first slot that takes of it in its round. Only the document in which
    a source's last block ends is taken in part, so rounding moves a source by less than one
    document. Rows that repeat id and text share what is taken of them.
    """
    _, takes = _mix(df, weights, total, most, block, id_col, text_col, source_col)
    # a row has some `most` rounds at most; repeated rows have equal sizes
    rounds = takes.groupBy("doc_id", "mark", "row_tag", "round").agg(F.sum("part").alias("part"), F.min("slot").alias("slot"), F.first("size").alias("size"))
    rounds = rounds.groupBy("doc_id", "mark", "round").agg(F.avg(F.col("part") / F.col("size")).alias("share"), F.min("slot").alias("slot"))
    plan = rounds.groupBy("doc_id", "mark").agg(F.round(F.sum("share")).cast("int").alias("copies"), F.array_sort(F.collect_list(F.struct("round", "slot"))).alias("at"))
    plan = plan.where("copies > 0").select("doc_id", "mark", F.slice("at.slot", F.lit(1), F.col("copies")).alias("at"))
    rows = df.select(whole_rows(df).alias("row"), col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("its"))
    placed = rows.join(plan, same(F.col("id"), F.col("doc_id")) & (F.col("its") == F.col("mark"))).select("row", "id", F.explode("at").alias("slot"))
    ordered = placed.repartitionByRange(shuffle_partitions(df.sparkSession), "slot", "id").sortWithinPartitions("slot", "id")
    return unpacked(ordered, df)

"""Trie of conversation prefixes by preorder intervals.

1. Turns are numbered: one range sort by conversation and turn; a task numbers its range, and
   where a conversation spans ranges, the counts of those before it say from where on.
2. Conversations are rebuilt, and every prefix gets a key: its depth and the exclusive-or of
   two 64-bit hashes of (place, turn) over its turns, in blocks of BLOCK turns and then over
   blocks, so a long conversation is never walked in one task.
3. Distinct keys are the nodes, aggregated map-side: a prefix of most conversations costs one
   row a task.
4. Nodes are ranked lexicographically by one range sort of their paths of 128-bit turn
   digests. A path longer than BLOCK turns is cut into blocks; the distinct blocks are ranked
   first and stand for their turns, and so on until every path is short, so sort keys are
   bounded whatever the depth, and the rounds are its logarithm to the base BLOCK.
5. In this order (preorder) a subtree is an interval. Its end is the last place at which a
   member ends. Leaves and savings have prefix sums, by range and then over ranges (the driver
   sees three sums a range), and a subtree's figures are differences of those at its end and
   before its top: prefix sums grow, so a maximum over members finds those at the end.
6. Members that end at a node are digested from their ids in order: a task packs the ids of
   its range into strings of up to CHUNK ids; strings of one node are hashed one after another.

Prefixes are told apart by their depth and 128 bits, turns by 128 bits.

Defined results: rows with a null conversation belong to none; null turns come first, rows of
one turn by role and text; null role or text is empty; repeated rows are turns of their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise, shuffle_partitions, stored, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
#: Turns of a block; ids of a string.
BLOCK, CHUNK = 32, 4096
#: Conversations with a common base, and the modulus of the turns that they borrow.
FAMILY, BORROW = 20, 4
KEY = ["depth", "x1", "x2"]
#: The textless root.
ROOT = {"depth": 0, "x1": 0, "x2": 0}
#: Most rows of a table by range that is broadcast.
SMALL = 100_000


def _runs(ids: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal ids."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))


def number_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, nth (from 0), label (digest of role and text), words: stored."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    label = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")
    rows = df.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), label.alias("label"), words.alias("words"), F.monotonically_increasing_id().alias("tie"))
    order = ["id", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    ranges = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).select("id", "label", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                nth = _runs(ids)
                if last == ids[0]:
                    nth[ids == last] += n
                last, n = ids[-1], nth[-1] + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), at, np.int32)), batch.column(0), pa.array(nth.astype(np.int64)), *batch.columns[1:]], names=["range", "id", "nth", "label", "words"])

    some = stored(ranges.mapInArrow(run, "range int, id bigint, nth bigint, label string, words bigint"))
    counts = some.groupBy("id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = counts.withColumn("first", F.sum("n").over(before)).where("first IS NOT NULL").select(F.col("id").alias("its"), F.col("range").alias("of"), "first")
    later = F.broadcast(materialise(later))  # of each range, its first conversation at most
    joined = some.join(later, (F.col("id") == F.col("its")) & (F.col("range") == F.col("of")), "left")
    return joined.select("id", (F.col("nth") + F.coalesce("first", F.lit(0))).alias("nth"), "label", "words")


def rebuild(turns: DataFrame, family: int = FAMILY, borrow: int = BORROW) -> tuple[DataFrame, DataFrame]:
    """Conversations (id, total) and their rebuilt turns (id, depth from 1, label, words, ends)."""
    lens = materialise(turns.groupBy("id").agg(F.count(F.lit(1)).alias("own")))
    convs = lens.select("id", "own", (F.crc32(F.col("id").cast("string").cast("binary")) % borrow).alias("h"), (F.col("id") - F.col("id") % family).alias("base"))
    convs = convs.join(lens.select(F.col("id").alias("base"), F.col("own").alias("theirs")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("theirs", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialise(convs.select("id", "base", "h", "taken", "total"))
    mine = turns.join(convs, "id").where("nth >= h").select("id", (F.col("taken") + F.col("nth") - F.col("h") + 1).alias("depth"), "label", "words", "total")
    heads = turns.where(F.col("nth") < borrow - 1).withColumnRenamed("id", "base")
    lent = heads.join(convs, "base").where("nth < h").select("id", (F.col("nth") + 1).alias("depth"), "label", "words", "total")
    return convs.select("id", "total"), mine.unionByName(lent).select("id", "depth", "label", "words", (F.col("depth") == F.col("total")).alias("ends"))


def with_keys(turns: DataFrame, deep: bool, block: int = BLOCK) -> DataFrame:
    """turns (id, depth, label) with x1, x2 (of the prefix), p1, p2 (of the one before it) and path (of its block)."""
    h1, h2 = F.xxhash64("depth", "label"), F.xxhash64("label", F.lit("second"), "depth")
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / block)).withColumn("h1", h1).withColumn("h2", h2)
    upto = Window.partitionBy("id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select(*turns.columns, "block", "h1", "h2", F.bit_xor("h1").over(upto).alias("x1"), F.bit_xor("h2").over(upto).alias("x2"), F.array_join(F.collect_list("label").over(upto), "").alias("path"))
    if deep:
        before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy("id", "block").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
        first = sums.select(F.col("id").alias("its"), F.col("block").alias("of"), F.bit_xor("s1").over(before).alias("f1"), F.bit_xor("s2").over(before).alias("f2")).where("of > 0")
        out = out.join(materialise(first), (F.col("id") == F.col("its")) & (F.col("block") == F.col("of")), "left")
        out = out.withColumn("x1", F.col("x1").bitwiseXOR(F.coalesce("f1", F.lit(0)))).withColumn("x2", F.col("x2").bitwiseXOR(F.coalesce("f2", F.lit(0))))
    return out.select(*turns.columns, "x1", "x2", F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"), "path")


def _key(side: DataFrame, other: DataFrame, names: list[str] = KEY) -> Column:
    out = side[names[0]] == other[KEY[0]]
    for a, b in zip(names[1:], KEY[1:]):
        out = out & (side[a] == other[b])
    return out


def short_paths(nodes: DataFrame, rows: DataFrame, deepest: int, block: int = BLOCK) -> DataFrame:
    """nodes with paths of at most ``block`` digests or ranks, in the order of their whole paths."""
    width = block
    while deepest > width:
        ranked = stored(nodes.select("path").distinct().repartitionByRange(shuffle_partitions(nodes.sparkSession), "path").sortWithinPartitions("path").select("path", F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0").alias("rank")))
        nodes = stored(nodes.join(ranked, "path").drop("path"))
        # the full blocks of a conversation, by blocks of blocks
        full = rows.where(F.col("depth") % width == 0).select("id", *KEY)
        ends = nodes.where(F.col("depth") % width == 0).select(*KEY, "rank")
        full = full.join(ends, KEY).select("id", "depth", "rank", F.floor((F.col("depth") / width - 1) / block).alias("of"))
        lists = full.groupBy(F.col("id").alias("its"), "of").agg(F.sort_array(F.collect_list(F.struct("depth", "rank"))).getField("rank").alias("ranks"))
        place = F.greatest(F.ceil(F.col("depth") / width), F.lit(1))  # the node's own block, from 1 (the root has the first)
        placed = nodes.withColumn("place", place).withColumn("outer", F.floor((F.col("place") - 1) / block))
        joined = placed.join(materialise(lists), (F.col("conv_id") == F.col("its")) & (F.col("outer") == F.col("of")), "left")
        earlier = F.slice(F.coalesce("ranks", F.array().cast("array<string>")), F.lit(1), ((F.col("place") - 1) % block).cast("int"))
        nodes = stored(joined.select(*nodes.drop("rank").columns, F.concat(F.array_join(earlier, ""), "rank").alias("path")))
        width *= block
    return nodes


def preorder(nodes: DataFrame) -> DataFrame:
    """nodes in the order of their paths: pos (from 0), and the leaves and savings up to and with each, stored."""
    spark = nodes.sparkSession
    kept = [*KEY, "p1", "p2", "conv_id", "n_convs", "n_children"]
    ranges = nodes.repartitionByRange(shuffle_partitions(spark), "path").sortWithinPartitions("path").select(*kept, "leaf", "saving")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, leaves, saved = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                own = [batch.column(c).to_numpy() for c in ("leaf", "saving")]
                upto = [leaves + np.cumsum(own[0]), saved + np.cumsum(own[1])]
                pos = np.arange(n, n + batch.num_rows)
                n, leaves, saved = n + batch.num_rows, int(upto[0][-1]), int(upto[1][-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, at, np.int32)), *map(pa.array, (pos, *upto))], names=[*batch.schema.names, "range", "pos", "leaves", "saved"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.schema)
    out = stored(ranges.mapInArrow(run, f"{fields}, range int, pos bigint, leaves bigint, saved bigint"))
    totals, first, firsts = out.groupBy("range").agg(F.max("pos") + 1, F.max("leaves"), F.max("saved")).orderBy("range").collect(), (0, 0, 0), []
    for at, *sums in totals:
        firsts.append((at, *first))
        first = tuple(a + b for a, b in zip(first, sums))
    starts = spark.createDataFrame(firsts, "of int, pos0 bigint, leaves0 bigint, saved0 bigint")
    joined = out.join(F.broadcast(starts) if len(firsts) <= SMALL else starts, F.col("range") == F.col("of"))
    return joined.select(*kept, "leaf", "saving", *[(F.col(c) + F.col(f"{c}0")).alias(c) for c in ("pos", "leaves", "saved")])


def digests_of_ends(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """KEY and ends_sha256 of the ids that end at each node."""
    order = [*KEY, "id"]
    sorted_ends = ends.select(*order).repartitionByRange(shuffle_partitions(ends.sparkSession), *order).sortWithinPartitions(*order)
    names = [*KEY, "first", "ids"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *key, ids = (c.to_numpy() for c in batch.columns)
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)]
            starts = np.flatnonzero(new | (_runs(np.cumsum(new)) % chunk == 0))
            texts = ids.astype(str)
            joined = [",".join(texts[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in key), pa.array(ids[starts]), pa.array(joined)], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=[*KEY, "ends_sha256"])

    key = "depth bigint, x1 bigint, x2 bigint"
    strings = sorted_ends.mapInArrow(pack, f"{key}, first bigint, ids string")
    return strings.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, borrow: int = BORROW, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and preorder places first_pos and last_pos: one row for each node."""
    spark = df.sparkSession
    convs, turns = rebuild(number_turns(df, id_col, turn_col, role_col, text_col), family, borrow)
    n, least, deepest, turnless = convs.agg(F.count(F.lit(1)), F.min("id"), F.max("total"), F.count_if(F.col("total") == 0)).first()
    rows = stored(with_keys(turns, (deepest or 0) > block, block))
    nodes = rows.groupBy(*KEY, "p1", "p2", "words", "path").agg(F.min("id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = spark.createDataFrame([(*ROOT.values(), None, None, 0, "", least, n)] if n else [], "depth bigint, x1 bigint, x2 bigint, p1 bigint, p2 bigint, words bigint, path string, conv_id bigint, n_convs bigint")
    nodes = stored(nodes.unionByName(root).withColumn("saving", (F.col("n_convs") - 1) * F.col("words")).drop("words"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("d"), F.col("p1").alias("a"), F.col("p2").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    ranked = short_paths(nodes, rows, deepest or 0, block)
    ranked = ranked.join(children, _key(children, ranked, ["d", "a", "b"]), "left").select(*ranked.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"))
    placed = preorder(ranked.withColumn("leaf", (F.col("n_children") == 0).cast("long")))

    at_root = [F.lit(v).cast("long").alias(k) for k, v in ROOT.items()]
    ends = rows.where("ends").select("id", *KEY)
    if turnless:
        ends = ends.unionByName(convs.where("total = 0").select("id", *at_root))
    lasts = materialise(ends.join(placed.select(*KEY, "pos", "leaves", "saved"), KEY).select("id", "pos", "leaves", "saved"))
    passed = rows.select("id", *KEY).join(lasts, "id").groupBy(*KEY)
    last = lambda d: d.agg(F.max("pos").alias("last_pos"), F.max("leaves").alias("leaves_in"), F.max("saved").alias("saved_in"))
    intervals = last(passed).unionByName(last(lasts).select(*at_root, "last_pos", "leaves_in", "saved_in"))
    digests = digests_of_ends(ends)

    out = placed.join(intervals, KEY).join(digests, KEY, "left")
    parents = placed.select(*[F.col(c).alias(f"of_{c}") for c in KEY], F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, (out["depth"] - 1 == parents["of_depth"]) & (out["p1"] == parents["of_x1"]) & (out["p2"] == parents["of_x2"]), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_in") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_in") - F.col("saved") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.col("pos").alias("first_pos"), "last_pos",
    )

"""Hierarchical weighted hash tree: region, rack, shard (DataFrame functions only).

Shards join in order. When one of weight w brings the total to c, a row moves to it with the
chance w / c, and to no other; this is decided down the tree, by one weighted draw for each
child of the subtree that the row has come to:

- a region drew the row while it was filled, from the total a to the total b, with the chance
  1 - a / b: it did if the row's uniform draw u for the region's name is at least a / b, and
  then when the total reached a / u. The last region that drew the row has it;
- of the racks of that region, the one being filled at that moment has it, or the last later
  one whose own draw took it since; likewise for the shards of that rack.

So a row costs a draw for each region, for each rack of one region and for each shard of one
rack, whatever the number of shards, and each shard holds rows in proportion to its weight.
Names are those of the path, so another shape of the tree deals differently.

Movement: a shard that joins (or weight that joins an old shard, ``raise_weight``) takes rows
only to itself, whatever the number of shards: the law ``key``. Where weight is shifted inside
a rack or a region whose total stays, no draw outside it has changed, and rows move inside it
alone. Where a subtree in the middle of the order changes its total by anything but
``raise_weight``, the subtrees that joined later are drawn anew and give or take rows too.

Slots: rows that agree in id, size and CRC are alike, so they are counted first (map-side)
and numbered as one; a running sum over buckets of a hash, then within a bucket, places them,
and counts are spread out again in two steps, so neither a shard nor a group of equal rows
is ever sorted or made in one task.

Defined results: null text has size 1 and CRC of no bytes; a null id is drawn like an id of
its own (hash of the null marker), so all null ids fall into one shard; repeated rows fall
into one shard and get different slots; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, shuffle_partitions, text_or_empty

SHARDS = 8
#: Shards of a rack and racks of a region; equal rows that one task writes out at a time; longest table that is broadcast.
PER_RACK, RACKS, SPREAD, SMALL = 2, 2, 4096, 100_000


@dataclass(frozen=True)
class Leaf:
    """A shard's weight; shards are in the order in which they joined."""

    shard: int
    weight: float = 1.0


#: A tree: regions of racks of leaves. Only the last region and rack may still be filled.
Rack = tuple[Leaf, ...]
Region = tuple[Rack, ...]
Tree = tuple[Region, ...]


def leaves(tree: Tree) -> list[Leaf]:
    return [x for region in tree for rack in region for x in rack]


def add_leaf(tree: Tree, leaf: Leaf, racks: int, per_rack: int) -> Tree:
    """The tree with one more leaf at its end: in the last rack, in a new rack of the last region, or in a new region."""
    if not tree or (len(tree[-1]) == racks and len(tree[-1][-1]) == per_rack):
        return (*tree, ((leaf,),))
    *before, last = tree
    if len(last[-1]) == per_rack:
        return (*before, (*last, (leaf,)))
    return (*before, (*last[:-1], (*last[-1], leaf)))


def standard_tree(n_shards: int, racks: int = RACKS, per_rack: int = PER_RACK) -> Tree:
    """Regions of racks x per_rack equal shards; the last region and rack may be smaller."""
    tree: Tree = ()
    for s in range(n_shards):
        tree = add_leaf(tree, Leaf(s), racks, per_rack)
    return tree


def grow(tree: Tree, racks: int = RACKS, per_rack: int = PER_RACK, weight: float = 1.0) -> Tree:
    """The tree with one more shard: only that shard gains rows."""
    return add_leaf(tree, Leaf(max((x.shard for x in leaves(tree)), default=-1) + 1, weight), racks, per_rack)


def raise_weight(tree: Tree, shard: int, by: float) -> Tree:
    """The tree in which a shard has more weight: it joins again, as a region of its own, and takes rows only to itself."""
    return (*tree, ((Leaf(shard, by),),))


def reweigh(tree: Tree, weights: dict[int, float]) -> Tree:
    """The tree with these shards' weights replaced; where the sums of all subtrees around them stay, only their rows move."""
    return tuple(tuple(tuple(Leaf(x.shard, weights.get(x.shard, x.weight)) for x in rack) for rack in region) for region in tree)


def _draw(key: Column, level: str, *names: Column) -> Column:
    """Uniform over (0, 1], by the row and a node's path."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), *names), 11)  # 53 bits
    return (bits.cast("double") + F.lit(1.0)) / F.lit(float(1 << 53))


def _numbers(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _bind(value: Column, then) -> Column:
    """then(value), with value in the plan once, however often ``then`` refers to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _last_drawn(first: Column, last: Column, came: Column, starts: Column, ends: Column, draw) -> Column:
    """(node, since): of the nodes ``first`` to ``last``, the last that drew a row which came when the total was ``came``."""
    found = lambda k, since: F.struct(k.cast("int").alias("node"), since.cast("double").alias("since"))

    def step(acc: Column, k: Column) -> Column:
        start, end = F.element_at(starts, k + 1), F.element_at(ends, k + 1)
        return F.when((k == first) | (start < came), found(k, came)).otherwise(_bind(draw(k), lambda u: F.when(u >= start / end, found(k, start / u)).otherwise(acc)))

    return F.aggregate(F.sequence(first, last), found(F.lit(-1), F.lit(0.0)), step)


def shard_column(key: Column, tree: Tree) -> Column:
    """The shard that a key falls into; an expression of the same size for any tree."""
    upto = [0.0, *accumulate(x.weight for x in leaves(tree))]
    first_leaf = [0, *accumulate(len(rack) for region in tree for rack in region)]
    first_rack = [0, *accumulate(len(region) for region in tree)]
    of_racks, of_regions = [upto[k] for k in first_leaf], [upto[first_leaf[k]] for k in first_rack]
    spans = lambda bounds: (_numbers(bounds[:-1], "double"), _numbers(bounds[1:], "double"))
    pick = lambda values, k: F.element_at(_numbers(values, "int"), k + 1)

    def in_region(r: Column) -> Column:
        first = pick(first_rack[:-1], r["node"])
        rack = _last_drawn(first, pick(first_rack[1:], r["node"]) - 1, r["since"], *spans(of_racks), lambda k: _draw(key, "rack", r["node"], k - first))
        return _bind(rack, lambda c: in_rack(r["node"], c["node"] - first, c))

    def in_rack(region: Column, nth: Column, c: Column) -> Column:
        first = pick(first_leaf[:-1], c["node"])
        leaf = _last_drawn(first, pick(first_leaf[1:], c["node"]) - 1, c["since"], *spans(upto), lambda k: _draw(key, "shard", region, nth, k - first))
        return pick([x.shard for x in leaves(tree)], leaf["node"])

    region = _last_drawn(F.lit(0), F.lit(len(tree) - 1), F.lit(0.0), *spans(of_regions), lambda k: _draw(key, "region", k))
    return _bind(region, in_region)


def shard_of(df: DataFrame, tree: Tree, key: Column, out: str) -> DataFrame:
    """df with the shard that each row's key falls into; no shuffle."""
    return df.withColumn(out, shard_column(key, tree) if tree else F.lit(-1))


def assign_shards(df: DataFrame, tree: Tree, id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """df with the shard column (replaced if df has it); no shuffle."""
    return shard_of(df, tree, col(id_col), out)


def with_slots(df: DataFrame, group: str, ordered: list[str], groups: int) -> DataFrame:
    """Columns ``group`` and ``ordered`` of every row of df, and ``slot``: places in each group, gapless from 0.

    Rows that agree in all these columns are alike and counted first. Buckets of a hash and
    their sizes (``groups`` x buckets rows at most, set by the parallelism, not by the data;
    broadcast up to SMALL, else shuffled) give each bucket its first slot.
    """
    partitions = shuffle_partitions(df.sparkSession)
    bucket = F.pmod(F.xxhash64(*ordered, F.lit("slot")), F.lit(4 * partitions)).cast("int")
    alike = df.groupBy(group, *ordered).agg(F.count(F.lit(1)).alias("rows")).withColumn("bucket", bucket)
    counts = df.groupBy(F.col(group).alias("its"), bucket.alias("of")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("its").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("its", "of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if groups * 4 * partitions <= SMALL:
        first = F.broadcast(first)
    inside = Window.partitionBy(group, "bucket").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        alike.withColumn("within", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        .join(first, (F.col(group) == F.col("its")) & (F.col("bucket") == F.col("of")))
        .withColumn("slot", F.col("first") + F.col("within"))
    )
    lots = placed.select(group, *ordered, "slot", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(SPREAD).cast("long"))).alias("lot"))
    lots = lots.repartition(partitions, "slot", "lot")
    last = F.least(F.col("lot") + SPREAD, F.col("rows")) - 1
    return lots.select(group, *ordered, "slot", F.explode(F.sequence("lot", last)).alias("nth")).select(group, *ordered, (F.col("slot") + F.col("nth")).alias("slot"))


def shard_documents(df: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of df."""
    tree = standard_tree(n_shards)
    text = text_or_empty(text_col)
    rows = df.select(col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = shard_of(shard_of(rows, tree, F.col("doc_id"), "shard"), grow(tree), F.col("doc_id"), "grown_shard")
    slotted = with_slots(keyed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"], max(1, n_shards))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

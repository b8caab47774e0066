"""Joins of values with ranges that are data.

Ranges are [low, high); a null end is open. They are laid into bins as wide as the average
range, so that all of them together take at most three rows each; values meet the ranges of
their own bin by an equi-join, and the exact ends are checked there. A value and a range share
one bin at most, so a pair appears once; overlapping ranges give a row for each range.

What is only counted, or whose extremes are sought, needs no pairs (``interval_aggregate``):
values and ends are numbered in their order, FAN neighbours are summed up in a node, FAN nodes
in one above, and a range reads a part of at most two nodes of each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpointed
from .records import with_event_ids

#: Most bins between the least and the greatest value.
BINS = 1 << 16
#: Cells of a node are 2 to the power of this many.
FAN_BITS = 6
#: Most nodes that are broadcast.
NODES = 10_000


def bin_layout(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, bins: int = BINS) -> tuple[float, float, float]:
    """Least and greatest value, and the width of a bin."""
    least, most = points.where(~F.isnan(F.col(point).cast("double"))).agg(F.min(F.col(point).cast("double")), F.max(F.col(point).cast("double"))).first()
    if least is None or most <= least:
        return least or 0.0, most or 0.0, 1.0
    a, b = _clipped(low, high, least, most)
    average = ranges.where(b >= a).agg(F.avg(b - a)).first()[0] or 0.0
    return least, most, max(average, (most - least) / bins)


def _clipped(low: str, high: str, least: float, most: float) -> tuple[Column, Column]:
    inside = lambda c, default: F.least(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(default)), F.lit(least)), F.lit(most))
    return inside(low, least), inside(high, most)


def interval_join(points: DataFrame, point: str, ranges: DataFrame, low: str = "low", high: str = "high", how: str = "inner", bins: int = BINS) -> DataFrame:
    """points with the columns of every range that holds their value (column names must differ).

    ``how``: inner, or left to keep values in no range. Null values and NaN are in no range;
    a range whose low end is not below its high end holds nothing.
    """
    least, most, width = bin_layout(points, point, ranges, low, high, bins)
    place = lambda c: F.floor((c - F.lit(least)) / F.lit(width))
    a, b = _clipped(low, high, least, most)
    outside = (F.col(low).cast("double") > F.lit(most)) | (F.col(high).cast("double") <= F.lit(least)) | (F.col(low) >= F.col(high))
    laid = ranges.where(~F.coalesce(outside, F.lit(False))).withColumn("__bin", F.explode(F.sequence(place(a), place(b))))
    value = F.col(point).cast("double")
    keyed = points.withColumn("__at", F.when(~F.isnan(value), place(value)))
    holds = (F.col(low).isNull() | (F.col(low) <= F.col(point))) & (F.col(high).isNull() | (F.col(point) < F.col(high)))
    return keyed.join(broadcast_if_small(laid), (F.col("__at") == F.col("__bin")) & holds, how).drop("__at", "__bin")


def _merged(how: str, c: str) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max}[how](c).alias(c)


def _nodes(places: DataFrame, levels: int, bits: int, measures: dict[str, str]) -> DataFrame:
    """level, node, cells: measures of a node's places (level 0), or of the nodes right below it, in order."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("place", k * bits).alias("cell")) for k in range(levels)]))
    cells = places.select(at.alias("at"), *measures).groupBy("at.level", "at.cell").agg(*[_merged(how, m) for m, how in measures.items()])
    return cells.groupBy("level", F.shiftright("cell", bits).alias("node")).agg(F.sort_array(F.collect_list(F.struct("cell", *measures))).alias("cells"))


def _parts(levels: int, bits: int) -> Column:
    """The parts of nodes (level, node, first cell, size) that make up the places from a0 to before b0; columns a1, b1, ... are the same ends by level."""
    parts = []
    for k in range(levels):
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        left, right = F.shiftright(a, bits), F.shiftright(b - 1, bits)
        part = lambda node, x, y: F.struct(F.lit(k).alias("level"), node.alias("node"), (x - F.shiftleft(node, bits) + 1).cast("int").alias("first"), (y - x).cast("int").alias("size"))  # noqa: B023, E731
        parts.append(F.when(a < b, part(left, a, F.least(b, F.shiftleft(left + 1, bits)))))
        parts.append(F.when((a < b) & (left < right), part(right, F.shiftleft(right, bits), b)))
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def interval_aggregate(
    points: DataFrame, point: str, ranges: DataFrame, by: str, low: str = "low", high: str = "high", count: str = "n", least: dict[str, str] | None = None, greatest: dict[str, str] | None = None,
    bits: int = FAN_BITS,
) -> DataFrame:
    """by, the number of points in its ranges, and over them the least and the greatest of columns (out: column); a ``by`` without points leaves.

    The same as ``interval_join`` grouped by ``by``, but no pairs are made: rows grow with
    points and ranges, however these overlap.
    """
    asked = [(out, "min", c) for out, c in (least or {}).items()] + [(out, "max", c) for out, c in (greatest or {}).items()]
    measures = {"n": "sum"} | {f"m{k}": how for k, (_, how, _) in enumerate(asked)}
    some = points.where(F.col(point).isNotNull())
    if points.schema[point].dataType.typeName() in ("float", "double"):
        some = some.where(~F.isnan(point))
    some = some.select(F.col(point).alias("x"), F.lit(1).cast("long").alias("n"), *[F.col(c).alias(f"m{k}") for k, (_, _, c) in enumerate(asked)])
    ends = ranges.select(F.explode(F.array(low, high)).alias("x")).where("x IS NOT NULL")
    values = some.unionByName(ends, allowMissingColumns=True).groupBy("x").agg(*[_merged(how, m) for m, how in measures.items()])
    places = checkpointed(with_event_ids(values.withColumn("run", F.lit(0)), "run", "x", out="place").withColumn("place", F.col("place").cast("long")))
    n, levels = places.count(), 1
    while n > 1 << levels * bits:
        levels += 1

    at = lambda end, c: places.select(F.col("x").alias(f"{c}_x"), F.col("place").alias(c)).hint("merge").alias(end)
    kind = places.schema["x"].dataType
    spans = ranges.select(F.col(by).alias("of"), F.col(low).cast(kind).alias("low"), F.col(high).cast(kind).alias("high"))
    spans = spans.join(at("low", "a"), F.col("low") == F.col("a_x"), "left").join(at("high", "b"), F.col("high") == F.col("b_x"), "left")
    spans = spans.select("of", F.coalesce("a", F.lit(0)).alias("a0"), F.coalesce("b", F.lit(n)).cast("long").alias("b0")).where("a0 < b0")
    for k in range(levels - 1):  # what lies between the outer two nodes are whole nodes, the cells of the next level
        spans = spans.withColumns({f"a{k + 1}": F.shiftright(f"a{k}", bits) + 1, f"b{k + 1}": F.shiftright(F.col(f"b{k}") - 1, bits)})
    parts = spans.select("of", F.explode(_parts(levels, bits)).alias("part")).select("of", "part.*")
    cells = F.slice("cells", F.col("first"), F.col("size"))
    over = {"sum": lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + F.coalesce(y, F.lit(0))), "min": F.array_min, "max": F.array_max}
    met = parts.join(broadcast_if_small(checkpointed(_nodes(places, levels, bits, measures)), NODES), ["level", "node"]).select("of", cells.alias("cells"))
    found = met.select("of", *[over[how](F.col("cells").getField(m)).alias(m) for m, how in measures.items()])
    found = found.groupBy("of").agg(*[_merged(how, m) for m, how in measures.items()]).where("n > 0")
    return found.select(F.col("of").alias(by), F.col("n").alias(count), *[F.col(f"m{k}").alias(out) for k, (out, _, _) in enumerate(asked)])


def ranges_of_bounds(bounds: DataFrame, bound: str, label: str, top: str | None = None) -> DataFrame:
    """low, high, label of ascending upper bounds: each range ends before its own bound, the first is open below; ``top`` is above the last.

    Bounds are a dimension (labels of buckets), so one task orders them; a repeated bound ends one range, its least label's.
    """
    each = bounds.where(F.col(bound).isNotNull()).groupBy(F.col(bound).alias("high")).agg(F.min(label).alias("label"))
    out = each.select(F.lag("high").over(Window.orderBy("high")).alias("low"), "high", "label")
    if top is None:
        return out
    last = each.agg(F.max("high").alias("low"))
    return out.unionByName(last.select("low", F.lit(None).cast(last.schema["low"].dataType).alias("high"), F.lit(top).alias("label")))


def bucketize_by(df: DataFrame, value: str, bounds: DataFrame, bound: str, label: str, top: str | None = None, out: str = "bucket", unknown: str | None = None) -> DataFrame:
    """df with the label of the first bound above its value: ``bucketize`` with boundaries that are data."""
    ranges = ranges_of_bounds(bounds, bound, label, top).select(F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("label").alias("__label"))
    joined = interval_join(df.drop(out), value, ranges, "__low", "__high", "left")
    found = F.col("__label") if unknown is None else F.when(F.col(value).isNull(), unknown).otherwise(F.col("__label"))
    return joined.withColumn(out, found).drop("__low", "__high", "__label")

"""Connected components of a table of links, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, looked_up, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) for every node of links, which are read twice.

    Each round sends every node the least root among its neighbours, hooks roots to lesser
    roots, and halves the paths; messages are pre-aggregated map-side, so a node with very
    many links receives one row a task. Tables that many rows look up by one key (a neighbour
    with many links, a root with many nodes) are written before they are joined, so both sides
    are plain shuffles, and Spark splits the hot key's rows; small ones are broadcast. Rounds
    grow with the logarithm of a component's diameter; each ends in a checkpoint. The number
    of links bounds all tables, and so the tasks of a round where there are few.
    """
    n = links.count()
    most = 2 * n  # rows of both, and nodes
    links = gathered(links, n)
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct()
    both = materialise(gathered(both, most))
    least = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least"))
    roots = materialise(gathered(least, most).select("node", F.least("node", "least").alias("root")))
    while True:
        theirs = looked_up(roots.select(F.col("node").alias("y"), F.col("root").alias("theirs")), most)
        near = gathered(both.join(theirs, "y").groupBy(F.col("x").alias("node")).agg(F.min("theirs").alias("theirs")), most)
        met = roots.join(looked_up(near, most), "node").select("node", "root", F.least("root", "theirs").alias("lower"))
        # a root follows the least root that any of its nodes has met
        hooks = gathered(met.groupBy(F.col("root").alias("node")).agg(F.min("lower").alias("hook")), most)
        hooked = materialise(met.join(looked_up(hooks, most), "node", "left").select("node", F.col("root").alias("old"), F.least("lower", F.coalesce("hook", "lower")).alias("next")))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("after"))
        moved = hooked.join(looked_up(jump, most), "next", "left").select("node", "old", F.least("next", F.coalesce("after", "next")).alias("root"))
        moved = materialise(gathered(moved.repartition("node"), most))  # not left lying by root
        changed = moved.where("old <> root").limit(1).count()
        roots = moved.select("node", "root")
        if not changed:
            return roots

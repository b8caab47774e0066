"""The first rows of a table, or of each of its groups, in the order of a hash; however many they are.

Where a group's last chosen row lies is found by refining a histogram: rows are counted by the
next three digits of the hash, the digits in which the quota is met become the prefix, and so
on until few rows share it. Only those few are ranked. The chosen rows are then df under a
filter by the last one's place, in their own partitions: nothing but counts is shuffled, and
no task sorts a quota, be it a fraction of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpointed

#: Digits of a round (16^3 counts for each group), most rounds, and rows of a group that are ranked.
DIGITS, ROUNDS, RANKED = 3, 10, 20_000


def _same(a: DataFrame, b: DataFrame, groups: Sequence[str]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & a[g].eqNullSafe(b[f"__{g}"])
    return out


def _share(order: Column, prefix: Column) -> Column:
    return F.substring(order, F.lit(1), F.length(prefix))


def last_places(rows: DataFrame, groups: Sequence[str], quotas: DataFrame, ranked: int | None = None) -> DataFrame:
    """For each group (columns __<group>): __order and __id of the last chosen row, and how many rows with just these are chosen (__take) of how many (__ties).

    ``rows`` has __order (hexadecimal digits) and __id; ``quotas`` has the groups, __quota (0
    or more, at most the group's rows) and __n.
    """
    ranked = RANKED if ranked is None else ranked
    own = [f"__{g}" for g in groups]
    state = quotas.where("__quota > 0").select(*[F.col(g).alias(f"__{g}") for g in groups], F.lit("").alias("__prefix"), F.col("__quota").cast("long").alias("__need"), F.col("__n").cast("long").alias("__in"))
    state = checkpointed(state)
    for turn in range(ROUNDS):
        wide = state.where((F.col("__in") > ranked) & (F.length("__prefix") == DIGITS * turn))
        if not wide.limit(1).count():
            break
        met = rows.join(broadcast_if_small(wide), _same(rows, wide, groups) & (_share(rows["__order"], wide["__prefix"]) == wide["__prefix"]))
        digits = F.substring(met["__order"], DIGITS * turn + 1, DIGITS).alias("__digits")
        counts = met.groupBy(*own, "__prefix", "__need", digits).agg(F.count(F.lit(1)).alias("__c"))
        upto = F.sum("__c").over(Window.partitionBy(*own).orderBy("__digits"))  # 16^3 rows of a group at most
        found = counts.withColumn("__upto", upto).where((F.col("__upto") >= F.col("__need")) & (F.col("__upto") - F.col("__c") < F.col("__need")))
        found = found.select(*own, F.concat("__prefix", "__digits").alias("__prefix"), (F.col("__need") - F.col("__upto") + F.col("__c")).alias("__need"), F.col("__c").alias("__in"))
        rest = state.where((F.col("__in") <= ranked) | (F.length("__prefix") != DIGITS * turn))
        state = checkpointed(rest.unionByName(found))
    met = rows.join(broadcast_if_small(state), _same(rows, state, groups) & (_share(rows["__order"], state["__prefix"]) == state["__prefix"]))
    each = met.groupBy(*own, "__need", "__order", "__id").agg(F.count(F.lit(1)).alias("__ties"))  # rows of one id are one here
    upto = F.sum("__ties").over(Window.partitionBy(*own).orderBy("__order", "__id"))
    last = each.withColumn("__upto", upto).where((F.col("__upto") >= F.col("__need")) & (F.col("__upto") - F.col("__ties") < F.col("__need")))
    return last.select(*own, F.col("__order").alias("__last"), F.col("__id").alias("__last_id"), "__ties", (F.col("__need") - F.col("__upto") + F.col("__ties")).alias("__take"))


def first_in_groups(df: DataFrame, groups: Sequence[str], quotas: DataFrame, order: Column, id_col: str, ranked: int | None = None) -> DataFrame:
    """The first __quota rows of each group by ``order`` (hexadecimal digits) and id; ``quotas`` has the groups, __quota and __n.

    df is read several times, so it should be a table or a checkpoint. Where an id repeats
    beyond a quota, the rows that files hold first are taken; they are numbered by file.
    """
    from .sampling import with_row_ids

    rows = df.withColumn("__order", order).withColumn("__id", F.col(id_col))
    last = checkpointed(last_places(rows, groups, quotas, ranked))
    place = (rows["__order"] < last["__last"]) | ((rows["__order"] == last["__last"]) & (rows["__id"] < last["__last_id"]))
    edge = (rows["__order"] == last["__last"]) & (rows["__id"] == last["__last_id"])
    whole = last["__ties"] == last["__take"]
    chosen = rows.join(broadcast_if_small(last), _same(rows, last, groups) & (place | (edge & whole))).select(*[rows[c] for c in df.columns])
    parted = last.where("__ties > __take")
    if parted.limit(1).count():
        ties = df.withColumn("__order", order)
        ties = ties.join(broadcast_if_small(parted), _same(ties, parted, groups) & (ties["__order"] == parted["__last"]) & (ties[id_col] == parted["__last_id"]))
        ties = checkpointed(ties.select(*[ties[c] for c in df.columns], "__take", "__order"))
        keys = F.to_json(F.struct("__order", *groups))
        numbered = with_row_ids(ties, keys, out="__nth").where(F.substring_index("__nth", "-", -1).cast("long") < F.col("__take"))
        chosen = chosen.unionByName(numbered.select(*df.columns))
    return chosen


def first_rows(df: DataFrame, n: int, order: Column, id_col: str, total: int | None = None, ranked: int | None = None) -> DataFrame:
    """The first n rows by ``order`` (hexadecimal digits) and id; all of them when there are no more."""
    total = df.count() if total is None else total
    if n >= total:
        return df
    quotas = df.sparkSession.createDataFrame([(max(0, n), total)], "__quota bigint, __n bigint")
    return first_in_groups(df, [], quotas, order, id_col, ranked)

"""Batches under a budget of padded tokens.

Rows are classed by length, rounded up to a multiple of STEP, so that all rows of a class are
padded to much the same length, and a class's batches hold as many rows as the budget has
room for. Rows get their number in the class from a range sort by length and the counts of its
ranges (``with_event_ids``), so no class is sorted in one task, and the cost of a batch, rows
times padded length, never exceeds the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import with_event_ids

STEP = 8


def length_class(length: Column | str, step: int = STEP) -> Column:
    """The length rounded up to a multiple of ``step``, at least one of them."""
    n = F.col(length) if isinstance(length, str) else length
    return F.greatest(F.ceil(n / F.lit(step)), F.lit(1)) * F.lit(step)


def budget_batches(df: DataFrame, length: str, budget: int, *order: str, step: int = STEP) -> DataFrame:
    """df with padded_to (the class), batch (from 0 in its class) and place (from 0 in its batch).

    ``order`` breaks ties of equal lengths and should be unique. A row longer than the budget
    is a batch of its own. A null length counts as 0.
    """
    classed = df.withColumn("padded_to", length_class(F.coalesce(F.col(length), F.lit(0)), step).cast("long"))
    numbered = with_event_ids(classed, "padded_to", F.coalesce(F.col(length), F.lit(0)), *order, out="__nth")
    rows = F.greatest(F.lit(budget).cast("long"), F.col("padded_to"))
    per_batch = F.floor(rows / F.col("padded_to"))
    return numbered.select(*df.columns, "padded_to", F.floor(F.col("__nth") / per_batch).alias("batch"), (F.col("__nth") % per_batch).alias("place"))

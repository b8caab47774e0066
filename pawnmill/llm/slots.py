"""A bit map of hash slots, 2 MiB whatever the corpus: tells which rows may be wanted.

It never loses a wanted row. On a corpus that fills all slots it lets every row pass, and the
join behind it does the work alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def slot_map(hashes: DataFrame) -> np.ndarray:
    """Bit map, as 64-bit words, of the slots of column ``h`` (64-bit hashes)."""
    slot = F.pmod(F.col("h"), F.lit(1 << BITS)).cast("int")
    words = hashes.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits"))
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    found = words.toPandas()  # at most 2^(BITS - 6) rows
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def in_slots(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these 64-bit hashes fall into a marked slot."""
    slot = hashes & ((1 << BITS) - 1)
    return (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1

"""Statistics of whole texts for the quality rules, one vector for each text."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType

from .common import parts, sole_cache

NAMES = (
    "log_chars",
    "log_words",
    "mean_word",
    "longest_word",
    "upper_share",
    "digit_share",
    "symbol_share",
    "bang_share",
    "pipe_share",
    "stop_share",
    "comma_share",
    "nonascii_share",
    "distinct_words",
    "same_as_last",
    "capital_words",
    "odd_endings",
    "words_per_line",
    "repeated_lines",
    "lower_start",
)
_UPPER, _LOWER, _DIGIT = (np.array([chr(i) in s for i in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
_SYMBOL = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".,;:'\"!?|-()" for i in range(256)])


def text_stats(text: str | None) -> list[float]:
    """The statistics named in NAMES; all 0 for an empty or null text."""
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size, words = len(raw), text.split()
    n = max(1, len(words))
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    lines = text.split("\n")
    odd = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?\"')")
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        len(text) / n,
        float(max(map(len, words), default=0)),
        upper / max(1, upper + lower),
        int(counts[_DIGIT].sum()) / size,
        int(counts[_SYMBOL].sum()) / size,
        int(counts[ord("!")]) / n,
        int(counts[ord("|")]) / n,
        int(counts[ord(".")]) / n,
        int(counts[ord(",")]) / n,
        int(counts[128:].sum()) / size,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        odd / n,
        len(words) / len(lines),
        1 - len(set(lines)) / len(lines),
        float(text[0].islower()),
    ]


def with_stats(df: DataFrame, text: str | None = None) -> DataFrame:
    """df's first column and a double column for each statistic of its text.

    The text is df's second column or, if ``text`` is given, that field of the first, a struct.
    """
    first = df.schema.fields[0]
    schema = StructType([first])
    for n in NAMES:
        schema = schema.add(n, DoubleType())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("statistics", lambda: None)
        for batch in batches:
            own = batch.column(0)
            texts = batch.column(1) if text is None else own.field(own.type.get_field_index(text))
            for part in parts(pa.RecordBatch.from_arrays([own, texts], names=["own", "text"])):
                table = np.array([text_stats(t) for t in part.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(NAMES)))], names=[first.name, *NAMES])

    return df.mapInArrow(measure, schema)

"""Column functions on arrays of scores and tokens; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

NEGATIVE_INFINITY = float("-inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def log_softmax(a: Column | str) -> Column:
    """x - (max + ln sum exp(x - max)) for every x."""
    doubles = F.transform(col(a), lambda v: v.cast("double"))
    norm = lambda x, top: top + F.ln(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
    return let(doubles, lambda x: let(let(F.array_max(x), lambda top: norm(x, top)), lambda n: F.transform(x, lambda v: v - n)))


def mask_scores(scores: Column | str, allowed: Column | str) -> Column:
    """Scores with -inf outside the allowed positions (0-based)."""
    return F.transform(col(scores), lambda x, i: F.when(F.array_contains(col(allowed), i), x.cast("double")).otherwise(F.lit(NEGATIVE_INFINITY)))


def argmax(scores: Column | str) -> Column:
    """0-based place of the largest score, the first of equal ones."""
    return (F.array_position(col(scores), F.array_max(col(scores))) - 1).cast("int")


def masked_argmax(scores: Column | str, allowed: Column | str) -> Column:
    """argmax over the allowed places; null when none is allowed (the game is over)."""
    return F.when(F.size(col(allowed)) > 0, let(mask_scores(scores, allowed), argmax))


def top_k(logprobs: Column | str, k: int, labels: Column | None = None) -> Column:
    """The k largest as (move or id, logprob), descending, lower places first among equals."""
    pairs = F.transform(col(logprobs), lambda x, i: F.struct((-x).alias("down"), i.alias("id")))
    best = F.slice(F.array_sort(pairs), 1, max(k, 0)) if k > 0 else F.slice(pairs, 1, 0)
    if labels is None:
        return F.transform(best, lambda p: F.struct(p["id"].alias("id"), (-p["down"]).alias("logprob")))
    return F.transform(best, lambda p: F.struct(F.get(labels, p["id"]).alias("move"), (-p["down"]).alias("logprob")))


def sample_index(logits: Column | str, temperature: float, k: int, *seed: Column) -> Column:
    """Greedy when temperature <= 0; else a draw from the (top-k) softmax by hashed Gumbel noise.

    The noise is a hash of the seed columns and the place, so a row always draws the same.
    """
    x = F.transform(col(logits), lambda v: v.cast("double"))
    if temperature <= 0:
        return argmax(x)
    if k > 0:
        least = lambda y: F.element_at(F.sort_array(y, asc=False), F.least(F.lit(k), F.size(y)))
        x = let(x, lambda y: let(least(y), lambda low: F.transform(y, lambda v: F.when(v >= low, v).otherwise(F.lit(NEGATIVE_INFINITY)))))
    uniform = lambda i: (F.shiftrightunsigned(F.xxhash64(*seed, i), 11).cast("double") + 0.5) / float(1 << 53)
    return argmax(F.transform(x, lambda v, i: v / F.lit(float(temperature)) - F.ln(-F.ln(uniform(i)))))


def pick_logprobs(rows: Column | str, ids: Column | str) -> Column:
    """From rows of logprobs for places 0..n-2, the logprob of the id that follows each."""
    return F.transform(F.slice(col(ids), 2, F.greatest(F.size(col(ids)) - 1, F.lit(0))), lambda t, i: F.get(F.get(col(rows), i), t))


def ones_like(a: Column | str) -> Column:
    return F.transform(col(a), lambda _: F.lit(1))


def labels_of(padded: Column | str, value: int = 0, ignored: int = -100) -> Column:
    """Training labels of padded ids: the ids themselves, padding ignored."""
    return F.transform(col(padded), lambda x: F.when(x == value, F.lit(ignored)).otherwise(x))


def pad_to(a: Column | str, size: Column | int, value: int = 0) -> Column:
    n = F.lit(size) if isinstance(size, int) else size
    return F.concat(col(a), F.array_repeat(F.lit(value), F.greatest(n - F.size(col(a)), F.lit(0)).cast("int")))

"""Column functions: safe conversion, buckets, lookups, phases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_int(c: Column | str) -> Column:
    """Whole number, or null where the text is none."""
    return col(c).try_cast("int")


def map_default(c: Column | str, values: Mapping[str, object], default: object = None) -> Column:
    """Lookup in a fixed map; default for absent and null keys."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.when(col(c).isNotNull(), F.element_at(F.create_map(*pairs), col(c)))
    return found if default is None else F.coalesce(found, F.lit(default))


def bucketize(c: Column | str, bounds: Sequence[tuple[float, str]], top: str, unknown: str | None = None) -> Column:
    """Label of the first bound above the value; ``unknown`` for null."""
    value = col(c)
    chain = reduce(lambda acc, b: acc.when(value < b[0], b[1]), bounds[1:], F.when(value < bounds[0][0], bounds[0][1])).otherwise(top)
    return chain if unknown is None else F.when(value.isNull(), unknown).otherwise(chain)


def floor_mean(a: Column | str, b: Column | str) -> Column:
    return F.floor((col(a) + col(b)) / F.lit(2))


def elo_bucket(white: Column | str, black: Column | str) -> Column:
    """Bucket of the mean rating; ``unknown`` when either rating is no number."""
    return bucketize(floor_mean(safe_int(white), safe_int(black)), C.ELO_BUCKETS, C.TOP_ELO_BUCKET, C.UNKNOWN_ELO)


def opening_family(first_move: Column | str) -> Column:
    return map_default(first_move, C.OPENINGS, C.OTHER_OPENING)


def outcome(result: Column | str) -> Column:
    """white, black or draw; null for anything else."""
    return map_default(result, C.OUTCOMES)


def termination_type(result: Column | str) -> Column:
    return F.when(col(result) == "1/2-1/2", "draw").otherwise("decisive")


def phase(ply: Column | str, bounds: tuple[int, int] = C.PHASE_BOUNDS) -> Column:
    return F.when(col(ply) < bounds[0], C.PHASES[0]).when(col(ply) < bounds[1], C.PHASES[1]).otherwise(C.PHASES[2])


def color_for_game(mode: str, index: Column | str) -> Column:
    """The model's side: fixed, or alternating from white on."""
    return F.when(col(index) % 2 == 0, "white").otherwise("black") if mode == "alternate" else F.lit(mode)


def side_for_turn(white_to_move: Column | str) -> Column:
    return F.when(col(white_to_move), "white").otherwise("black")


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def split_words(c: Column | str, space: str = r"\s+") -> Column:
    """Words between runs of white space; none for an empty text."""
    return F.filter(F.split(col(c), space), lambda w: w != "")


def hash_order(seed: object, *keys: Column | str) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(col(k).cast("string") for k in keys)))


def game_id(index: Column | str) -> Column:
    return F.format_string("game-%04d", col(index))


def position_id(game: Column | str, ply: Column | str) -> Column:
    return F.format_string("%s:ply%d", col(game), col(ply))


def time_control(event: Column | str) -> Column:
    """The kind of game that an event's name tells: bullet, blitz, rapid, classical, correspondence, else other."""
    name = F.lower(col(event))
    chain = reduce(lambda acc, kind: acc.when(F.contains(name, F.lit(kind)), kind), C.TIME_CONTROLS[1:], F.when(F.contains(name, F.lit(C.TIME_CONTROLS[0])), C.TIME_CONTROLS[0]))
    return chain.otherwise("other")


def game_length(plies: Column | str) -> Column:
    """short, middle or long, by the plies at which the phases begin."""
    return bucketize(plies, [(C.PHASE_BOUNDS[0], "short"), (C.PHASE_BOUNDS[1], "middle")], "long", "unknown")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

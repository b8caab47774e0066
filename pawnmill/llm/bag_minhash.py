"""BagMinHash signatures of weighted sets, many sets at a time.

Element d with weight w covers [0, w) of its own line. The line is discretised into dyadic
levels [0,1), [1,2), [2,4), [4,8), ...; each level carries a Poisson process over time whose
rate is its length, seeded by (d, level), each point with a random component of the
signature and a random place in the level. A set sees the points whose place lies below its
weight, and keeps the earliest time for each component. Two sets then agree in a component
with probability sum(min) / sum(max), the weighted Jaccard similarity, without bias. A
weight of w costs about log w processes, and a process is followed only until it is later
than every component of its set.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    h = h + _STEP
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, m: int) -> np.ndarray:
    """sets x m earliest times; inf throughout for a set without elements."""
    sig = np.full(sets * m, np.inf)
    if not len(owner):
        return sig.reshape(sets, m)
    levels = np.frexp(weight.astype(np.float64) - 0.5)[1].clip(0) + 1  # levels that [0, weight) meets
    at = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    begin = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    length = np.where(level == 0, 1.0, begin)
    own = owner[at].astype(np.int64)
    reach = (weight[at] - begin) / length  # the share of the level that is covered
    with np.errstate(over="ignore"):
        state = mix(element[at] ^ mix(level.astype(np.uint64)))
        scale = 1.0 / (length * m)
        time = np.zeros(len(at))
        while len(own):
            state = mix(state)
            time = time - np.log(_unit(state)) * scale
            other = mix(state ^ _M1)
            component = ((other >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
            seen = (other & np.uint64(0xFFFFFFFFFF)).astype(np.float64) * 2.0**-40 < reach
            np.minimum.at(sig, (own * m + component)[seen], time[seen])
            latest = sig.reshape(sets, m).max(axis=1)
            go = time < latest[own]
            own, state, time, scale, reach = own[go], state[go], time[go], scale[go], reach[go]
    return sig.reshape(sets, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """sets x bands 64-bit keys of ``rows`` components each."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.zeros(bits.shape[:2], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key ^ bits[:, :, r])
    return key.view(np.int64)

"""Word shingles of whole texts as multisets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .bag_minhash import mix
from .common import sole_cache

WORDS = 5
#: Word hashes that a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 200_000
_cache: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    sole_cache("words", _cache.clear)
    words = text.lower().split()
    missing = [w for w in words if w not in _cache]
    if missing:
        if len(_cache) + len(missing) > CACHE_WORDS:
            _cache.clear()
            missing = words
        for w in missing:
            if w not in _cache:
                _cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_cache.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_bag(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts; a shorter text is one shingle, an empty one none."""
    h = word_hashes(text or "")
    n = len(h)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = min(words, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = mix(out ^ h[k : n - width + 1 + k])
    return np.unique(out, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 1 for two empty ones."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    common = int(np.minimum(a[1][at[both]], b[1][both]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 1.0

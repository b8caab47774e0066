from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, more=""):
    """rows: (doc_id, text, source, ...); lang and n_chars are filled in."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *r[3:]) for r in rows]
    return spark.createDataFrame(full, DOCS + more)


def words(n, seed, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prose(n, seed):
    return " ".join(words(n, seed))

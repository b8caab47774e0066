from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pawnmill.llm import packing as P
from pawnmill.llm.tokens import WordCachedTokenizer, default_path
from tests.llm.helpers import docs, prose


def sequential_best_fit(lengths, capacity):
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def packed(rows, capacity):
    """Sequences (offset, length) of (tag, length, sequence, offset) rows, which must be gapless."""
    out = defaultdict(list)
    for _, length, sequence, offset in rows:
        out[sequence].append((offset, length))
    for v in out.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return out


def pack(spark, lengths, capacity, range_rows=P.RANGE_ROWS):
    items = spark.createDataFrame(list(enumerate(lengths)), "tag bigint, length int")
    rows = items.join(P.place(items, capacity, range_rows), "tag").select("tag", "length", "sequence_id", "offset").collect()
    assert sorted(r[:2] for r in map(tuple, rows)) == list(enumerate(lengths))
    return packed(map(tuple, rows), capacity)


@pytest.mark.parametrize("seed", range(6))
def test_a_sweep_equals_sequential_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 50, 128])
    free = [rng.randint(1, capacity) for _ in range(rng.choice([0, 5, 60]))]
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 40, 300]))]
    gaps, pieces = P.Gaps(), {n: np.array([k for k, x in enumerate(lengths) if x == n]) for n in set(lengths)}
    for size in set(free):
        gaps.add(size, np.array([k for k, x in enumerate(free) if x == size]))
    found = [(int(s), n) for n, _, sequences, _ in P.best_fit(pieces, gaps, capacity) for s in sequences]
    left, unplaced = sorted(free), []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in left if g >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            unplaced.append(n)
    assert sorted(n for n, names in pieces.items() for _ in names) == sorted(unplaced)
    assert sorted(n for n, lots in gaps.by_size.items() for lot in lots for _ in lot) == sorted(g for g in left if g)
    room = Counter()
    for s, n in found:
        room[s] += n
    assert all(room[s] <= free[s] for s in room)


def test_claims_match_as_brackets():
    assert P.claims({0: (3, 9), 1: (1, 7)}, {1: (0, 1), 2: (2, 6), 3: (5, 5)}) == [(1, 0, 1, 2), (0, 0, 1, 2), (0, 1, 3, 3)]
    assert P.claims({0: (3, 9)}, {1: (5, 2), 2: (9, 2)}) == [(0, 0, 2, 1), (0, 2, 3, 2)]  # four pieces to a gap at least
    assert P.claims({2: (4, 5)}, {0: (3, 9), 2: (1, 5)}) == [] and P.claims({}, {}) == []


@pytest.mark.parametrize(("range_rows", "seed"), [(10**6, 1), (25, 2), (7, 3)])
def test_rounds(spark, range_rows, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([64, 64, rng.randint(1, 64), rng.randint(1, 12)]) for _ in range(160)]
    sequences = pack(spark, lengths, 64, range_rows)
    assert -(-sum(lengths) // 64) <= len(sequences) <= sequential_best_fit(lengths, 64) + (range_rows < 100)
    assert sorted(sequences) == list(range(len(sequences)))


def test_equal_lengths_and_nothing(spark):
    assert len(pack(spark, [3] * 50, 10, 8)) == 17 and len(pack(spark, [10] * 5, 10)) == 5
    assert P.place(spark.createDataFrame([], "tag bigint, length int")).count() == 0


def test_tokens_equal_the_library():
    w = WordCachedTokenizer(default_path(), cache_words=50)
    rng = random.Random(5)
    parts = ["a", "B", "É", "İ", "Σ", "ß", "ſ", "1", "²", ".", ",", "!!", "'s", "don't", " ", "\n", "\t", "\x1c", "\x01", "é", "Å", "😀", "語", "<|endoftext|>", "***", "_", "-", " ", "\u0085", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", "x" * 5000]
    got = []
    for k in range(0, len(texts), 100):
        got += w.encode_batch(texts[k : k + 100])
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_documents(spark):
    rows = [(k, prose(5 + 37 * k % 900, k)) for k in range(60)] + [(100, prose(5000, 7)), (101, None), (102, ""), (5, "twice"), (5, "twice"), (None, "no id")]
    found = P.pack_documents(docs(spark, [(*r, "s", 0) for r in rows], ", offset int"), capacity=512).collect()
    w = WordCachedTokenizer(default_path())
    want = Counter()
    for i, t in rows:
        raw = w.encode_batch([t or ""])[0] + (1).to_bytes(4, "little")
        for k in range(0, len(raw), 4 * 512):
            chunk = raw[k : k + 4 * 512]
            want[i, k // 2048, k // 4, len(chunk) // 4, zlib.crc32(chunk)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= -(-sum(r["length"] for r in found) // 512) + 2
    assert P.pack_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("least_rows", [60, 1000])
def test_whole_table_over_several_ranges(spark, monkeypatch, least_rows):
    """At full capacity, by ranges from parallelism: gapless, and the fewest sequences or one more."""
    rng = random.Random(9)
    lengths = [min(4096, int(rng.lognormvariate(6, 1.4)) + 1) for _ in range(2500)]
    items = spark.createDataFrame(list(enumerate(lengths)), "tag bigint, length int")
    monkeypatch.setattr(P, "PARTITIONS_A_RANGE", 1)
    places = P.place(items, 4096, P.RANGE_ROWS, least_rows)
    rows = items.join(places, "tag").select("tag", "length", "sequence_id", "offset").collect()
    assert sorted(r[:2] for r in map(tuple, rows)) == list(enumerate(lengths))
    assert len(packed(map(tuple, rows), 4096)) <= max(-(-sum(lengths) // 4096), sum(2 * n > 4096 for n in lengths)) + 1


def test_ranges_that_claim_are_marked_without_a_join(spark, monkeypatch):
    """Only gaps are joined, with the claims on them; pieces, all of which each round reads, are not."""
    plans = []

    def watched(rows, capacity, dealt, plain=P.sweep):
        if dealt:
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return plain(rows, capacity, dealt)

    monkeypatch.setattr(P, "sweep", watched)
    items = spark.range(1200).selectExpr("id AS tag", "1 + (id * 7919) % 4096 AS length")
    placed = P.place(items, range_rows=300, least_rows=100)
    assert placed.count() == placed.select("tag").distinct().count() == 1200
    assert plans and all(plan.count("Join") == 1 for plan in plans)

"""Every operator and every stage over one awkward table, and over an empty one."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from pawnmill.llm import exact_dedup, fingerprint, line_dedup, mixing, near_dedup, packing, pii, quality, sharding, url_filter
from tests.llm.helpers import DOCS, prose

#: Names that operators use for columns of their own, and odd ones.
CLASHES = ("row", "id", "mark", "its", "slot", "block", "key", "size", "bands", "rep", "label", "of", "at", "kind", "name", "tag", "score", "predicted", "log_chars", "kept", "keep_id", "class_id", "text_sha256",
           "fingerprint", "range", "shard", "drawn", "bucket", "spans", "removed", "start", "hash", "n", "taken", "target", "piece", "offset", "__suffix", "__score", "__copy", "__key", "__text", "__label", "a.b", "a`b", "with space")
NEAR = " ".join([*prose(100, 1).split()[:-1], "edit"])
ROWS = [
    (1, prose(100, 1), "en", "a", 5), (2, NEAR, None, "b", None), (3, prose(100, 1).replace(" ", "\n", 1), "en", None, 0), (4, None, None, None, None), (5, "", "", "", 0), (6, " \n\t", "x", "a", 3),
    (7, prose(40, 2), "en", "a", 1), (7, prose(40, 3), "en", "a", 1), (7, prose(40, 3), "en", "a", 1), (None, prose(40, 4), "en", "b", 1), (None, prose(40, 4), "en", "b", 1), (None, prose(40, 5), None, "b", 1),
    (None, None, None, None, None), (8, "long " * 30_000 + prose(30_000, 6), "en", "a", 1), (9, "x" * 200_000, "en", "a", 1), (-3, "Ünï😀 côde ﬁ \u0000 ퟿", "de", "é", 1), (2**62, prose(3, 7), "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, *[k] * len(CLASHES)) for k, r in enumerate(ROWS)]
    names = DOCS + "".join(f", `{c.replace('`', '``')}` int" for c in CLASHES)
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def marked(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 1, 0), (9, 0, 0), (9, None, 0), (None, 1, 0), (5, 0, None)], "doc_id bigint, quality int, toxic int")


EACH = {
    "pii": pii.find_personal_data, "exact": exact_dedup.duplicate_groups, "near": near_dedup.near_classes, "fingerprint": fingerprint.edited_fingerprints, "lines": line_dedup.dedup_lines,
    "mixing": mixing.mix_sources, "sharding": sharding.shard_documents, "urls": lambda df: url_filter.judge_urls(df, id_col="doc_id", url_col="text"),
}


@pytest.mark.parametrize("name", sorted(EACH))
def test_a_row_for_each_row(odd, name):
    found = EACH[name](odd).collect()
    assert len(found) == len(ROWS)
    ids = sorted(repr(r["doc_id" if name != "urls" else "page_id"]) for r in found)
    assert ids == sorted(repr(r[0]) for r in ROWS)
    assert EACH[name](odd.limit(0)).count() == 0


def test_quality_and_packing(odd, marked):
    scores = quality.score_quality(odd, marked).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    pieces = packing.pack_documents(odd).collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(ROWS) and max(r["length"] for r in pieces) == 4096


def test_stages_pass_all_columns_through(spark, odd, marked, tmp_path):
    marked.write.parquet(f"{tmp_path}/labels.parquet")
    df, counts = odd, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns and out.schema == odd.schema
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(out.count())
        df = out
    assert counts[0] <= len(ROWS) and counts[1] <= counts[0] and counts[2] <= counts[1]


def test_stages_alone_on_the_odd_table(spark, odd):
    exact = sorted((repr(r["doc_id"]), r["text"] or "") for r in exact_dedup.drop_duplicates(odd).select("doc_id", "text").collect())
    empty = [x for x in exact if not x[1].strip()]
    assert len(exact) == len(ROWS) - 5 and len(empty) == 2  # null and "" are one text, " \n\t" is one space; repeats of 7, null and 1 go
    near = {(repr(r["doc_id"]), r["text"]) for r in near_dedup.drop_near_duplicates(odd).select("doc_id", "text").collect()}
    assert ("2", NEAR) not in near and ("1", ROWS[0][1]) in near and ("7", ROWS[6][1]) in near and ("7", ROWS[7][1]) in near and ("None", ROWS[11][1]) in near
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_packing_at_full_capacity(spark):
    """Gapless, and at most one sequence above what the tokens need."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in rows) // 4096) + 1

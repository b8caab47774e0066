from __future__ import annotations

import corpus_pipeline
from tests.llm.helpers import docs, prose


def test_stages(spark, tmp_path):
    rows = [(k, prose(80, k), ["a", "b", None][k % 3]) for k in range(60)]
    rows += [(100 + k, rows[k][1], "a") for k in range(10)]  # copies
    rows += [(200 + k, rows[20 + k][1].rsplit(" ", 1)[0] + " changed", "b") for k in range(10)]  # near copies
    rows += [(300 + k, prose(80, 300 + k).upper().replace(" ", "!! "), "a") for k in range(30)]  # junk
    rows += [(400, None, "a"), (401, "", "b")]
    folder = str(tmp_path)
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if r[0] >= 300 else 1, 0) for r in rows if r[0] < 400], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mixing", "best-fit packing"]
    df, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, folder)
        if k < 4:
            assert out.columns == df.columns
        out.write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        seen.append({r["doc_id"] for r in df.select("doc_id").collect()})
    good = {r[0] for r in rows if r[0] < 300}
    assert seen[0] & set(range(300)) == good and not seen[0] & set(range(300, 330))
    assert seen[1] & set(range(300)) == good - set(range(100, 110))
    assert seen[2] & set(range(300)) == good - set(range(100, 110)) - set(range(200, 210))
    assert seen[4] == seen[3] <= seen[2]
    ran = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in ran.collect()} == seen[4]


def test_empty(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

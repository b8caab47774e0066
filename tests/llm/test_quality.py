from __future__ import annotations

import zlib

import numpy as np

from pawnmill.llm import quality as Q
from pawnmill.llm.text_stats import NAMES, text_stats
from tests.llm.helpers import docs, prose

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=400):
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = prose(60 + k % 40, k)
        if bad:
            text = [text.upper().replace(" ", "!! "), " | ".join(text.split()), "same " * 80][k // 4 % 3]
        rows.append((k, text))
        labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_columns_equal_numpy(spark):
    rows, labels = corpus()
    df, lab = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    found = Q.score_quality(df, lab).collect()
    truth = {i: q for i, q, _ in labels}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    model = Q.fit_on_labels(df, lab)
    want = dict(zip((i for i, _ in rows), model.score(np.array([text_stats(t) for _, t in rows]))))
    assert all(abs(want[r["doc_id"]] - r["score"]) < 1e-9 for r in found)
    assert 0 < len(model.rules) < 200
    assert all(len(rule.tests) <= Q.DEPTH for rule, _ in model.rules)


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(120)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    score = lambda lab: {r["doc_id"]: r["score"] for r in Q.score_quality(docs(spark, rows), spark.createDataFrame(lab, LABELS)).collect()}
    assert score(labels) == score(flipped)


def test_weights_are_optimal():
    """The lasso's conditions at its solution, computed apart from the solver."""
    rng = np.random.default_rng(3)
    r = (rng.random((400, 12)) < rng.uniform(0.1, 0.9, 12)).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1] + r[:, 2])))).astype(float)
    penalty = 0.01
    b, w = Q._lasso(r, y, penalty, 4000)
    scale = np.maximum(r.std(0), 0.02)
    error = 1 / (1 + np.exp(-(b + r @ w))) - y
    slope = ((r - r.mean(0)) / scale).T @ error / len(y)
    own = w * scale
    assert abs(error.mean()) < 1e-4 and (own == 0).any() and (own != 0).sum() >= 3
    assert np.all(np.abs(slope[own == 0]) <= penalty + 1e-4)
    assert np.allclose(slope[own != 0], -penalty * np.sign(own[own != 0]), atol=1e-4)


def auc(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = truth.sum()
    return (rank[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_against_an_independent_model():
    """Held out, on noisy statistics with an interaction, not below naive Bayes with normal densities."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, len(NAMES)))
    z = 1.5 * (x[:, 0] > 0.3) - 1.2 * (x[:, 1] > 0) * (x[:, 2] > 0) + 0.8 * x[:, 3] - 0.2
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * z))).astype(int)
    train, test = np.arange(3000) < 2000, np.arange(3000) >= 2000
    mean, sd = ([f(x[train & (y == k)], 0) for k in (0, 1)] for f in (np.mean, np.std))
    bayes = sum((-np.log(sd[k]) - (x[test] - mean[k]) ** 2 / 2 / sd[k] ** 2).sum(1) * (1 if k else -1) for k in (0, 1))
    model = Q.fit_rules(x[train], y[train])
    assert auc(model.score(x[test]), y[test]) >= max(0.8, auc(bayes, y[test]) - 0.005)
    # a rule's meaning, read from its tests
    rule, row = model.rules[0][0], x[5]
    assert rule.holds(x[5:6])[0] == all((row[k] > bound) if above else (row[k] <= bound) for k, above, bound in rule.tests)


def test_clashing_names_and_repeated_labelled_ids(spark):
    rows, labels = corpus(80)
    names = ", log_chars int, __label int, __text string, row string, `a.b` int"
    df = docs(spark, [(*r, "s", 1, 2, "t", "r", 3) for r in rows + [rows[6]] * 50], names)
    kept = Q.keep_good(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {i for i, q, _ in labels if q} and ids.count(6) == 51
    few = Q.fit_on_labels(df, spark.createDataFrame(labels, LABELS), sample=30)
    assert few.score(np.zeros((1, len(NAMES)))).shape == (1,)


def test_odd_inputs(spark):
    rows, labels = corpus(80)
    rows += [(900, None), (901, ""), (902, "word " * 100_000), (None, "no id"), (5, "again")]
    labels += [(900, None, 0), (None, 1, 0), (1, 0, 0)]
    df = docs(spark, [(*r, "s", 0) for r in rows], ", score int")
    found = Q.score_quality(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    empty = [r["score"] for r in found if r["doc_id"] in (900, 901)]
    assert empty[0] == empty[1]
    assert {r["score"] for r in Q.score_quality(df, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    one = Q.score_quality(df, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)).collect()
    assert len({r["score"] for r in one}) == 1
    kept = Q.keep_good(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    assert Q.score_quality(docs(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_statistics():
    assert len(text_stats("a b")) == len(NAMES) and text_stats(None) == text_stats("") == [0.0] * len(NAMES)


def test_repeated_labelled_rows_are_never_all_lost(spark):
    """Two labelled ids, each in far more rows than the sample has room for."""
    good, bad = prose(120, 1), "!!! ### $$$ " * 40
    df = spark.range(6002).selectExpr("CAST(id % 2 + 1 AS BIGINT) AS doc_id").selectExpr("doc_id", f"IF(doc_id = 1, '{good}', '{bad}') AS text")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    assert not any(r[0] for r in labels.select(Q.held_out()).collect())
    scores = {r["doc_id"]: r["score"] for r in Q.score_quality(df, labels, sample=2000).dropDuplicates(["doc_id"]).collect()}
    assert scores[1] > 0.95 and scores[2] < 0.05


def test_counts_shrink_in_proportion():
    assert Q.shrunk(np.array([3.0, 1.0]), 10).tolist() == [3, 1]
    assert Q.shrunk(np.array([1e9, 3e9, 1.0]), 100).tolist() == [24, 74, 1] or Q.shrunk(np.array([1e9, 3e9, 1.0]), 100).sum() <= 200

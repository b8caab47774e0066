"""Quality classifier: a sparse rule ensemble.

Shallow boosted trees over text statistics are fitted to a bounded sample of labelled rows;
each path from a root becomes a rule, a conjunction of at most DEPTH comparisons; an L1
penalised logistic regression picks and weighs rules; the rules that stay are compiled into
one Spark column expression over the statistics.

Only the fit sees labels, and at most SAMPLE of them (those with the smallest hash of the
id); of the rows with such ids, those of equal label and statistics are counted together, at
most SAMPLE of these (with the smallest hash) are used, and their counts shrink in proportion
if they exceed SAMPLE. Scoring covers every row and whole text.

Defined results: null and empty texts have all statistics 0 and are scored like others; rows
whose label or id is null are not learned from; contradictory labels of an id are averaged
and rounded; rows that repeat a labelled id all have its label; with no labelled rows the score is 0.5, with one class alone that class's
smoothed share; an empty table gives no rows; repeated rows get equal scores; extra columns
are ignored by ``score_quality`` and passed through, whatever their names, by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, least_hashed, materialise, unpacked, whole_rows
from .text_stats import NAMES, with_stats
from .trees import Split, boost

#: Most labelled rows that a fit uses.
SAMPLE = 10_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY, STEPS = 24, 3, 0.3, 32, 5, 3e-4, 400
THRESHOLD, FOLDS = 0.3, 5


@dataclass(frozen=True)
class Rule:
    """All comparisons hold; each is (feature, is it above, bound)."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, bound in self.tests:
            out &= (x[:, k] > bound) == above
        return out

    def column(self, names: tuple[str, ...]) -> Column:
        out = None
        for k, above, bound in self.tests:
            test = F.col(names[k]) > F.lit(bound) if above else F.col(names[k]) <= F.lit(bound)
            out = test if out is None else out & test
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, names: tuple[str, ...] = NAMES) -> Column:
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(names), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def paths(node: Split, tests: tuple = ()) -> list[tuple]:
    """The tests on the way to each node below the root."""
    if node.feature < 0:
        return [tests] if tests else []
    below = [p for above, child in ((False, node.low), (True, node.high)) for p in paths(child, (*tests, (node.feature, above, node.bound)))]
    return ([tests] if tests else []) + below


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Logistic weights of the columns of r under an L1 penalty, by accelerated proximal steps."""
    n, m = r.shape
    mean, scale = r.mean(0), np.maximum(r.std(0), 0.02)
    x = (r - mean) / scale
    v, reach = np.ones(m) / max(1, m) ** 0.5, 1.0
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = x.T @ (x @ v)
        reach = np.linalg.norm(v)
        v /= max(reach, 1e-12)
    step = 1 / (0.25 * (reach / n + 1))
    b = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    w, w_last, b_last, t = np.zeros(m), np.zeros(m), b, 1.0
    for _ in range(steps):
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = (t - 1) / t_next
        wy, by = w + ahead * (w - w_last), b + ahead * (b - b_last)
        e = 1 / (1 + np.exp(-(x @ wy + by))) - y
        w_last, b_last, t = w, b, t_next
        w = wy - step * (x.T @ e) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = by - step * e.mean()
    return float(b - (w / scale * mean).sum()), w / scale


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A rule model of the rows of x; y is 0 or 1."""
    if not len(y):
        return RuleModel(0.0, ())
    p = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return RuleModel(prior, ())
    _, trees = boost(x, y, TREES, DEPTH, RATE, BINS, LEAST_ROWS, share=0.5)
    rules = dict.fromkeys(Rule(tests) for tree in trees for tests in paths(tree))
    kept, columns, seen = [], [], set()
    for rule in rules:
        holds = rule.holds(x)
        mark = holds.tobytes()
        if 0 < holds.sum() < len(y) and mark not in seen and (~holds).tobytes() not in seen:
            seen.add(mark)
            kept.append(rule)
            columns.append(holds)
    if not kept:
        return RuleModel(prior, ())
    intercept, weights = _lasso(np.stack(columns, axis=1).astype(np.float64), y.astype(np.float64))
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(kept, weights) if abs(w) > 1e-6))


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(col(id_col).cast("string").cast("binary")) % folds == 0


def fit_on_labels(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    usable = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull() & ~held_out(id_col))
    each = usable.groupBy(col(id_col).alias("id")).agg(F.round(F.avg(col(label_col).cast("double"))).alias("label"))
    chosen = least_hashed(each, sample, "id")  # the documented bound of the sample; also the bound of the broadcast
    texts = df.select(col(id_col).alias("of"), col(text_col).alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("of") == F.col("id")).select("label", "text")
    alike = with_stats(met).groupBy("label", *NAMES).agg(F.count(F.lit(1)).alias("rows"))  # so a cut by hash never drops all repeats at once
    rows = least_hashed(materialise(alike), sample, "label", *NAMES).toPandas()
    rows = rows.sort_values(list(rows.columns)).to_numpy(dtype=np.float64)
    rows = np.repeat(rows[:, :-1], shrunk(rows[:, -1], sample), axis=0)
    return fit_rules(rows[:, 1:], rows[:, 0].astype(int))


def shrunk(counts: np.ndarray, most: int) -> np.ndarray:
    """Counts as they are if they sum to ``most`` at most, else in proportion, each at least 1 (so below twice ``most`` for ``most`` counts or fewer)."""
    total = counts.sum()
    return (counts if total <= most else np.maximum(1, np.floor(counts * (most / total)))).astype(np.int64)


def score_quality(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of df."""
    model = fit_on_labels(df, labels, id_col, text_col, label_col, sample)
    stats = with_stats(df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")))
    return stats.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that are predicted good, with df's columns; no shuffle."""
    model = fit_on_labels(df, labels, id_col, text_col, label_col)
    stats = with_stats(df.select(whole_rows(df).alias("row")), text_col)
    return unpacked(stats.where(model.column() >= threshold), df)

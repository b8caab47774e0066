"""URL filter: rules first, then gradient-boosted trees on lexical features.

All features are DataFrame expressions; the trees are fitted in the driver on at most SAMPLE
labelled URLs (those with the smallest hash) and compiled into one column expression, so no
Python runs on executors. Labels come from a table of (url, blocked); where none is given,
the URLs that rules decide are the labelled ones.

Suffix statistics are the smoothed share of blocked URLs for each two-label host suffix of
the sample: at most SAMPLE rows, a fixed bound, and so broadcast. A labelled URL's own
statistic, on which the trees are fitted, leaves out the URLs of its fold, itself among them.
Each labelled URL is also fitted as if its host had never been seen, with the statistic of such
a host, so the lexical features are learned even where hosts alone would tell the labels apart.
``held_out_scores`` judges each fold of a label table by a model of the others; folds are URLs,
or whole suffixes.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is judged by the trees; a host fits a rule when it is the rule's or ends in a dot and the
rule's; the path must begin with the rule's, so an empty path fits none; with no labelled
URL, or labels of one class only, the verdict follows the smoothed share of that class;
contradictory labels of a URL are averaged and rounded; an empty table gives no rows; repeated rows get equal verdicts; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, least_hashed, materialise
from .trees import Split, boost

#: Most labelled URLs that a fit uses.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, SMOOTHING, FOLDS = 20, 3, 0.3, 32, 10, 20.0, 5
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
FEATURES = ("f_length", "f_depth", "f_digit_ratio", "f_entropy", "f_params", "f_host_length", "f_labels", "f_path_length", "f_hyphens", "f_escapes", "f_secure", "f_suffix")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host, path and the query's text (__query)."""
    after = F.when(F.instr(url_col, "://") > 0, F.substr(F.col(url_col), F.instr(url_col, "://") + 3)).otherwise(F.lit(""))
    return df.withColumn("__after", F.coalesce(after, F.lit(""))).withColumns(
        {
            "host": F.translate(F.regexp_extract("__after", r"^[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract("__after", r"^[^/?#]*([^?#]*)", 1),
            "__query": F.regexp_extract("__after", r"^[^?#]*\?([^#]*)", 1),
        }
    )


def rule_columns(rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text, and its verdict; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _count(col: Column, characters: str) -> Column:
    return F.length(col) - F.length(F.translate(col, characters, ""))


def with_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with the lexical features, f_suffix left out, and the host's suffix."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    # equal characters side by side: work grows with the length, not with its product by distinct characters
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(url, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    entropy = F.aggregate(F.transform(runs, lambda r: F.length(r) / n), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    features = {
        "f_length": F.length(url),
        "f_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "f_digit_ratio": _count(url, DIGITS) / n,
        "f_entropy": F.round(entropy, 6),
        "f_params": F.when(F.col("__query") == "", 0).otherwise(_count(F.col("__query"), "&") + 1),
        "f_host_length": F.length("host"),
        "f_labels": F.size(F.filter(F.split("host", r"\."), lambda s: s != "")),
        "f_path_length": F.length("path"),
        "f_hyphens": _count(url, "-_"),
        "f_escapes": _count(url, "%"),
        "f_secure": F.startswith(url, F.lit("https")).cast("int"),
    }
    return df.withColumns({k: v.cast("double") for k, v in features.items()}).withColumn("__suffix", F.substring_index("host", ".", -2))


def tree_column(tree: Split, names: tuple[str, ...]) -> Column:
    if tree.feature < 0:
        return F.lit(tree.value)
    return F.when(F.col(names[tree.feature]) <= F.lit(tree.bound), tree_column(tree.low, names)).otherwise(tree_column(tree.high, names))


@dataclass(frozen=True)
class UrlModel:
    """Boosted log odds of a block, and the blocked share for each host suffix."""

    prior: float
    trees: tuple[Split, ...]
    share: float
    suffixes: DataFrame

    def score(self, featured: DataFrame) -> DataFrame:
        """featured with __score, the chance that the method blocks the url."""
        z = F.lit(self.prior)
        for tree in self.trees:
            z = z + F.lit(RATE) * tree_column(tree, FEATURES)
        full = featured.join(F.broadcast(self.suffixes), "__suffix", "left").withColumn("f_suffix", F.coalesce("f_suffix", F.lit(self.share)))
        return full.withColumn("__score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _hash_cut(labelled: DataFrame, most: int) -> DataFrame:
    """labelled without most of the URLs that are not among the ``most`` of least hash, before any shuffle.

    The bound comes from a sketch of the number of distinct URLs; its error is 1 % and its
    margin 10 %. All rows of a URL stay or go together.
    """
    distinct = labelled.agg(F.approx_count_distinct("url", 0.01)).first()[0]
    share = (1.1 * most + 7 * most**0.5 + 60) / max(distinct, 1)
    return labelled.where(F.xxhash64("url") <= F.lit(int(-(1 << 63) + share * (1 << 64)))) if share < 1 else labelled


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", sample: int = SAMPLE) -> UrlModel:
    """Boosted trees from (url, blocked 0 or 1), at most ``sample`` URLs of it."""
    usable = labelled.select(col(url_col).alias("url"), col(label_col).cast("double").alias("y")).where("url IS NOT NULL AND y IS NOT NULL")
    each = _hash_cut(usable, sample).groupBy("url").agg(F.round(F.avg("y")).alias("y"))
    chosen = least_hashed(materialise(each), sample, "url").withColumn("fold", fold_of(F.col("url")))
    featured = materialise(with_features(with_parts(chosen)).select("__suffix", "fold", "y", *FEATURES[:-1]))  # at most `sample` rows, as all below
    share = featured.agg((F.coalesce(F.sum("y"), F.lit(0.0)) + 1) / (F.count("y") + 2)).first()[0]
    smoothed = lambda y, n: (y + F.lit(SMOOTHING * share)) / (n + F.lit(SMOOTHING))
    whole = featured.groupBy("__suffix").agg(F.sum("y").alias("all_y"), F.count("y").alias("all_n"))
    own = featured.groupBy("__suffix", "fold").agg(F.sum("y").alias("fold_y"), F.count("y").alias("fold_n"))
    others = own.join(F.broadcast(whole), "__suffix").select("__suffix", "fold", smoothed(F.col("all_y") - F.col("fold_y"), F.col("all_n") - F.col("fold_n")).alias("f_suffix"))
    rows = featured.join(F.broadcast(others), ["__suffix", "fold"]).select(*FEATURES, "y").collect()
    table = np.array(sorted(map(tuple, rows)), dtype=np.float64).reshape(-1, len(FEATURES) + 1)
    unseen = table.copy()
    unseen[:, FEATURES.index("f_suffix")] = share
    both = np.concatenate([table, unseen])  # every label twice, so leaves hold twice as many
    prior, trees = boost(both[:, :-1], both[:, -1], TREES, DEPTH, RATE, BINS, 2 * LEAST_ROWS)
    suffixes = materialise(whole.select("__suffix", smoothed(F.col("all_y"), F.col("all_n")).alias("f_suffix")))
    return UrlModel(prior, tuple(trees), float(share), suffixes)


def held_out_scores(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", sample: int = SAMPLE, whole_suffixes: bool = False) -> DataFrame:
    """url, blocked and block_score of every labelled row, each by a model that has not seen its fold.

    With ``whole_suffixes`` a fold takes all URLs of a host suffix, so each is judged as of an unseen host.
    """
    rows = labelled.select(col(url_col).alias("url"), col(label_col).alias("blocked")).where("url IS NOT NULL AND blocked IS NOT NULL")
    unit = F.substring_index("host", ".", -2) if whole_suffixes else F.col("url")
    rows = with_parts(rows).withColumn("fold", fold_of(unit)).select("url", "blocked", "fold")
    out = None
    for k in range(FOLDS):
        one = fit_urls(rows.where(F.col("fold") != k), "url", "blocked", sample).score(with_features(with_parts(rows.where(F.col("fold") == k))))
        one = one.select("url", "blocked", F.col("__score").alias("block_score"))
        out = one if out is None else out.unionByName(one)
    return out


def rule_labels(df: DataFrame, rules: tuple[UrlRule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """url and blocked (0 or 1) of the rows that a rule decides."""
    rule, verdict = rule_columns(rules)
    judged = with_parts(df.select(col(url_col).alias("url"))).withColumns({"rule": rule, "verdict": verdict})
    return judged.where("rule IS NOT NULL").select("url", (F.col("verdict") == "block").cast("int").alias("blocked"))


def judge_urls(
    df: DataFrame, rules: tuple[UrlRule, ...] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, sample: int = SAMPLE
) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score for every row of df."""
    rule, verdict = rule_columns(rules)
    judged = with_parts(df.select(col(id_col).alias("page_id"), col(url_col).alias("url"))).withColumns({"rule": rule, "__verdict": verdict})
    labelled = rule_labels(df, rules, url_col) if labelled is None else labelled.select(col(url_col).alias("url"), "blocked")
    scored = fit_urls(labelled, "url", "blocked", sample).score(with_features(judged))
    by_method = F.when(F.col("__score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__verdict", by_method).alias("verdict"), F.col("__score").alias("block_score"))

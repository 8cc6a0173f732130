"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees on a bounded sample of labelled rows give paths; every path
is a conjunction of comparisons. A logistic model with a lasso penalty weighs the
rules, most at zero. What is left is compiled to Spark column expressions, so
scoring reads the whole text of every document without Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, word_count, words

#: Labelled rows that the model is fitted on, at most: those of the smallest hash of doc_id.
MAX_LABELLED = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES, DEPTH, SHRINK, LEAF, CUTS = 40, 3, 0.3, 8, 24
LASSO = 0.002
SEED = 6


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, 0 where it has no words; no label, id, language or source among them."""
    n = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))
    w = F.greatest(F.col("__words"), F.lit(1))
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    return {
        "words": F.col("__words").cast("double"),
        "word_length": n / w,
        "distinct": F.coalesce(F.col("__distinct") / w, F.lit(0.0)),
        "capitals": count("[A-Z]") / n,
        "symbols": count(r"[#$%&*!|<>=@^~\\]") / n,
        "symbol_words": count(r"[#$%&*!|]{2,}") / w,
        "bars": count(r"\|") / w,
        "digits": count("[0-9]") / n,
        "sentences": count(r"[.!?](?=\s|$)") / w,
        "commas": count(",") / w,
        "lines": count("\n") / w,
        "wide": (F.coalesce(F.octet_length(text), F.lit(0)) - F.coalesce(F.length(text), F.lit(0))) / n,
    }


NAMES = ["words", "word_length", "distinct", "capitals", "symbols", "symbol_words", "bars", "digits", "sentences", "commas", "lines", "wide"]


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    counted = docs.select(*keep, F.col(text).alias("__text"), word_count(F.col(text)).alias("__words"), F.size(F.array_distinct(words(F.col(text)))).alias("__distinct"))
    stats = statistics(F.col("__text"))
    return counted.select(*keep, *[stats[name].cast("double").alias(f"__s_{name}") for name in NAMES])


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut)


def _tree(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray, rng) -> None:
    value = target[rows].sum() / (weight[rows].sum() + 1.0)
    best = None
    if depth and len(rows) >= 2 * LEAF:
        base = target[rows].sum() ** 2 / (weight[rows].sum() + 1.0)
        for f in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]:
            for c in np.unique(np.quantile(x[rows, f], np.linspace(0, 1, CUTS + 2)[1:-1])):
                above = x[rows, f] > c
                k = int(above.sum())
                if LEAF <= k <= len(rows) - LEAF:
                    g, h = target[rows][above].sum(), weight[rows][above].sum()
                    gain = g * g / (h + 1) + (target[rows].sum() - g) ** 2 / (weight[rows].sum() - h + 1) - base
                    if best is None or gain > best[0]:
                        best = gain, f, float(c), above
    if best is None or best[0] < 1e-3:
        out[rows] += SHRINK * value
        return
    _, f, c, above = best
    for side in (True, False):
        longer = (*path, (int(f), side, c))
        rules.append(longer)
        _tree(x, target, weight, rows[above == side], depth - 1, longer, rules, out, rng)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for i, rule in enumerate(rules):
        for f, above, c in rule:
            out[:, i] *= (x[:, f] > c) == above
    return out


class RuleEnsemble:
    """rules, weights (none zero) and intercept; ``fit`` and ``column``."""

    def __init__(self, rules: list[Rule], weights: np.ndarray, intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        """Without rows of both labels the score is the labels' share, or 0.5 without any."""
        if len(y) == 0 or y.min() == y.max():
            p = 0.5 if len(y) == 0 else 0.02 + 0.96 * float(y[0])
            return cls([], np.zeros(0), float(np.log(p / (1 - p))))
        rng = np.random.default_rng(SEED)
        margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
        rules: list[Rule] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            rows = np.sort(rng.permutation(len(y))[: max(LEAF * 4, min(len(y), 4000))])
            _tree(x, y - p, p * (1 - p), rows, DEPTH, (), rules, margin, rng)
        rules = list(dict.fromkeys(rules))
        z = holds(rules, x)
        _, one = np.unique(z, axis=1, return_index=True)
        rules, z = [rules[i] for i in sorted(one)], z[:, np.sort(one)]
        w, b = _lasso(z, y)
        kept = np.flatnonzero(np.abs(w) > 1e-6)
        return cls([rules[i] for i in kept], w[kept], b)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + holds(self.rules, x) @ self.weights)))

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            test = None
            for f, above, c in rule:
                one = F.col(f"__s_{NAMES[f]}") > F.lit(c) if above else F.col(f"__s_{NAMES[f]}") <= F.lit(c)
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _lasso(z: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss with an L1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    n = len(y)
    a = np.concatenate([z, np.ones((n, 1))], 1)
    step = 4.0 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(a.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ v)))
        new = v - step * (a.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * LASSO, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(1))


def train(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """Fit on labelled rows outside fold 0, at most MAX_LABELLED of them."""
    marked = labels.select(*need(labels, "doc_id", "quality")).where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 0).dropDuplicates(["doc_id"])
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select(F.col("doc_id").alias("__id"), "quality")
    rows = docs.select(*need(docs, "doc_id", "text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    table = with_statistics(rows, ["doc_id", "quality"]).toArrow()
    x = np.stack([table[f"__s_{name}"].to_numpy() for name in NAMES], 1) if len(table) else np.zeros((0, len(NAMES)))
    by = np.lexsort((*x.T, table["doc_id"].to_numpy()))
    return RuleEnsemble.fit(x[by], table["quality"].to_numpy().astype(float)[by])


def score_quality(docs: DataFrame, labels: DataFrame, model: RuleEnsemble | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs(doc_id, text)``.

    Null and empty texts have statistics of 0 and a score like others; a null doc_id
    is never held out; repeated rows each have a row; an empty table gives an empty
    result; other columns are dropped. Labels only fit the model.
    """
    model = model or train(docs, labels)
    rows = with_statistics(docs.select(*need(docs, "doc_id", "text")), ["doc_id"])
    scored = rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, as they were; one pass, no join."""
    model = train(docs, labels)
    names = docs.columns
    counted = docs.select(F.struct(*[F.col(c) for c in names]).alias("__row"), F.col("text").alias("__body"))
    return with_statistics(counted, ["__row"], "__body").where(model.column() >= THRESHOLD).select("__row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

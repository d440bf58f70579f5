"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics of whole texts are computed once per document. Small regression
trees, each fitted to the residuals of those before on a random half of a
bounded labelled sample, give paths; every path is a rule, a conjunction of
comparisons. A lasso logistic regression over the rules keeps few of them. The
kept rules and weights become one Spark column expression that scores every
document.

Defined results. Null text scores like the empty text. Without a usable label,
or with one class only, the score is the smoothed share of label 1 (0.5 without
labels). Labels other than 0 and 1, null labels and null ids teach nothing;
repeated labels count as often as they occur. An empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import double, with_text_columns

STATISTICS = ("n_words", "chars_per_word", "symbols_per_word", "upper_share", "digit_share", "marks_per_word", "points_per_word", "repeat_share", "distinct_share", "top_word_share", "dup_line_share", "words_per_line", "wide_share")
_KIND = np.zeros(256, np.uint8)  # of each byte: 1 upper case, 2 digit, 3 symbol, 4 ! or ?, 5 point or comma, 6 first byte of a wider character, 7 its later bytes
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[list(b"#*$%&|<>@^_~{}[]")] = 3
_KIND[list(b"!?")], _KIND[list(b".,;:")] = 4, 5
_KIND[192:256], _KIND[128:192] = 6, 7


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of STATISTICS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8)
    chars = len(text)
    triples = Counter(zip(words, words[1:], words[2:]))
    repeated = sum(triples.values()) - sum(1 for c in triples.values() if c == 1) if len(triples) < n - 2 else 0
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (float(n), chars / n, kinds[3] / n, kinds[1] / chars, kinds[2] / chars, kinds[4] / n, kinds[5] / n, repeated / n, len(counts) / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines), n / len(lines), kinds[6] / chars)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # value > limit, else value <= limit
    limit: float

    def column(self, of: dict[str, Column]) -> Column:
        c = of[self.statistic]
        return c > self.limit if self.above else c <= self.limit

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, STATISTICS.index(self.statistic)]
        return v > self.limit if self.above else v <= self.limit


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def column(self, of: dict[str, Column]) -> Column:
        """The score as a Spark expression."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            test = rule[0].column(of)
            for c in rule[1:]:
                test = test & c.column(of)
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy, for tests and for the fit."""
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * np.logical_and.reduce([c.holds(x) for c in rule])
        return 1 / (1 + np.exp(-total))


def _grow(x, residual, limits, depth, least, path, rules):
    """One regression tree on quantile limits; each node's path becomes a rule. Returns a function of x."""
    n = len(residual)
    mean = residual.mean() if n else 0.0
    best, at = 1e-9, None
    if depth and n >= 2 * least:
        total = residual.sum()
        for k in range(x.shape[1]):
            if not len(limits[k]):
                continue
            code = np.searchsorted(limits[k], x[:, k], side="left")  # value <= limits[code]
            count = np.cumsum(np.bincount(code, minlength=len(limits[k]) + 1))[:-1]
            sums = np.cumsum(np.bincount(code, residual, minlength=len(limits[k]) + 1))[:-1]
            ok = (count >= least) & (n - count >= least)
            gain = np.where(ok, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
            if gain.max() > best:
                best, at = gain.max(), (k, float(limits[k][gain.argmax()]))
    if at is None:
        return lambda z: np.full(len(z), mean)
    k, limit = at
    low = x[:, k] <= limit
    kids = []
    for above, rows in ((False, low), (True, ~low)):
        step = (*path, Condition(STATISTICS[k], above, limit))
        rules.append(step)
        kids.append(_grow(x[rows], residual[rows], limits, depth - 1, least, step, rules))
    return lambda z: np.where(z[:, k] <= limit, kids[0](z), kids[1](z))


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, least: int = 8, rate: float = 0.3, bins: int = 48, seed: int = 0) -> list[Rule]:
    rng = np.random.default_rng(seed)
    limits = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
        limits.append(cuts if len(values) > bins else (values[:-1] + values[1:]) / 2)
    prior = y.mean()
    total = np.full(len(y), math.log(prior / (1 - prior)))
    rules: list[Rule] = []
    for _ in range(trees):
        rows = rng.random(len(y)) < 0.5
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x[rows], (y - p)[rows], limits, depth, least, (), rules)
        total += rate * 4 * tree(x)
    return list(dict.fromkeys(tuple(sorted(r, key=lambda c: (c.statistic, c.above, c.limit))) for r in rules))


def fit_lasso(hits: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 600) -> tuple[float, np.ndarray]:
    """Lasso logistic weights of 0/1 columns by accelerated proximal gradient; the intercept is not penalised."""
    n, m = hits.shape
    a = np.concatenate([np.ones((n, 1)), hits], axis=1)
    w = np.zeros(m + 1)
    w[0] = math.log(y.mean() / (1 - y.mean()))
    v = np.ones(m + 1)  # the largest eigenvalue, for the step
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / (v @ (a.T @ (a @ v)))
    z, t = w.copy(), 1.0
    shrink = step * penalty * np.r_[0, np.ones(m)]
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / n
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, **options) -> RuleEnsemble:
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    rules = extract_rules(x, y, **options)
    if not rules:
        return RuleEnsemble(math.log(y.mean() / (1 - y.mean())), ())
    hits = np.stack([np.logical_and.reduce([c.holds(x) for c in r]) for r in rules], axis=1).astype(np.float64)
    intercept, weights = fit_lasso(hits, y.astype(np.float64))
    kept = [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6]
    return RuleEnsemble(intercept, tuple(kept))


def with_statistics(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    def make():
        def work(texts):
            rows = [statistics(t) for t in texts]
            return list(np.array(rows, np.float64).reshape(-1, len(STATISTICS)).T)

        return work

    return with_text_columns(df, text_col, [double(prefix + s) for s in STATISTICS], make)


def held_out(id_col: str | Column, folds: int = 5, held_fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000, folds: int = 5, held_fold: int = 0) -> RuleEnsemble:
    """Fit on a sample of about ``max_rows`` labels outside the held-out fold, drawn by a hash of the id."""
    usable = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & F.col("i").isNotNull()).where(~held_out("i", folds, held_fold))
    n = usable.count()
    drawn = usable.where(F.pmod(F.xxhash64("i", F.lit(29)), F.lit(1_000_000)) < min(1.0, max_rows / max(1, n)) * 1_000_000).limit(2 * max_rows)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "i")  # at most 2 * max_rows small rows
    got = with_statistics(texts, "t", "s_").drop("t").limit(4 * max_rows).toPandas().sort_values("i", kind="stable")
    x = got[["s_" + s for s in STATISTICS]].to_numpy(np.float64)
    order = np.lexsort([*x.T, got["y"].to_numpy()]) if len(got) else []
    return fit(x[order], got["y"].to_numpy()[order])


def with_quality_score(df: DataFrame, model: RuleEnsemble, text_col: str = "text", field: str = "score") -> DataFrame:
    """``df`` with the model's score of its text."""
    prefix = "s_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    wide = with_statistics(df, text_col, prefix)
    return wide.select(*df.columns, model.column({s: F.col(prefix + s) for s in STATISTICS}).alias(field))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 if score >= cut, else 0)."""
    model = learn(docs, labels, id_col, text_col, label_col)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = with_quality_score(slim, model, "__text", "score")
    return out.select(F.col("__id").alias(id_col), held_out("__id").alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).cast(T.IntegerType()).alias("predicted"))

"""Quality classifier: a sparse rule ensemble, compiled into Spark columns.

Statistics of a text are DataFrame columns. On a bounded sample of labelled documents (SAMPLE, those of the least id
hash) small boosted trees are grown; every path of a tree is a conjunctive rule over the statistics. A lasso logistic
regression over all rules leaves a few with a weight, and those become one column expression. Neither labels, lang,
source nor doc_id enter a score. Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from.

Defined cases: null text counts as empty; null labels and labels without a document are not learned from; of repeated
labels for one id the least counts; without labels of both kinds the score is the smoothed share of label 1; repeated
documents give a row each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WHITE, held_out
from vigil.llm.ledger import let

SAMPLE, TREES, DEPTH, THRESHOLD = 16_000, 24, 3, 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Name -> statistic; those that begin with _ are parts of others."""
    words = F.filter(F.split(text, WHITE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("distinct"), F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("double").alias("twice")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("distinct"), F.size(F.filter(x, lambda s: s.contains(" | "))).cast("double").alias("bars")))
    return {"_w": of_words, "_l": of_lines, "_chars": left(WHITE), "_letters": left("[^\\p{L}]+"), "_upper": left("[^\\p{Lu}]+"), "_digits": left("[^0-9]+"), "_symbols": left("[^#*$%&|<>{}\\[\\]=_/\\\\]+"), "_marks": left("[^!?]+"), "_stops": left("[^.,;:]+")}


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """keep and the statistics (as f_<name>) of every document."""
    c, w, x = F.col, F.greatest(F.col("_w.n"), F.lit(1.0)), F.greatest(F.col("_chars"), F.lit(1.0))
    df = docs.select(*keep, *[v.alias(k) for k, v in statistics(F.coalesce(F.col("text"), F.lit(""))).items()])
    out = {
        "words": c("_w.n"), "distinct": c("_w.distinct") / w, "lines": c("_l.n"), "same_lines": 1 - c("_l.distinct") / F.greatest(c("_l.n"), F.lit(1.0)), "bars": c("_l.bars") / F.greatest(c("_l.n"), F.lit(1.0)),
        "word_length": c("_chars") / w, "letters": c("_letters") / x, "upper": c("_upper") / F.greatest(c("_letters"), F.lit(1.0)), "digits": c("_digits") / x, "symbols": c("_symbols") / w, "marks": c("_marks") / w, "stops": c("_stops") / w,
        "twice": c("_w.twice") / w, "line_words": c("_w.n") / F.greatest(c("_l.n"), F.lit(1.0)), "root_distinct": c("_w.distinct") / F.sqrt(w),
    }
    return df.select(*keep, *[v.alias(f"f_{k}") for k, v in out.items()])


NAMES = ("words", "distinct", "lines", "same_lines", "bars", "word_length", "letters", "upper", "digits", "symbols", "marks", "stops", "twice", "line_words", "root_distinct")
Rule = tuple[tuple[int, bool, float], ...]  # (feature, greater, threshold) of each condition


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score over the columns f_<name>."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = F.lit(True)
            for f, greater, t in rule:
                c = F.col(f"f_{NAMES[f]}")
                held = held & ((c > t) if greater else (c <= t))
            z = z + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, t in rule:
        out &= (x[:, f] > t) if greater else (x[:, f] <= t)
    return out


def grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, out: list[Rule], least: int) -> np.ndarray:
    """A regression tree; its paths go to out. Returns the fitted values at rows."""
    r = residual[rows]
    best = (1e-12, None)
    if depth and len(rows) >= 2 * least:
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            side = np.searchsorted(c, x[rows, f], side="left")  # x <= c[i] iff side <= i
            n, s = np.cumsum(np.bincount(side, minlength=len(c) + 1))[:-1], np.cumsum(np.bincount(side, r, len(c) + 1))[:-1]
            good = (n >= least) & (len(r) - n >= least)
            gain = np.where(good, s * s / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(r) - n, 1) - r.sum() ** 2 / len(r), 0)
            if gain.max() > best[0]:
                best = (gain.max(), (f, float(c[gain.argmax()])))
    if best[1] is None:
        return np.full(len(rows), r.mean() if len(r) else 0.0)
    f, t = best[1]
    low, fitted = x[rows, f] <= t, np.zeros(len(rows))
    for greater, side in ((False, low), (True, ~low)):
        longer = (*path, (f, greater, t))
        out.append(longer)
        fitted[side] = grow(x, residual, rows[side], cuts, depth - 1, longer, out, least)
    return fitted


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, k = m.shape
    step = 4 / max(np.linalg.eigvalsh(m.T @ m / n)[-1] + 1, 1e-9)
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(m @ v + c))) - y
        new = v - step * (m.T @ e / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, w, b, t = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b), new, new_b, t2
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) < 20 or y.min() == y.max():
        return Ensemble(base, ())
    rnd = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 63), method="lower")) for c in x.T]
    z, rules = np.full(len(y), base), []
    least = max(3, min(20, int(0.02 * min(y.sum(), len(y) - y.sum())) + 3))
    for _ in range(TREES):
        rows = np.sort(rnd.choice(len(y), max(20, len(y) // 2), replace=False)) if len(y) > 200 else np.arange(len(y))
        p = 1 / (1 + np.exp(-z))
        found: list[Rule] = []
        grow(x, y - p, rows, cuts, DEPTH, (), found, least)
        rules += found
        leaves = [r for r in found if not any(o[: len(r)] == r and len(o) > len(r) for o in found)]
        for r in leaves:
            at = holds(r, x)
            if at.any():
                z[at] += 0.5 * np.clip((y - p)[at].sum() / max((p * (1 - p))[at].sum(), 1e-3), -4, 4)
    rules = list(dict.fromkeys(rules))
    if not rules:
        return Ensemble(base, ())
    m = np.stack([holds(r, x) for r in rules], 1).astype(np.float64)
    _, first = np.unique(m, axis=1, return_index=True)  # rules that hold alike count once
    first.sort()
    rules, m = [rules[i] for i in first], m[:, first]
    check = np.arange(len(y)) % 4 == 0
    loss = lambda b, w: float(np.logaddexp(0, -(2 * y[check] - 1) * (m[check] @ w + b)).mean())
    tried = [(loss(*lasso(m[~check], y[~check], p)), p) for p in (0.01, 0.003, 0.001, 0.0003)]
    b, w = lasso(m, y, min(tried)[1], 800)
    return Ensemble(float(b), tuple((r, float(a)) for r, a in zip(rules, w, strict=True) if abs(a) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("__label")).filter("doc_id is not null and __label in (0, 1)").filter(~held_out(0))
    chosen = known.groupBy("doc_id").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "__label", "t.text")
    rows = features(one, "doc_id", "__label").orderBy("doc_id").toPandas()  # at most `sample` rows of 15 numbers
    return fit(rows[[f"f_{n}" for n in NAMES]].to_numpy(np.float64), rows["__label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if the score is 0.3 or more)."""
    return features(docs, "doc_id").withColumn("score", model.column()).select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Ensemble) -> DataFrame:
    """The documents that aren't rejected, columns as they were."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    return features(whole, "__row").filter(model.column() >= THRESHOLD).select("__row.*")

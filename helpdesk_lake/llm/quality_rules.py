"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of the whole text (lengths, character classes, repetition) are
   computed in Arrow batches, a few bytes-level passes per document.
2. On a bounded sample of labelled rows (``SAMPLE_ROWS``, documented parameter)
   small gradient-boosted trees are grown; every path from a root to a node is
   a conjunction of thresholds, i.e. a rule.
3. A logistic regression with an L1 penalty over all rules keeps a few of them.
4. The kept rules become one Spark column expression over the statistics.

Edge cases: a null text counts as empty; an empty text has all statistics 0 and
is scored like any other; null ids are returned, not held out; repeated rows are
scored one by one; an empty table gives no rows; without labels of both classes
the score is the constant class share (0.5 without any label). Extra columns of
the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import aside, held_out, training_rows

#: Most labelled rows that the fit reads (their statistics go to the driver).
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
L1 = 0.002
MAX_RULES = 400

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_ENDS = b".,;:"
_MARKS = bytes(c for c in range(33, 127) if chr(c) not in ".,;:'\"-()" and not chr(c).isalnum())
STATISTICS = ("log_bytes", "log_words", "word_bytes", "long_word", "distinct_words", "top_word", "upper", "digit", "mark", "pipe",
              "bang", "ends", "high_bytes", "line_words", "distinct_lines", "same_next")


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for one whole text; all 0 when it has no word."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    split = raw.split()
    n, size = len(split), len(raw)
    if not n:
        return (0.0,) * len(STATISTICS)
    counts = Counter(split)
    share = lambda drop: (size - len(raw.translate(None, drop))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        float(np.log1p(size)), float(np.log1p(n)), sum(map(len, split)) / n, max(map(len, counts)) / 100.0, len(counts) / n,
        max(counts.values()) / n, share(_UPPER), share(_DIGIT), share(_MARKS), share(b"|"), share(b"!"), share(_ENDS),
        share(_HIGH), n / len(lines), len(set(lines)) / len(lines),
        sum(map(eq, split, split[1:])) / n,
    )


@pandas_udf(StructType([StructField(s, DoubleType()) for s in STATISTICS]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS), dtype=float)


@dataclass
class RuleModel:
    """``rules``: (weight, ((statistic, at_most, threshold), ...)): all conditions hold -> the weight is added."""

    intercept: float
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]] = field(default_factory=list)

    def column(self, stats: str) -> Column:
        """The probability as a Spark expression over the struct column ``stats``."""
        total = F.lit(float(self.intercept))
        for weight, conditions in self.rules:
            test = None
            for j, at_most, threshold in conditions:
                value = F.col(f"{stats}.{STATISTICS[j]}")
                one = value <= F.lit(threshold) if at_most else value > F.lit(threshold)
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy (tests)."""
        return 1 / (1 + np.exp(-(self.intercept + sum((w * _holds(x, c) for w, c in self.rules), np.zeros(len(x))))))


def _holds(x: np.ndarray, conditions: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, at_most, threshold in conditions:
        out &= x[:, j] <= threshold if at_most else x[:, j] > threshold
    return out


def _grow(codes: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, path: tuple, depth: int,
          step: np.ndarray, rules: set) -> None:
    """One boosted tree by histogram splits; notes every path in ``rules`` and the leaf values in ``step``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, None, None)
    if depth and len(rows) >= 20:
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            gs = np.cumsum(np.bincount(codes[rows, j], grad[rows], len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(codes[rows, j], hess[rows], len(cut) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(hs < 2) | (h - hs < 2)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    _, j, k = best
    if j is None:
        step[rows] = -g / (h + 1)
        return
    left = codes[rows, j] <= k
    for at_most, part in ((True, rows[left]), (False, rows[~left])):
        longer = (*path, (j, at_most, float(cuts[j][k])))
        rules.add(tuple(sorted(longer)))
        _grow(codes, cuts, part, grad, hess, longer, depth - 1, step, rules)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees -> rules -> L1-penalised logistic weights (proximal gradient with momentum)."""
    n = len(y)
    if n == 0:
        return RuleModel(0.0)
    p0 = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(p0 / (1 - p0)))
    if y.min() == y.max():
        return RuleModel(base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, rules = np.full(n, base), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(n)
        _grow(codes, cuts, np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), (), DEPTH, step, rules)
        margin += RATE * step
    ordered = sorted(rules, key=lambda r: (len(r), r))[:MAX_RULES]
    if not ordered:
        return RuleModel(base)
    holds = np.stack([_holds(x, r) for r in ordered], axis=1).astype(np.float32)
    scale = 4.0 / max(float(np.linalg.norm(holds, 2) ** 2 / n), 1e-9)
    w = np.zeros(len(ordered))
    b, w_old, b_old = base, w.copy(), base
    for t in range(1, 601):
        m = (t - 1) / (t + 2)
        v, c = w + m * (w - w_old), b + m * (b - b_old)
        r = 1 / (1 + np.exp(-(holds @ v.astype(np.float32) + c))) - y
        w_old, b_old = w, b
        u = v - scale * (holds.T @ r.astype(np.float32)) / n
        w = np.sign(u) * np.maximum(np.abs(u) - scale * L1, 0)
        b = c - min(scale, 4.0) * float(r.mean())
    return RuleModel(float(b), [(float(k), r) for k, r in zip(w, ordered) if k])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                parts: int = 3, part: int = 1, bound: int = SAMPLE_ROWS) -> RuleModel:
    """Fits on at most ``bound`` labelled rows whose id's fold is not ``part``; only their statistics reach the driver."""
    rows = training_rows(labels, id_col, label_col, parts, part, bound)
    sample = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .join(F.broadcast(rows), "_id").select("_id", "_label", _statistics("_text").alias("_s")))
    got = sorted(sample.select("_id", "_label", "_s.*").collect())
    x = np.array([r[2:] for r in got[:bound]], float).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r[1] for r in got[:bound]], float))


def with_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``score_col``."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*kept, _statistics(text_col).alias("_stats")).select(*kept, model.column("_stats").alias(score_col))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit_quality(docs, labels)
    scored = with_quality(docs.select("doc_id", F.col("text").alias("_text")), model, "_text")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    plain, name = aside(docs)
    scored = with_quality(plain, fit_quality(docs, labels), name["text"], "_score")
    return scored.where(F.col("_score") >= 0.5).drop("_score").toDF(*docs.columns)

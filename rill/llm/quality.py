"""Quality classifier: a sparse rule ensemble.

1. A whole text becomes a row of statistics (``STATISTICS``), in Arrow batches: first those of a bounded sample of labelled rows,
   to fit on, then each row's, once, to score it.
2. On the sample boosted histogram trees are grown; every path from a root is a conjunctive rule
   over statistics.
3. A lasso logistic regression (proximal gradient steps) weighs the rules; most weights end at zero.
4. What is left compiles to one Spark column expression over the statistics, which scores all rows in the JVM.

Defined results: null and empty texts have zero statistics and get the score of such a row; without examples of either
label all scores are the share of label 1 (one half without any); repeated labels of a document are averaged, null
ones and those of null ids left out; very long texts are read whole, at one text's memory; repeated documents get a row and the same score each;
a score of exactly the threshold is kept; an empty table gives an empty table; other columns, of any names, stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, ship, utf8

#: Bound of the sample of labelled rows: about so many are fitted on.
ROWS = 20_000
TREES, DEPTH, LEAST_ROWS, RATE, BINS = 24, 3, 20, 0.3, 48
LASSO = 4e-4

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?!")
STATISTICS = (
    "words", "upper", "letters", "digits", "symbols", "marks", "bars", "mean_word", "long_words", "distinct",
    "repeated", "top_word", "symbol_ends", "lines", "twin_lines", "bad_lines", "stops",
)


def share_of(b: bytes, kind: bytes) -> float:
    return (len(b) - len(b.translate(None, kind))) / max(1, len(b))


def bad_line(line: bytes) -> bool:
    """Shouted, of symbols, a row of cells, or one word again and again."""
    words = line.split()
    n = len(words)
    if n < 4:
        return False
    return (
        share_of(line, UPPER) > 0.4
        or share_of(line, SYMBOLS) > 0.08
        or len(set(words)) < 0.5 * n
        or sum(map(eq, words, words[1:])) > 0.3 * n
    )


def statistics(text: str | None) -> tuple[float, ...]:
    b = utf8(text or "")
    words = b.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    counts = Counter(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    size = sum(map(len, words))
    bad = sum(len(x) for x in lines if bad_line(x))
    return (
        float(n),
        share_of(b, UPPER),
        share_of(b, LETTERS),
        share_of(b, b"0123456789"),
        share_of(b, SYMBOLS),
        share_of(b, b"!?"),
        share_of(b, b"|"),
        size / n,
        sum(len(w) > 20 for w in words) / n,
        len(counts) / n**0.8,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n,
        sum(w[-1] in SYMBOLS for w in words) / n,
        float(len(lines)),
        1 - len(set(lines)) / len(lines),
        bad / len(b),
        share_of(b, b".,"),
    )


@dataclass(frozen=True)
class Rule:
    """All of (statistic number, whether above, threshold)."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            c = F.col(names[f])
            out = out & ((c > t) if above else (c <= t))
        return out


def simplify(conditions: list[tuple[int, bool, float]]) -> Rule:
    """One bound of each kind for a statistic: the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for f, above, t in conditions:
        best[f, above] = t if (f, above) not in best else max(best[f, above], t) if above else min(best[f, above], t)
    return Rule(tuple((f, a, t) for (f, a), t in sorted(best.items())))


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each once."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}

    def split(rows: np.ndarray, path: list, depth: int) -> None:
        g, h = grad[rows], hess[rows]
        best = (1e-6, -1, -1)
        if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for f in range(x.shape[1]):
                b = binned[rows, f]
                k = len(edges[f]) + 1
                gs, hs, ns = (np.cumsum(np.bincount(b, v, k))[:-1] for v in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] < 0:
            margin[rows] += RATE * g.sum() / (h.sum() + 1)
            return
        _, f, k = best
        left = binned[rows, f] <= k
        for above, own in ((False, rows[left]), (True, rows[~left])):
            longer = [*path, (f, above, float(edges[f][k]))]
            rules.setdefault(simplify(longer))
            split(own, longer, depth + 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        split(np.arange(len(y)), [], 0)
    return list(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; columns are scaled by their spread."""
    scale = np.maximum(a.std(axis=0), 0.02)
    z, n = (a - a.mean(axis=0)) / scale, len(y)
    v = np.ones(z.shape[1]) / np.sqrt(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1))
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    ww, bb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ ww + bb, -40, 40))) - y
        new = ww - rate * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb, nt = bb - rate * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        ww, bb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w / scale, float(b - (w / scale) @ a.mean(axis=0))


class RuleEnsemble:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rules: list[Rule] = []
        self.weights = np.zeros(0)
        self.constant = (float(y.mean()) if len(y) else 0.5) if len(y) < 2 or y.min() == y.max() else None
        if self.constant is not None:
            return
        rules = grow_rules(x, y)
        a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
        w, self.bias = lasso_logistic(a, y, LASSO)
        self.rules = [r for r, v in zip(rules, w) if v]
        self.weights = w[w != 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, names: list[str]) -> Column:
        """The score as a Spark expression over the statistics."""
        if self.constant is not None:
            return F.lit(self.constant)
        z = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights):
            z = z + F.when(r.column(names), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_statistics(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with a struct column of the statistics of a text column."""
    ship(docs.sparkSession)
    ddl = ", ".join(f"{s} double" for s in STATISTICS)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from settled(pd.DataFrame([statistics(t) for t in s], columns=list(STATISTICS), dtype="float64") for s in batches)

    # Annotations are strings here, so the kind of function is given by them once resolved.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(name, F.pandas_udf(run, ddl)(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str) -> RuleEnsemble:
    """Rules from the statistics of a sample of labelled rows: numbers only leave the executors."""
    one = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    n = one.count()
    draw = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1_000_000)) / 1e6
    picked = one.where(draw < ROWS / max(n, 1)).limit(2 * ROWS)  # of two numbers each
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
    t = with_statistics(own, "text", "s").select("id", "y", "s.*").limit(4 * ROWS).toArrow()
    x = np.column_stack([t[s].to_numpy() for s in STATISTICS]) if len(t) else np.zeros((0, len(STATISTICS)))
    y = t["y"].to_numpy().astype(np.float64) if len(t) else np.zeros(0)
    order = np.lexsort((*x.T, t["id"].to_numpy())) if len(t) else np.zeros(0, np.int64)
    return RuleEnsemble(x[order], y[order])


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and score of every row of docs; labels (doc_id, label) are all that is learned from."""
    model = fit(docs, labels, label, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_statistics(rows, "text", "s").select("doc_id", model.column([f"s.{s}" for s in STATISTICS]).alias("score"))


def keep_good(
    docs: DataFrame, labels: DataFrame, least: float = 0.5, label: str = "quality", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of docs that score at least ``least``, with all their columns."""
    model = fit(docs, labels, label, doc_id, text)
    score = model.column([f"_statistics.{s}" for s in STATISTICS])
    return with_statistics(docs, text, "_statistics").where(score >= least).drop("_statistics")

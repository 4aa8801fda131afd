"""A sparse ensemble of rules over text statistics, compiled into one Spark column.

Shallow boosted trees on a labelled sample give candidate rules (the paths to their nodes); a
lasso logistic regression picks and weighs few of them. Scoring is JVM-side arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import base_statistics, labelled_sample, ratios, without_scratch
from .text import held_out, packed, unpacked

_READ = ("doc_id", "text")


@dataclass(frozen=True)
class PathRule:
    """A conjunction of (statistic, above, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            out = out & (F.col(name) > at if above else F.col(name) <= at)
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.conditions:
            v = x[:, names.index(name)]
            out &= v > at if above else v <= at
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[PathRule, ...]
    weights: tuple[float, ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float) -> tuple[list[tuple], np.ndarray]:
    """Paths of one regression tree on gradients g and curvatures h, and its values at x."""
    paths, values = [], np.zeros(len(g))

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            paths.append(path)
        best, cut = 1e-6, None
        if left:
            sg, sh = g[rows].sum(), h[rows].sum()
            for j, at in enumerate(cuts):
                if not len(at):
                    continue
                bins = np.searchsorted(at, x[rows, j])  # x <= at[i] iff its bin is i or less
                lg = np.cumsum(np.bincount(bins, g[rows], len(at) + 1))[:-1]
                lh = np.cumsum(np.bincount(bins, h[rows], len(at) + 1))[:-1]
                gain = lg**2 / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg**2 / (sh + 1)
                gain[(lh < least) | (sh - lh < least)] = 0
                i = int(gain.argmax())
                if gain[i] > best:
                    best, cut = gain[i], (j, float(at[i]))
        if cut is None:
            values[rows] = g[rows].sum() / (h[rows].sum() + 1)
            return
        j, at = cut
        below = x[rows, j] <= at
        grow(rows[below], (*path, (j, False, at)), left - 1)
        grow(rows[~below], (*path, (j, True, at)), left - 1)

    grow(np.arange(len(g)), (), depth)
    return paths, values


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, share: np.ndarray, names: list[str], trees: int = 12, depth: int = 3, penalty: float = 0.002, rounds: int = 600) -> RuleEnsemble:
    """Rules from boosted trees, then lasso weights by accelerated proximal gradient steps."""
    share = share / share.mean()
    cuts = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle[np.unique(np.linspace(0, len(middle) - 1, min(64, len(middle))).astype(int))] if len(middle) else middle)
    base = np.average(y, weights=share)
    z = np.full(len(y), np.log(base / (1 - base)))
    paths: dict[tuple, None] = {}
    for _ in range(trees):
        p = _sigmoid(z)
        found, values = _tree(x, cuts, share * (y - p), share * p * (1 - p), depth, 1e-3 * len(y))
        paths |= dict.fromkeys(found)
        z = z + 0.3 * values
    rules = [PathRule(tuple((names[j], above, at) for j, above, at in path)) for path in paths]
    if not rules:
        return RuleEnsemble(float(z[0]), (), ())
    r = np.column_stack([rule.holds(x, names) for rule in rules]).astype(float)
    share = share / len(y)
    step = 4 / (np.linalg.norm(np.column_stack([np.ones(len(y)), r]) * np.sqrt(share)[:, None], 2) ** 2)
    w, b = np.zeros(r.shape[1]), float(np.log(base / (1 - base)))
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        g = share * (_sigmoid(vb + r @ vw) - y)
        new = vw - step * (r.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = vb - step * g.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(float(b), tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept))


def fit_quality_ensemble(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> RuleEnsemble:
    """An ensemble from at most ``per_class`` labelled texts of each class, held-out rows excepted.

    Null text counts as empty; labels other than 0 and 1 and null ids are left out; of repeated
    labels of a doc_id the highest counts, and every row with that doc_id is learned from, up to
    ``2 * per_class`` rows. Without labels of both classes the model is a constant.
    """
    sample, weights = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), "quality", per_class)
    rows, names = ratios(base_statistics(sample))
    found = rows.select("y", "__order", *names).orderBy("__order", *names).limit(2 * per_class).collect()
    y = np.array([r.y for r in found], float)
    if len({*y}) < 2:  # one class or none: a constant
        return RuleEnsemble(50.0 if len(y) == 0 or y[0] else -50.0, (), ())
    x = np.array([[r[n] for n in names] for r in found])
    return train(x, y, np.array([weights[int(v)] for v in y]), names)


def score_quality(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """Add held_out, score (0 to 1) and predicted (score >= threshold), replacing columns of these names.

    Null text counts as empty; all other columns stay as they are, whatever their names (those that
    begin with two underscores are reserved). An empty table gives no rows. Without labels of both classes the score is near the known class's
    (near 1 with none). One row per input row.
    """
    clean = docs.drop("held_out", "score", "predicted")
    rows, _ = ratios(base_statistics(packed(clean, _READ)))
    rows = without_scratch(rows.withColumn("score", model.score()))
    rows = rows.withColumn("held_out", held_out("doc_id", 5, 0)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return rows.select(*unpacked(clean.columns, _READ), "held_out", "score", "predicted")

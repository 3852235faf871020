"""Quality score by a sparse ensemble of rules.

Shallow trees are boosted over statistics of a bounded sample of labelled texts; every path from a root is a
conjunction of comparisons. A lasso logistic regression over all rules leaves few with a weight, and these are
compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.labelled import labelled_sample, sigmoid
from tickloom.llm.textio import held_out, per_text, text_statistics

STATISTICS = tuple(text_statistics([b""]))
#: labelled rows (about) that the rules are learned from
TRAINING_ROWS = 12_000
TREES, DEPTH, CUTS, SHRINK, LEAST_LEAF = 40, 3, 24, 0.2, 8
PENALTY, STEPS = 0.002, 400
THRESHOLD = 0.7

#: (statistic, above, threshold): value > threshold, or value <= threshold
Condition = tuple[str, bool, float]


class Rules(NamedTuple):
    bias: float
    rules: list[tuple[float, tuple[Condition, ...]]]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (and any further column of ``docs``) with the statistics of every whole text."""
    return per_text(docs, ", ".join(f"{s} double" for s in STATISTICS), lambda texts: [pa.array(np.asarray(v, float)) for v in text_statistics(texts).values()])


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], path: tuple, depth: int, out: list) -> np.ndarray:
    """Newton steps of a regression tree on gradients; ``out`` gains the path of every node below the root."""
    step = np.full(len(g), -g.sum() / (h.sum() + 1.0))
    if path:
        out.append(path)
    if depth == DEPTH or len(g) < 2 * LEAST_LEAF:
        return step
    best = (1e-9, -1, 0.0)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f, own in enumerate(cuts):
        cell = np.searchsorted(own, x[:, f], side="left")  # cell <= k exactly where the value is <= own[k]
        n = len(own) + 1
        gs, hs, cs = (np.cumsum(np.bincount(cell, weights=w, minlength=n))[:-1] for w in (g, h, np.ones(len(g))))
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
        gain[(cs < LEAST_LEAF) | (len(g) - cs < LEAST_LEAF)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, float(own[int(gain.argmax())]))
    if best[1] < 0:
        return step
    above = x[:, best[1]] > best[2]
    for side in (False, True):
        own = above == side
        step[own] = _grow(x[own], g[own], h[own], cuts, (*path, (STATISTICS[best[1]], side, best[2])), depth + 1, out)
    return step


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, threshold in rule:
        out &= (x[:, STATISTICS.index(name)] > threshold) == above
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules of boosted trees under a lasso; only a bias where a class is missing."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    bias = float(np.log(share / (1 - share)))
    if len(y) < 4 * LEAST_LEAF or y.min() == y.max():
        return Rules(bias, [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))) for f in range(x.shape[1])]
    margin, paths, rng = np.full(len(y), bias), [], np.random.default_rng(11)
    for _ in range(TREES):
        p = sigmoid(margin)
        part = rng.random(len(y)) < 0.6
        own: list = []
        _grow(x[part], (p - y)[part], (p * (1 - p))[part], cuts, (), 0, own)
        paths += own
        # the step of every row follows from the leaves: those paths that no other path extends
        for leaf in (q for q in own if not any(len(o) > len(q) and o[: len(q)] == q for o in own)):
            at = _holds(x, leaf)
            margin[at] -= SHRINK * (p - y)[at].sum() / ((p * (1 - p))[at].sum() + 1.0)
    rules, columns, seen = [], [], set()
    for path in dict.fromkeys(paths):
        held = _holds(x, path)
        key = held.tobytes()
        if held.any() and not held.all() and key not in seen:
            seen.add(key)
            rules.append(path)
            columns.append(held)
    if not columns:  # nothing tells the rows apart
        return Rules(bias, [])
    r = np.column_stack(columns).astype(np.float32)
    w, b, momentum, t = np.zeros(r.shape[1]), bias, np.zeros(r.shape[1] + 1), 1.0
    rate = 4.0 * len(y) / np.linalg.norm(np.column_stack([r, np.ones(len(r), np.float32)]), 2) ** 2
    for _ in range(STEPS):  # accelerated proximal gradient
        error = (sigmoid(r @ momentum[:-1].astype(np.float32) + momentum[-1]) - y).astype(np.float32) / len(y)
        moved = momentum[:-1] - rate * (r.T @ error)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * PENALTY, 0)
        new_b = momentum[-1] - rate * float(error.sum())
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = np.append(new + (t - 1) / faster * (new - w), new_b + (t - 1) / faster * (new_b - b))
        w, b, t = new, new_b, faster
    return Rules(float(b), [(float(v), rule) for v, rule in zip(w, rules) if abs(v) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Rules:
    sample = labelled_sample(docs, labels, label, rows, id_col, text_col)
    found = statistics(sample).toArrow().sort_by([(id_col, "ascending"), *((s, "ascending") for s in STATISTICS)])
    x = np.column_stack([found.column(s).to_numpy() for s in STATISTICS]) if len(found) else np.zeros((0, len(STATISTICS)))
    return fit(x, found.column("_label").to_numpy().astype(float))


def compile_rules(model: Rules) -> Column:
    """The score as a column expression over the statistics."""
    total = F.lit(model.bias)
    for weight, rule in model.rules:
        holds = None
        for name, above, threshold in rule:
            one = F.col(name) > F.lit(threshold) if above else F.col(name) <= F.lit(threshold)
            holds = one if holds is None else holds & one
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def classify(docs: DataFrame, model: Rules, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every row; a null text has the statistics of an empty one."""
    measured = statistics(docs.select(id_col, text_col, held_out(F.col(id_col)).alias("held_out")))
    return measured.withColumn("score", compile_rules(model)).select(id_col, "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))

"""A bounded sample of labelled documents, and sums that do not depend on the order of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.textio import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and label of about ``bound`` labelled rows outside the held-out fold, drawn by the hash of the id.

    The sample of labels is broadcast: it has ``bound`` rows however many there are. Rows without a label are left
    out; an id with several labels takes the least.
    """
    every = max(1, -(-labels.count() // bound))
    chosen = labels.where(F.col(label).isNotNull() & (fold(F.col(id_col)) != 2) & (F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(every)) == 0))
    chosen = chosen.groupBy(id_col).agg(F.min(label).cast("int").alias("_label"))
    return docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col).select(id_col, text_col, "_label")


def span_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of integer values over [start, end)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:], dtype=np.int64)
    return total[end] - total[start]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and shift that calibrate a margin, by Newton steps on the smoothed targets of Platt."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (w - np.array([1.0, 0.0])))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)

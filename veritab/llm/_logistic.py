"""Logistic regression on a bounded sample, in NumPy, and the sampling of labelled rows."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters that the texts of a sample have together at most, on the driver.
MOST_CHARS = 1 << 26


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float, rounds: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias for sparse entries (row, column, value), by gradient steps of adaptive size (Adam)."""
    w, b = np.zeros(width), 0.0
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        p = sigmoid(np.bincount(rows, values * w[cols], len(y)) + b)
        error = (p - y) / len(y)
        g = np.append(np.bincount(cols, values * error[rows], width) + penalty * w, error.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * margin + shift) a probability on these rows (Platt's targets)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, c = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(rounds):
        p = sigmoid(a * margin + c)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-8:
            break
    return (float(a), float(c)) if a > 0 else (1.0, 0.0)


def sampled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, fit_rows: int, id_column: str = "doc_id", text_column: str = "text", most_chars: int = MOST_CHARS) -> list[tuple[str, str, int]]:
    """About ``fit_rows`` labelled documents (id, text, label), at most twice as many, by a hash of the id, in a fixed order.

    Labels other than 0 and 1 are no labels; of several labels for one id the largest counts. Texts come whole. Where
    they have more than ``most_chars`` characters together, the documents of the largest hashes are left out.
    """
    unit = 1 << 20
    known = labels.filter(usable).select(F.col(id_column).alias("i"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("i").isNotNull())
    n = known.count()
    share = min(unit, unit * fit_rows // max(n, 1) + 1)
    order = F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(unit))
    chosen = known.filter(order < share).groupBy("i").agg(F.max("y").alias("y")).limit(2 * fit_rows)
    rows = docs.select(F.col(id_column).alias("i"), F.col(text_column).cast("string").alias("t")).join(F.broadcast(chosen), "i").select(order.alias("o"), "i", "t", "y")
    held, chars = [], 0
    for r in rows.toLocalIterator():
        heapq.heappush(held, (-r["o"], str(r["i"]), r["t"] or "", r["y"]))
        chars += len(r["t"] or "")
        while chars > most_chars and len(held) > 1:
            chars -= len(heapq.heappop(held)[2])
    return sorted(x[1:] for x in held)[: 2 * fit_rows]

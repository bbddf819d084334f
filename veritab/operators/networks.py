"""Layered scorers as data, with forward and reverse passes over Arrow batches, and their explanations.

A network is a short list of dense layers of any width with one output (sigmoid or linear) or several. Explanations are
columns: nulls in a row's values, target or reference give null, rows of another width and targets that the network
lacks are errors, and so is any output that is not a probability where one is asked for. The network itself is small
(``MOST_PARAMETERS``) and goes to tasks with their code.

Explanations use that the first layer is linear in the input. Along a straight path the first sums move linearly, so
integrated gradients average the gradient of those sums and multiply by the first weights once; and a replaced
coordinate moves them by one row of the weights. No path point or replacement is ever built at the input's width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PARAMETERS, BLOCK_CELLS = 1 << 22, 1 << 20
LAYER_SCHEMA = "layer int, activation string, weights array<array<double>>, bias array<double>"


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: Each activation with its reverse pass: (sums, outputs, gradient of the outputs) -> gradient of the sums.
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "linear": (lambda z: z, lambda z, y, g: g),
    "relu": (lambda z: np.maximum(z, 0.0), lambda z, y, g: g * (z > 0)),
    "tanh": (np.tanh, lambda z, y, g: g * (1.0 - y * y)),
    "sigmoid": (_sigmoid, lambda z, y, g: g * y * (1.0 - y)),
    "softmax": (_softmax, lambda z, y, g: y * (g - (g * y).sum(-1, keepdims=True))),
}


@dataclass(frozen=True)
class Layer:
    """weights: inputs x outputs."""

    weights: np.ndarray
    bias: np.ndarray
    activation: str = "linear"


class Network:
    def __init__(self, *layers: Layer):
        if not layers:
            raise ValueError("a network has one layer at least")
        self.layers = tuple(Layer(np.asarray(x.weights, float), np.asarray(x.bias, float), x.activation) for x in layers)
        for before, after in zip((None, *self.layers), self.layers, strict=False):
            if after.activation not in ACTIVATIONS:
                raise ValueError(f"unknown activation {after.activation}")
            if after.weights.ndim != 2 or after.bias.shape != after.weights.shape[1:] or (before is not None and before.weights.shape[1] != after.weights.shape[0]):
                raise ValueError("layers don't fit together")
        if sum(x.weights.size + x.bias.size for x in self.layers) > MOST_PARAMETERS:
            raise ValueError(f"more than {MOST_PARAMETERS} parameters")
        self.width, self.outputs = self.layers[0].weights.shape[0], self.layers[-1].weights.shape[1]

    # -- as a table ---------------------------------------------------------------------------------------------------

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a layer."""
        return spark.createDataFrame([(i, x.activation, x.weights.tolist(), x.bias.tolist()) for i, x in enumerate(self.layers)], LAYER_SCHEMA)

    @classmethod
    def of_table(cls, layers: DataFrame) -> Network:
        """The network of a table of layers; its size is checked before it comes to the driver."""
        size = layers.agg(F.sum(F.size("bias").cast("long") * (F.size("weights") + 1))).first()[0]
        if size is not None and size > MOST_PARAMETERS:
            raise ValueError(f"more than {MOST_PARAMETERS} parameters")
        return cls(*[Layer(np.array(r["weights"], float), np.array(r["bias"], float), r["activation"]) for r in sorted(layers.collect(), key=lambda r: r["layer"])])

    # -- passes over rows in NumPy; leading axes are free -------------------------------------------------------------

    def first_sums(self, x: np.ndarray) -> np.ndarray:
        return x @ self.layers[0].weights + self.layers[0].bias

    def _passed(self, sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        steps = []
        for i, layer in enumerate(self.layers):
            sums = sums if i == 0 else steps[-1][1] @ layer.weights + layer.bias
            steps.append((sums, ACTIVATIONS[layer.activation][0](sums)))
        return steps

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Outputs of rows."""
        return self._passed(self.first_sums(np.asarray(x, float)))[-1][1]

    def _chosen(self, out: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The target's output and its gradient: p t + (1 - p)(1 - t) of one output, else the output at t."""
        target = np.broadcast_to(target, out.shape[:-1])
        if out.shape[-1] == 1:
            sign = np.where(target == 1, 1.0, -1.0)
            return np.where(target == 1, out[..., 0], 1.0 - out[..., 0]), sign[..., None]
        return np.take_along_axis(out, target[..., None], -1)[..., 0], (np.arange(out.shape[-1]) == target[..., None]).astype(float)

    def target_of_sums(self, sums: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self._chosen(self._passed(sums)[-1][1], target)[0]

    def gradient_of_sums(self, sums: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Gradient of the target's output in the first sums."""
        steps = self._passed(sums)
        grad = self._chosen(steps[-1][1], target)[1]
        for i in range(len(steps) - 1, -1, -1):
            grad = ACTIVATIONS[self.layers[i].activation][1](*steps[i], grad)
            grad = grad @ self.layers[i].weights.T if i else grad
        return grad

    def gradient(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self.gradient_of_sums(self.first_sums(x), target) @ self.layers[0].weights.T

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of all classes: one output p as (1 - p, p), several divided by their sum; anything else is an error."""
        out = self(x)
        if out.shape[-1] == 1:
            if not ((out >= 0) & (out <= 1)).all():
                raise ValueError("outputs that are not probabilities")
            return np.concatenate([1.0 - out, out], -1)
        total = out.sum(-1, keepdims=True)
        if not np.isfinite(out).all() or (out < 0).any() or (total <= 0).any():
            raise ValueError("outputs that are not probabilities")
        return out / total

    # -- explanations of rows -----------------------------------------------------------------------------------------

    def path_gradients(self, x: np.ndarray, reference: np.ndarray, target: np.ndarray, points: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(x - r) times the weighted mean of the gradient over points between r and x."""
        z0, z1 = self.first_sums(reference), self.first_sums(x)
        mean = np.einsum("p,nph->nh", weights, self.gradient_of_sums(z0[:, None] + points[None, :, None] * (z1 - z0)[:, None], target[:, None]))
        return (x - reference) * (mean @ self.layers[0].weights.T)

    def replaced(self, x: np.ndarray, reference: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The target's output, less that with one coordinate replaced, for each coordinate."""
        z = self.first_sums(x)
        moved = z[:, None] + (reference - x)[:, :, None] * self.layers[0].weights
        return self.target_of_sums(z, target)[:, None] - self.target_of_sums(moved, target[:, None])

    @property
    def widest(self) -> int:
        return max(x.weights.shape[1] for x in self.layers)


def path_rule(steps: int, rule: str = "trapezoid") -> tuple[np.ndarray, np.ndarray]:
    """Points in [0, 1] and weights that sum to 1: steps + 1 of the trapezoid, or ``steps`` Gauss-Legendre nodes."""
    if steps <= 0:
        raise ValueError("steps must be positive")
    if rule == "gauss":
        at, weight = np.polynomial.legendre.leggauss(steps)
        return (at + 1) / 2, weight / 2
    if rule != "trapezoid":
        raise ValueError(f"unknown rule {rule}")
    weight = np.full(steps + 1, 1.0 / steps)
    weight[[0, -1]] /= 2
    return np.linspace(0.0, 1.0, steps + 1), weight


def stacked(values, width: int) -> np.ndarray:
    """Arrays of one width as rows."""
    rows = [np.asarray(v, float) for v in values]
    if any(r.shape != (width,) for r in rows):
        raise ValueError(f"rows that don't have {width} values")
    return np.stack(rows) if rows else np.zeros((0, width))


def targets(values: pd.Series, outputs: int) -> np.ndarray:
    t = values.to_numpy(dtype=np.int64)
    if ((t < 0) | (t >= max(outputs, 2))).any():
        raise ValueError("targets that the scorer doesn't have")
    return t


def in_blocks(n: int, cells_a_row: int) -> Iterator[slice]:
    """Slices of rows that hold BLOCK_CELLS cells at most (one row at least)."""
    size = max(1, BLOCK_CELLS // max(1, cells_a_row))
    return (slice(i, i + size) for i in range(0, n, size))


def known_rows(*columns: pd.Series) -> np.ndarray:
    """Places without a null in any column."""
    return np.flatnonzero(~np.logical_or.reduce([c.isna().to_numpy() for c in columns]))


def _explained(network: Network, f: Callable, cells: int, x: Column, target: Column, reference: Column | None) -> Column:
    """f(rows, targets, references) -> rows, over blocks of Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, ts: pd.Series, rs: pd.Series) -> pd.Series:
        out, at = [None] * len(xs), known_rows(xs, ts, rs)
        rows, refs, chosen = stacked(xs.iloc[at], network.width), stacked(rs.iloc[at], network.width), targets(ts.iloc[at], network.outputs)
        for s in in_blocks(len(at), cells):
            for i, v in zip(at[s], f(rows[s], chosen[s], refs[s]), strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    return run(x, target.cast("long"), x if reference is None else reference)


def probabilities(network: Network, x: Column) -> Column:
    """Probabilities of all classes."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        out, at = [None] * len(xs), known_rows(xs)
        rows = stacked(xs.iloc[at], network.width)
        for s in in_blocks(len(at), network.widest):
            for i, v in zip(at[s], network.probabilities(rows[s]), strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    return run(x)


def target_probability(network: Network, x: Column, target: Column) -> Column:
    """Probability of each row's class (X26); a class that the network lacks is an error."""
    p = probabilities(network, x)
    return F.when(target.isNotNull(), F.element_at(p, target.cast("int") + 1))


def gradient_times_input(network: Network, x: Column, target: Column) -> Column:
    """Gradient of the target's output times the input."""
    return _explained(network, lambda v, t, r: network.gradient(v, t) * v, network.widest, x, target, None)


def integrated_gradients(network: Network, x: Column, target: Column, reference: Column, steps: int = 64, rule: str = "trapezoid") -> Column:
    """Path integral of the gradient from the reference, times the difference.

    The trapezoid is the stated rule; ``gauss`` is complete to rounding with few points on smooth networks.
    """
    points, weights = path_rule(steps, rule)
    return _explained(network, lambda v, t, r: network.path_gradients(v, r, t, points, weights), network.widest * len(points), x, target, reference)


def occlusion(network: Network, x: Column, target: Column, reference: Column) -> Column:
    """The target's output less that with one coordinate replaced, for each coordinate."""
    return _explained(network, lambda v, t, r: network.replaced(v, r, t), network.widest * network.width, x, target, reference)

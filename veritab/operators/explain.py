"""A logit scorer, its explanations, perturbation curves and areas (X8-X26, W14, W15, U of curves).

The scorer is p = sigmoid(w . x + b) on an array column. For it, gradients are closed forms, so explanations stay
in the JVM; any other scorer plugs into ``scored`` as a pandas UDF of the same shape.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import accounts as A


@dataclass(frozen=True)
class Logit:
    weights: tuple[float, ...]
    bias: float = 0.0

    def margin(self, x: Column) -> Column:
        return A.dot(x, list(self.weights)) + self.bias

    def probability(self, x: Column) -> Column:
        return A.logistic(self.margin(x))

    def array(self) -> Column:
        return F.array(*[F.lit(float(w)) for w in self.weights])


def scored(frame: DataFrame, x: str, scorer, name: str = "p") -> DataFrame:
    """scorer: NumPy rows -> probabilities, run on Arrow batches."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(scorer(np.stack(s.to_numpy()))) if len(s) else pd.Series([], dtype=float)

    return frame.withColumn(name, run(F.col(x)))


def target_probability(p: Column, target: Column) -> Column:
    return F.when(target == 1, p).otherwise(1 - p)


def gradient_times_input(model: Logit, x: Column) -> Column:
    """p (1 - p) w x."""
    return A.let(model.probability(x), lambda p: F.zip_with(x, model.array(), lambda a, w: p * (F.lit(1.0) - p) * w * a))


def integrated_gradients(model: Logit, x: Column, reference: Column, steps: int = 64) -> Column:
    """Trapezoid path integral of the gradient, times the difference."""
    delta = F.zip_with(x, reference, lambda a, r: a - r)

    def of(s: Column) -> Column:
        slope = lambda t: A.let(A.logistic(s["m"] + (s["n"] - s["m"]) * t), lambda p: p * (F.lit(1.0) - p))
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda acc, i: acc + slope(i / F.lit(float(steps))))
        return A.let((inner + (slope(F.lit(0.0)) + slope(F.lit(1.0))) / 2) / steps, lambda g: F.zip_with(delta, model.array(), lambda d, w: d * w * g))

    return A.let(F.struct(model.margin(reference).alias("m"), model.margin(x).alias("n")), of)


def occlusion(model: Logit, x: Column, reference: Column) -> Column:
    """p(x) less p with one coordinate replaced, for each (X20): the margin moves by w (r - x)."""
    moved = F.transform(F.arrays_zip(x.alias("x"), reference.alias("r"), model.array().alias("w")), lambda s: s["w"] * (s["r"] - s["x"]))
    return A.let(model.margin(x), lambda m: F.transform(moved, lambda d: A.logistic(m) - A.logistic(m + d)))


def shapley_logit_margin(model: Logit, x: Column, reference: Column) -> Column:
    """Exact Shapley values of the additive margin: w (x - r)."""
    return F.transform(F.arrays_zip(x.alias("x"), reference.alias("r"), model.array().alias("w")), lambda s: s["w"] * (s["x"] - s["r"]))


def lime(frame: DataFrame, key: str, x: str, model: Logit, samples: int = 500, width: float = 0.75, ridge: float = 1.0, seed: int = 42) -> DataFrame:
    """Weighted ridge surrogate on normal perturbations of each row: key, weights, r2 (X21, X23). Seeded by row."""
    w, b = np.array(model.weights), model.bias

    def run(batches):
        for batch in batches:
            rows = []
            for k, v in zip(batch[key], batch[x], strict=True):
                v = np.asarray(v, float)
                rng = np.random.default_rng([seed, int(k)])
                z = rng.standard_normal((samples, len(v)))
                y = 1 / (1 + np.exp(-((v + z) @ w + b)))
                d = np.exp(-(z * z).sum(1) / (2 * (width**2) * len(v)))
                zc, yc = z - np.average(z, axis=0, weights=d), y - np.average(y, weights=d)
                coef = np.linalg.solve((zc * d[:, None]).T @ zc + ridge * np.eye(len(v)), (zc * d[:, None]).T @ yc)
                rest = yc - zc @ coef
                rows.append((k, coef.tolist(), float(1 - (d * rest**2).sum() / max((d * yc**2).sum(), 1e-300))))
            yield pd.DataFrame(rows, columns=[key, "weights", "r2"])

    return frame.select(key, x).mapInPandas(run, f"{key} long, weights array<double>, r2 double")


def kernel_shap(frame: DataFrame, key: str, x: str, model: Logit, reference: list[float], coalitions: int = 2_000, seed: int = 42) -> DataFrame:
    """KernelSHAP of the margin against one reference row, by constrained weighted least squares."""
    w, b, r = np.array(model.weights), model.bias, np.array(reference, float)
    d = len(r)
    sizes = np.arange(1, d)
    p = (d - 1) / (sizes * (d - sizes))
    p = p / p.sum()

    def run(batches):
        rng = np.random.default_rng(seed)
        chosen = rng.choice(sizes, size=coalitions, p=p)
        masks = np.zeros((coalitions, d))
        for i, s in enumerate(chosen):
            masks[i, rng.choice(d, s, replace=False)] = 1
        # the design is that of all rows, so one pseudo-inverse solves each of them
        m = masks[:, :-1] - masks[:, -1:]
        solve = np.linalg.pinv(m, rcond=max(m.shape) * np.finfo(float).eps)
        for batch in batches:
            rows = []
            for k, v in zip(batch[key], batch[x], strict=True):
                v = np.asarray(v, float)
                full, base = v @ w + b, r @ w + b
                y = masks @ ((v - r) * w) - masks[:, -1] * (full - base)
                coef = solve @ y
                rows.append((k, [*coef.tolist(), float(full - base - coef.sum())]))
            yield pd.DataFrame(rows, columns=[key, "values"])

    return frame.select(key, x).mapInPandas(run, f"{key} long, values array<double>")


def curves(frame: DataFrame, keys: list[str], x: str, reference: str, ranking: str, model: Logit, fractions: tuple[float, ...] = (0.05, 0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """Effect of deleting and of inserting the first features of a ranking, for each fraction.

    Fractions are rows, so one plan scores all of them: keys, fraction, deletion, insertion.
    """
    grid = frame.select(*keys, x, reference, ranking, F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction"))
    k = F.greatest(F.ceil(F.col("fraction") * F.size(x)), F.lit(1)).cast("int")
    cut = grid.withColumn("selected", F.slice(ranking, F.lit(1), k))
    p = cut.select(*keys, "fraction", model.probability(F.col(x)).alias("p0"), model.probability(F.col(reference)).alias("pr"), model.probability(A.replace_selected(F.col(x), F.col(reference), F.col("selected"))).alias("pd"), model.probability(A.insert_selected(F.col(x), F.col(reference), F.col("selected"))).alias("pi"))
    return p.select(*keys, "fraction", (F.col("p0") - F.col("pd")).alias("deletion"), (F.col("pi") - F.col("pr")).alias("insertion"))


def area(frame: DataFrame, fraction: str, values: list[str], *keys: str) -> DataFrame:
    """Trapezoid area from (0, 0), over the last fraction (W14, W15): a weighted sum, combined before the shuffle.

    Needs the fractions of a key complete; n_fractions tells how many there were.
    """
    line = Window.partitionBy(*keys).orderBy(fraction)
    before, after = F.coalesce(F.lag(fraction).over(line), F.lit(0.0)), F.coalesce(F.lead(fraction).over(line), F.col(fraction))
    weighted = frame.withColumn("_w", (after - before) / 2)
    return weighted.groupBy(*keys).agg(*[(F.sum(F.col("_w") * F.col(v)) / F.max(fraction)).alias(v) for v in values], F.count("*").alias("n_fractions"))


def area_with_error(frame: DataFrame, fraction: str, value: str, se: str, *keys: str) -> DataFrame:
    """Area, Monte-Carlo error through the same weights, and the lower 95 % bound."""
    line = Window.partitionBy(*keys).orderBy(fraction)
    before, after = F.coalesce(F.lag(fraction).over(line), F.lit(0.0)), F.coalesce(F.lead(fraction).over(line), F.col(fraction))
    w = frame.withColumn("_w", (after - before) / 2)
    out = w.groupBy(*keys).agg((F.sum(F.col("_w") * F.col(value)) / F.max(fraction)).alias("area"), (F.sqrt(F.sum(F.col("_w") * F.col("_w") * F.col(se) * F.col(se))) / F.max(fraction)).alias("area_se"))
    return out.withColumn("lower95", F.col("area") - 1.96 * F.col("area_se"))


#: Partial moments that reach the driver at most, whatever the number of partitions.
MOMENT_PARTS = 32


def merged_moments(parts) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and scatter of disjoint parts (n, mean, flat or square scatter), about their common mean."""
    n, mean, scatter = 0, 0.0, 0.0
    for m, part, own in parts:
        part = np.asarray(part, float)
        d = part - mean
        scatter = scatter + np.asarray(own, float).reshape(len(part), len(part)) + np.outer(d, d) * (n * m / (n + m))
        mean, n = mean + d * (m / (n + m)), n + m
    return n, mean, scatter


def moments(frame: DataFrame, x: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of an array column: one row of sums for each partition, merged about their means in
    MOMENT_PARTS groups, which the driver merges.
    """
    schema = "part int, n long, mean array<double>, scatter array<double>"

    def of(batch: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        rows = np.stack(batch[x].to_numpy()).astype(float)
        mean = rows.mean(0)
        return len(rows), mean, (rows - mean).T @ (rows - mean)

    def row(part: int, n: int, mean: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [n], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})

    def run(batches):
        n, mean, scatter = merged_moments(of(b) for b in batches if len(b))
        if n:  # a partition without rows has no row of sums: Arrow takes no empty column for arrays
            yield row(TaskContext.get().partitionId() % MOMENT_PARTS, n, mean, scatter)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return row(int(rows["part"].iloc[0]), *merged_moments(zip(rows["n"], rows["mean"], rows["scatter"], strict=True)))

    found = frame.select(x).dropna().mapInPandas(run, schema).groupBy("part").applyInPandas(merge, schema).collect()
    n, mean, scatter = merged_moments((r["n"], r["mean"], r["scatter"]) for r in sorted(found, key=lambda r: r["part"]))
    if not n:
        raise ValueError("no rows to take moments of")
    return mean, scatter / max(n - 1, 1)


def conditional_gaussian(frame: DataFrame, key: str, x: str, selected: str, mean: np.ndarray, covariance: np.ndarray, ridge: float = 1e-6, draw: bool = False, seed: int = 42) -> DataFrame:
    """E[x_S | x_rest] for each row's selected coordinates, in ascending coordinate order, or a draw around it.

    mean and covariance have the width of a row. A solve is shared by the rows of a batch with equal selections. Draws
    are seeded by row, so they don't depend on partitions.
    """
    sigma = covariance + ridge * np.eye(len(mean))

    def run(batches):
        for batch in batches:
            out = [None] * len(batch)
            rows, names = np.stack(batch[x].to_numpy()).astype(float) if len(batch) else np.zeros((0, len(mean))), batch[key].to_numpy()
            places: dict[tuple, list[int]] = {}
            for i, s in enumerate(batch[selected]):
                places.setdefault(tuple(sorted(int(c) for c in s)), []).append(i)
            for s, at in places.items():
                cols, rest = np.array(s, int), np.setdiff1d(np.arange(len(mean)), s)
                gain = np.linalg.solve(sigma[np.ix_(rest, rest)], sigma[np.ix_(rest, cols)]) if len(rest) else np.zeros((0, len(cols)))
                made = mean[cols] + (rows[np.ix_(at, rest)] - mean[rest]) @ gain
                if draw:
                    spread = sigma[np.ix_(cols, cols)] - sigma[np.ix_(cols, rest)] @ gain
                    value, vector = np.linalg.eigh((spread + spread.T) / 2)
                    root = vector * np.sqrt(np.maximum(value, 0))
                    made = made + np.stack([root @ np.random.default_rng([seed, int(names[i])]).standard_normal(len(cols)) for i in at])
                for i, v in zip(at, made, strict=True):
                    out[i] = v.tolist()
            yield pd.DataFrame({key: names, "values": out})

    return frame.select(key, x, selected).mapInPandas(run, f"{key} long, values array<double>")


def with_values(x: Column, selected: Column, values: Column) -> Column:
    """x with its selected coordinates replaced by values that come in ascending coordinate order."""
    return A.let(F.array_sort(selected), lambda s: F.transform(x, lambda v, i: F.when(F.array_contains(s, i), F.get(values, F.array_position(s, i).cast("int") - 1)).otherwise(v)))
